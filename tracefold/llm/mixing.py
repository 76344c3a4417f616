"""Mixing sources to target weights by iterative proportional fitting.  DataFrame functions only.

Documents are counted in tokens (runs of non-space) per cell of (source, lang, topic).  The cells'
weights start at their tokens and are scaled to each marginal in turn until all three agree with
the targets.  A cell's weight over its tokens is the relative rate of its documents; rates are
scaled to the wanted share of the corpus, none above 1, and a document stays when the uniform number
of its identifier's hash is below its cell's probability.

Targets: ``shares`` names shares of a marginal's values (renormalised over those present).  Values
not named have what the named ones leave of 1, by tokens to the power ``alpha``; where these leave
nothing, the part that power gives them among all values, and the named ones share the rest.  Without
``shares`` every value goes by that power, which flattens a source that holds a third of all rows.

Scale: one pass over the text to (id, cell, tokens); all else runs on cells, after a map-side sum.
Cells stay a DataFrame, in the shared folder between rounds; the driver sees one row of sums a step
(totals, a deviation).  Only the sums of raking are windows, each over the cells of one marginal value.
The last join is on the cell; a hot cell is a hot key on the document side alone, which the adaptive
skew join splits (or the cells are broadcast when their measured size allows).

Defined results: null source, lang or topic is the value ''.  A null or empty text has no tokens and
the probability of its cell (1 in a cell without tokens).  Rows that repeat an identifier share its
decision.  Marginals that contradict each other (no cell joins two wanted values) leave the fit of
the last round.  An empty table gives no rows.  Extra columns are ignored by ``weigh``, kept by
``mix``; ``topic`` is a column expression, by default the form of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, table

MARGINALS = ("source", "lang", "topic")
#: Wanted shares of languages in the registered query and the pipeline.
LANG_SHARES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """The topic used when the table has none: the text's form."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1))
    digits = size - F.char_length(F.translate(text, "0123456789", ""))
    lines = size - F.char_length(F.translate(text, "\n", ""))
    return F.when(digits * 10 > size, "figures").when(lines * 60 > size, "lines").when(size < 600, "short prose").when(size < 4000, "prose").otherwise("long prose")


def _targets(cells: DataFrame, name: str, shares: dict[str, float] | None, alpha: float) -> DataFrame:
    shares, share = shares or {}, F.lit(None).cast("double")
    for k, v in shares.items():
        share = F.when(F.col(name) == k, F.lit(float(v))).otherwise(share)
    flat = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    sums = cells.where("tokens > 0").groupBy(name).agg(F.sum("tokens").alias("tokens")).select(name, share.alias("share"), flat.alias("flat"))
    named, other, every = (x or 0.0 for x in sums.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("flat"))), F.sum("flat")).first())
    left = 1.0 - sum(shares.values())
    rest = left if left > 1e-9 else other / every if every else 0.0
    whole = (rest if other else 0.0) + ((1.0 - rest) if named else 0.0)
    of_other, of_named = (part / (whole * held) if whole and held else 0.0 for part, held in ((rest, other), (1.0 - rest, named)))
    return sums.select(name, F.when(F.col("share").isNull(), F.col("flat") * of_other).otherwise(F.col("share") * of_named).alias(f"{name}_target"))


def rake(cells: DataFrame, shares: dict[str, dict[str, float]], alphas: dict[str, float], rounds: int = 24, per_round: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """cells: source, lang, topic, tokens.  Adds ``weight``; weights sum to 1."""
    grid = cells
    for m in MARGINALS:
        grid = grid.join(_targets(cells, m, shares.get(m), alphas.get(m, 1.0)), m, "left")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    grid = grid.fillna(0.0, [f"{m}_target" for m in MARGINALS]).withColumn("weight", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total)).otherwise(0.0))
    grid = stored = materialise(grid, "cells")
    for _ in range(-(-rounds // per_round)):
        for _ in range(per_round):
            for m in MARGINALS:
                held = F.sum("weight").over(Window.partitionBy(m))
                grid = grid.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"{m}_target") / held).otherwise(0.0))
        old, grid = stored, materialise(grid, "cells")
        stored = grid
        forget(old)
        off = grid.select(*(F.abs(F.sum("weight").over(Window.partitionBy(m)) - F.col(f"{m}_target")).alias(m) for m in MARGINALS)).agg(F.max(F.greatest(*MARGINALS))).first()[0]
        if off is None or off < tolerance:
            break
    return grid.select(*MARGINALS, "docs", "tokens", "weight")


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """Adds ``probability`` = min(1, c * weight / tokens), with c so that ``share`` of all tokens is expected.

    Where the cells with weight do not hold that many tokens, all their documents have probability 1.
    c rises by steps, one sum over the cells each: cells that are full at the last c give their tokens, the
    others share what is left.  No cell leaves the full ones, so the steps end, as a rule after a few.
    """
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    budget = float(share) * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    c, n_full = 0.0, -1
    while True:
        full = rate * F.lit(c) > 1
        filled, open_weight, n = cells.where(rate > 0).agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not open_weight:
            c = None
            break
        c = max(c, (budget - (filled or 0)) / open_weight)
        if n == n_full:
            break
        n_full = n
    chance = F.least(F.lit(1.0), rate * F.lit(c)) if c is not None else F.lit(1.0)
    return cells.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).when(rate == 0, 0.0).otherwise(chance))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the identifier: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(str(seed)))), 1, 13), 16, 10)
    return bits.cast("double") / float(1 << 52)


def weigh(
    docs: DataFrame,
    shares: dict[str, dict[str, float]] | None = None,
    alphas: dict[str, float] | None = None,
    keep_share: float = 0.7,
    seed: int = 17,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, source, lang, topic, n_tokens, weight (of a token), probability, sampled."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = form_topic(F.col(text_col)) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    rows = materialise(docs.select(F.col(id_col).alias("id"), blank("source").alias("source"), blank("lang").alias("lang"), kind.alias("topic"), n_tokens(F.col(text_col)).alias("n_tokens")), "tokens")
    cells = materialise(rows.groupBy(*MARGINALS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), "cells")
    fitted = rake(cells, shares or {}, alphas or {})
    rated = calibrate(fitted, keep_share).select(*MARGINALS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("weight"), "probability")
    rated = materialise(rated, "rates")
    forget(cells)
    return rows.join(rated, list(MARGINALS)).withColumn("sampled", uniform(F.col("id"), seed) < F.col("probability")).select("id", *MARGINALS, "n_tokens", "weight", "probability", "sampled")


def production(docs: DataFrame) -> DataFrame:
    return weigh(docs, shares={"lang": LANG_SHARES}, alphas={"source": 0.5, "topic": 0.8}, keep_share=0.7)


def mix(docs: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    found = production(docs)
    rates = materialise(found.select(*(F.col(m).alias(f"_{m}") for m in MARGINALS), F.col("probability").alias("_probability")).distinct(), "rates")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), blank("source").alias("a"), blank("lang").alias("b"), form_topic(F.col("text")).alias("c"), F.col("doc_id").alias("id"))
    joined = packed.join(rates, (F.col("a") == F.col("_source")) & (F.col("b") == F.col("_lang")) & (F.col("c") == F.col("_topic")))
    return joined.where(uniform(F.col("id"), 17) < F.col("_probability")).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, source, lang, topic, n_tokens, weight, probability, sampled (see the module's text)."""
    return production(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
