"""Language identification in two steps: the family first, then one-versus-one linear machines within it.

Whole texts become hashed counts of their letters' n-grams (1 to 3 code points of the lower-cased text, with
words set apart), as roots scaled to unit length.  Linear support vector machines with squared hinge loss,
fitted by dual coordinate descent, decide each pair of families, then each pair of languages of the
family that won; wins are counted, ties go to the larger sum of margins, then to the first name.
Label, source and identifier never enter.

Machines learn on the driver from at most ``max_rows`` labelled rows that are not held out, an equal share
for each of the at most ``max_langs`` most frequent languages (chosen by MD5 of the identifier, so the
sample is the same at every size).  Families are those of ``FAMILIES``; a language that is not in it is a
family of its own.  Prediction has no shuffle and holds one block of texts at a time.

Defined results: a null text or one without a letter is ``und`` with score 0 and teaches nothing, as do rows
with a null language; without labelled rows every text is ``und``.  With one language learned all texts with
letters get it, with score 1.  Repeated rows get equal results; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it oc pt ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
    "bantu": "rw sn sw xh zu",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
DIMS = 2048
BLOCK = 1 << 20
_BETWEEN = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray | None:
    """The vector of a text; None if it has no letter."""
    if not text:
        return None
    kept = _BETWEEN.sub(" ", text.lower())
    if not any(map(str.isalpha, kept)):
        return None
    points = np.frombuffer(f" {kept} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(DIMS, np.int64)
    shift = np.uint32(32 - (DIMS.bit_length() - 1))
    for start in range(0, len(points), BLOCK):
        part = points[start : start + BLOCK + 2]
        h = np.zeros(len(part), np.uint32)
        for n in range(3):
            h = (h[: len(part) - n] + part[n:]) * np.uint32(2654435761) + np.uint32(n)
            own = h[: max(0, BLOCK)]  # the overlap belongs to the next block
            counts += np.bincount((own >> shift).astype(np.int64), minlength=DIMS)
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def matrix(texts) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of those texts that have letters, and which those are."""
    found = [grams(t) for t in texts]
    has = np.array([v is not None for v in found], bool)
    return np.array([v for v in found if v is not None], np.float32).reshape(-1, DIMS), has


def machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, epochs: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights and bias of a support vector machine; ``y`` is 1 or -1, both classes weigh the same."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    c = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = (x * x).sum(1) + 1 / (2 * c)
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] / (2 * c[i])
            if alpha[i] > 0 or g < 0:
                new = max(alpha[i] - g / diagonal[i], 0.0)
                worst = max(worst, abs(new - alpha[i]) * diagonal[i])
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst < tolerance:
            break
    return w


@dataclass
class Duels:
    """A machine for each pair of names; above 0 the first of the pair wins."""

    names: list[str]
    weights: dict[tuple[int, int], np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duels:
        names = sorted(set(labels))
        pairs = {}
        for a, b in combinations(range(len(names)), 2):
            rows = (labels == names[a]) | (labels == names[b])
            pairs[a, b] = machine(x[rows], np.where(labels[rows] == names[a], 1.0, -1.0))
        return cls(names, pairs)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and how sure its closest duel is (0 to 1)."""
        k = len(self.names)
        wins, sums, least = np.zeros((len(x), k)), np.zeros((len(x), k)), np.full((len(x), k), np.inf)
        for (a, b), w in self.weights.items():
            m = x @ w[:-1] + w[-1]
            for i, margin in ((a, m), (b, -m)):
                wins[:, i] += margin > 0
                sums[:, i] += margin
                least[:, i] = np.minimum(least[:, i], margin)
        best = np.lexsort((-np.arange(k) * np.ones((len(x), 1)), sums, wins), axis=1)[:, -1] if len(x) else np.zeros(0, np.int64)
        margin = np.clip(least[np.arange(len(x)), best], -10, 10)
        return best, 1 / (1 + np.exp(-4 * margin)) if k > 1 else np.ones(len(x))


@dataclass
class Hierarchy:
    families: Duels
    within: dict[str, Duels]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> Hierarchy:
        family = np.array([FAMILY_OF.get(v, v) for v in langs], object)
        return cls(Duels.fit(x, family), {f: Duels.fit(x[family == f], langs[family == f]) for f in sorted(set(family))})

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, score = self.families.decide(x)
        names = np.empty(len(x), object)
        for i, f in enumerate(self.families.names):
            rows = np.flatnonzero(best == i)
            found, sure = self.within[f].decide(x[rows])
            names[rows] = [self.within[f].names[j] for j in found]
            score[rows] *= sure
        return names, score


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, max_rows: int = 6000, max_langs: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """Learn from rows that are not held out; None if none has a language and a letter."""
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return None
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, max_rows / len(counts) / r.n)) for r in counts], "lang string, rate double")
    key = F.md5(F.coalesce("id", F.lit("")))
    drawn = known.join(F.broadcast(rates), "lang").where(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") < F.col("rate") * 2**32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, has = matrix(batch["text"])
            yield pd.DataFrame({"key": batch["key"][has], "lang": batch["lang"][has], "x": [v.astype(np.float16).tobytes() for v in x]})

    vectors = drawn.select(key.alias("key"), "lang", "text").mapInPandas(run, "key string, lang string, x binary")
    rows = vectors.orderBy("key", "lang", "x").limit(max_rows).toPandas()  # max_rows vectors of 4 kB
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(-1, DIMS).astype(np.float32)
    return Hierarchy.fit(x, rows["lang"].to_numpy(object))


def predict(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.iloc[start : start + 500]
                names, score = np.full(len(batch), "und", object), np.zeros(len(batch))
                if model is not None:
                    x, has = matrix(batch["text"])
                    names[has], score[has] = model.predict(x)
                yield pd.DataFrame({"id": batch["id"], "lang_pred": names, "score": score})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, held_out, lang_pred, score (see the module's text)."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
