"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Statistics come from bytes and words alone; labels, language, source and identifiers never enter.
The trees are grown on the driver from at most ``max_rows`` labelled rows (those with the smallest
MD5 of their identifier, so the sample is the same at every size), on features cut into at most 255
bins, and flattened into arrays; tasks score a batch by stepping all its rows down each tree at once.

Python in Arrow batches: word statistics and tree traversal in numpy.  Scoring has no shuffle; the
labelled rows are joined once, by identifier alone, before their texts are read.

Defined results: a null text counts as empty and is scored like any text.  Labels that are null
teach nothing; of rows that repeat an identifier the least text teaches; an identifier with contradicting labels counts as 0.  Without labelled rows every
score is 1 (nothing is known against a text).  Repeated rows get equal scores; an empty table gives
none.  Extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

FEATURES = (
    "log_chars", "log_words", "word_length", "word_spread", "longest_word", "distinct", "top_word", "repeats", "upper", "digits", "marks", "odd_marks",
    "bars", "shouts", "lines", "line_length", "repeated_lines", "stops", "other_bytes", "entropy", "marks_in_words", "title_words", "short_words",
)
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 7 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in "#$%&*<>{}[]=\\^~_@+" else 5 if _c in ".,;:?'\"-()" else 6 if _c.isspace() else 8 if _c == "|" else 9 if _c == "!" else 0


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=byte, minlength=10)
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = text.split("\n")
    share = byte[byte > 0] / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float(lengths.max()), len(counts) / w, max(counts.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w, kind[2] / n, kind[3] / n, (kind[4] + kind[5] + kind[8] + kind[9]) / n, kind[4] / n, kind[8] / n, kind[9] / n, len(lines) / w, n / len(lines),
        1 - len(set(lines)) / len(lines), byte[46] / w, kind[7] / n, float(-(share * np.log2(share)).sum()), (kind[4] + kind[8] + kind[9]) / w,
        sum(map(str.istitle, words)) / w, float((lengths <= 2).sum()) / w,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """Nodes of all trees in one set of arrays; ``roots`` are where trees begin.  A leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 255, least: int = 10, ridge: float = 1.0) -> Forest:
    """Logistic boosting; splits maximise the gain of the summed gradients' histograms."""
    n, d = x.shape
    if n == 0:
        leaf = np.zeros(1, np.int64)
        return Forest(leaf[:0], leaf, np.zeros(1), leaf, leaf, np.zeros(1), 30.0, 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(d)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(d)], 1)  # bin b: value <= edges[b]
    offset = np.arange(d) * (bins + 1)
    flat = binned + offset
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    total = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        feature.append(0), threshold.append(0.0), left.append(i), right.append(i), value.append(0.0)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), 0)]
        while todo:
            i, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                at = flat[rows].ravel()
                size = d * (bins + 1)
                hg, hh, hn = (np.bincount(at, np.repeat(v, d), size).reshape(d, -1).cumsum(1) for v in (grad[rows], hess[rows], np.ones(len(rows))))
                ok = (hn >= least) & (len(rows) - hn >= least)
                gain = np.where(ok, hg**2 / (hh + ridge) + (g - hg) ** 2 / (h - hh + ridge) - g**2 / (h + ridge), -1.0)
                f, b = divmod(int(gain.argmax()), bins + 1)
                if gain[f, b] > 1e-6 and b < len(edges[f]):
                    best = (f, b)
            if best is None:
                value[i] = float(rate * g / (h + ridge))
                total[rows] += value[i]
                continue
            f, b = best
            feature[i], threshold[i] = f, float(edges[f][b])
            left[i], right[i] = node(), node()
            low = binned[rows, f] <= b
            todo += [(left[i], rows[low], level + 1), (right[i], rows[~low], level + 1)]
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), start, depth)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Learn from labelled rows that are not held out, ``max_rows`` of them at most."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.min("quality").alias("quality"))
    # a limit over the ordered key: each task sends its smallest rows only
    chosen = known.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(max_rows).select(F.col(id_col).alias("labelled"), "quality")
    chosen = materialise(chosen, "labelled")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled"))  # max_rows rows of two numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["text"])
            yield pd.DataFrame({"id": batch["id"].astype(str), "quality": batch["quality"], "x": list(x)})

    one = joined.groupBy("id", "quality").agg(F.min("text").alias("text"))  # rows that repeat an identifier teach once
    rows = one.select("id", "text", "quality").mapInPandas(run, "id string, quality int, x array<double>").toPandas().sort_values("id")  # max_rows vectors
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, (rows["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": model.score(matrix(batch["text"]))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: Forest, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with all their columns."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return docs.where(scored(F.col(text_col)) >= least)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, held_out, score, predicted (see the module's text)."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
