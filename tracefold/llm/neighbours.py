"""Approximate nearest neighbours with learned partitions.

On a bounded sample a neighbour graph is cut into equally large parts (recursive spectral bisection of the
graph, then swaps that keep the sizes and reduce cut edges).  A small network learns, for
a point, in which parts its neighbours lie.  Every vector is put into its most probable part; a query
goes to its most probable parts, as many as give ``target`` recall inside the sample and at least
``20 * k`` vectors, and all vectors there are ranked by exact Euclidean distance in double precision.
With ``probes`` equal to the number of parts the search is exact.

The number of parts grows with the square root of the rows, up to one for each 64 vectors of the sample.  How many
are probed follows from the data: few where vectors lie in clusters, nearly all where they are spread evenly over a
sphere, as in the test tables; ``Index`` tells it.

Python in Arrow batches and groups: matrix products.  Every row is indexed.  Of identical vectors only
the k + 1 smallest identifiers can be among anyone's k nearest, so a vector that a third of the rows
share folds to k + 1 rows before the shuffle, map-side; only rows whose vector's 64-bit hash may repeat, by a bit map of
bounded size, are shuffled for that.  Parts are cut into blocks of at most
``block`` vectors and the queries of a part into blocks as well; a task holds one block of each.
A group gives k rows per query, so pairs are never rows.  The driver holds the sample (``sample``
vectors) and a count per part.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
neither do those of another length than most; equal distances go to the smaller identifier; with
fewer than k candidates all are returned; rows that repeat an identifier and vector count once,
an identifier with several vectors by the nearest; null
identifiers take no part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .exact_dedup import bit_filter, may_hold


def knn(x: np.ndarray, k: int) -> np.ndarray:
    norms = (x**2).sum(1)
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        d = norms[i : i + 512, None] + norms[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        part = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[i : i + len(d)] = part
    return out


def fiedler(x: np.ndarray, i: np.ndarray, j: np.ndarray, steps: int = 40) -> np.ndarray:
    """The second eigenvector of the graph's normalised adjacency, by power iteration from the principal direction."""
    n = len(x)
    degree = np.maximum(np.bincount(i, minlength=n) + np.bincount(j, minlength=n), 1e-9)
    top = np.sqrt(degree / degree.sum())
    centred = x - x.mean(0)
    v = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    for _ in range(steps):
        v = v - top * (top @ v)
        size = np.sqrt(v @ v)
        if not size:
            break
        w = v / size / np.sqrt(degree)
        v = v / size + (np.bincount(i, w[j], n) + np.bincount(j, w[i], n)) / np.sqrt(degree)
    return v / np.sqrt(degree)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """A part for each point, sizes at most one apart within a split; swaps reduce cut edges."""
    label = np.zeros(len(x), np.int64)
    place = np.full(len(x), -1)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(rows) < 2:
            label[rows] = first
            return
        place[rows] = np.arange(len(rows))
        j = place[near[rows]]
        i, c = np.nonzero(j >= 0)
        order = rows[np.argsort(fiedler(x[rows], i, j[i, c]), kind="stable")]
        place[rows] = -1
        cut = len(rows) * (n // 2) // n
        split(order[:cut], first, n // 2)
        split(order[cut:], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    if near.shape[1] == 0:
        return label
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts))
        for c in range(near.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[near[:, c]]), 1)
            np.add.at(votes, (near[:, c], label), 1)
        gain = votes - votes[np.arange(len(x)), label][:, None]
        moved = 0
        want = gain.argmax(1)
        for a in range(parts):
            for b in range(a + 1, parts):
                there = np.flatnonzero((label == a) & (want == b) & (gain[:, b] > 0))
                back = np.flatnonzero((label == b) & (want >= 0) & (gain[:, a] > -1))
                there, back = there[np.argsort(-gain[there, b])], back[np.argsort(-gain[back, a])]
                n = min(len(there), len(back))
                n = int((gain[there[:n], b] + gain[back[:n], a] > 1).sum())
                label[there[:n]], label[back[:n]] = b, a
                want[back[:n]] = -1
                want[there[:n]] = -1
                moved += n
        if moved < len(x) // 200:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer: probabilities of parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def learn(x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 60, rate: float = 3e-3) -> Router:
    """Cross-entropy with the shares of neighbours as targets, by Adam."""
    rng = np.random.default_rng(5)
    d, parts = x.shape[1], target.shape[1]
    scale = float(x.std()) or 1.0
    r = Router(x.mean(0), scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts))
    z = (x - r.mean) / scale
    weights = [r.w1, r.b1, r.w2, r.b2]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            a, t = z[order[i : i + 256]], target[order[i : i + 256]]
            h = np.maximum(a @ r.w1 + r.b1, 0)
            o = h @ r.w2 + r.b2
            p = np.exp(o - o.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - t) / len(a)
            back = (g @ r.w2.T) * (h > 0)
            step += 1
            for w, grad, mm, vv in zip(weights, (a.T @ back, back.sum(0), h.T @ g, g.sum(0)), m, v):
                mm += 0.1 * (grad - mm)
                vv += 0.001 * (grad**2 - vv)
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return r


@dataclass
class Index:
    """What was learned: the router, the number of parts and of parts to probe, and the recall that gives in the sample."""

    router: Router
    parts: int
    probes: int
    sample_recall: float


def fit(x: np.ndarray, parts: int, k: int, target: float) -> Index:
    """The router, and as many probes as give ``target`` recall within the sample."""
    near = knn(x, k)
    label = balanced_parts(x, near, parts)
    share = np.full((len(x), parts), 1e-3)
    share[np.arange(len(x)), label] += 1.0
    for c in range(near.shape[1]):
        np.add.at(share, (np.arange(len(x)), label[near[:, c]]), 1.0)
    router = learn(x, share / share.sum(1, keepdims=True))
    order = router.order(x)
    rank = np.argsort(order, axis=1)
    if near.shape[1] == 0:
        return Index(router, parts, parts, 1.0)
    at = np.take_along_axis(rank, order[:, 0][near], axis=1)  # where a neighbour's part comes in a point's order
    recall = [float((at < p).mean()) for p in range(1, parts + 1)]
    probes = 1 + next(i for i, r in enumerate(recall) if r >= target or i == parts - 1)
    return Index(router, parts, probes, recall[probes - 1])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine).withColumn("d", F.size("v"))
    most = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.col("d") == (most.d if most else 0)).select("id", "v")


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of each query's k nearest other candidates, ties to the smaller id."""
    out = []
    c_norms = (c**2).sum(1)
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        norms = (part**2).sum(1)
        rough = norms[:, None] + c_norms[None, :] - 2 * part @ c.T
        rough[q_ids[i : i + 256, None] == c_ids[None, :]] = np.inf
        if len(c) > k:
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (norms + c_norms.max())
        else:
            bound = np.full(len(part), np.finfo(float).max)
        for j in range(len(part)):
            at = np.flatnonzero(rough[j] <= bound[j])
            exact = np.sqrt(((c[at] - part[j]) ** 2).sum(1))
            best = np.lexsort((c_ids[at], exact))[:k]
            out += [(int(q_ids[i + j]), int(c_ids[at[b]]), float(exact[b])) for b in best]
    return out


def folded(rows: DataFrame, most: int, bits: int = 1 << 22) -> DataFrame:
    """Of rows (id, v) with identical vectors the ``most`` smallest identifiers, each once; adds ``seen``, from 1."""
    rows = rows.withColumn("digest", F.xxhash64("v"))
    again = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    probed = may_hold(rows, bit_filter(again, bits), bits)
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    shared = probed.where("maybe").select("id", "v").distinct().withColumn("seen", order).where(F.col("seen") <= most)
    return probed.where("not maybe").select("id", "v", F.lit(1).alias("seen")).unionByName(shared)


def build(rows: DataFrame, k: int, parts: int | None, sample: int, target: float) -> Index | None:
    """Learn from the ``sample`` vectors with the smallest MD5 of their identifiers; None without vectors."""
    chosen = rows.where("seen = 1").orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample).select("v").toPandas()
    if not len(chosen):
        return None
    if parts is None:
        parts = int(np.clip(np.ceil(np.sqrt(rows.count()) / 10), 4, max(4, sample // 64)))
    return fit(np.array(chosen["v"].tolist(), np.float64), parts, k, target)


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    parts: int | None = None,
    sample: int = 8192,
    target: float = 0.985,
    probes: int | None = None,
    block: int = 20_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    index: Index | None = None,
) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id, score.  Queries: rows whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vec_col)
    few = folded(rows, k + 1)
    index = index or build(few, k, parts, sample, target)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, parts, probes = index.router, index.parts, min(probes or index.probes, index.parts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "part": router.order(np.array(b["v"].tolist()))[:, 0].astype("int32")})

    placed = materialise(few.select("id", "v").mapInPandas(place, "id long, v array<double>, part int"), "placed")
    held = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per part
    counts = np.array([held.get(p, 0) for p in range(parts)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                order = router.order(np.array(b["v"].tolist()))
                before = np.cumsum(counts[order], axis=1) - counts[order]
                go = (np.arange(parts)[None, :] < probes) | (before < 20 * k)
                i, j = np.nonzero(go)
                yield pd.DataFrame({"id": b["id"].to_numpy()[i], "v": [b["v"].iloc[t] for t in i], "part": order[i, j].astype("int32")})

    wanted = rows.where(F.col("id") % every == 0).distinct()
    routed = materialise(wanted.mapInPandas(route, "id long, v array<double>, part int"), "routed")
    asked = {r.part: r.n for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    # blocks of vectors and of queries; each block of the one meets each of the other
    cuts = vectors.sparkSession.createDataFrame([(p, -(-int(held.get(p, 0)) // block) or 1, -(-asked.get(p, 0) // 4096) or 1) for p in range(parts)], "part int, v_blocks int, q_blocks int")
    dealt = lambda f, mine, other, own, far: f.join(F.broadcast(cuts), "part").withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")).withColumn(far, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = dealt(placed, "v_blocks", "q_blocks", "vb", "qb").select("part", "vb", "qb", "id", "v")
    right = dealt(routed, "q_blocks", "v_blocks", "qb", "vb").select("part", "vb", "qb", "id", "v")

    def rank(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = nearest(q["id"].to_numpy(), np.array(q["v"].tolist()), c["id"].to_numpy(), np.array(c["v"].tolist()), k) if len(c) and len(q) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["part", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double").where("score < double('Infinity')")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an identifier with several vectors counts by its nearest
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``embeddings``, ten nearest: query_id, rank, vec_id, score (see the module's text)."""
    return search(table(spark, sf_dir, "embeddings"))
