"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find.

1. A task turns texts into shingle sets (64-bit hashes) and SuperMinHash signatures: element by
   element a random rank and a partial permutation, level by level, stopping once no slot of the
   document can still fall.  It writes the set's size and fingerprint, band keys and an 8-bit
   sketch of the signature.
2. Equal sets (same size and 128-bit fingerprint) fold into one representative, their smallest identifier.
   Different sets share size and fingerprint with a probability below 2**-90 for 10**9 documents.
3. Representatives that share a band key form a bucket; buckets with the same members are one.
   Inside a bucket sketches are compared, and those that agree in more than ``similarity``
   less 0.2 are united; a bucket gives at most one edge per member, never its pairs.  In a bucket of more than ``BUCKET``
   members all are united unseen: that only adds candidates.
4. Connected components of these edges hold all true links.  Each component's texts are read again
   and its sets are compared by exact intersection counts (a document-by-shingle product); confirmed links are
   united in the task and leave as one edge per member.  A component above a block's bounds is cut into blocks, and its
   smallest member stands in each of them, so copies of one text are one group after this step.
5. What is still apart in such a component is compared across blocks: sets of different groups, in all pairs of
   blocks that are not of one group.
6. Connected components of the confirmed links are the result.

Misses: with r rows in each of b bands a pair of similarity s shares no band with probability
(1 - s**r)**b; r and b are chosen so that this is below 1e-6 at the threshold, and the sketch's margin
of 0.2 is over six standard errors.

Scale: nothing is collected; components are found by alternating large-star and small-star steps
over written edge tables, two exchanges and one broadcast of at most 1000 keys a round.  A text that a third of
all rows share is one representative after a map-side combine.  Nodes with over a thousandth of the edges are
dealt over parts; band keys, components and sets that many rows share are joined to one short row each, by a
broadcast where Spark measures that row's side as small, else by a join whose large partitions the adaptive
skew join splits.  Large components are cut into blocks, each block or block pair a group of its
own, so no task holds an unbounded group.  Only texts of candidate components are shuffled, found by
a bit map of bounded size: once, and for those of large components that hold several groups once more for each block
of another group.  So many copies of one text cost what they weigh; many small groups chained in one candidate
component cost the number of its block pairs.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing
and is its own component.  A text with fewer words than a shingle is one shingle.  A row whose identifier is
null is known by its text; it is linked like any other, its component is null where no row of it has an identifier,
and rows of equal text and null identifier share the decision.  Identifiers are below 2**62.  Rows that repeat an
identifier are judged each by its own text; sets with the same representative identifier are one node.  An empty
table gives no rows; extra columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh_path, materialise, owned, remove, shuffle_partitions, small_batches, table
from .exact_dedup import bit_filter, may_hold

M = 128  # signature length
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 19  # bytes of text that are hashed at once
BLOCK = 2048  # members of a block
BUCKET = 512  # members of a bucket whose sketches are compared
ELEMENTS = 1_000_000  # set elements of a block
NAMELESS = 1 << 62  # nodes from here on stand for rows without an identifier
HUB = 256  # edges below which no node is a hub


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bands_for(similarity: float, m: int = M) -> tuple[int, int]:
    """Most rows per band with a miss below 1e-6 at the threshold: (rows, bands)."""
    return max(((r, m // r) for r in range(1, m + 1) if (1 - similarity**r) ** (m // r) < 1e-6), default=(1, m))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin (one more than texts)."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined.lower(), np.uint8)
    starts_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts_at[1:])
    space = _SPACE[raw]
    word = ~space
    first = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(word & np.concatenate((space[1:], [True]))) + 1
    power = np.ones(len(raw) + 1, U)
    np.cumprod(np.full(len(raw), _BASE), out=power[1:])
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * power[:-1], out=sums[1:])
    back = np.cumprod(np.concatenate((np.ones(1, U), np.full(len(raw), _INVERSE))))
    words = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(U) * U(0xD6E8FEB86659FD93))
    doc = np.searchsorted(starts_at, first, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    window = len(words) - k + 1
    h, d = np.zeros(0, U), np.zeros(0, np.int64)
    if window > 0:
        h = np.zeros(window, U)
        for j in range(k):
            h = mix(h + words[j : j + window] * U(2 * j + 1))
        inside = doc[:window] == doc[k - 1 :]
        h, d = h[inside], doc[:window][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        at = np.searchsorted(doc, short)
        extra = np.zeros(len(short), U)
        for j in range(k - 1):
            has = n_words[short] > j
            extra[has] = mix(extra[has] + words[at[has] + j] * U(2 * j + 1) + U(0xA5A5A5A5))
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


def super_minhash(h: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """Signatures, a row per document; slots of empty sets stay infinite."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    sig = np.full((n, m), np.inf)
    live, owner, perm = h, doc, None
    for j in range(m):
        worst = sig.max(1)
        still = worst[owner] > j  # values of this level are j at least
        if not still.all():
            live, owner = live[still], owner[still]
            perm = perm[still] if perm is not None else None
        if not len(live):
            break
        rank = mix(live + U((j + 1) * int(_BASE) % (1 << 64)))
        k = (j + (mix(rank) >> U(33)).astype(np.int64) % (m - j)).astype(np.int64)
        slot = k
        if j == 1:  # few documents get here with many elements
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(live), 1))
            k0 = (mix(mix(live + _BASE)) >> U(33)).astype(np.int64) % m
            perm[np.arange(len(live)), k0] = 0
            perm[:, 0] = k0
        if j:
            rows = np.arange(len(live))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig.ravel(), owner * m + slot, (rank >> U(11)).astype(np.float64) * 2.0**-53 + j)
    return sig


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def sketch(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """docs: node, h, text.  node, h, n (set size), f1, f2 (fingerprint), bands (keys), sketch (M bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            for a, b in pieces(texts):
                h, bounds = shingle_sets(texts[a:b], k)
                n = np.diff(bounds)
                sig = super_minhash(h, bounds)
                bits = mix(sig.view(U))
                keys = np.zeros((b - a, bands), U)
                for r in range(rows):
                    keys = mix(keys * _BASE + bits[:, r : rows * bands : rows])
                keys = mix(keys + np.arange(bands, dtype=U) * U(0xD6E8FEB86659FD93)).view(np.int64)
                total = [np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ U(s))))) for s in (0x1234567, 0x89ABCDEF)]
                f1, f2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
                short = (bits >> U(56)).astype(np.uint8)
                yield pd.DataFrame({"node": batch["node"].iloc[a:b].to_numpy(), "h": batch["h"].iloc[a:b].to_numpy(), "n": n, "f1": f1, "f2": f2, "bands": [x if y else x[:0] for x, y in zip(keys, n)], "sketch": [x.tobytes() for x in short]})

    return docs.mapInPandas(run, "node long, h long, n long, f1 long, f2 long, bands array<long>, sketch binary")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 4096) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups from batches sorted by ``keys``, with the groups' bounds."""

    def bounds(f: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(f), bool)
        for c in keys:
            v = f[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.concatenate(([0], np.flatnonzero(new), [len(f)]))

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        f = pd.concat(held, ignore_index=True)
        b = bounds(f)
        if len(b) > 2:
            yield f.iloc[: b[-2]], b[:-1]
            f = f.iloc[b[-2] :]
        held = [f]
    if held and len(f := pd.concat(held, ignore_index=True)):
        yield f, bounds(f)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def unite_matrix(union: Union, linked: np.ndarray, at: int) -> None:
    """Rows ``at``.. of a boolean matrix of links over all members."""
    for i, row in enumerate(linked):
        root = union.find(at + i)
        for j in np.flatnonzero(row):
            if union.find(j) != root:
                union.unite(j, root)
                root = union.find(root)


def star(ids: np.ndarray, union: Union) -> list[tuple[int, int]]:
    """An edge from each member to its root, the smallest id of those united (ids ascend; equal ones are one node)."""
    for i in np.flatnonzero(ids[1:] == ids[:-1]):
        union.unite(i, i + 1)
    roots = union.roots()
    i = np.flatnonzero(roots != np.arange(len(ids)))
    return list(zip(ids[roots[i]].tolist(), ids[i].tolist()))


def similar_sketches(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need = int(np.ceil(least * M))
        for f, b in whole_groups(batches, ["key"]):
            ids, s = f["id"].to_numpy(), np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(-1, M)
            size = np.diff(b)
            two = b[:-1][size == 2]
            near = two[(s[two] == s[two + 1]).sum(1) >= need]
            edges = list(zip(np.minimum(ids[near], ids[near + 1]).tolist(), np.maximum(ids[near], ids[near + 1]).tolist()))
            for at in np.flatnonzero(size > 2):
                order = np.argsort(ids[b[at] : b[at + 1]]) + b[at]
                own, mine = ids[order], s[order]
                union = Union(len(own))
                step = max(1, 2_000_000 // (M * len(own)))
                for i in range(0, len(own), step):
                    unite_matrix(union, (mine[i : i + step, None, :] == mine[None, :, :]).sum(2) >= need, i)
                edges += star(own, union)
            if edges:
                yield pd.DataFrame(edges, columns=["lo", "hi"])

    return run


def exact_links(h: np.ndarray, bounds: np.ndarray, percent: int) -> Union:
    """Unite sets with 100 * intersection >= percent * union, from exact intersection counts."""
    n, size = len(bounds) - 1, np.diff(bounds)
    union = Union(n)
    doc = np.repeat(np.arange(n), size)
    if n == 2:
        both = np.intersect1d(h[: bounds[1]], h[bounds[1] :], assume_unique=True).size
        if both and 100 * both >= percent * (size.sum() - both):
            union.unite(0, 1)
        return union
    _, col, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = count[col] > 1  # a shingle of one set is in no intersection
    col, doc = col[shared], doc[shared]
    names, col = np.unique(col, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    width = max(64, min(len(names), 8_000_000 // max(1, n)))
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    for at in range(0, len(names), width):
        a, b = np.searchsorted(col, [at, at + width])
        part = np.zeros((n, min(width, len(names) - at)), np.float32)
        part[doc[a:b], col[a:b] - at] = 1
        both += part @ part.T  # sums of ones, exact below 2**24
    for i in range(0, n, 256):
        counts = both[i : i + 256].astype(np.int64)
        linked = (counts > 0) & (100 * counts >= percent * (size[i : i + 256, None] + size[None, :] - counts))
        unite_matrix(union, linked, i)
    return union


def confirm(k: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, b in whole_groups(batches, ["component", "a", "b"], 512):
            edges = []
            for i, j in zip(b[:-1], b[1:]):
                g = f.iloc[i:j].sort_values(["id", "h"])
                if len(g) > 1:
                    h, bounds = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in g["text"]], k)
                    edges += star(g["id"].to_numpy(), exact_links(h, bounds, percent))
            if edges:
                yield pd.DataFrame(edges, columns=["lo", "hi"])

    return run


def star_round(e: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over ``n`` edges: lo, hi, moved (whether the edge was not yet to a root)."""
    most = max(HUB, n // 1000)
    hubs = e.groupBy(F.col("lo").alias("key")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")  # fewer than 1000
    ends = e.select(F.inline(F.array(F.struct(F.col("lo").alias("key"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("key"), F.col("lo").alias("other")))))
    # a hub's larger neighbours are dealt over its parts, its smaller ones go to each part
    own = F.array(F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"))
    part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("other") > F.col("key"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = ends.join(F.broadcast(hubs), "key", "left").withColumn("part", F.explode(part))
    least = F.least("key", F.min("other").over(Window.partitionBy("key", "part")))
    large = dealt.withColumn("lo", least).where("other > key").select("lo", F.col("other").alias("hi"), (F.col("lo") < F.col("key")).alias("moved"))
    order = Window.partitionBy("hi").orderBy("lo", F.desc("moved"))
    ranked = large.select("hi", "lo", "moved", F.first("lo").over(order).alias("m"), F.lag("lo").over(order).alias("before")).where("before is null or before <> lo")
    return ranked.select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), (F.col("moved") | (F.col("lo") > F.col("m"))).alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """edges: lo, hi.  Returns (node, root) for each node that is not its component's smallest; a written table."""
    spark, old, moved = edges.sparkSession, None, True
    step = edges.where("lo < hi").select("lo", "hi", F.lit(True).alias("moved"))
    while True:
        path, seen = fresh_path(spark, "edges"), Observation()
        step = step.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"))
        step.select(F.col("lo").alias("root"), F.col("hi").alias("node")).write.parquet(path)
        n, moved = seen.get.get("n") or 0, seen.get.get("moved") or 0
        if old:
            remove(spark, old)
        found = spark.read.schema("root long, node long").parquet(path)
        if not moved:
            return owned(found.select("node", "root"), path)
        old, step = path, star_round(found.select(F.col("root").alias("lo"), F.col("node").alias("hi")), n)


def _needed(count, elements) -> Column:
    """Blocks for so many members and set elements."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(elements / ELEMENTS)).cast("int")


def in_blocks(sized: DataFrame, large: DataFrame) -> DataFrame:
    """component, a, b, id, h: members dealt to the blocks of their component; its root stands in each."""
    dealt = sized.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    each = F.when(F.col("id") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    return dealt.withColumn("a", F.explode(each)).select("component", "a", F.col("a").alias("b"), "id", "h")


def across_groups(sized: DataFrame, large: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """component, a, b, id, h: pairs of blocks of large components that bring every two members of different groups together; and the table it reads.

    Groups that need more than half a block have blocks of their own, which are not paired with each other; the others are dealt by group.
    """
    named = sized.join(large.select("component"), "component").join(links.select(F.col("node").alias("id"), F.col("root").alias("group")), "id", "left").withColumn("group", F.coalesce("group", "id"))
    groups = named.groupBy("component", "group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).withColumn("own", _needed(F.col("m") * 2, F.col("n") * 2) > 1)
    groups = materialise(groups.withColumn("k", F.when(F.col("own"), _needed(F.col("m"), F.col("n"))).otherwise(0)), "groups")
    several = groups.groupBy("component").agg(F.count(F.lit(1)).alias("groups"), _needed(F.sum(F.when(~F.col("own"), F.col("m"))), F.sum(F.when(~F.col("own"), F.col("n")))).alias("shared"), F.sum("k").alias("owned"))
    several = several.where("groups > 1").withColumn("shared", F.coalesce("shared", F.lit(0))).withColumn("total", (F.col("shared") + F.col("owned")).cast("int"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("component").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # groups with blocks of their own are few: one for each half block at most
    first = groups.where("own").join(several.select("component", "shared"), "component").select("component", "group", "k", (F.col("shared") + before).cast("int").alias("first"))
    placed = named.join(several, "component").join(first, ["component", "group"], "left")
    block = F.when(F.col("first").isNull(), F.pmod(F.xxhash64("group", F.lit(7)), F.col("shared"))).otherwise(F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("k"))).cast("int")
    mine = lambda x: F.when(F.col("first").isNull(), x == F.col("block")).otherwise((x >= F.col("first")) & (x < F.col("first") + F.col("k")))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: ~mine(x))
    paired = placed.withColumn("block", block).withColumn("other", F.explode(F.when(F.col("total") == 1, F.array(F.lit(0))).otherwise(others)))
    return paired.select("component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "id", "h"), groups


def _keys(id_col: str, text_col: str) -> list[Column]:
    """node (the identifier, or a number of the text) and h (64-bit hash of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text, F.octet_length(text))
    node = F.coalesce(F.col(id_col).cast("long"), h.bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    return [node.alias("node"), h.alias("h")]


def decisions(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, filter_bits: int) -> DataFrame:
    """One row per row of ``docs``: node, h (see ``_keys``), n, root (null: linked with nothing)."""
    spark = docs.sparkSession
    rows, bands = bands_for(similarity)
    percent = round(100 * similarity)
    texts = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    with small_batches(spark):
        base = materialise(sketch(texts, words, rows, bands), "sketches")
    of_rep = F.min_by(F.struct("h", "bands", "sketch"), "node").alias("own")
    classes = materialise(base.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("node").alias("rep"), of_rep).select("n", "f1", "f2", "rep", "own.*"), "classes")

    keyed = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lo"), F.bit_xor(F.xxhash64("id")).alias("members")).where("size > 1")
    chosen = buckets.groupBy("size", "lo", "members").agg(F.min("key").alias("key")).select("key", "size", "lo")
    members = materialise(keyed.join(chosen, "key"), "members")
    parts = shuffle_partitions(spark)
    sketched = members.where(F.col("size") <= BUCKET).select("key", "id").join(classes.select(F.col("rep").alias("id"), "sketch"), "id").repartition(parts, "key").sortWithinPartitions("key")
    united = members.where((F.col("size") > BUCKET) & (F.col("id") > F.col("lo"))).select("lo", F.col("id").alias("hi"))
    candidates = components(sketched.mapInPandas(similar_sketches(similarity - 0.2), "lo long, hi long").unionByName(united))

    nodes = candidates.select(F.col("root").alias("component"), F.col("node").alias("id")).unionByName(candidates.select(F.col("root").alias("component"), F.col("root").alias("id")).distinct())
    sized = materialise(nodes.join(classes.select(F.col("rep").alias("id"), "h", "n"), "id"), "candidates")
    large = materialise(sized.groupBy("component").agg(_needed(F.count(F.lit(1)), F.sum("n")).alias("blocks")).where("blocks > 1"), "large-components")
    held = may_hold(texts.withColumn("digest", F.col("node")), bit_filter(sized.select(F.col("id").alias("digest")), filter_bits), filter_bits).where("maybe")
    once = held.groupBy(F.col("node").alias("id"), "h").agg(F.first("text").alias("text"))  # rows that repeat identifier and text

    def confirmed(placed: DataFrame) -> DataFrame:
        checked = placed.join(once, ["id", "h"]).repartition(parts, "component", "a", "b").sortWithinPartitions("component", "a", "b")
        return checked.select("component", "a", "b", "id", "h", "text").mapInPandas(confirm(words, percent), "lo long, hi long")

    with small_batches(spark):
        links = components(confirmed(in_blocks(sized, large)))
        if not large.isEmpty():
            known = links
            apart, groups = across_groups(sized, large, known)
            links = components(confirmed(apart).unionByName(known.select(F.col("root").alias("lo"), F.col("node").alias("hi"))))
            forget(known, groups)
    forget(members, candidates, sized, large)

    grouped = classes.join(links, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("root"))
    linked = base.where("n > 0").select("node", "h", "n", "f1", "f2").join(grouped, ["n", "f1", "f2"]).select("node", "h", "n", "root")
    return linked.unionByName(base.where("n = 0").select("node", "h", "n", F.lit(None).cast("long").alias("root")))


def _kept() -> Column:
    return F.coalesce(F.col("node") == F.col("root"), F.lit(True))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 22) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    named = lambda c: F.when(c < NAMELESS, c)
    found = decisions(docs, words, similarity, id_col, text_col, filter_bits)
    return found.select(named(F.col("node")).alias("id"), F.col("n").alias("n_shingles"), named(F.coalesce("root", "node")).alias("component_id"), _kept().alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 22) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    found = decisions(docs, words, similarity, id_col, text_col, filter_bits)
    gone = materialise(found.where(~_kept()).select("node", "h").distinct().withColumn("digest", F.xxhash64("node", "h")), "gone")
    packed = docs.select(F.struct("*").alias("row"), *_keys(id_col, text_col)).withColumn("digest", F.xxhash64("node", "h"))
    probed = may_hold(packed, bit_filter(gone, filter_bits), filter_bits)
    left = probed.where("maybe").join(gone.select("node", "h"), ["node", "h"], "left_anti")
    return probed.where("not maybe").select("row.*").unionByName(left.select("row.*"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, three words and 0.85: doc_id, n_shingles, component_id, kept (see the module's text)."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
