"""Trees as node tables (tree_id, path array<int>, kind, spelling, type, start, end)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CHANGES = ("node_changed", "name_changed", "type_changed", "position_changed", "structure_change")
ALL_CHANGES = (*CHANGES, "node_added", "node_removed")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Changes between two versions by (tree_id, path): tree_id, path, change, details (a sentence on it).

    An added or removed subtree gives one row, at its root.
    """
    strip = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("modified1_"), F.lit(""))
    cols = ["kind", "spelling", "type", "location", "children"]
    left = a.select("tree_id", "path", *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(True).alias("in_a"))
    right = b.select("tree_id", "path", *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(True).alias("in_b"))
    up = lambda d, name: d.select("tree_id", F.col("path").alias("up"), F.lit(True).alias(name))
    both = left.join(right, ["tree_id", "path"], "full_outer").withColumn("up", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    both = both.join(up(a, "up_a"), ["tree_id", "up"], "left").join(up(b, "up_b"), ["tree_id", "up"], "left")
    root = F.size("path") == 0
    pair = F.col("in_a") & F.col("in_b")
    name = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for v in "ab" for c in (f"{v}_{x}" for x in cols)}
    old, new = {c: strip(name[f"a_{c}"]) if c in ("spelling", "location") else name[f"a_{c}"] for c in cols}, {c: strip(name[f"b_{c}"]) if c in ("spelling", "location") else name[f"b_{c}"] for c in cols}

    def change(when: Column, kind: str, sentence: str, *values: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.format_string(sentence, *values).alias("details")))

    found = [
        change(pair & (F.col("a_kind") != F.col("b_kind")), "node_changed", "Node kind changed from '%s' to '%s'", old["kind"], new["kind"]),
        change(pair & (old["spelling"] != new["spelling"]), "name_changed", "Node spelling changed from '%s' to '%s'", old["spelling"], new["spelling"]),
        change(pair & (old["type"] != new["type"]), "type_changed", "Node type changed from '%s' to '%s'", old["type"], new["type"]),
        change(pair & (old["location"] != new["location"]), "position_changed", "Node position changed from %s to %s", old["location"], new["location"]),
        change(pair & (F.col("a_children") != F.col("b_children")), "structure_change", "%s children count changed from %s to %s", old["kind"], old["children"], new["children"]),
        change(F.col("in_a").isNull() & (root | F.col("up_a").isNotNull()), "node_added", "New %s '%s' added at %s", name["b_kind"], name["b_spelling"], name["b_location"]),
        change(F.col("in_b").isNull() & (root | F.col("up_b").isNotNull()), "node_removed", "%s '%s' removed from %s", name["a_kind"], name["a_spelling"], name["a_location"]),
    ]
    each = both.select("tree_id", "path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c"))
    return each.select("tree_id", "path", F.col("c.type").alias("change"), F.col("c.details").alias("details"))


def changes_of_variants(variants: DataFrame, nodes: DataFrame, modified: DataFrame) -> DataFrame:
    """A row per variant with what it does to its text's tree: id, position, original_line, modified_line, ast_changes.

    variants: id, at, line, modified.  nodes: the texts' trees (tree_id is the text).  modified: those of the variants (tree_id, position).
    Changes stand in the order of a walk from the root; a variant without a tree of its own has null.
    """
    one = F.struct(F.col("id").alias("id"), F.col("at").alias("position"))
    placed = variants.select(F.col("id").alias("tree_id"), F.col("at").alias("position"), one.alias("variant"))
    after = modified.join(placed, ["tree_id", "position"]).drop("tree_id", "position").withColumnRenamed("variant", "tree_id")
    before = nodes.join(placed.join(modified.select("tree_id", "position").distinct(), ["tree_id", "position"], "left_semi"), "tree_id").drop("tree_id", "position").withColumnRenamed("variant", "tree_id")
    order = F.array_position(F.array(*map(F.lit, ALL_CHANGES)), F.col("change"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("path", order.alias("k"), "change", "details"))), lambda x: F.struct(x["change"].alias("type"), x["details"].alias("details")))
    found = diff(before, after).groupBy("tree_id").agg(rows.alias("ast_changes"))
    known = after.select(F.col("tree_id").alias("v")).distinct().join(found, F.col("v") == F.col("tree_id"), "left").select("v", F.coalesce("ast_changes", F.array().cast("array<struct<type:string,details:string>>")).alias("ast_changes"))
    return variants.select("id", F.col("at").alias("position"), F.trim("line").alias("original_line"), F.trim("modified").alias("modified_line"), one.alias("v")).join(known, "v", "left").drop("v")


def kinds(nodes: DataFrame) -> DataFrame:
    """The kinds of node that a table has, and how many nodes of each: kind, n."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dump(nodes: DataFrame) -> DataFrame:
    """A line per node, two blanks per level: tree_id, place (preorder), line.  Order by place to print."""
    line = F.concat(F.expr("repeat('  ', size(path))"), F.col("kind"), F.lit(": "), F.col("spelling"))
    return nodes.select("tree_id", F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 9, "0")), ".").alias("place"), line.alias("line"))


def node_at(nodes: DataFrame, offsets: DataFrame, width: int = 4096) -> DataFrame:
    """The deepest node with start <= offset < end, per (tree_id, offset).

    An interval join by bins of ``width``: a node is listed in each bin it touches, an offset in one, so it is an equi-join.
    """
    spread = nodes.where("start < end").withColumn("bin", F.explode(F.sequence((F.col("start") / width).cast("long"), ((F.col("end") - 1) / width).cast("long"))))
    asked = offsets.withColumn("bin", (F.col("offset") / width).cast("long"))
    hit = asked.join(spread, ["tree_id", "bin"]).where("start <= offset and offset < end")
    return hit.groupBy("tree_id", "offset").agg(F.max_by("kind", F.struct(F.size("path"), F.col("kind"))).alias("kind"))


@lru_cache(10_000)
def _last_first(name: str) -> tuple[int, ...]:
    """Orders names from the last to the first: each letter inverted, a shorter name behind its continuations."""
    return (*(-ord(c) for c in name), 1)


def add_kinds(nodes: DataFrame, rows: DataFrame, tree: str, at: str, name: str = "node_kind") -> DataFrame:
    """Adds to rows of any columns the kind of the deepest node around their place ``at`` in the text ``tree``, null if none.

    One pass over nodes and rows in the order of texts and starts: nodes that have begun wait in a heap, deepest first, and leave
    when they have ended.  Nodes may overlap in any way; a task holds the open nodes of one text.  Rows are shuffled once and pass
    as Arrow columns that Python does not look into.
    """
    columns = rows.columns

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, heap = None, []
        for b in batches:
            ids, (starts, is_row, ends, depths) = b.column("_tree"), (b.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "_row", "_end", "_depth"))
            ids = ids.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(ids.type) and not ids.null_count else ids.to_pylist()
            found = []
            for t, start, row, end, depth, kind in zip(ids, starts.tolist(), is_row.tolist(), ends.tolist(), depths.tolist(), b.column("_kind").to_pylist()):
                if t != text:
                    text, heap = t, []
                if row:
                    while heap and heap[0][2] <= start:
                        heappop(heap)
                    found.append(heap[0][3] if heap else None)
                else:
                    heappush(heap, (-depth, _last_first(kind), end, kind))
            if found:
                kept = b.select(columns).filter(pa.array(is_row == 1))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], names=[*columns, name])

    number = lambda x, c: F.lit(x).cast("long").alias(c)
    first = F.lit(-(2**63))  # a row without a place comes before all nodes
    asked = rows.select(F.col(tree).alias("_tree"), F.coalesce(F.col(at).cast("long"), first).alias("_at"), number(1, "_row"), number(0, "_end"), number(0, "_depth"), F.lit("").alias("_kind"), *columns)
    begun = nodes.where("tree_id is not null and start < end").select(
        F.col("tree_id").alias("_tree"), F.col("start").cast("long").alias("_at"), number(0, "_row"), F.col("end").cast("long").alias("_end"), F.size("path").cast("long").alias("_depth"), F.col("kind").alias("_kind"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields),
    )
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields), StructField(name, StringType())])
    return begun.unionByName(asked).repartition("_tree").sortWithinPartitions("_tree", "_at", "_row").mapInArrow(sweep, schema)


def kinds_at(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """``node_at`` for many places of a text: tree_id, offset, kind (null outside all nodes), a row per distinct place."""
    asked = places.where("tree_id is not null").select("tree_id", F.col("offset").cast("long").alias("offset")).distinct()
    return add_kinds(nodes, asked, "tree_id", "offset", "kind")


def first_identifiers(tokens: DataFrame) -> DataFrame:
    """tokens: tree_id, path, pos, kind, spelling.  The first IDENTIFIER of each node: tree_id, path, spelling, pos."""
    return tokens.where("kind = 'IDENTIFIER'").groupBy("tree_id", "path").agg(F.min_by("spelling", F.struct("pos", "spelling")).alias("spelling"), F.min("pos").alias("pos"))


def parentheses(nodes: DataFrame) -> DataFrame:
    """The first opening and last closing parenthesis in each call and function: tree_id, path, kind, side, pos.  nodes also have file, main and text."""
    inside = F.expr("substr(text, start + 1, end - start)")
    own = nodes.where("kind in ('CALL_EXPR', 'FUNCTION_DECL') and file = main").withColumn("inside", inside)
    left, right = F.instr("inside", "("), F.char_length("inside") - F.instr(F.reverse("inside"), ")")
    sides = F.array(F.when(left > 0, F.struct(F.lit("left").alias("side"), (F.col("start") + left - 1).cast("long").alias("pos"))), F.when(F.col("inside").contains(")"), F.struct(F.lit("right").alias("side"), (F.col("start") + right).cast("long").alias("pos"))))
    return own.select("tree_id", "path", "kind", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select("tree_id", "path", "kind", "s.*")


#: Kinds of nodes that own no parenthesis.
NO_OWNER = ("UNEXPOSED_EXPR", "DECL_REF_EXPR")


def parenthesis_owner(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """The construct a parenthesis is part of: the walk from the root goes on to the first child that holds the place, as far as one does.

    Its end, or the nearest node above that is no ``NO_OWNER``, is the owner.  What stands below a node that does not hold the place is
    never reached, nor is a second child that holds it.

    nodes: tree_id, path, kind, line_start, line_end, col_start, col_end (both ends inside); a root's path is the shortest of its tree.  places:
    tree_id, line, col, symbol; other symbols than parentheses have no owner.  Returns tree_id, line, col, kind (null if none).
    """
    asked = places.where("symbol in ('(', ')')")
    roots = nodes.groupBy("tree_id").agg(F.min(F.size("path")).alias("top"))
    spread = nodes.withColumn("line", F.explode(F.sequence("line_start", "line_end")))  # an equi-join on the line
    around = asked.join(spread, ["tree_id", "line"]).where("col_start <= col and col <= col_end")
    held = around.groupBy("tree_id", "line", "col").agg(F.array_sort(F.collect_set(F.struct("path", "kind"))).alias("held")).join(roots, "tree_id")
    # in the order of paths a node stands before what is below it, and that before its next sibling
    start = F.struct(F.lit(None).cast(nodes.schema["path"].dataType).alias("path"), F.lit(None).cast("string").alias("kind"))
    next_ = lambda at, x: F.when(at["path"].isNull(), F.size(x["path"]) == F.col("top")).otherwise((F.size(x["path"]) == F.size(at["path"]) + 1) & (F.slice(x["path"], F.lit(1), F.size(at["path"])) == at["path"]))
    step = lambda at, x: F.when(next_(at, x), F.struct(x["path"].alias("path"), F.when(x["kind"].isin(*NO_OWNER), at["kind"]).otherwise(x["kind"]).alias("kind"))).otherwise(at)
    owner = held.select("tree_id", "line", "col", F.aggregate("held", start, step)["kind"].alias("kind"))
    return asked.select("tree_id", "line", "col").join(owner, ["tree_id", "line", "col"], "left")
