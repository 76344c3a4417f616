"""Groups of warnings that hold other groups: what a flag switches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, folder: str) -> DataFrame:
    """top, below: every group with itself and all groups under it; edges: name, subgroup.

    Each round doubles how far down pairs are known: from those exactly as far apart as the round before reached, all that is
    known goes on.  What is known already is left out, so cycles end and pairs that several ways lead to count once.  A round
    is written below ``folder``, which executors share, and read again: plans stay short and survive lost executors.  There are as
    many rounds as the logarithm of the longest shortest way, so pairs are read as often as that.
    """
    spark = edges.sparkSession
    home = f"{folder}/closure-{uuid.uuid4().hex}"
    schema = f"top {edges.schema['name'].dataType.simpleString()}, below {edges.schema['name'].dataType.simpleString()}, far long"

    def kept(rows: DataFrame, n: int) -> DataFrame:
        rows.write.parquet(f"{home}/round={n}")
        return spark.read.schema(schema).parquet(f"{home}/round={n}")

    def nearest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("top", "below").agg(F.min("far").alias("far"))

    far = lambda n: F.lit(n).cast("long").alias("far")
    ways = F.array(F.struct(F.col("name").alias("top"), F.col("name").alias("below"), far(0)), F.struct(F.col("subgroup").alias("top"), F.col("subgroup").alias("below"), far(0)), F.struct(F.col("name").alias("top"), F.col("subgroup").alias("below"), far(1)))
    kept(nearest(edges.select(F.explode(ways).alias("w")).select("w.*").where("top is not null and below is not null")), 0)
    n, reach = 0, 1
    while True:
        seen = spark.read.schema(schema).option("basePath", home).parquet(*(f"{home}/round={i}" for i in range(n + 1)))
        ends = seen.where(F.col("far") == reach).select("top", F.col("below").alias("mid"))
        onward = seen.where("far > 0").select(F.col("top").alias("mid"), "below", (F.col("far") + reach).alias("far"))
        found = ends.join(onward, "mid").select("top", "below", "far")
        n += 1
        if kept(nearest(found).join(seen, ["top", "below"], "left_anti"), n).isEmpty():
            break
        reach *= 2
    return spark.read.schema(schema).parquet(*(f"{home}/round={i}" for i in range(n))).select("top", "below")


def switched(groups: DataFrame, diagnostics: DataFrame, folder: str) -> DataFrame:
    """flag, n_groups, n_diagnostics: what each flag switches, subgroups included.

    groups: name, flag, subgroups.  diagnostics: group_name (null: made on the spot, then flag).  Groups that are named but not defined count
    as groups and have no flag; names that share a flag act together.
    """
    edges = groups.select("name", F.explode_outer("subgroups").alias("subgroup"))
    reach = closure(edges.withColumn("subgroup", F.coalesce("subgroup", "name")), folder)
    own = diagnostics.where("group_name is not null").groupBy(F.col("group_name").alias("below")).agg(F.count(F.lit(1)).alias("n"))
    below = groups.select(F.col("name").alias("top"), "flag").distinct().join(reach, "top").select("flag", "below").distinct()
    held = below.join(own, "below", "left").groupBy("flag").agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    here = diagnostics.where("group_name is null and flag is not null").groupBy("flag").agg(F.count(F.lit(1)).alias("here"))
    both = held.join(here, "flag", "full_outer")
    return both.select("flag", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), (F.coalesce("n", F.lit(0)) + F.coalesce("here", F.lit(0))).alias("n_diagnostics"))
