"""Readers and writers of run logs, annotated sources, ledgers and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encodings import read_decoded

SOURCE_RUN = "timestamp string, fuzz_mode string, original_line string, modified_line string, node_kind string, status string, message string"
ARGUMENT_RUN = "timestamp string, fuzz_mode string, fuzzed_args array<string>, original_command array<string>, fuzzed_command array<string>, status string, message string"
AGENT_RUN = "timestamp string, file string, fuzz_mode string, status string, message string, diff string"
TREE_RUN = "original_line string, modified_line string, position int, ast_changes array<struct<type:string,details:string>>, compilation_result string, error_message string"
ANNOTATION = "file string, error_full string, error_content string, line_number int"
#: Fixed value: the head of a log entry.
_HEAD = re.compile(r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) - (\w+) - (.*)", re.ASCII)
LABELLED = ANNOTATION + ", error_name array<string>"


def read_strict(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path, schema: str) -> DataFrame:
    """Lines that are not JSON objects are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(path)


def count_lines(spark: SparkSession, path: str) -> int | str:
    """Lines of a file, or a sentence if there is none."""
    try:
        return spark.read.text(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return "File not found. Please check the file path."


def messages(*logs: DataFrame) -> DataFrame:
    """message of all logs; a tree log's is its error_message."""
    out = None
    for log in logs:
        have = [F.col(c) for c in ("message", "error_message") if c in log.columns]
        one = log.select(F.coalesce(*have).alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


def read_count_map(spark: SparkSession, path: str) -> DataFrame:
    """name, n of one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("name", "n"))


def count_map_json(counts: DataFrame) -> DataFrame:
    """One row with the map as JSON, keys sorted.  Counts have a row per label."""
    entries = F.array_sort(F.collect_list(F.struct("name", "n")))
    return counts.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """file, text of C and C++ sources in the encoding their bytes tell; files that are no text are left out."""
    return read_decoded(spark, path).where("text is not null").select("file", "text")


def skipped_sources(spark: SparkSession, path: str) -> int:
    """How many files ``read_sources`` leaves out."""
    return read_decoded(spark, path).where("text is null").count()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_locations(lines: DataFrame) -> DataFrame:
    """id, file, line from ``Diag ID: N Located at: PATH:LINE`` in column value."""
    p = r"Diag ID: (\d+) Located at: (.+):(\d+)"
    return lines.where(F.col("value").rlike(p)).select(*(F.regexp_extract("value", p, i).cast(t).alias(n) for i, n, t in ((1, "id", "long"), (2, "file", "string"), (3, "line", "int"))))


def read_ledger(lines: DataFrame) -> DataFrame:
    """id of ``Diag ID: N, file_name: ...`` lines."""
    p = r"Diag ID: (\d+), file_name: (.+?), line number: (.+?)"
    return lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).cast("long").alias("id"))


def read_flags(lines: DataFrame) -> DataFrame:
    """name, flag (null if none) from lines ``  name [-Wflag]``."""
    p = r"^ +(\w+)(?: \[(-W[^\]]+)\])?\s*$"
    flag = F.regexp_extract("value", p, 2)
    return lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("name"), F.when(flag != "", flag).alias("flag"))


def read_attempts(lines: DataFrame) -> DataFrame:
    """Multi-line log entries: time, level, message.  lines: file, pos, value; an entry runs to the next head of its file."""
    p = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) - (\w+) - (.*)$"
    marked = lines.withColumn("entry", F.sum(F.col("value").rlike(p).cast("int")).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.where("entry > 0").groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("rows"))
    head = F.element_at("rows", 1)["value"]
    rest = F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: r["value"])
    return grouped.select("file", "entry", F.regexp_extract(head, p, 1).alias("time"), F.regexp_extract(head, p, 2).alias("level"), F.array_join(F.concat(F.array(F.regexp_extract(head, p, 3)), rest), "\n").alias("message"))


def read_attempts_in_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``read_attempts`` of files however large: file, time, level, message, block and place (which order a file's entries).

    A task reads its byte range of a file in order and cuts it at entry heads.  Only the lines before a range's first head
    and its last entry leave unfinished; they are put together per file, a row or two for each range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, place, entry = None, 0, None
        columns = ["file", "block", "place", "time", "level", "message", "whole"]

        def done(whole: bool) -> list[tuple]:
            return [(*at, place, *entry[:2], "\n".join(entry[2]), whole)] if entry else []

        for b in batches:
            rows = []
            for file, block, value in zip(b["file"], b["block"], b["value"]):
                head = _HEAD.fullmatch(value)
                if at != (file, block):
                    rows += done(False)
                    at, place, entry = (file, block), 0, None
                    if not head:
                        entry = [None, None, []]
                elif head:
                    rows += done(entry[0] is not None)
                if head:
                    place, entry = place + 1, [head.group(1), head.group(2), [head.group(3)]]
                else:
                    entry[2].append(value)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if entry:
            yield pd.DataFrame(done(False), columns=columns)

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    parts = lines.mapInPandas(run, "file string, block long, place int, time string, level string, message string, whole boolean")
    # the last entry of a range and what the next ranges have before their first head are one
    order = Window.partitionBy("file").orderBy("block", "place")
    open_ = parts.where("not whole").withColumn("n", F.sum(F.col("time").isNotNull().cast("int")).over(order)).where("n > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "message"))), lambda x: x["message"])
    first = lambda c: F.min_by(c, F.struct("block", "place")).alias(c)
    put = open_.groupBy("file", "n").agg(first("time"), first("level"), F.array_join(texts, "\n").alias("message"), F.min(F.struct("block", "place")).alias("at"))
    names = ["file", "block", "place", "time", "level", "message"]
    return parts.where("whole").select(*names).unionByName(put.select("file", "at.block", "at.place", "time", "level", "message"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, path: str, column: str = "message") -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """rows: id, file, line, name."""
    text = F.concat(F.lit("Diag ID: "), F.col("id").cast("string"), F.lit(", file_name: "), F.col("file"), F.lit(", line number: "), F.col("line").cast("string"), F.lit(", error_name: "), F.col("name"))
    rows.select(text.alias("value")).write.mode("append").text(path)


def write_id_report(rows: DataFrame, path: str) -> None:
    """rows: id, name."""
    rows.select(F.concat_ws(": ", F.concat(F.lit("Diag ID: "), F.col("id").cast("string")), "name").alias("value")).write.mode("overwrite").text(path)
