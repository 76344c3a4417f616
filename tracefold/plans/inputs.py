"""Inputs that the queries derive from the tables, each as a Spark expression and the same in SQL."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [
    ("err_undeclared", r"use of undeclared identifier .*"),
    ("err_any_use", r"use of .*"),
    ("err_expected", r"expected .* after .*"),
    ("err_unknown_type", r"(unknown|invalid) type name .*"),
    ("err_wild", r".*"),
    ("err_never", r"never seen .*"),
]
RULES_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(RULES)) + ") AS rules(ord, name, pattern)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MESSAGE = """CASE event_type WHEN 'click' THEN 'expected '';'' after expression' WHEN 'error' THEN concat('use of undeclared identifier v', cast(user_id % 50 AS {s}))
 WHEN 'purchase' THEN concat('no member named m', cast(user_id % 9 AS {s})) WHEN 'signup' THEN concat('unknown type name T', cast(user_id % 7 AS {s})) ELSE 'use of moved value' END"""


def _log(s: str, esc: str, nl: str) -> str:
    return f"concat({esc}, '[1mf', cast(user_id AS {s}), '.c:3:1: ', {esc}, '[0;31m', ': error: ', {esc}, '[0m', {_MESSAGE.format(s=s)}, {nl}, '  int x = 1;', {nl}, 'f.c:9:1: fatal error: too many errors', {nl}, 'f.c:10:2: error: not terminated')"


LOG_SQL = f"(SELECT event_id, event_type, user_id, {_log('VARCHAR', 'chr(27)', 'chr(10)')} AS content FROM events)"
MESSAGES_SQL = rf"(SELECT event_id, unnest(regexp_extract_all(regexp_replace(content, chr(27) || '\[[0-?]*[ -/]*[@-~]', '', 'g'), ':\s+error:\s+([^\n]*)\n', 1)) AS message FROM {LOG_SQL})"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.expr(_log("STRING", "char(27)", "char(10)")).alias("content"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import error_messages, strip_ansi

    return logs(spark, sf_dir).select("event_id", F.explode(error_messages(strip_ansi(F.col("content")))).alias("message"))



def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a fresh one on a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracefold-")
    return found.rstrip("/")


#: Two or three lines of source with nested pairs, doubled symbols, a continued line and a parenthesis that nothing closes.
CODE = """concat('for (i = 0; a::b == c[', cast(event_id % 7 AS {s}), ']; i++) {{ f(x, {{y < z, [k]}}, g<T<U>>(q)); }}', {nl}, '::h ? p : (r = ', event_type, '); ::: ===', CASE WHEN event_id % 5 = 0 THEN concat({slash}, {nl}, ' (s') ELSE '' END)"""


def argv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, argv."""
    text = F.expr(
        "concat('clang', CASE WHEN user_id % 2 = 0 THEN '++' ELSE '' END, ' -c -Iinc', cast(user_id % 5 AS STRING), ' -o out.o -MF dep', cast(event_id % 7 AS STRING), '.d -std=c++17 -Wall %clang_cc1 %itanium_abi_triple src', cast(user_id AS STRING), CASE WHEN event_type = 'click' THEN '.c' ELSE '.cpp' END)"
    )
    return table(spark, sf_dir, "events").select("event_id", F.split(text, " ").alias("argv"))


ARGV_SQL = """(SELECT event_id, string_split(concat('clang', CASE WHEN user_id % 2 = 0 THEN '++' ELSE '' END, ' -c -Iinc', cast(user_id % 5 AS VARCHAR), ' -o out.o -MF dep', cast(event_id % 7 AS VARCHAR), '.d -std=c++17 -Wall %clang_cc1 %itanium_abi_triple src', cast(user_id AS VARCHAR), CASE WHEN event_type = 'click' THEN '.c' ELSE '.cpp' END), ' ') AS argv FROM events)"""
