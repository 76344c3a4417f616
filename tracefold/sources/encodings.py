"""Encodings of source files, told from their bytes.

In order: a byte order mark; zero bytes that stand in every other place; UTF-8 by validity; then Shift-JIS,
GB18030 and the Latin alphabets by how plausible the bytes are.  Bytes beyond ASCII stand in pairs in East Asian
text, each pair a common letter there, and alone between ASCII letters in Latin text; two of them that a Latin word begins
with, a capital and a small letter, are no pair.  Files with control characters that no text has are no text.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]")
_HIGH_RUN = re.compile(rb"[\x80-\xff]+")
#: Hiragana and katakana with the kanji of the first level; hanzi of the first level with their punctuation.
_JAPANESE = re.compile(rb"\x82[\x9f-\xf1]|\x83[\x40-\x96]|\x81[\x41-\x5b\x69-\x7a]|[\x89-\x97][\x40-\x7e\x80-\xfc]|\x88[\x9f-\xfc]|\x98[\x40-\x72]")
_CHINESE = re.compile(rb"[\xb0-\xd7][\xa1-\xfe]|\xa1[\xa2-\xb5]|\xa3[\xa1-\xfe]")
#: Words with letters beyond ASCII, and those that Latin text has: small letters behind at most one capital, or capitals with ASCII ones among them.
_WORD = re.compile(rb"[A-Za-z\x80-\xff]*[\x80-\xff][A-Za-z\x80-\xff]*")
_LATIN = re.compile(rb"[A-Z\xc0-\xd6\xd8-\xde]?[a-z\xdf-\xf6\xf8-\xff]+|(?=[\xc0-\xde]*[A-Z])[A-Z\xc0-\xd6\xd8-\xde]+")
_UNUSED_1252 = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")


def _decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def _share(raw: bytes, pattern: re.Pattern) -> float:
    """How much of the bytes beyond ASCII is in matches of ``pattern``."""
    high = sum(c > 127 for c in raw)
    return sum(sum(c > 127 for c in m.group()) for m in pattern.finditer(raw)) / high


def _latin_words(raw: bytes) -> float:
    """How much of the bytes beyond ASCII is in words as Latin text has them."""
    words = _WORD.findall(raw)
    high = [sum(c > 127 for c in w) for w in words]
    return sum(n for n, w in zip(high, words) if _LATIN.fullmatch(w)) / sum(high)


def _without_mark(raw: bytes) -> str | None:
    """UTF-16 by its zero bytes: most of one half of the places, few of the other."""
    if len(raw) < 2 or len(raw) % 2:
        return None
    zero = np.frombuffer(raw, np.uint8) == 0
    even, odd = zero[::2].mean(), zero[1::2].mean()
    for encoding, full, empty in (("utf-16-le", odd, even), ("utf-16-be", even, odd)):
        if full > 0.4 and empty < 0.05 and _decodes(raw, encoding):
            return encoding
    return None


def detect(raw: bytes) -> str | None:
    """The encoding of a file's bytes, None if they are no text."""
    for mark, encoding in MARKS:
        if raw.startswith(mark) and _decodes(raw, encoding):
            return encoding
    if found := _without_mark(raw):
        return found
    if _CONTROL.search(raw):
        return None
    if raw.isascii():
        return "ascii"
    if _decodes(raw, "utf-8"):
        return "utf-8"
    alone = sum(len(m.group()) for m in _HIGH_RUN.finditer(raw) if len(m.group()) == 1) / max(1, sum(len(m.group()) for m in _HIGH_RUN.finditer(raw)))
    found = [(_share(raw, p), e) for p, e in ((_JAPANESE, "shift_jis"), (_CHINESE, "gb18030")) if _decodes(raw, e)]
    share, encoding = max(found, default=(0.0, ""))
    if share > 0.85 and (encoding == "shift_jis" or (alone < 0.2 and _latin_words(raw) < 0.5)):
        return encoding
    if re.search(rb"[\x80-\x9f]", raw):
        return "cp1252" if not _UNUSED_1252.search(raw) else None
    return "latin-1"


def decode_with(raw: bytes | None) -> tuple[str | None, str | None]:
    """(encoding, text); the encoding is null where the bytes are no text."""
    encoding = detect(raw) if raw is not None else None
    return encoding, raw.decode(encoding) if encoding else None


def decoded(content: Column) -> Column:
    """(encoding, text) of a binary column."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_with(x) for x in s], columns=["encoding", "text"], dtype=object)

    return F.pandas_udf(run, "struct<encoding: string, text: string>")(content)


def read_decoded(spark: SparkSession, path: str, glob: str = "*.{c,cpp,cc,cxx}") -> DataFrame:
    """file, encoding, text of all files below a folder; encoding and text are null for files that are no text.  Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), decoded(F.col("content")).alias("d")).select("file", "d.encoding", "d.text")
