"""Text extraction as Column expressions; all stay inside the JVM but those that look up many offsets of a text."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fences in the order they are deleted.
FENCES = ("```python", "```cpp", "```c++", "```c", "```")
#: Characters escaped in each context of a diagnostic template.
ESCAPED = {"special": r".^$+?{}[]\()", "diff": r".*^+?{}[]\()", "literal": r".^$*+|?{}[]\()", "select": r".^$*+?{}[]\()"}


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-?]*[ -/]*[@-~]", "")


def error_messages(c: Column) -> Column:
    """Array of messages of terminated ``: error:`` lines."""
    return F.regexp_extract_all(c, F.lit(r":\s+error:\s+([^\n]*)\n"), F.lit(1))


#: Fixed value: an annotation and its content.
ANNOTATION = r"(expected-error(?:@(?:\+\d+|[\w.]+:\*?))?)\s*\{\{([^}]+)\}\}"
_ANNOTATION = re.compile(ANNOTATION, re.ASCII)


class Lines:
    """Where the lines of a text begin, found once; an offset is looked up by binary search."""

    def __init__(self, text: str):
        self.text, self.breaks = text, [m.start() for m in re.finditer("\n", text)]

    def number(self, offset: int) -> int:
        """1-based line of a 0-based offset; one on a newline is on the line that ends there."""
        return bisect_left(self.breaks, offset) + 1

    def line(self, offset: int) -> str:
        """The line of an offset with the continuations that follow it."""
        _, start, size = self.span(offset)
        return self.text[start : start + size]

    def span(self, offset: int) -> tuple[int, int, int]:
        """Number, start and size of the line of an offset with the continuations that follow it."""
        i = last = bisect_left(self.breaks, offset)
        start = self.breaks[i - 1] + 1 if i else 0
        while last < len(self.breaks) and self.breaks[last] > 0 and self.text[self.breaks[last] - 1] == "\\" and self.breaks[last] > offset:
            last += 1
        return i + 1, start, (self.breaks[last] if last < len(self.breaks) else len(self.text)) - start


def _lists(sizes: list[int | None], fields: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs from the columns of their fields and the size of each list; None is a null list."""
    starts = [0, *accumulate(n or 0 for n in sizes)]
    offsets = [None if n is None else start for start, n in zip(starts, sizes)] + starts[-1:]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def annotations_of(texts: pa.Array) -> pa.Array:
    """``expected_annotations`` of a batch; one text at a time is an object of Python."""
    sizes, full, content, line = [], [], [], array("q")
    for t in texts:
        if not t.is_valid:
            sizes.append(None)
            continue
        text, before = t.as_py(), len(line)
        at = number = 0
        for m in _ANNOTATION.finditer(text):
            number, at = number + text.count("\n", at, m.start()), m.start()
            full.append(m.group())
            content.append(m.group(2).strip(" "))
            line.append(number + 1)
        sizes.append(len(line) - before)
    return _lists(sizes, {"full": pa.array(full, pa.string()), "content": pa.array(content, pa.string()), "line": pa.array(np.array(line, np.int64))})


def expected_annotations(c: Column) -> Column:
    """Array of (full, content, line) of expected-error comments; lines count from 1.  Arrow batches: one pass over a text."""
    return F.arrow_udf(annotations_of, "array<struct<full: string, content: string, line: long>>")(c)


def spans_of(texts: pa.Array, offsets: pa.Array) -> pa.Array:
    """``line_spans`` of a batch: numbers alone, however long the lines are."""
    sizes, found = [], (array("q"), array("q"), array("q"))
    for t, o in zip(texts, offsets):
        if not (t.is_valid and o.is_valid):
            sizes.append(None)
            continue
        lines, places = Lines(t.as_py()), o.as_py()
        for place in places:
            for column, x in zip(found, lines.span(place)):
                column.append(x)
        sizes.append(len(places))
    number, start, size = (np.array(x, np.int64) for x in found)
    return _lists(sizes, {"number": pa.array(number), "start": pa.array(start.astype(np.int32)), "size": pa.array(size.astype(np.int32))})


def line_spans(c: Column, offsets: Column) -> Column:
    """Array of (number from 1, start from 0, size) of the lines of an array of 0-based offsets, continuations included, in its order."""
    return F.arrow_udf(spans_of, "array<struct<number: long, start: int, size: int>>")(c, offsets)


def span_lines(c: Column, spans: Column) -> Column:
    """The lines that ``line_spans`` found, cut from the text outside of Python."""
    return F.transform(spans, lambda s: F.substring(c, s["start"] + 1, s["size"]))


def line_numbers(c: Column, offsets: Column) -> Column:
    """1-based lines of an array of 0-based offsets, in its order; for many offsets in long texts."""
    return F.transform(line_spans(c, offsets), lambda s: s["number"])


def lines_at(c: Column, offsets: Column) -> Column:
    """The lines of an array of 0-based offsets, as ``line_at_offset`` gives them."""
    return span_lines(c, line_spans(c, offsets))


def run_lines(c: Column, most: int = 5) -> Column:
    """The first ``most`` lines that begin with ``// RUN:``."""
    return F.slice(F.filter(F.split(c, "\n"), lambda x: x.startswith("// RUN:")), 1, most)


def pragma_scope(c: Column, line: Column) -> Column:
    """lines, start, end (from 1) of the text from a line with ``#`` to the first line from there on with a semicolon; null if it has no ``#``.

    A scope that no semicolon ends is its first line.  Semicolons in comments count.
    """
    trimmed = lambda t: F.transform(t, lambda x: F.trim(x))
    bound = F.transform(F.array(F.split(c, "\n")), lambda t: F.struct(t.alias("t"), F.array_position(F.transform(F.slice(t, line, F.size(t)), lambda x: x.contains(";")), True).cast("int").alias("n")))
    s = F.get(F.filter(bound, lambda s: F.get(s["t"], line - 1).contains("#")), 0)
    n = F.greatest(s["n"], F.lit(1))
    return F.when(s.isNotNull(), F.struct(trimmed(F.slice(s["t"], line, n)).alias("lines"), line.alias("start"), (line + n - 1).alias("end")))


#: Fixed values in it: the report's labels.
def annotation_report(file: Column, line: Column, full: Column, content: Column) -> Column:
    """A block of the console report of annotations."""
    return F.concat_ws("\n", F.concat(F.lit("File: "), file), F.concat(F.lit("Line: "), line.cast("string")), F.concat(F.lit("Full Error: "), full), F.concat(F.lit("Error Content: "), content), F.lit("-" * 80))


def diag_ids(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"DiagID:\s*(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def line_number(c: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(c, F.lit(1), offset)
    return (F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_at_offset(c: Column, offset: Column) -> Column:
    """The line of a 0-based offset (an offset on a newline is on the line it ends), with its backslash continuations."""
    before = F.substring_index(F.substring(c, F.lit(1), offset), "\n", -1)
    after = F.regexp_extract(F.substring(c, offset + 1, F.char_length(c)), r"^((?:[^\n]*\\\n)*[^\n]*)", 1)
    return F.concat(before, after)


def code_deformat(c: Column, unwrap_ticks: bool = False) -> Column:
    out = c
    for fence in FENCES:
        out = F.replace(out, F.lit(fence), F.lit(""))
    if unwrap_ticks:
        single = c.startswith("`") & c.endswith("`") & ~c.startswith("``") & (F.char_length(c) > 1)
        out = F.when(single, F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(out)
    return out


def escape(c: Column, context: str) -> Column:
    chars = "".join("\\" + x for x in ESCAPED[context])
    return F.regexp_replace(c, f"([{chars}])", r"\\$1")


def remove_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"//[^\n]*\n", "\n")


def normalise_summary(c: Column) -> Column:
    """Trim lines, drop comments, unescaped quotes and breaks, make runs of white space one blank."""
    out = F.regexp_replace(c, r"(?dm)^\s+", "")
    out = remove_comments(out)
    out = F.regexp_replace(out, r'(?<!\\)"', "")
    out = F.regexp_replace(out, r"\n|\r|\t|\\n", "")
    return F.trim(F.regexp_replace(out, r"[\s\x0B]+", " "))


def line_count(c: Column) -> Column:
    """Lines as a reader counts them: a last newline opens none."""
    n = F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    return (n + F.when((F.char_length(c) > 0) & ~c.endswith("\n"), 1).otherwise(0)).cast("long")


def kind_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def stem_name(path: Column) -> Column:
    """Base name without .cpp and .c."""
    return F.replace(F.replace(F.substring_index(path, "/", -1), F.lit(".cpp"), F.lit("")), F.lit(".c"), F.lit(""))


def modified_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)$", "_modified$1")


def has_source_extension(path: Column) -> Column:
    #: Extensions of source files.
    out = F.lit(False)
    for ext in (".c", ".cpp", ".cxx", ".cc", ".c++"):
        out = out | path.endswith(ext)
    return out
