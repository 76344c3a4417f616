"""Byte-pair encoding and decoding with a public vocabulary (byte-level BPE in a tokenizers JSON file).

A text is cut at the special tokens and then into pre-tokens.  The bytes of a pre-token form a doubly
linked list of symbols, a priority queue holds the ranks of adjacent pairs, the lowest rank (leftmost
among equals) is merged, and entries whose symbols have changed meanwhile are skipped as stale.
Decoding concatenates vocabulary strings and maps them back to bytes; bytes that are not UTF-8 give U+FFFD.

Python in Arrow batches: the merge loop is sequential per word.  No shuffle.  A Python worker holds a batch,
the vocabulary (its size is fixed) and the ids of at most 2 * ``CACHE`` short pre-tokens, which it keeps from
task to task: those of the older half go when the younger half is full.  What a cache holds never changes a result.
The vocabulary's path is a parameter; it is read on the driver and travels inside the task closure.

Defined results: a null text counts as empty and has no tokens; its digests are those of no bytes.
Every row gives one row, repeated ones too; an empty table gives none.  Extra columns are ignored by
``encode`` and kept by the pipeline's stage.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CACHE = 250_000  # some 45 MB
#: Fixed value: the published pre-token pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Recent(dict):
    """Ids of pre-tokens as little-endian bytes: those used since the last turn, and those of the turn before."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self.make(word)
        if len(word) < 48:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    def __init__(self, spec: str):
        model = json.loads(spec)
        self.ids: dict[str, int] = model["model"]["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"])
        top = max(self.ids.values()) + 1
        self.after: list[dict[int, int]] = [{} for _ in range(top)]  # by left id: right id, rank of the pair
        self.merged: list[int] = []  # by rank
        for rank, (a, b) in enumerate(pairs):
            self.after[self.ids[a]][self.ids[b]] = rank
            self.merged.append(self.ids[a + b])
        self.packed = [i.to_bytes(4, "little") for i in range(top)]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        letters = byte_letters()
        self.single = [self.ids[c] for c in letters]
        self.first = [[self.after[a].get(b) for b in self.single] for a in self.single]  # ranks of pairs of bytes
        self.cut = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte_of = {c: b for b, c in enumerate(letters)}
        self.strings = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for s, i in self.ids.items():
            self.strings[i] = s.encode() if s in self.special else bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.words = _Recent(self.word)

    def word(self, word: str) -> bytes:
        after, merged, first, packed = self.after, self.merged, self.first, self.packed
        raw = word.encode()
        symbols = [self.single[b] for b in raw]
        n = len(symbols)
        # an entry is a rank and a place: 40 bits hold any place
        queue = [r << 40 | i for i, (a, b) in enumerate(zip(raw, raw[1:])) if (r := first[a][b]) is not None]
        heapq.heapify(queue)
        many = list if n < 1 << 16 else functools.partial(array.array, "q")
        right, left = many(range(1, n + 1)), many(range(-1, n - 1))
        while queue:
            top = heapq.heappop(queue)
            i, rank = top & 0xFFFFFFFFFF, top >> 40
            j, a = right[i], symbols[i]
            if a < 0 or j >= n or after[a].get(symbols[j]) != rank:
                continue  # stale: one of the two has been merged away
            symbols[i], symbols[j] = new, _ = merged[rank], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := after[new].get(symbols[k])) is not None:
                    heapq.heappush(queue, r << 40 | i)
            if (h := left[i]) >= 0 and (r := after[symbols[h]].get(new)) is not None:
                heapq.heappush(queue, r << 40 | h)
        return b"".join([packed[s] for s in symbols if s >= 0])

    def stretch(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.split.split(text) if self.split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.append(self.stretch(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, numbers(ids))).decode("utf-8", "replace")


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


_made: dict[int, Bpe] = {}


def _coder(spec: str) -> Bpe:
    """One coder per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(spec)
    return _made[key]


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of tokens), decoded (text of those ids)."""
    spec = open(vocabulary or default_vocabulary(), encoding="utf-8").read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(spec)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = [coder.encode(t or "") for t in part["text"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "ids": [numbers(x) for x in ids], "decoded": [coder.decode(x) for x in ids]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and digests of the ids and of the decoded text, without moving tokens out of the task."""
    spec = open(vocabulary or default_vocabulary(), encoding="utf-8").read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(spec)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch["text"]:
                ids = coder.encode(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"id": batch["id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256 (see the module's text)."""
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
