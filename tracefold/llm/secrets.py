"""Secret scans with structural confirmation.

Base patterns, leftmost and non-overlapping per kind: an assignment to a secret's name (value of 6
or more), an access key (20 or more) and a run of hex digits (24 or more).  Structural kinds are
reported beside them only when their content parses:

  signed_token  three base64url parts; the first decodes to a JSON object with "alg", the second to a JSON object
  private_key   an armoured PRIVATE KEY block whose base64 body is a private key as below, or an OpenSSH container
                whose strings fill it, or, under a header that says it is encrypted, whole cipher blocks
  der_key       a base64, base64url or hex run, bare or wrapped over lines, whose DER lengths nest to the end and whose
                fields are those of a private key: PKCS#1 (nine integers), DSA (six), PKCS#8, SEC1 or encrypted PKCS#8
  openssh_key   a bare base64 run of such an OpenSSH container

Certificates and public keys are no secrets and are not reported.  A run may begin inside other text of its alphabet: the
DER header gives the length, and as much of the text is taken as it asks for.

Python regular expressions in Arrow batches: code-point offsets and captures per match are not
expressible with built-in functions.  A task holds one batch; batches are cut by row count, and a
text is scanned whole.  No shuffle.  A run of an alphabet is turned into symbols once, a candidate in it is judged by
its headers alone, and what is known of a nested content is kept: the time is in proportion to the text.

Defined results: a null or empty text has no spans; its digest is that of the empty string.  Every
row gives one row, repeated ones too; an empty table gives none; extra columns are ignored.  Spans
of different kinds may overlap.  Offsets count code points; the end is exclusive.  Spans are ordered
by start, then kind as in ``KINDS``, then end.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "signed_token", "private_key", "der_key", "openssh_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so a shorter match never hides a longer one
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
DER_START = re.compile(r"M(?=[A-Za-z0-9+/_-]{15})")  # a SEQUENCE (0x30) begins with M
SSH_START = re.compile(r"b3BlbnNzaC1rZXktdjEA")  # the container's magic
HEX_START = re.compile(r"30(?=(?:[ \t\r\n:]?[0-9a-fA-F]{2}){10})")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Runs: their pieces, the gaps between pieces, the value of each symbol, bits in one.
BASE64 = (re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[ \t\r\n]*"), {ord(c): i for i, c in enumerate(_ALPHABET)} | {ord("-"): 62, ord("_"): 63}, 6)
HEXITS = (re.compile(r"[0-9a-fA-F]+"), re.compile(r"[ \t\r\n:]*"), {ord(c): int(c, 16) for c in "0123456789abcdefABCDEF"}, 4)
#: The magic of an OpenSSH container, and the object identifier (1.2.840.113549.1.5) of password-based encryption.
SSH_MAGIC = b"openssh-key-v1\0"
PBE = bytes.fromhex("2a864886f70d0105")


def from_base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Symbols:
    """A text's run of one alphabet, gaps left out, as symbols of ``width`` bits; all places are in bits.

    It is made once for all places in a run where something may begin; reading at a place costs what is read.
    """

    def __init__(self, codes: bytes, width: int, places: tuple[list[int], list[int]] = ([0], [0]), end: int = 0):
        self.codes, self.width, self.size, self.end = codes, width, len(codes) * width, end
        self.known: dict[tuple[int, int], bool] = {}  # contents that nest, or do not
        self.inside, self.outside = places  # where each piece begins in the codes and in the text

    @classmethod
    def run(cls, text: str, start: int, piece: re.Pattern, gap: re.Pattern, table: dict[int, int], width: int) -> Symbols:
        """The run that goes on from ``start``."""
        pieces, inside, outside, at, n = [], [], [], start, 0
        while m := piece.match(text, at):
            pieces.append(m.group())
            inside.append(n)
            outside.append(at)
            n, at = n + len(m.group()), gap.match(text, m.end()).end()
        return cls("".join(pieces).translate(table).encode("latin-1"), width, (inside, outside), outside[-1] + len(pieces[-1]))

    def bit(self, place: int) -> int:
        """Of a place in the text."""
        i = bisect_right(self.outside, place) - 1
        return (self.inside[i] + place - self.outside[i]) * self.width

    def place(self, bit: int) -> int:
        """Where in the text the symbols before ``bit`` end."""
        n = -(-bit // self.width)
        i = bisect_right(self.inside, n - 1) - 1
        return self.outside[i] + n - self.inside[i]

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from bit ``at`` on; fewer at the end."""
        n = min(n, (self.size - at) // 8)
        first, last = at // self.width, -(-(at + 8 * n) // self.width)
        value = 0
        for c in self.codes[first:last]:
            value = value << self.width | c
        return (value >> (last * self.width - at - 8 * n) & ((1 << 8 * n) - 1)).to_bytes(n, "big") if n > 0 else b""


def element(bits: Symbols, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag of the DER element at ``at`` and where its content begins and ends, None if it does not end by ``end``."""
    head = bits.read(at, 6) if at + 16 <= end else b""
    if len(head) < 2:
        return None
    n, start = head[1], at + 16
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + 8 * k > end or len(head) < 2 + k:
            return None
        n, start = int.from_bytes(head[2 : 2 + k], "big"), start + 8 * k
        if n < 0x80:
            return None
    return (head[0], start, start + 8 * n) if start + 8 * n <= end else None


def nests(bits: Symbols, start: int, stop: int) -> bool:
    """Whether elements fill the content from ``start`` to ``stop`` at every depth; what is known of a content is not asked again."""
    open_, at = [(start, stop)], [start]
    while open_:
        if at[-1] == open_[-1][1]:
            bits.known[open_.pop()] = True
            end = at.pop()
            if at:
                at[-1] = end
            continue
        found = element(bits, at[-1], open_[-1][1])
        known = bits.known.get(found[1:]) if found and found[0] & 0x20 else True
        if not found or known is False:
            bits.known.update(dict.fromkeys(open_, False))
            return False
        if known:
            at[-1] = found[2]
        else:
            open_.append(found[1:])
            at.append(found[1])
    return True


def private_end(bits: Symbols, at: int) -> int:
    """Where the private key that begins at ``at`` ends, 0 if none does: PKCS#1, DSA, PKCS#8, SEC1 and encrypted PKCS#8.

    At most eleven headers are read before the layout is known; none of the layouts has more fields.
    """
    top = element(bits, at, bits.size)
    if not top or top[0] != 0x30 or top[2] - at < 24 * 8:
        return 0
    fields, a = [], top[1]
    while a < top[2]:
        found = element(bits, a, top[2])
        if not found or len(fields) == 10 or not fields and found[0] not in (2, 0x30):
            return 0
        fields.append(found)
        a = found[2]
    tags = [t for t, _, _ in fields]
    content = lambda i, n: bits.read(fields[i][1], min(n, (fields[i][2] - fields[i][1]) // 8))
    version = content(0, 2) if tags[:1] == [2] else b""
    first = lambda i: element(bits, fields[i][1], fields[i][2])
    if tags[:9] == [2] * 9 and version in (b"\0", b"\1"):
        held = tags[9:] in ([], [0x30])
    elif tags == [2] * 6:
        held = version == b"\0"
    elif tags[:3] == [2, 0x30, 4] and version in (b"\0", b"\1"):
        kind = first(1)
        held = kind is not None and kind[0] == 6 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    elif tags[:2] == [2, 4]:
        held = version == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}
    elif tags == [0x30, 4]:
        kind = first(0)
        held = kind is not None and kind[0] == 6 and bits.read(kind[1], min(len(PBE), (kind[2] - kind[1]) // 8)) == PBE
    else:
        held = False
    return top[2] if held and nests(bits, top[1], top[2]) else 0


def is_private_key(data: bytes | None) -> bool:
    """Whether the bytes are one private key."""
    return bool(data) and private_end(Symbols(data, 8), 0) == 8 * len(data)


def ssh_end(bits: Symbols, at: int) -> int:
    """Where the OpenSSH container that begins at ``at`` ends, 0 if it holds none; it is of one key, as the format is written."""
    if bits.read(at, len(SSH_MAGIC)) != SSH_MAGIC:
        return 0
    at += 8 * len(SSH_MAGIC)
    for part in range(5):  # cipher, key derivation, its options, then how many, the public key and the private part
        if part == 3:
            if bits.read(at, 4) != b"\0\0\0\1":
                return 0
            at += 32
        head = bits.read(at, 4)
        at += 32 + 8 * int.from_bytes(head, "big")
        if len(head) < 4 or at > bits.size:
            return 0
    return at


def is_private_body(body: str) -> bool:
    """The body of an armoured block, lines perhaps parted by a written backslash and n."""
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    headers = [x for x in lines if ":" in x]
    data = from_base64("".join(x for x in lines if ":" not in x).replace(" ", "").replace("\\", ""))
    if any(h.startswith("Proc-Type:") and "ENCRYPTED" in h for h in headers):
        return bool(data) and len(data) % 8 == 0
    return bool(data) and (ssh_end(Symbols(data, 8), 0) == 8 * len(data) or is_private_key(data))


def is_signed_token(parts: list[str]) -> bool:
    if not parts[0].startswith(("ey", "ew")):  # an opening brace
        return False
    try:
        first, second = (json.loads((from_base64(x) or b"").decode()) for x in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def run_spans(text: str, starts: re.Pattern, run: tuple, ends: Callable[[Symbols, int], int], kind: str) -> list[tuple[int, str, int]]:
    """What ``ends`` confirms of the places that match ``starts``, leftmost first; a run of symbols is read once."""
    out, after, bits = [], 0, None
    for m in starts.finditer(text):
        if m.start() < after:
            continue
        if bits is None or m.start() >= bits.end:
            bits = Symbols.run(text, m.start(), *run)
        if end := ends(bits, bits.bit(m.start())):
            after = bits.place(end)
            out.append((m.start(), kind, after))
    return out


def der_spans(text: str) -> list[tuple[int, str, int]]:
    return run_spans(text, DER_START, BASE64, private_end, "der_key") + run_spans(text, HEX_START, HEXITS, private_end, "der_key")


def ssh_spans(text: str) -> list[tuple[int, str, int]]:
    return run_spans(text, SSH_START, BASE64, ssh_end, "openssh_key")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    low = text.lower()
    out = []
    if any(w in low for w in NAMES):  # a name is there, so the pattern is worth its time
        out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def token_spans(text: str) -> list[tuple[int, str, int]]:
    out = []
    for m in DOTTED.finditer(text):
        parts, at, last = m.group().split("."), m.start(), -3
        for i in range(len(parts) - 2):
            if i >= last + 3 and is_signed_token(parts[i : i + 3]):
                out.append((at, "signed_token", at + sum(map(len, parts[i : i + 3])) + 2))
                last = i
            at += len(parts[i]) + 1
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    out = token_spans(text) if text.count(".") > 1 else []
    armoured = []
    if "-----BEGIN" in text:
        armoured = [(m.start(), "private_key", m.end()) for m in ARMOUR.finditer(text) if is_private_body(m.group(2))]
    # what stands in an armoured block is part of it
    bare = [x for x in der_spans(text) + ssh_spans(text) if not any(a <= x[0] < b for a, _, b in armoured)]
    return out + armoured + bare


def order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def find(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans of a whole text, as (start, kind, end)."""
    if not text:
        return [], []
    base = order(base_spans(text))
    return base, order(base + confirmed_spans(text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and spans, arrays of (kind, start, end)."""
    span = "array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find(t) for t in batch["text"]]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, k, b in spans]
            yield pd.DataFrame({"id": batch["id"], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, base {span}, spans {span}")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (see the module's text)."""
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *(count(k) for k in KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
