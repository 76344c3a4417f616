"""The valid-time contract in plain Python."""

import math
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

EPOCH = datetime(1970, 1, 1)


def _batch(day, n):
    return n - 1 if day is None else max(0, min(n - 1, math.floor((day - 19723) * n / 152)))


def _order(c):
    low = lambda v: (0, 0) if v is None else (1, v)
    return c["valid_at"], low(c["seq"]), low(c["change_id"])


def _cents(c):
    return None if c["balance"] is None or not math.isfinite(c["balance"]) else math.floor(100 * c["balance"] + 0.5)


def valid_time(sales, changes, n=8):
    """Rows of (sale_id, client_id, sold_at, arrived_at) and changes as dicts to (rec, id, batch, n_held, change_id, cents, op)."""
    new_sales, new_changes = defaultdict(list), defaultdict(list)
    for s in sales:
        new_sales[_batch(None if s[3] is None else (s[3] - EPOCH).days, n)].append(s)
    for c in {repr(sorted(c.items())): c for c in changes}.values():
        if c["valid_at"] is not None:
            shift = zlib.crc32(("" if c["change_id"] is None else str(c["change_id"])).encode()) % 4
            new_changes[_batch((c["valid_at"] - EPOCH).days + shift, n)].append(c)
    held, waiting, out = defaultdict(list), [], []

    def emit(s, b):
        own = held[s[1]] if s[1] is not None else []
        best = max((c for c in own if s[2] is not None and c["valid_at"] <= s[2]), key=_order, default=None)
        out.append(("sale", s[0], b, len(own), *((best["change_id"], _cents(best), best["op"]) if best else (None, None, None))))

    def mark(tops):
        tops = [t for t in tops if t is not None]
        return max(tops) - timedelta(hours=12) if tops else datetime.min

    for b in range(n):
        changes_mark = mark(c["valid_at"] for k in range(b) for c in new_changes[k])
        low = min(changes_mark, mark(s[2] for k in range(b) for s in new_sales[k]))
        for c in new_changes[b]:
            if c["valid_at"] < changes_mark:
                out.append(("late", c["change_id"], b, None, None, None, None))
            elif c["client_id"] is not None:
                held[c["client_id"]].append(c)
        here, waiting = waiting + new_sales[b], []
        for s in here:
            if s[2] is None or s[2] < low:
                emit(s, b)
            else:
                waiting.append(s)
        for k, own in held.items():
            held[k] = sorted((c for c in own if c["valid_at"] <= low), key=_order)[-1:] + [c for c in own if c["valid_at"] > low]
    for s in waiting:
        emit(s, n)
    return out
