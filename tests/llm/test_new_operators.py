"""Language, valid-time enrichment and fill-in-the-middle against brute force, on small tables and awkward rows."""

import hashlib
import os
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tracefold.llm import fill_middle, language, valid_time

from valid_time_brute import valid_time as brute_valid_time

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, digest int, starts int, n int, key int, x int"
SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "src0", 1, "x", 1, 2, 3, 4, 5) for i, t, lang in rows], DOC)


# ---- fill in the middle ----


@pytest.mark.parametrize("values", [[0], [0, 0, 0], list(range(3000)), list(range(0, 9000, 3)), sorted(np.random.default_rng(1).integers(0, 10**6, 2000).tolist())])
def test_elias_fano_selects_every_value(values):
    blob = fill_middle.elias_fano(np.array(values, np.int64))
    assert [fill_middle.select(blob, i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        fill_middle.select(blob, len(values))


def brute_fill(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", text
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", text


@pytest.mark.parametrize("pieces", [3, 1000])  # few pieces: the copies are not hot
def test_fill_in_middle_equals_brute_force(spark, pieces):
    from pyspark.sql import functions as F

    odd = [None, "", "a", "é", "\U0001f600", "<", "a<S>b", "<P", "<M<S<P", ">>><<<", "ß" * 700 + "x", "\n\t ", "日本語テキスト" * 300, "y" * 200_000]
    rows = [(i, odd[i % len(odd)]) for i in range(140)] + [(1000 + i, "a copy äöü of many") for i in range(60)] + [(None, "no name"), (7, odd[7]), (7, odd[7])]
    found = fill_middle.fill_in_middle(table(spark, [(*r, "en") for r in rows]), pieces=pieces)
    got = found.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).select("id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    assert Counter(map(tuple, got)) == Counter(brute_fill(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(table(spark, [])).collect() == []


# ---- language ----


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_on_held_out_rows(spark):
    found = language.op11_language_id(spark, SF)
    truth = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = found.collect()
    assert len(rows) == len(truth) and found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_never_sees_held_out_rows_or_labels(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    seen = [i for i in range(200) if i not in held]
    rows = [(i, "aaa aab aba" if i % 2 else "zzz zzy zyz", "fr" if i % 2 else "de") for i in seen]
    wrong = [(i, "aaa aab aba", "de") for i in held]
    model = language.train(table(spark, rows + wrong))
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", None), (4, "½ ² _", None), (None, "aaa", None), (5, "aaa " * 400_000, None), (6, "zzz", "fr"), (6, "zzz", "fr")]
    got = Counter((r.id, r.lang_pred) for r in language.predict(table(spark, odd + wrong), model).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "und"), (None, "fr"), (5, "fr"), (6, "de"), (6, "de")] + [(i, "fr") for i in held])


def test_language_without_labels_and_with_one(spark):
    assert language.train(table(spark, [])) is None and language.train(table(spark, [(1, "word", None), (3, None, "en")])) is None
    assert [tuple(r) for r in language.predict(table(spark, [(1, "word", "en")]), None).collect()] == [(1, "und", 0.0)]
    one = language.train(table(spark, [(i, "word", "xx") for i in range(8)]))
    assert [tuple(r) for r in language.predict(table(spark, [(1, "other", None)]), one).collect()] == [(1, "xx", 1.0)]
    assert language.predict(table(spark, []), one).collect() == []


def test_machine_finds_the_optimum():
    """The primal objective at the fitted weights against plain gradient descent on it."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.4, 1.0, -1.0)
    x[:, 0] += y
    full = np.hstack([x, np.ones((60, 1))])
    c = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    loss = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    w = np.zeros(6)
    for _ in range(20_000):
        w -= 0.002 * (w - 2 * (c * y * np.maximum(0, 1 - y * (full @ w))) @ full)
    assert loss(language.machine(x, y, cost=1.0, epochs=2000, tolerance=1e-7)) <= loss(w) * (1 + 1e-4)


def test_blocks_of_long_texts_count_like_one(monkeypatch):
    text = "Ein Satz über Wörter und Zahlen, " * 50
    whole = language.grams(text)
    monkeypatch.setattr(language, "BLOCK", 97)
    assert np.allclose(whole, language.grams(text))


# ---- valid time ----

DAY = datetime(2024, 1, 1)
SALE = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, kind string, batch int"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, slice long"


def shop(n=700):
    rng = np.random.default_rng(5)
    client = lambda: None if rng.random() < 0.03 else 7 if rng.random() < 0.4 else int(rng.integers(0, 40))
    sales, changes = [], []
    for i in range(n):
        sold = DAY + timedelta(minutes=int(rng.integers(0, 150 * 1440 // 30)) * 30, microseconds=int(rng.integers(0, 2)))
        arrived = sold + timedelta(hours=int(rng.integers(0, 60)))
        sales.append((i, client(), None if rng.random() < 0.03 else sold, None if rng.random() < 0.02 else arrived))
    for i in range(n):
        at = DAY + timedelta(minutes=int(rng.integers(0, 150 * 1440 // 30)) * 30)
        changes.append({"change_id": i, "client_id": client(), "seq": None if rng.random() < 0.05 else int(rng.integers(0, 5)), "op": None if rng.random() < 0.1 else "IUD"[i % 3], "valid_at": None if rng.random() < 0.03 else at, "balance": None if rng.random() < 0.05 else float(rng.integers(-9999, 9999)) / 100})
    return sales + sales[:20], changes + changes[:20]


def frames(spark, sales, changes):
    s = spark.createDataFrame([(i, c, "done", 1.0, sold, arrived, 1, "x", 9) for i, c, sold, arrived in sales], SALE)
    c = spark.createDataFrame([(c["change_id"], c["client_id"], c["seq"], c["op"], c["valid_at"], "web", "s", "c", c["balance"], 5) for c in changes], CHANGE)
    return s, c


@pytest.mark.parametrize(("rows_per_key", "batches"), [(30, 8), (10_000, 3)])  # few rows to a key: clients are cut into slices of time
def test_valid_time_equals_brute_force(spark, rows_per_key, batches):
    sales, changes = shop()
    got = valid_time.enrich(*frames(spark, sales, changes), batches=batches, rows_per_key=rows_per_key, pieces=50).collect()
    assert Counter(map(tuple, got)) == Counter(brute_valid_time(sales, changes, batches))


def test_valid_time_of_empty_tables(spark):
    assert valid_time.enrich(*frames(spark, [], []), batches=1).collect() == []


def test_bisect_and_prune():
    frame = lambda rows: pd.DataFrame(rows, columns=["client", "at", "seq", "id", "cents", "op", "settled"])
    versions = frame([(1, 5, 0, 1, 0, "a", False), (1, 5, 1, 2, 0, "a", False), (1, 9, 0, 3, 0, "a", False), (4, 2, 0, 4, 0, "a", False)])
    place, held = valid_time.bisect(versions, pd.DataFrame({"client": [1, 1, 1, 4, 3, 1], "id": 0, "at": [4, 5, 8, 100, 100, valid_time.NONE]}))
    assert place.tolist() == [-1, 1, 1, 3, -1, -1] and held.tolist() == [3, 3, 3, 1, 0, 3]
    left = valid_time.pruned(versions, 5)
    assert left["id"].tolist() == [2, 3, 4] and left["settled"].tolist() == [True, False, True]
    assert valid_time.pruned(left, 9)["id"].tolist() == [3, 4]
