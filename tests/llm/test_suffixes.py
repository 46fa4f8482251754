import hashlib
import random

import numpy as np
from firmlens.llm import suffixes


def brute(rows):
    seen, out = set(), []
    for k, t in sorted({(k, t or "") for k, t in rows}, key=lambda r: -(2**63) if r[0] is None else r[0]):
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = [say(40) for _ in range(4)]
    rows = []
    for k in range(60):
        t = say(rng.randint(0, 120))
        if k % 3 == 0:
            t += " " + rng.choice(passage) + " " + say(rng.randint(0, 30))
        if k % 7 == 0 and rows:
            w = rng.choice(rows)[1].split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        if k % 11 == 0:
            t = rng.choice(["ab", "x", "Shti "]) * rng.randint(10, 200) + t
        rows.append((k, t))
    return [*rows, (100, rows[0][1]), (101, ""), (102, None), (None, passage[0]), (103, passage[0][:99]), (104, passage[1][-100:]), (105, "y" * 5000)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, suffixes.dedup(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_equals_brute_force(spark):
    check(spark, corpus())


def test_hot_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 1)
    check(spark, corpus())


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "z" * 150), (1, "z" * 150)], "doc_id long, text string")
    assert {r["n_removed"] for r in suffixes.dedup(df).collect()} == {149}
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_multikey_order():
    rows = np.random.default_rng(2).integers(0, 2, (500, 100), dtype=np.uint8)
    rows[100:200] = rows[:100]
    rows[200:300, :90] = rows[:100, :90]
    got = [rows[i].tobytes() for i in suffixes.multikey_order(rows)]
    assert got == sorted(got)


def test_suffix_order():
    """Neighbours in the order share as many leading bytes as said; repeats are read from that order."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (400, 30), dtype=np.uint8)
    rows[50:90, :25] = rows[:40, :25]
    order, common = suffixes.suffix_order(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(got)
    for a, b, n in zip(got, got[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 30 or a[n] != b[n])


def test_the_order_decides(monkeypatch):
    """Without the sort, equal windows that don't stand together would be missed."""
    rng = np.random.default_rng(4)
    ctx = rng.integers(0, 256, (60, suffixes.LEFT + suffixes.LENGTH), dtype=np.uint8)
    ctx[40:] = ctx[:20]
    n = len(ctx)
    args = (np.arange(n), np.zeros(n, np.int64), np.full(n, 500), np.full(n, suffixes.LEFT), np.full(n, suffixes.LENGTH), ctx)
    got = suffixes.repeated_windows(*args)
    assert len(got) == suffixes.LEFT + 1 and all(sorted(rows) == list(range(40, 60)) for rows, _ in got)
    monkeypatch.setattr(suffixes, "multikey_order", lambda rows: np.arange(len(rows)))
    assert suffixes.repeated_windows(*args) == []


def test_long_texts(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghij ") for _ in range(30_000))
    check(spark, [(1, long), (2, "x" + long[100:20_000]), (3, long[25_000:] + "end" + long[:300]), (4, "ab" * 9000)])
