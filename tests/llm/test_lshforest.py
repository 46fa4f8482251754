import random
from collections import Counter

import pyarrow as pa
import pytest
from firmlens.llm import lshforest
from pyspark.sql import functions as F


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    texts = {}
    for k, t in rows:
        texts.setdefault(t or "", []).append(k)
    sets = {t: shingles(t) for t in texts}
    names = list(texts)
    links, up = Counter(), {t: t for t in names}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for t in names:
        least[root(t)] = min(least.get(root(t), 10**9), *texts[t])
    return sorted((k, least[root(t or "")], links[t or ""], len(texts[t or ""])) for k, t in rows)


def corpus(n=150, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows, base = [], [word() for _ in range(60)]
    for k in range(n):
        w = [word() for _ in range(rng.randint(0, 60))] if k % 3 else list(base)
        if k % 3 == 0:
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
        if k % 5 == 0:
            w += passage
        rows.append((k, " ".join(w)))
    return [*rows, (n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, "one two"), (n + 4, "one  two"), (n + 5, " \n"), (n + 6, " ".join(base * 400)), (n + 7, " ".join([*base * 400, "end"]))]


@pytest.mark.parametrize("sizes", [{}, {"PAIRWISE": 3, "BLOCK": 9, "BROADCAST_NODES": 0}, {"PAIRWISE": 2, "BLOCK_BYTES": 1500}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(lshforest, k, v)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in lshforest.near_classes(df).collect())
    assert got == brute(rows)


def test_keep_first(spark):
    rows = [(1, "a b c d e f", 7), (1, "a b c d e f", 7), (2, "a b c d e f", 8), (None, "x y z", 9), (3, None, 1), (4, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = lshforest.keep_first(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a b c d e f", 7), (None, "x y z", 9), (3, None, 1)]))
    assert lshforest.keep_first(df.limit(0)).count() == 0


def test_depth():
    assert lshforest.prefix_depth() == 4
    assert lshforest.prefix_depth(target=0.5) == lshforest.MAX_DEPTH


def test_recall_is_measured_and_shortens_the_prefixes():
    deepest = lshforest.MAX_DEPTH
    # without links only the guard at the threshold counts
    assert lshforest.measured_recall({}, deepest) == pytest.approx(lshforest.chance(0.8, deepest))
    # many links far above the threshold don't hide those near it
    assert lshforest.measured_recall({19: 10**6, 0: 10}, deepest) < lshforest.TARGET_RECALL <= lshforest.measured_recall({19: 10**6, 0: 10}, 4)
    # a million links of 0.84 to 0.85 are found by a longer prefix
    assert lshforest.measured_recall({4: 10**6}, 5) >= lshforest.TARGET_RECALL > lshforest.measured_recall({0: 10**6}, 5)


def test_common_prefixes():
    import numpy as np

    labels = [b"\x00" + x for x in (b"aabbccddeeffgghh", b"aabbccddeeffggii", b"aabbxxddeeffgghh", b"zzbbccddeeffgghh")] + [b"\x01" + b"zzbbccddeeffgghh"] * 2
    t = pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.arange(6))], ["label", "node"])
    for parts in ([t], [t.slice(0, 3), t.slice(3, 0), t.slice(3)], [t.slice(i, 1) for i in range(6)]):
        got = pa.Table.from_batches(list(lshforest._common_prefixes(parts)))
        # the first and last rows of a partition count as matched
        assert got.column("lcp").to_pylist() == [8, 7, 2, 0, 8, 8] and got.column("label").to_pylist() == labels


def test_recall_against_brute_force(spark):
    """Pairs of just over 0.8: one word in a text of fifty or more is another."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows = []
    for g in range(400):
        w = [word() for _ in range(rng.randint(52, 60))]
        rows.append((2 * g, " ".join(w)))
        w[rng.randrange(5, len(w) - 5)] = word()
        rows.append((2 * g + 1, " ".join(w)))
    want = {k: links for k, _, links, _ in brute(rows[:100])}
    got = {r["doc_id"]: r["n_links"] for r in lshforest.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == n for k, n in want.items()) and sum(want.values()) == 100
    assert sum(got.values()) == len(rows)


def test_a_large_group_loses_no_links(spark, monkeypatch):
    """Many texts around one base that differ from each other: dealt to many pairs of blocks."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(90)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(lshforest, "BLOCK", 11)
    monkeypatch.setattr(lshforest, "PAIRWISE", 4)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in lshforest.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_signatures_of_long_texts():
    """Unrelated sets of any size agree in next to no MinHash."""
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (10, 1000, 1_000_000):
        hashes = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = lshforest.minhashes(hashes, np.array([0, n]))
        assert (a == b).mean() < 0.01


def near_copies(n, edits, seed, words=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


def test_heavy_groups_are_settled_and_lose_no_links(spark, monkeypatch):
    for k, v in {"HEAVY": 8, "BLOCK": 11, "PAIRWISE": 4, "VOTERS": 9, "SALT_ROWS": 10}.items():
        monkeypatch.setattr(lshforest, k, v)
    texts = near_copies(90, 2, 21) + near_copies(60, 4, 22) + near_copies(30, 9, 23) + near_copies(3, 1, 24)
    texts += [texts[0] + " " + texts[100]] + near_copies(40, 0, 25)
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = {}
    settle = lshforest.settle
    monkeypatch.setattr(lshforest, "settle", lambda *a: seen.setdefault("got", settle(*a)))
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in lshforest.near_classes(df).collect())
    assert got == sorted(brute(rows))
    sizes = {r["lead"]: r["size"] for r in seen["got"].collect()}
    assert sum(sizes.values()) >= 0.8 * len(set(texts[:150]))  # most of the first two groups, in few classes
    assert len(sizes) <= 6


def test_blocks_of_one_class_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "BLOCK", 10)
    label = bytes(1 + 2 * lshforest.MAX_DEPTH)
    rows = [(label, k, 8, 5, 0 if k < 500 else None) for k in range(520)]
    members = spark.createDataFrame([(bytearray(a), *b) for a, *b in rows], "label binary, node long, lcp int, n long, lead long").withColumn("lead", F.col("lead") + 1)
    got = lshforest.units(members, 4)
    # 50 blocks of the class meet two of the rest: not 520 rows for each of 52 blocks
    assert got.count() == 500 * 2 + 20 * 52
    pairs = Counter(r["unit"] for r in got.collect())
    assert len(pairs) == 50 * 2 + 3


def test_of_equal_rows_the_least_stays(spark):
    rows = [(1, "a b c d e f", f"src{k}", k) for k in range(4)]
    for order, parts in ((rows[::-1], 1), ([rows[2], rows[0], rows[3], rows[1]], 4)):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, n int").repartition(parts).withColumn("m", F.create_map(F.lit("x"), F.col("n")))
        assert [tuple(r)[:4] for r in lshforest.keep_first(df).collect()] == [rows[0]]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8)], "doc_id long, text string, _node int, _key int, _null int, __node int")
    assert [tuple(r) for r in lshforest.keep_first(df).collect()] == [(1, "a b c d e f", 1, 2, 3, 4)]
