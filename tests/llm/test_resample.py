import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import resample

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent, least, seed, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for c, some in ((s, [x for _, x in docs]), (t, target)):
        for x in some:
            c.update(map(bucket, grams(x, longest)[0]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for k, x in docs:
        g, words = grams(x, longest)
        got = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, g)]
        weight = sum(got) // len(got) if got else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus():
    rng = random.Random(3)
    vocab = ["the", "Cat", "ß", "İstanbul", "中文", "x1", "42", "don't", "a-b", "É", "z\x00y"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(7, docs[7][1]), (8, "the cat"), (None, "cat " * 30), (None, "cat " * 30), (9001, None), (9002, ""), (9003, " \n"), (9004, "\x00\x00"), (9005, "long words here " * 5000)]
    return docs, ["cat the 42", None, "", "中文 x1 cat cat"]


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_brute_force(spark, longest):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "k": F.lit(0)}).repartition(5)
    got = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), 25, 10, 2024, longest, 97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, 25, 10, 2024, longest, 97)


@pytest.mark.parametrize("block", [1, 2, 3, 200_000])
def test_features_never_cross_texts(monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK_WORDS", block)
    texts = [b"a b", b"", b"c", b"d e f"]
    got = [(o, b) for owner, bucket, _ in resample.features(texts, 3, 1 << 40) for o, b in zip(owner.tolist(), bucket.tolist())]
    want = [(k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in grams(t.decode(), 3)[0]]
    assert sorted(got) == sorted(want)


def test_empty_tables_and_ties(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(none, target).count() == 0
    docs = spark.createDataFrame([(1, "w " * 30)] * 50 + [(2, "v " * 5)], "doc_id long, text string")
    got = resample.resample(docs, target.limit(0), percent=50)  # all texts tie but the short one
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 26))
    none_fit = resample.resample(docs, target, least_words=99)
    assert none_fit.count() == 51 and none_fit.filter("rank is not null").count() == 0


def test_gains_are_bounded_by_counts():
    g = resample.gains({0: 5}, {1: 5}, 10)
    assert g[1] > g[2] > g[0] and isinstance(g, np.ndarray) and len(g) == 10


def test_query_equals_brute_force(spark):
    from firmlens.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(map(tuple, queries.op12_batch_resample(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute(docs, target, 10, 20, 2024, 1, 10000)
