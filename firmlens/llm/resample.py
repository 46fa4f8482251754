"""Importance resampling towards a target distribution over hashed n-grams, by batch concatenation.

The texts of a batch are lower-cased (A-Z only) and joined with a sentinel that is no part of any word, so that one pass of one
regular expression finds the words of all of them. A search of the words' places in the sorted offsets of the texts says whose they are; runs of
consecutive words that lie in two texts are masked before the buckets of the others are counted.

The corpus and the target are counted in this way, each task giving one count for a bucket at most. A bucket's gain is the
logarithm of its share in the target over its share in the corpus (both with one added to each bucket), and a text's weight is the floored mean of its features' gains. Gumbel noise
seeded by the key makes the highest scores a sample without replacement in proportion to the weights. The cut is found from the number of texts
at each score, a bounded table; only texts from the cut up are range-partitioned and numbered.

Defined results: null or empty texts, and texts without words, have no features and the weight 0; a null key is hashed as an empty string and comes last among ties;
rows with equal keys have the same noise, and if they tie the one with fewer features comes first; repeated rows are drawn each; very long texts are worked on in blocks of
`BLOCK_WORDS` words; an empty table gives an empty result, an empty target one of equal shares; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut
from firmlens.llm.tokens import _byte_groups

BUCKETS = 10_000
#: Words of lower-cased UTF-8: digits, a to z, and every character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\x00"
GROUP_BYTES = 1_000_000
BLOCK_WORDS = 200_000
REMEMBER = 300_000


class _Hashes(dict):
    """The CRC-32 of a word; what is remembered is bounded, and long words aren't remembered."""

    def __missing__(self, word):
        h = zlib.crc32(word)
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = h
        return h


_here = _Hashes()


def features(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, whether the feature is one word) of all runs of 1 to `longest` consecutive words, block by block."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes + 1) - sizes - 1
    found = WORD.finditer(SENTINEL.join(texts).lower())
    words: list[bytes] = []
    owner = np.zeros(0, np.int64)
    crc = _here.__getitem__
    while block := list(islice(found, BLOCK_WORDS)):
        # the last words of the block before, whose longer runs end in this one
        old = len(words)
        words += [m.group() for m in block]
        at = np.fromiter((m.start() for m in block), np.int64, len(block))
        del block
        owner = np.concatenate([owner, np.searchsorted(offsets, at, "right") - 1])
        hashed = np.fromiter(map(crc, words), np.int64, len(words))
        yield owner[old:], hashed[old:] % buckets, np.ones(len(words) - old, bool)
        longer = hashed
        for n in range(2, longest + 1):
            # longer[i]: of the n - 1 words from i on
            last = np.arange(len(words) - n + 1)
            inside = (owner[last] == owner[last + n - 1]) & (last + n > old)
            begun = owner[last] == owner[last + n - 1]
            longer = np.fromiter((zlib.crc32(words[i + n - 1], zlib.crc32(b" ", int(longer[i]))) if ok else 0 for i, ok in enumerate(begun)), np.int64, len(last))
            yield owner[last[inside]], longer[inside] % buckets, np.zeros(int(inside.sum()), bool)
        keep = longest - 1
        words, owner = (words[-keep:], owner[-keep:]) if keep else ([], np.zeros(0, np.int64))


def _groups(batches, column: int):
    for b in batches:
        texts = pc.fill_null(b.column(column), "")
        for i, j in _byte_groups(texts, GROUP_BYTES):
            yield b, i, j, texts.slice(i, j - i).cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts are in each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, _, texts in _groups(batches, 0):
            for _, bucket, _ in features(texts, longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """In thousandths, of each bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    out = [math.floor(1000 * math.log(float((target.get(b, 0) + 1) * (s_all + buckets)) / float((corpus.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]
    return np.array(out, np.int64)


def noise(key, seed: int) -> int:
    """Gumbel noise in thousandths, from the key alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """k, n_features, n_words, weight, score of each row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches):
        gain = shared.value
        for b, i, j, texts in _groups(batches, 1):
            n, words, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for owner, bucket, single in features(texts, longest, len(gain)):
                n += np.bincount(owner, minlength=len(texts))
                words += np.bincount(owner[single], minlength=len(texts))
                # sums of doubles are exact up to 2**53
                total += np.bincount(owner, gain[bucket], len(texts)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            keys = b.column(0).slice(i, j - i)
            score = weight + np.fromiter((noise(k, seed) for k in keys.to_pylist()), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(words), pa.array(weight), pa.array(score)], ["k", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"k {kind}, n_features long, n_words long, weight long, score long")


def _numbered(batches):
    """Adds each row's place in its partition."""
    at = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows))], [*b.schema.names, "place"])
        at += b.num_rows


def ranked(rows: DataFrame, draw: int, order: list[str]) -> DataFrame:
    """rows with rank, 1 to `draw` by the columns of `order` (a `-` before a name means descending), null beyond. rows: a written table."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that tie in all of order are dealt out by a number of their own
    by = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc_nulls_last() for c in order]
    dealt = rows.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(n, *by, "u").sortWithinPartitions(*by, "u").drop("u").withColumn("part", F.spark_partition_id())
    # written before anything else reads it: parts and places are set once
    placed = cut(dealt.mapInArrow(_numbered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", place long"), "placed")
    base, at = [], 0
    for part, size in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # at most n rows
        base.append((part, at))
        at += size
    side = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    rank = F.col("base") + F.col("place") + 1
    return placed.join(side, "part").withColumn("rank", F.when(rank <= draw, rank)).drop("part", "place", "base")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score and rank (null for what isn't drawn) of every row of docs. Of the rows with at least `least_words` words
    floor(percent * n / 100) are drawn."""
    count = lambda df: {r["bucket"]: r["n"] for r in bucket_counts(df, text, longest, buckets).collect()}  # noqa: E731  at most a row for each bucket
    rows = cut(scored(docs, gains(count(docs), count(target), buckets), seed, key, text, longest), "scored")
    fit = F.col("n_words") >= least_words
    # scores lie between about -50,000 and 60,000 whatever the data
    at_score = rows.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    draw = percent * sum(r["n"] for r in at_score) // 100
    least, above = None, 0
    for score, n in sorted(((r["score"], r["n"]) for r in at_score), reverse=True):
        if above >= draw:
            break
        least, above = score, above + n
    names = [F.col("k").alias(key), "n_features", "weight", "score"]
    if least is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    up = fit & (F.col("score") >= least)
    top = ranked(rows.filter(up), draw, ["-score", "k", "n_features"])
    return rows.filter(~up).withColumn("rank", F.lit(None).cast("long")).unionByName(top).select(*names, "rank")
