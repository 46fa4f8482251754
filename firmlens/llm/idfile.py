"""Token ids in a binary format with Elias-Fano encoded document boundaries.

A file is a table of blocks. A block holds the concatenated ids of consecutive documents (2 or 4
bytes each, little-endian, as the vocabulary needs), their ids' end offsets and their document ids, both as Elias-Fano
sequences: `n * (2 + log2(U / n))` bits instead of 64 for each, and half a bit for the select structure, the positions of
every `SAMPLE`th value, which is stored with them. Offsets are read through select, alone or many at once. Blocks are rows of
a Parquet table, written and read by Spark itself, so that any store that Spark reaches will do.

Texts are encoded where they are read; only their packed ids are range-partitioned by key. Within a partition blocks follow
each other, and the offset of a partition is the sum of those before it, one number for each partition.

Defined results: a null text is an empty document, which has its end id only; a null key comes
first; rows with equal keys are ordered by their text's hash, and rows that are equal in both may lie in several partitions; a
document is never split between blocks, however long it is; an empty table gives an empty file; other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.common import cut
from firmlens.llm.tokens import _byte_groups, encoder, prove_whole

BLOCK_IDS = 1_500_000
SAMPLE = 64

_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ones = _bits.sum(1).astype(np.int64)
#: _nth[b, k]: where the k-th one of a byte stands.
_nth = np.argsort(1 - _bits, axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers, compressed. sample: where every `SAMPLE`th one stands in `high`."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        low_bits = max(0, int(v[-1] // n).bit_length() - 1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        lows = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0))
        return cls(n, low_bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i) -> np.ndarray:
        """The values at the positions i, each from the sample before it and the bytes up to it."""
        i = np.asarray(i, np.int64)
        at = self.sample[i // SAMPLE].astype(np.int64)
        byte, skip = at >> 3, i % SAMPLE
        skip = skip + _ones[self.high[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
        open_ = np.arange(len(i))
        while True:  # open_: positions whose one lies in a later byte
            here = _ones[self.high[byte[open_]]]
            open_, here = open_[skip[open_] >= here], here[skip[open_] >= here]
            if not len(open_):
                break
            skip[open_] -= here
            byte[open_] += 1
        out = (byte * 8 + _nth[self.high[byte], skip] - i) << self.low_bits
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            out |= (self.low[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(np.int64) << b
        return out

    def dump(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.sample)) + self.low.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @classmethod
    def load(cls, data, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


def pack_block(keys: np.ndarray, nulls: int, sizes: np.ndarray, ids: list[bytes], width: int) -> bytes:
    """keys: of the documents after the first `nulls`, ascending; sizes: numbers of ids; ids: as bytes."""
    first = int(keys[0]) if len(keys) else 0
    # differences are taken as unsigned numbers: keys may be further apart than a signed one holds
    return b"EFID" + struct.pack("<BBQq", 2, width, nulls, first) + EliasFano.of(np.cumsum(sizes)).dump() + EliasFano.of(keys.astype(np.int64).view(np.uint64) - np.int64(first).view(np.uint64)).dump() + b"".join(ids)


class Block:
    """A block as read: n documents."""

    def __init__(self, data):
        if bytes(memoryview(data)[:4]) != b"EFID":
            raise ValueError("not a block of ids")
        version, width, self.nulls, self.first = struct.unpack_from("<BBQq", data, 4)
        if version != 2:
            raise ValueError(f"version {version} of the format is unknown")
        self.ends, at = EliasFano.load(data, 4 + struct.calcsize("<BBQq"))
        self.gaps, at = EliasFano.load(data, at)
        self.all_ids = np.frombuffer(data, f"<u{width}", -1, at)
        self.n = self.ends.n

    def bounds(self, i) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the documents at the positions i begin and end."""
        i = np.asarray(i, np.int64)
        start = np.zeros(len(i), np.int64)
        start[i > 0] = self.ends.select(i[i > 0] - 1)
        return start, self.ends.select(i)

    def keys(self) -> list[int | None]:
        gaps = self.gaps.select(np.arange(self.gaps.n)).view(np.uint64)
        return [None] * self.nulls + (gaps + np.int64(self.first).view(np.uint64)).view(np.int64).tolist()

    def ids(self, i: int) -> np.ndarray:
        """The ids of one document, found by select alone."""
        start, end = self.bounds([i])
        return self.all_ids[start[0] : end[0]]


def encoded(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> tuple[DataFrame, int]:
    """(k, h, u, ids: packed ids with the end id, for each row, the bytes of an id). u parts equal rows."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole(path))  # at most the vocabulary
    width = encoder(path, whole).dtype.itemsize
    if end_id >= 1 << 8 * width:
        width = 4

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, whole)
        for b in batches:
            texts = pc.fill_null(b.column(2), "")
            for i, j in _byte_groups(texts):
                ids, bounds = enc.encode(texts.slice(i, j - i))
                ids = np.insert(ids.astype(f"<u{width}"), bounds[1:], end_id)
                off = (bounds + np.arange(len(bounds))) * width
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(off), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), packed.cast(pa.binary())], ["k", "h", "ids"])

    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))
    return rows.mapInArrow(run, "k long, h long, ids binary").withColumn("u", F.monotonically_increasing_id()), width


def write_ids(docs: DataFrame, out: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text, appends `end_id` to each, and writes the blocks to `out`."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed, width = encoded(docs, path, end_id, key, text)
    # written first: range partitioning reads its input twice
    dealt = cut(packed, "encoded", "zstd").repartitionByRange(n, "k", "h", "u").sortWithinPartitions("k", "h", "u")
    dealt = dealt.select("k", "ids", F.spark_partition_id().alias("part"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        keys, sizes, ids, nulls, size, total, no, part = [], [], [], 0, 0, 0, 0, 0

        def block():
            data = pack_block(np.concatenate(keys), nulls, np.concatenate(sizes), ids, width)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (no, pa.int32()), (total - size, pa.int64()), (size, pa.int64()), (data, pa.binary()))], ["part", "block", "first", "n_ids", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            n_ids = pc.binary_length(b.column(1)).to_numpy().astype(np.int64) // width
            at = 0
            while at < b.num_rows:
                # documents up to the one that fills the block
                end = min(b.num_rows, at + 1 + int(np.searchsorted(np.cumsum(n_ids[at:]), BLOCK_IDS - size)))
                k = b.column(0).slice(at, end - at)
                nulls += k.null_count
                keys.append(k.drop_null().to_numpy())
                sizes.append(n_ids[at:end])
                ids += b.column(1).slice(at, end - at).to_pylist()
                size, total, at = size + int(n_ids[at:end].sum()), total + int(n_ids[at:end].sum()), end
                if size >= BLOCK_IDS:
                    yield block()
                    keys, sizes, ids, nulls, size, no = [], [], [], 0, 0, no + 1
        if size:
            yield block()

    dealt.mapInArrow(run, "part int, block int, first long, n_ids long, payload binary").write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """For each document of the file: key, start (ids before it), n_tokens, ids_crc32 (of its ids as 32-bit little-endian integers)."""
    blocks = spark.read.schema("part int, block int, first long, n_ids long, payload binary").parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a number for each partition of the writer
    at, base = 0, []
    for r in sums:
        base.append((r["part"], at))
        at += r["n"]
    side = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    todo = blocks.join(side, "part").select((F.col("base") + F.col("first")).alias("first"), "payload")

    def run(batches):
        for b in batches:
            for first, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block = Block(payload.as_buffer())
                starts, ends = block.bounds(np.arange(block.n))
                wide = block.all_ids.astype("<u4")
                crc = [zlib.crc32(wide[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.keys(), pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], ["k", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)
