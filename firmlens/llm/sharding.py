"""Sharding through fixed virtual slots.

Records are hashed into `n_slots` virtual slots that never change. Bytes are summed by slot
(one small aggregate), a map from slot to shard is balanced on those sums, and the map is a
versioned table: rebalancing or adding a shard edits the map and appends a version, and only
the rows of edited slots move.

Defined results: a null text has 0 bytes and the checksum of the empty string; a null key hashes
like any other value; repeated rows share a slot and get different positions; rows are numbered by id, checksum and size; a very
long text is one record of one slot; an empty table gives an empty result and a map that deals the empty slots out evenly; columns of the
input that clash with the names added here are replaced by them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmlens.llm.common import fresh

N_SLOTS = 16384


@dataclass(frozen=True)
class SlotMap:
    """shard_of[s] is the shard of virtual slot s."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @property
    def n_slots(self) -> int:
        return len(self.shard_of)


def slot_of(keys: list[Column], n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_sizes(df: DataFrame, vslot: str = "vslot", size: str = "size") -> list[tuple[int, int, int]]:
    """(slot, rows, bytes) of the slots that have rows: at most `n_slots` rows reach the driver."""
    got = df.groupBy(vslot).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()
    return [(int(r[vslot]), int(r["n"]), int(r["b"] or 0)) for r in got]


def build_map(sizes: Iterable[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """The first version: the largest slot first, always to the shard with the fewest bytes."""
    load = {s: (b, n) for s, n, b in sizes}
    heap = [(0, 0, k) for k in range(n_shards)]
    shard_of = [0] * n_slots
    for s in sorted(range(n_slots), key=lambda s: (-load.get(s, (0, 0))[0], s)):
        b, count, k = heapq.heappop(heap)
        shard_of[s] = k
        heapq.heappush(heap, (b + load.get(s, (0, 0))[0], count + 1, k))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalance(old: SlotMap, sizes: Iterable[tuple[int, int, int]], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: moves slots from the fullest to the emptiest shard while that lessens
    their difference and it exceeds `tolerance` of the mean. Shards beyond a smaller `n_shards`
    are emptied; a larger one takes slots from the rest."""
    n_shards = n_shards or old.n_shards
    load = {s: b for s, _, b in sizes}
    shard_of = list(old.shard_of)
    total = [0] * n_shards
    homeless = []
    own: list[list[int]] = [[] for _ in range(n_shards)]
    for s, k in enumerate(shard_of):
        if k >= n_shards:
            homeless.append(s)
        else:
            total[k] += load.get(s, 0)
            own[k].append(s)
    for s in sorted(homeless, key=lambda s: (-load.get(s, 0), s)):
        k = min(range(n_shards), key=lambda k: (total[k], len(own[k]), k))
        shard_of[s], total[k] = k, total[k] + load.get(s, 0)
        own[k].append(s)
    mean = sum(total) / n_shards
    while True:
        hi, lo = max(range(n_shards), key=total.__getitem__), min(range(n_shards), key=total.__getitem__)
        gap = total[hi] - total[lo]
        fit = [s for s in own[hi] if 0 < load.get(s, 0) < gap]
        if gap <= tolerance * mean or not fit:
            break
        s = min(fit, key=lambda s: (abs(gap / 2 - load[s]), s))
        own[hi].remove(s)
        own[lo].append(s)
        shard_of[s] = lo
        total[hi] -= load[s]
        total[lo] += load[s]
    return SlotMap(old.version + 1, n_shards, tuple(shard_of))


def map_frame(spark: SparkSession, m: SlotMap) -> DataFrame:
    return spark.createDataFrame([(m.version, m.n_shards, s, k) for s, k in enumerate(m.shard_of)], "version int, n_shards int, vslot int, shard int")


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Appends a version to the map's table; versions that are there stay."""
    map_frame(spark, m).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    df = spark.read.parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    rows = df.filter(F.col("version") == version).orderBy("vslot").collect()
    return SlotMap(int(version), int(rows[0]["n_shards"]), tuple(int(r["shard"]) for r in rows))


def with_sizes(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "text"), text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Adds size, text_crc32 and vslot. The text is a part of the slot's key, so that an id or a null which many rows share has many slots."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body), "vslot": slot_of([F.col(k) for k in keys], n_slots)})


def place(df: DataFrame, m: SlotMap, sizes: list[tuple[int, int, int]], order: tuple[str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Adds shard and slot, the row's gapless position within its shard. Positions come from the
    slots' row counts plus a row number within the virtual slot, so that no task sees a whole
    shard. The joined side has one row for each virtual slot, a fixed number."""
    n = {s: c for s, c, _ in sizes}
    nxt = [0] * m.n_shards
    rows = []
    for s, k in enumerate(m.shard_of):
        rows.append((s, k, nxt[k]))
        nxt[k] += n.get(s, 0)
    side = df.sparkSession.createDataFrame(rows, "vslot int, shard int, slot_base long")
    w = Window.partitionBy("vslot").orderBy(*order)
    base, number = fresh(df, "slot_base", "in_slot")
    return (
        df.drop("shard", "slot")
        .withColumn(number, F.row_number().over(w) - 1)
        .join(F.broadcast(side.withColumnRenamed("slot_base", base)), "vslot")
        .withColumn("slot", (F.col(base) + F.col(number)).cast("long"))
        .drop(number, base)
    )


def shard(docs: DataFrame, n_shards: int = 8, map_path: str | None = None, n_slots: int = N_SLOTS) -> DataFrame:
    """Deals documents into shards of near-equal bytes and, with `map_path`, stores the map."""
    sized = with_sizes(docs, n_slots=n_slots)
    narrow = sized.select("size", "vslot")  # the text's length is all that this pass needs
    sizes = slot_sizes(narrow)
    m = build_map(sizes, n_shards, n_slots)
    if map_path:
        save_map(docs.sparkSession, m, map_path)
        m = load_map(docs.sparkSession, map_path, m.version)  # what was stored decides
    return place(sized, m, sizes)
