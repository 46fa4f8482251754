"""A store of results in several tables, saved batch by batch, and inserts that read only the buckets of their own keys.

A batch writes its firms, members and portfolio, each to its own partition of its table, and its ledger last. Readers take only batches that the ledger
has, so a batch that stops in between is not seen, and one that runs again replaces what it wrote. The tables are partitioned by batch and by a
hash of (job, firm); to find firms that are stored already, only the buckets of the batch's own firms are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions import tiers
from firmlens.operators import aggregate
from firmlens.sources.export import new_rows

#: What each tier filter lets through.
TIERS = {"tier1": ["Tier 1"], "tier1-2": ["Tier 1", "Tier 2", "Tier 3"], "all": None}
BUCKETS = 64


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at `path`, or no rows if it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def touched(df: DataFrame) -> list[int]:
    """The buckets that rows fall in: at most as many as there are."""
    return [r[0] for r in df.select("bucket").distinct().collect()]


def insert_absent(df: DataFrame, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """Appends the rows whose keys aren't stored yet, of equal keys the first by `order`; running it again adds nothing. Returns what was read of the
    table: the buckets of these keys only, however large the others are."""
    spark = df.sparkSession
    rows = df.withColumn("bucket", bucket(keys, buckets))
    some = touched(rows)
    there = stored(spark, path, rows.schema).filter(F.col("bucket").isin(some))
    new_rows(rows, there, keys, order).write.mode("append").partitionBy("bucket").parquet(path)
    return there


class FirmStore:
    """Tables firms, members, portfolio and ledger under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _place(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _write(self, df: DataFrame, table: str, batch: str) -> None:
        # the letter keeps an id that looks like a number a text
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._place(table)}/batch=b{batch}")

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._place(table)).withColumn("batch", F.expr("substring(batch, 2)"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def batches(self) -> DataFrame | None:
        """The batches that are complete: one row for each, from the ledger's partitions."""
        ledger = self._read("ledger")
        return None if ledger is None else ledger.select("batch").distinct()

    def read(self, table: str) -> DataFrame | None:
        """Rows of complete batches, with batch and bucket; None before the first one."""
        rows, done = self._read(table), self.batches()
        return None if rows is None or done is None else rows.join(done, "batch", "left_semi")

    def save(self, batch: str, firms: DataFrame, members: DataFrame, portfolio: DataFrame, tier_filter: str = "all", as_of: str = "2001-08-02") -> None:
        """Saves a batch. firms: job_id, firm_id, company_name and any other columns; members and portfolio: job_id, vc_firm and others.

        A firm whose (job, name) is stored by another batch isn't inserted again, and its members and portfolio get the stored id. Members pass the filter of tiers. The ledger has a row for each
        firm with the number of members saved. Empty texts are stored as null."""
        key = ["job_id", "company_name"]
        firms = firms.withColumn("bucket", bucket(key, self.buckets))
        if self.read("ledger") is not None:  # a batch that runs again is not seen until it is complete
            self._write(self._read("ledger").drop("batch").limit(0), "ledger", batch)
        first = firms.groupBy(*key).agg(F.min_by(F.struct(*firms.columns), "firm_id").alias("_f")).select("_f.*")
        known = self.read("firms")
        if known is None:
            ids, new = first.select(*key, "firm_id"), first
        else:
            mine = known.filter(F.col("bucket").isin(touched(firms)) & (F.col("batch") != batch)).groupBy(*key).agg(F.min("firm_id").alias("_stored"))
            both = first.join(mine, key, "left")
            ids = both.select(*key, F.coalesce("_stored", "firm_id").alias("firm_id"))
            new = both.filter("_stored IS NULL").drop("_stored")
        self._write(_nulled(new), "firms", batch)
        owner = ids.select("job_id", F.col("company_name").alias("vc_firm"), F.col("firm_id").alias("_id"), bucket(key, self.buckets).alias("bucket"))
        # a batch may come in a few large parts: classing titles is most of its work, and is dealt over all tasks. A filter on a generated column stays
        # where it stands; else it would go below the exchange, and titles would be classed there and once more above
        dealt = members.drop("tier", "tier_priority").repartition(*(f.name for f in members.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in ("tier", "tier_priority")))
        tiered = dealt.select("*", F.explode(F.array(tiers.tier(F.col("title")))).alias("tier"))
        allowed = TIERS[tier_filter]
        kept = (tiered if allowed is None else tiered.filter(F.col("tier").isin(allowed))).withColumn("tier_priority", tiers.tier_priority(F.col("title")))
        team = _nulled(_owned(kept, owner))
        self._write(team, "members", batch)
        self._write(_nulled(_owned(aggregate.with_recency(portfolio, as_of), owner)), "portfolio", batch)
        # counted where they are stored, so that no title is classed again; a key that is null there was empty, as null keys have no owner
        there = self.spark.read.schema(team.select("job_id", "vc_firm").schema).parquet(f"{self._place('members')}/batch=b{batch}")
        empty = lambda c: F.coalesce(c, F.lit("")) if isinstance(there.schema[c].dataType, T.StringType) else F.col(c)
        counts = there.groupBy(empty("job_id").alias("job_id"), empty("vc_firm").alias("company_name")).agg(F.count(F.lit(1)).alias("team_members_found"))
        done = ids.join(counts, key, "left").select(*key, "firm_id", F.lit("completed").alias("status"), F.coalesce("team_members_found", F.lit(0)).alias("team_members_found"), bucket(key, self.buckets).alias("bucket"))
        self._write(done, "ledger", batch)


    def save_results(self, batch: str, results: DataFrame, tier_filter: str = "all", as_of: str = "2001-08-02") -> None:
        """Saves results of firms with their members and portfolio inside (arrays of structs), as a stream brings them."""
        inner = lambda c: results.select("job_id", F.col("company_name").alias("vc_firm"), F.explode(c).alias("_x")).select("job_id", "vc_firm", "_x.*")
        self.save(batch, results.drop("members", "portfolio"), inner("members"), inner("portfolio"), tier_filter, as_of)


def _owned(rows: DataFrame, owner: DataFrame) -> DataFrame:
    return rows.drop("firm_id").join(owner, ["job_id", "vc_firm"]).withColumnRenamed("_id", "firm_id")


def _nulled(df: DataFrame) -> DataFrame:
    return df.select(*(F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields))
