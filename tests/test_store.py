"""The store of batches and inserts by bucket."""

import os

import pytest
from firmlens.sources import store
from firmlens.streaming import jobs
from pyspark.sql import functions as F

FIRMS, MEMBERS, PORTFOLIO = "job_id int, firm_id long, company_name string, website_url string", "job_id int, vc_firm string, name string, title string", "job_id int, vc_firm string, portfolio_company string, investment_date string"


def batch(spark, k, n=3):
    names = [f"firm {k}-{i}" for i in range(n)]
    f = spark.createDataFrame([(1, 100 * k + i, x, "") for i, x in enumerate(names)], FIRMS)
    m = spark.createDataFrame([(1, x, "Ann", "Partner") for x in names] + [(1, x, "Bo", "Software Engineer") for x in names], MEMBERS)
    p = spark.createDataFrame([(1, x, "Acme", "2001-06") for x in names], PORTFOLIO)
    return f, m, p


def counts(s):
    return {t: s.read(t).count() if s.read(t) is not None else None for t in ("firms", "members", "portfolio", "ledger")}


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s = store.FirmStore(spark, str(tmp_path / "s"), 4)
    s.save("1", *batch(spark, 1), "tier1")
    before = counts(s)
    assert before == {"firms": 3, "members": 3, "portfolio": 3, "ledger": 3}
    write = store.FirmStore._write
    for stop in ("members", "ledger"):
        calls = []

        def broken(self, df, table, name, stop=stop, calls=calls):
            if table == stop and name == "2" and (table != "ledger" or calls):
                raise OSError("the cluster went away")
            calls.append(table)
            write(self, df, table, name)

        monkeypatch.setattr(store.FirmStore, "_write", broken)
        with pytest.raises(OSError):
            s.save("2", *batch(spark, 2))
        assert counts(s) == before, stop
    monkeypatch.setattr(store.FirmStore, "_write", write)
    for _ in range(2):  # a second run replaces the first
        s.save("2", *batch(spark, 2))
        assert counts(s) == {"firms": 6, "members": 9, "portfolio": 6, "ledger": 6}
    # a complete batch that runs again and stops is not half seen
    monkeypatch.setattr(store.FirmStore, "_write", lambda self, df, table, name: (_ for _ in ()).throw(OSError()) if table == "members" else write(self, df, table, name))
    with pytest.raises(OSError):
        s.save("2", *batch(spark, 2))
    assert counts(s) == before


def test_stored_firms_keep_row_and_id(spark, tmp_path):
    s = store.FirmStore(spark, str(tmp_path / "s"), 4)
    assert s.read("firms") is None and s.batches() is None
    f, m, p = batch(spark, 1)
    s.save("007", f, m, p)
    s.save("7", f.withColumn("firm_id", F.col("firm_id") + 50).withColumn("website_url", F.lit("x")), m, p)
    assert sorted((r["firm_id"], r["website_url"]) for r in s.read("firms").collect()) == [(100, None), (101, None), (102, None)]  # empty texts are null
    assert {r[0] for r in s.read("members").select("firm_id").collect()} == {100, 101, 102} and s.read("members").count() == 12
    assert sorted(r[0] for r in s.batches().collect()) == ["007", "7"]
    assert {(r["team_members_found"], r["status"]) for r in s.read("ledger").collect()} == {(2, "completed")}
    s.save("none", f.limit(0), m.limit(0), p.limit(0))
    assert s.read("firms").count() == 3


def test_members_of_one_part_are_dealt_over_tasks(spark, tmp_path):
    """Members that come in one part are classed and written by several tasks; empty names have counts, and null ones no owner."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = store.FirmStore(spark, str(tmp_path / "s"), 2)
        names = ["", "a", "b", None]
        f = spark.createDataFrame([(1, i, x, "") for i, x in enumerate(names)], FIRMS)
        m = spark.createDataFrame([(1, x, f"p{i}", t) for x in names for i, t in enumerate(["Partner", "Software Engineer", "Principal"] * 20)], MEMBERS).withColumn("tier", F.lit("clash")).coalesce(1)
        s.save("1", f, m, spark.createDataFrame([], PORTFOLIO), "tier1-2")
        files = [x for _, _, fs in os.walk(tmp_path / "s/members") for x in fs if x.startswith("part-")]
        assert len({x.split("-")[1] for x in files}) > 1
        assert {(r["company_name"], r["team_members_found"]) for r in s.read("ledger").collect()} == {(None, 0), ("", 40), ("a", 40), ("b", 40)}
        assert {r["tier"] for r in s.read("members").collect()} == {"Tier 1", "Tier 2"} and s.read("members").count() == 120
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_insert_reads_only_its_own_buckets(spark, tmp_path):
    """However large the table is: what a batch of one key reads is one of the buckets."""
    path = str(tmp_path / "t")
    read = []
    for size in (2_000, 20_000):
        rows = spark.range(size).select(F.col("id").cast("string").alias("url"), F.lit(1).alias("n"))
        store.insert_absent(rows, path, ["url"], "n", 32)
        there = store.insert_absent(spark.createDataFrame([("5", 1), ("new", 1)], "url string, n int").filter("url = '5'"), path, ["url"], "n", 32)
        files = {f for f in there.inputFiles()}
        buckets = {os.path.basename(os.path.dirname(f)) for f in spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in there.select("bucket").distinct().collect()])).inputFiles()}
        assert files and len(buckets) >= 1
        read.append(there.count() / size)
        assert spark.read.parquet(path).count() == size
    assert all(x < 2 / 32 for x in read)
    plan = there._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:60]


def test_streamed_results(spark, tmp_path):
    schema = "job_id int, firm_id long, company_name string, website_url string, members array<struct<name string, title string>>, portfolio array<struct<portfolio_company string, investment_date string>>"
    rows = [(1, i, f"f{i}", "u", [("Ann", "Partner"), ("Bo", "Chef")], [("Acme", "2001")]) for i in range(4)]
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).write.parquet(str(tmp_path / f"in/{k}.parquet"))
    s = store.FirmStore(spark, str(tmp_path / "s"), 4)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for checkpoint in ("c", "c"):  # the same stream again has nothing to do
        jobs.save_results_stream(stream(), s, "results", str(tmp_path / checkpoint), "tier1").awaitTermination()
    assert counts(s) == {"firms": 4, "members": 4, "portfolio": 4, "ledger": 4}
