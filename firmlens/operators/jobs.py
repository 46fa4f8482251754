"""Reports about jobs, job logs and fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import dates, dims
from firmlens.operators.shared import cut


def estimate(jobs: DataFrame, mean_chars: Column) -> DataFrame:
    """Adds input_tokens, output_tokens, cost (with its lower and upper bound) and duration for each job's firm_count."""
    scale = F.least(F.lit(2.5), F.greatest(F.lit(0.7), mean_chars / 200))
    total = lambda k: sum((F.lit(float(op[k] * op[4])) * (scale if op[3] else F.lit(1.0)) for op in dims.OPERATIONS), F.lit(0.0))
    n = F.col("firm_count")
    cost = (total(1) / 1e6 * dims.PRICE_IN + total(2) / 1e6 * dims.PRICE_OUT) * n
    seconds = F.greatest(n * 6 / F.lit(1000 / 60), F.ceil(n / 50).cast("double") * 25)
    cents = lambda c: F.floor(c * 100 + 0.5) / 100
    return jobs.withColumns({"input_tokens": dates.rounded(total(1) * n), "output_tokens": dates.rounded(total(2) * n), "cost": cost, "cost_low": cents(cost * (1 - dims.VARIANCE)), "cost_high": cents(cost * (1 + dims.VARIANCE)), "duration": dates.duration_text(seconds)})


def status_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def fill_rates(logs: DataFrame, sections: list[str]) -> DataFrame:
    """For each section the share of logs in which it is filled. Logs without a list of empty fields are left out;
    a list that can't be read counts as all filled."""
    empty = F.coalesce(F.from_json("empty_fields", "array<string>"), F.array().cast("array<string>"))
    rows = logs.filter("empty_fields IS NOT NULL").select(empty.alias("_e"))
    sums = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(~F.array_contains("_e", s)).alias(f"_{i}") for i, s in enumerate(sections)))
    one = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"_{i}").alias("filled")) for i, s in enumerate(sections))))
    pct = F.when(F.col("total") > 0, dates.rounded(F.col("filled") / F.col("total") * 100)).otherwise(F.lit(0).cast("long"))
    out = sums.select("total", one.alias("x")).select("x.section", "x.filled", "total")
    return out.withColumn("pct", pct).withColumn("band", F.when(F.col("pct") >= 80, "green").when(F.col("pct") >= 40, "yellow").otherwise("red"))


def seconds_per_firm(jobs: DataFrame, n: int = 10) -> DataFrame:
    """Mean, least and most seconds for a firm over the last n completed jobs."""
    last = jobs.filter("status = 'completed' AND firm_count > 0").orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)
    s = F.timestamp_diff("SECOND", F.col("created_at"), F.col("completed_at")) / F.col("firm_count")
    return last.select(s.alias("s")).agg(F.count(F.lit(1)).alias("jobs"), F.avg("s").alias("avg_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


def eligibility(jobs: DataFrame) -> DataFrame:
    """Whether a job can be cancelled or resumed, and why not."""
    s = F.col("status")
    reason = F.when(s == "completed", "Job is already completed").when(s == "pending", "Job has not started").when(~F.col("has_file"), "Input file is missing").when(F.col("processed_count") >= F.col("firm_count"), "All firms are processed")
    return jobs.select("job_id", s.isin("pending", "processing").alias("can_cancel"), reason.isNull().alias("can_resume"), F.coalesce(reason, F.lit("")).alias("reason"))


def progress(jobs: DataFrame) -> DataFrame:
    left = F.greatest(F.lit(0), F.col("firm_count") - F.col("processed_count"))
    pct = F.when(F.col("firm_count") > 0, dates.rounded(F.col("processed_count") / F.col("firm_count") * 100)).otherwise(F.lit(0).cast("long"))
    return jobs.select("job_id", left.alias("remaining"), pct.alias("percent"))


#: Rows of a job's log that one task numbers; the rows of larger jobs are numbered by ranges.
LARGE = 1_000_000


def eta(logs: DataFrame, large: int = LARGE) -> DataFrame:
    """Running estimate of the seconds left for each row of a job's log: elapsed / index * remaining."""
    rows = logs.select("job_id", "log_id", F.col("created_at").cast("timestamp").alias("at"))
    many = cut(rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("job_id"), "large")
    if many.isEmpty():
        return _left(_by_job(rows))
    # few jobs are large: one for each `large` rows at most
    hot = F.broadcast(many)
    return _left(_by_job(rows.join(hot, "job_id", "left_anti")).unionByName(_by_ranges(rows.join(hot, "job_id", "left_semi"))))


def _by_job(rows: DataFrame) -> DataFrame:
    job = Window.partitionBy("job_id")
    order = job.orderBy("at", "log_id")
    return rows.withColumns({"i": F.row_number().over(order), "n": F.count(F.lit(1)).over(job), "began": F.min("at").over(job)})


def _by_ranges(rows: DataFrame) -> DataFrame:
    """A job with most of the rows lies in many ranges, and what comes before a range is summed from one row for each job and range."""
    ranged = cut(rows.repartitionByRange("job_id", "at", "log_id").withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("job_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    job = Window.partitionBy("job_id")
    before = F.sum("n").over(job.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("job_id", "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(job).alias("n"), F.min("at").over(job).alias("began"))
    i = F.col("base") + F.row_number().over(Window.partitionBy("job_id", "part").orderBy("at", "log_id"))
    return ranged.join(base, ["job_id", "part"]).select("job_id", "log_id", "at", i.alias("i"), "n", "began")


def _left(numbered: DataFrame) -> DataFrame:
    elapsed = (F.unix_micros("at") - F.unix_micros("began")) / 1e6
    return numbered.select("job_id", "log_id", F.col("i").cast("int").alias("i"), (elapsed / F.col("i") * (F.col("n") - F.col("i"))).alias("eta_s"))


def fetch_metrics(fetches: DataFrame) -> DataFrame:
    """Success and cache-hit share and mean duration by strategy, and over all. fetches: strategy, ok, cached, duration."""
    pct = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)) * 100, 2)
    out = fetches.rollup("strategy").agg(F.count(F.lit(1)).alias("n"), pct("ok").alias("success_pct"), F.round(F.avg("duration"), 6).alias("avg_duration"), pct("cached").alias("cache_pct"), F.round(F.avg(F.when(F.col("ok"), F.col("duration"))), 6).alias("avg_ok_duration"))
    return out.withColumn("strategy", F.coalesce("strategy", F.lit("ALL")))


def stale(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs in processing without a heartbeat in the last 5 minutes."""
    return jobs.filter((F.col("status") == "processing") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < as_of - F.expr("INTERVAL 5 MINUTES"))))


def cost_totals(jobs: DataFrame) -> DataFrame:
    i, o = F.sum("input_tokens"), F.sum("output_tokens")
    return jobs.groupBy("owner_id").agg(i.alias("input_tokens"), o.alias("output_tokens"), F.round(i / 1e6 * dims.PRICE_IN + o / 1e6 * dims.PRICE_OUT, 6).alias("cost"))


def latest(logs: DataFrame, n: int = 5) -> DataFrame:
    """The last n rows of each job's log, the latest first: job_id, log_id, status, place."""
    w = Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("log_id"))
    return logs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("job_id", "log_id", "status", "place")
