"""Queries over jobs, job logs and fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import text
from firmlens.operators import jobs
from firmlens.plans.fixtures import AS_OF, view, with_views
from firmlens.plans.registry import query

SECTIONS = ["aum", "headquarters", "founded"]


@query(f"{with_views('job_logs')} SELECT job_id, status, count(*) AS n, sum(fields_filled)::BIGINT AS filled FROM job_logs GROUP BY ALL")
def log_status_counts(spark, d) -> DataFrame:
    """E17, and what L3 keeps live."""
    return view(spark, d, "job_logs").groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("fields_filled").alias("filled"))


@query(f"""{with_views('job_logs')}, e AS (SELECT CASE WHEN json_valid(empty_fields) THEN CAST(empty_fields AS VARCHAR[]) ELSE [] END AS e FROM job_logs WHERE empty_fields IS NOT NULL), s AS (SELECT unnest(['aum', 'headquarters', 'founded']) AS section),
    c AS (SELECT section, count(*) FILTER (NOT list_contains(e, section)) AS filled, count(*) AS total FROM s, e GROUP BY section), p AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(filled / total * 100 + 0.5) AS BIGINT) ELSE 0 END AS pct FROM c) SELECT *, CASE WHEN pct >= 80 THEN 'green' WHEN pct >= 40 THEN 'yellow' ELSE 'red' END AS band FROM p""")
def fill_rates(spark, d) -> DataFrame:
    """E18."""
    return jobs.fill_rates(view(spark, d, "job_logs"), SECTIONS)


@query(f"{with_views('jobs')}, l AS (SELECT * FROM jobs WHERE status = 'completed' AND firm_count > 0 ORDER BY created_at DESC, job_id DESC LIMIT 10), s AS (SELECT date_diff('second', created_at, completed_at) / firm_count AS s FROM l) SELECT count(*) AS jobs, avg(s) AS avg_s, min(s) AS min_s, max(s) AS max_s FROM s")
def seconds_per_firm(spark, d) -> DataFrame:
    """E19, G2."""
    return jobs.seconds_per_firm(view(spark, d, "jobs"))


@query(f"{with_views('jobs')} SELECT job_id, status IN ('pending', 'processing') AS can_cancel, reason IS NULL AS can_resume, coalesce(reason, '') AS reason FROM (SELECT *, CASE WHEN status = 'completed' THEN 'Job is already completed' WHEN status = 'pending' THEN 'Job has not started' WHEN NOT has_file THEN 'Input file is missing' WHEN processed_count >= firm_count THEN 'All firms are processed' END AS reason FROM jobs)")
def job_eligibility(spark, d) -> DataFrame:
    """C7."""
    return jobs.eligibility(view(spark, d, "jobs"))


@query(f"{with_views('jobs')} SELECT job_id, greatest(0, firm_count - processed_count) AS remaining, CAST(floor(processed_count / firm_count * 100 + 0.5) AS BIGINT) AS percent FROM jobs")
def job_progress(spark, d) -> DataFrame:
    """E29."""
    return jobs.progress(view(spark, d, "jobs"))


@query(f"{with_views('job_logs')}, r AS (SELECT job_id, log_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY job_id) AS n, epoch_us(created_at) - epoch_us(first_value(created_at) OVER w) AS us FROM job_logs WINDOW w AS (PARTITION BY job_id ORDER BY created_at, log_id)) SELECT job_id, log_id, i, us / 1e6 / i * (n - i) AS eta_s FROM r")
def running_eta(spark, d) -> DataFrame:
    """F5."""
    return jobs.eta(view(spark, d, "job_logs"))


@query("""WITH f AS (SELECT event_type AS strategy, event_type <> 'error' AS ok, event_id % 4 = 0 AS cached, value AS duration FROM events)
    SELECT coalesce(strategy, 'ALL') AS strategy, count(*) AS n, round(count(*) FILTER (ok) / count(*) * 100, 2) AS success_pct, round(avg(duration), 6) AS avg_duration, round(count(*) FILTER (cached) / count(*) * 100, 2) AS cache_pct, round(avg(duration) FILTER (ok), 6) AS avg_ok_duration FROM f GROUP BY ROLLUP (strategy)""")
def fetch_metrics(spark, d) -> DataFrame:
    """By strategy and over all."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return jobs.fetch_metrics(e.select(F.col("event_type").alias("strategy"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 4 == 0).alias("cached"), F.col("value").alias("duration")))


@query(f"{with_views('jobs')} SELECT owner_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(input_tokens) / 1e6 * 0.15 + sum(output_tokens) / 1e6 * 0.6, 6) AS cost FROM jobs GROUP BY owner_id")
def cost_totals(spark, d) -> DataFrame:
    """E22."""
    return jobs.cost_totals(view(spark, d, "jobs"))


@query(f"{with_views('jobs')} SELECT job_id, owner_id FROM jobs WHERE status = 'processing' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 5 MINUTE)")
def stale_jobs(spark, d) -> DataFrame:
    """C6, L2 in batch."""
    return jobs.stale(view(spark, d, "jobs"), F.lit(AS_OF).cast("timestamp")).select("job_id", "owner_id")


@query(f"{with_views('jobs')} SELECT owner_id, 'mine' AS list, job_id, created_at FROM jobs WHERE owner_id = 3 UNION ALL SELECT owner_id, 'open', job_id, created_at FROM jobs WHERE status IN ('pending', 'processing') UNION ALL (SELECT owner_id, 'oldest', job_id, created_at FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 1) UNION ALL (SELECT owner_id, 'latest', job_id, created_at FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 5)")
def job_lists(spark, d) -> DataFrame:
    """By owner, open, the oldest pending, the latest five."""
    j = view(spark, d, "jobs")
    pick = lambda df, n: df.select("owner_id", F.lit(n).alias("list"), "job_id", "created_at")
    out = pick(j.filter("owner_id = 3"), "mine").unionByName(pick(j.filter(F.col("status").isin("pending", "processing")), "open"))
    out = out.unionByName(pick(j.filter("status = 'pending'").orderBy("created_at", "job_id").limit(1), "oldest"))
    return out.unionByName(pick(j.orderBy(F.desc("created_at"), F.desc("job_id")).limit(5), "latest"))


@query(f"{with_views('job_logs')} SELECT log_id, url, created_at FROM job_logs WHERE job_id = 7 ORDER BY created_at, log_id LIMIT 500")
def job_log_page(spark, d) -> DataFrame:
    """One job's log, oldest first, at most 500."""
    return view(spark, d, "job_logs").filter("job_id = 7").orderBy("created_at", "log_id").limit(500).select("log_id", "url", "created_at")


@query(f"{with_views('job_logs')} SELECT log_id, fields_total, fields_filled, CASE WHEN fields_filled = 0 THEN 'failed' WHEN fields_filled < fields_total THEN 'partial' ELSE 'success' END AS status FROM job_logs")
def log_status(spark, d) -> DataFrame:
    """I25."""
    return view(spark, d, "job_logs").select("log_id", "fields_total", "fields_filled", text.log_status(F.col("fields_filled"), F.col("fields_total")).alias("status"))


@query(f"{with_views('processed', 'members')} SELECT p.status, count(DISTINCT p.firm_id) AS firms, count(m.member_id) AS members FROM processed p LEFT JOIN members m USING (firm_id) GROUP BY p.status")
def job_monitor(spark, d) -> DataFrame:
    """Saved firms and members by state; latest_logs has what was processed last."""
    m = view(spark, d, "members").groupBy("firm_id").agg(F.count(F.lit(1)).alias("_n"))
    return view(spark, d, "processed").join(m, "firm_id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("firms"), F.coalesce(F.sum("_n"), F.lit(0)).alias("members"))


@query(f"{with_views('members')}, r AS (SELECT firm_id, [name, title, coalesce(linkedin_url, ''), coalesce(email, '')] AS v FROM members), s AS (SELECT member_id, firm_id, list_filter(['name', 'title', 'linkedin', 'email'], lambda x, i: trim([name, title, coalesce(linkedin_url, ''), coalesce(email, '')][i]) = '') AS e FROM members) SELECT member_id, 4 AS total, 4 - len(e) AS filled, array_to_string(e, ',') AS empty FROM s")
def result_fill(spark, d) -> DataFrame:
    """Fields of a map that are empty, by section."""
    keys = ["name", "title", "linkedin", "email"]
    data = F.create_map(F.lit("name"), F.col("name"), F.lit("title"), F.col("title"), F.lit("linkedin"), F.col("linkedin_url"), F.lit("email"), F.col("email"))
    empty = F.filter(F.array(*map(F.lit, keys)), lambda k: F.trim(F.coalesce(F.element_at(F.col("data"), k), F.lit(""))) == "")
    rows = view(spark, d, "members").select("member_id", data.alias("data")).withColumn("e", empty)
    return rows.select("member_id", F.lit(4).alias("total"), (F.lit(4) - F.size("e")).cast("long").alias("filled"), F.array_join("e", ",").alias("empty"))
