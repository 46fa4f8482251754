"""Streaming queries over the events as a file source, run until everything that is there is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators.shared import shared_path
from firmlens.plans.firms import DATED, SCORED, TIERED
from firmlens.plans.fixtures import AS_OF, view, with_views
from firmlens.plans.registry import query
from firmlens.sources.store import FirmStore
from firmlens.streaming import jobs


def events(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _logs(df: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial").otherwise("success")
    return df.select((F.col("user_id") % 20).alias("job_id"), F.concat(F.lit("https://site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("url"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def _final(spark, df: DataFrame) -> DataFrame:
    """The result table after the last batch. It has a row for each group of the aggregate, and stays in the shared folder."""
    out, done = shared_path(spark, "final"), []

    def save(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{i}")
        done.append(i)

    q = df.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/{done[-1]}") if done else spark.createDataFrame([], df.schema)


@query("SELECT user_id % 20 AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY ALL")
def live_progress(spark, d) -> DataFrame:
    """L3: counts by job and status."""
    return _final(spark, jobs.progress(_logs(events(spark, d))))


@query("""WITH e AS (SELECT user_id % 20 AS job_id, ts, lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, p ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT job_id, CAST(min(ts) AS TIMESTAMP) AS alive_from, CAST(max(ts) + INTERVAL 5 MINUTE AS TIMESTAMP) AS silent_at, count(*) AS beats FROM g GROUP BY job_id, s""")
def liveness(spark, d) -> DataFrame:
    """L2: sessions of heartbeats; a job is silent after five minutes without one."""
    return _final(spark, jobs.liveness(_logs(events(spark, d))))


@query("SELECT DISTINCT user_id % 20 AS job_id, 'https://site' || user_id || '.example.com' AS url FROM events")
def incremental_save(spark, d) -> DataFrame:
    """L1: every site of a job is saved once, whatever runs again."""
    out, rows = shared_path(spark, "saved"), _logs(events(spark, d)).select("job_id", "url")
    for _ in range(2):  # a second run, from the beginning, adds nothing
        jobs.save_stream(rows, out, ["job_id", "url"], shared_path(spark, "save")).awaitTermination()
    return spark.read.parquet(out).select("job_id", "url")


_BATCHES = f"""{with_views('firms', 'members', 'portfolio')}, {TIERED}, {DATED}, {SCORED}, b AS (SELECT firm_id, firm_id % 3 AS batch FROM firms UNION ALL SELECT firm_id, 2 FROM firms WHERE firm_id % 6 = 0)"""


@query(f"""{_BATCHES}, k AS (SELECT t.*, b.batch FROM t JOIN b USING (firm_id) WHERE tier IN ('Tier 1', 'Tier 2', 'Tier 3')), c AS (SELECT firm_id, batch, count(*) AS n FROM k GROUP BY ALL)
    SELECT 'firms' AS kept_in, firm_id, company_name AS name, coalesce(nullif(website_url, ''), '-') || '|' || coalesce(nullif(investor_type, ''), '-') AS detail FROM firms
    UNION ALL SELECT 'members', firm_id, name, coalesce(nullif(title, ''), '-') || '|' || tier || '|' || member_id FROM k
    UNION ALL SELECT 'portfolio', firm_id, portfolio_company, recency_score || '|' || recency_category || '|' || coalesce(nullif(investment_niche, ''), '-') FROM s JOIN b USING (firm_id)
    UNION ALL SELECT 'ledger', f.firm_id, company_name, 'completed|' || coalesce(n, 0) FROM b JOIN firms f USING (firm_id) LEFT JOIN c ON c.firm_id = b.firm_id AND c.batch = b.batch""")
def saved_batches(spark, d) -> DataFrame:
    """Firms with their members and portfolio saved in three batches to four tables, the ledger last. Some firms of the first batch come again, under
    another id, in the last one: they keep their row and id. The second batch runs twice."""
    store, f, m, p = FirmStore(spark, shared_path(spark, "store"), 8), view(spark, d, "firms"), view(spark, d, "members"), view(spark, d, "portfolio")
    one = F.lit(1).alias("job_id")
    again = f.filter("firm_id % 6 = 0").withColumn("firm_id", F.col("firm_id") + 1_000_000)
    for batch in (0, 1, 1, 2):
        mine = f.filter(F.col("firm_id") % 3 == batch)
        if batch == 2:
            mine = mine.unionByName(again)
        names = mine.select(F.col("company_name").alias("vc_firm"))
        store.save(f"saved-{batch}", mine.select(one, "*"), m.join(names, "vc_firm", "left_semi").select(one, "*"), p.join(names, "vc_firm", "left_semi").select(one, "*"), "tier1-2", AS_OF)
    part = lambda table, name, *detail: store.read(table).select(F.lit(table).alias("kept_in"), "firm_id", F.col(name).alias("name"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in detail)).alias("detail"))
    firms, members = part("firms", "company_name", "website_url", "investor_type"), part("members", "name", "title", "tier", "member_id")
    return firms.unionByName(members).unionByName(part("portfolio", "portfolio_company", "recency_score", "recency_category", "investment_niche")).unionByName(part("ledger", "company_name", "status", "team_members_found"))
