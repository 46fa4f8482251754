"""Queries that write through the sinks and read back what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators import explore, pages
from firmlens.operators.shared import shared_path
from firmlens.plans import teampages
from firmlens.plans.fixtures import AS_OF, view, with_views
from firmlens.plans.registry import query
from firmlens.operators import aggregate
from firmlens.sources import export, firm_list


@query(f"{with_views('firms')} SELECT coalesce(nullif(company_name, ''), website_url) AS company_name, website_url, investment_niches AS description, CASE WHEN website_url = '' THEN 'no URL' END AS reject_reason FROM firms")
def csv_firm_list(spark, d) -> DataFrame:
    """A1 to A3, A5, A6, B3, B5 (A4: list_preview): a list written as CSV, read, its columns detected, its rows validated."""
    path = shared_path(spark, "firms-csv")
    firms = view(spark, d, "firms").select(F.col("company_name").alias("Firm Name"), F.col("website_url").alias("Website URL"), F.col("investment_niches").alias("About"))
    export.write_tables({"firms": export.clean(firms)}, path, "csv")
    return firm_list.standardise(firm_list.read_csv(spark, f"{path}/firms"))


@query(f"{with_views('firms')} SELECT website_url AS company_name, website_url, '' AS description FROM firms WHERE website_url LIKE 'http%'")
def url_list(spark, d) -> DataFrame:
    """A list of URLs, one on each line."""
    path = shared_path(spark, "urls")
    view(spark, d, "firms").select(F.concat(F.lit("  "), "website_url").alias("value")).write.text(path)
    return firm_list.read_urls(spark, path)


@query(f"{with_views('job_logs')} SELECT log_id, status FROM job_logs WHERE job_id = 7")
def partitioned_logs(spark, d) -> DataFrame:
    """Logs written by job; a job's read touches its own files only."""
    path = shared_path(spark, "logs")
    view(spark, d, "job_logs").select("log_id", "status", "job_id").write.partitionBy("job_id").parquet(path)
    return spark.read.parquet(path).filter("job_id = 7").select("log_id", "status")


@query(f"{with_views('firms', 'members', 'portfolio')} SELECT 'firms' AS sheet, count(*) AS n FROM firms UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'portfolio', count(*) FROM portfolio UNION ALL SELECT 'thesis', count(*) FROM firms UNION ALL SELECT 'summary', count(*) FROM firms UNION ALL SELECT 'metrics', count(*) + 1 FROM firms UNION ALL SELECT 'empty', 1")
def exported_tables(spark, d) -> DataFrame:
    """B1, B2: all tables of the export, one of them without rows; rows of each after reading back."""
    f, m, p = view(spark, d, "firms"), view(spark, d, "members"), view(spark, d, "portfolio")
    path = shared_path(spark, "export")
    tables = {"firms": f, "members": aggregate.with_tier(m), "portfolio": aggregate.with_recency(p, AS_OF), "thesis": aggregate.thesis(f, m, p, AS_OF), "summary": aggregate.processing_summary(f, m, p), "metrics": aggregate.quality_metrics(f, m, p), "empty": export.with_placeholder(f.filter("firm_id < 0"), "No data")}
    export.write_tables(tables, path)
    counts = [spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("sheet"), F.count(F.lit(1)).alias("n")) for k in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"{with_views('members')}, f AS (SELECT DISTINCT firm_id FROM members), s AS (SELECT firm_id, unnest(range(1, 5)) AS p FROM f) SELECT 'https://list.example.com/f' || firm_id || '?page=1' AS start, 'https://list.example.com/f' || firm_id || '?page=' || p AS url, p AS place FROM s WHERE firm_id % 4 = 0 AND p <= 2")
def followed_listings(spark, d) -> DataFrame:
    """Listings followed to the next page until there is none."""
    nxt = pages.next_page(teampages.listing_pages(spark, d))
    return explore.follow(nxt.select("url", "next_url"), nxt.filter("url LIKE '%page=1'").select(F.col("url").alias("start"))).withColumn("place", F.col("place").cast("long"))


@query(f"{with_views('firms', 'members')}, n AS (SELECT DISTINCT name AS company_name, 'https://list.example.com/profile/p' || member_id AS website_url FROM members) SELECT company_name, website_url FROM firms UNION ALL SELECT * FROM n")
def expanded_list(spark, d) -> DataFrame:
    """Entries of listings added to the list of firms."""
    entries = pages.markdown_links(teampages.listing_pages(spark, d)).filter("link LIKE '%/profile/%'").select(F.col("text").alias("name"), F.col("link").alias("url"))
    return explore.expand(view(spark, d, "firms").select("company_name", "website_url"), firm_list.from_directory(entries).select(F.col("company_name").alias("name"), F.col("website_url").alias("url")))


@query(f"{with_views('firms')} SELECT count(*) AS rows_kept FROM firms")
def counted_list(spark, d) -> DataFrame:
    """The guard on a list's length, here with a bound that no table of suppliers reaches; the usual one is MAX_FIRMS."""
    return firm_list.check_count(view(spark, d, "firms"), 2**31 - 2).agg(F.count(F.lit(1)).alias("rows_kept"))


@query(f"{with_views('firms', 'members')}, p AS (SELECT firm_id, company_name FROM firms ORDER BY md5(company_name || '42') LIMIT 5), n AS (SELECT firm_id, CAST(to_json(list({{'member_id': member_id, 'name': name, 'title': title}} ORDER BY member_id)) AS VARCHAR) AS members FROM members GROUP BY 1) SELECT p.firm_id, p.company_name, n.members FROM p LEFT JOIN n USING (firm_id)")
def seeded_sample(spark, d) -> DataFrame:
    """Five firms by a seeded hash, with their members nested."""
    got = export.sample(view(spark, d, "firms").select("firm_id", "company_name"), view(spark, d, "members"))
    return got.select("firm_id", "company_name", F.to_json("members").alias("members"))
