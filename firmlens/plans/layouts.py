"""Queries of the export's layouts, of messages, previews, candidates and precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions import dates, dims, names, text, tiers, urls
from firmlens.operators import explore, jobs, match
from firmlens.plans.columns import _H, _VISIBLE
from firmlens.plans.firms import DATED, SCORED
from firmlens.plans.fixtures import AS_OF, view, with_views
from firmlens.plans.registry import ORACLES, QUERIES, query
from firmlens.sources import export, firm_list

#: Messages by log_id, the same in both engines.
_MESSAGE = """CASE log_id % 13 WHEN 0 THEN 'getaddrinfo ENOTFOUND x.example' WHEN 1 THEN 'DNS server failed' WHEN 2 THEN 'Timeout of 10000ms exceeded' WHEN 3 THEN 'connect ETIMEDOUT' WHEN 4 THEN 'connect ECONNREFUSED 10.0.0.1' WHEN 5 THEN 'Connection refused by peer'
    WHEN 6 THEN 'Request failed with status code 403' WHEN 7 THEN 'Page Not Found' WHEN 8 THEN 'Circuit breaker is open' WHEN 9 THEN 'status code 502' WHEN 10 THEN '429 too many' WHEN 11 THEN 'request timed out' ELSE repeat('boom ', 30) END"""


def _messages(spark, d) -> DataFrame:
    return view(spark, d, "job_logs").selectExpr("log_id", f"{_MESSAGE} AS message")


@query(f"""{with_views('job_logs')}, m AS (SELECT log_id, {_MESSAGE} AS message FROM job_logs) SELECT log_id, CASE WHEN log_id % 13 IN (0, 1) THEN 'Domain does not exist or DNS lookup failed' WHEN log_id % 13 IN (2, 3) THEN 'Website timeout - site may be slow or temporarily unavailable' WHEN log_id % 13 IN (4, 5) THEN 'Connection refused - server may be down'
    WHEN log_id % 13 = 6 THEN 'Access blocked - website has anti-bot protection' WHEN log_id % 13 = 7 THEN 'Page not found (404)' WHEN log_id % 13 = 8 THEN 'Circuit breaker open - domain temporarily blocked due to repeated failures' ELSE 'Failed to fetch: ' || substr(message, 1, 100) END AS message FROM m""")
def site_check_errors(spark, d) -> DataFrame:
    """What the check of a site says of an error."""
    return _messages(spark, d).select("log_id", text.site_error(F.col("message")).alias("message"))


@query(f"""{with_views('job_logs')} SELECT log_id, CASE log_id % 13 WHEN 0 THEN 'Website domain not found' WHEN 1 THEN 'Website domain not found' WHEN 2 THEN 'Verification timed out' WHEN 4 THEN 'Website connection refused' WHEN 5 THEN 'Website connection refused' WHEN 6 THEN 'Website blocked access (403)'
    WHEN 7 THEN 'Website not accessible (404)' WHEN 9 THEN 'Website server error' WHEN 10 THEN 'Verification temporarily unavailable (rate limit)' WHEN 11 THEN 'Verification timed out' ELSE 'Verification unavailable' END AS message FROM job_logs""")
def verification_errors(spark, d) -> DataFrame:
    """What a verification says of an error."""
    return _messages(spark, d).select("log_id", text.verification_error(F.col("message")).alias("message"))


_PEOPLE = "SELECT c_custkey AS member_id, CASE c_custkey % 4 WHEN 0 THEN 'Robert Q' WHEN 1 THEN 'Chris' WHEN 2 THEN 'Kate Ann Maria' ELSE 'Cher' END || CASE WHEN c_custkey % 4 = 3 THEN '' ELSE ' O''Neil-Smith' || CAST(c_custkey AS STRING) END AS name FROM {customer}"


@query(f"""WITH p AS ({_PEOPLE.format(customer='customer')}), w AS (SELECT member_id, regexp_replace(lower(string_split(name, ' ')[1]), '[^a-z]', '', 'g') AS f, CASE c_custkey WHEN 0 THEN 'q' WHEN 2 THEN 'annmaria' ELSE '' END AS m FROM (SELECT *, member_id % 4 AS c_custkey FROM p WHERE member_id % 4 <> 3)),
    l AS (SELECT member_id, list_concat(list_concat([f || '-oneilsmith', f || 'oneilsmith'], CASE WHEN m <> '' THEN [f || '-' || m || '-oneilsmith'] ELSE [] END), [substr(f, 1, 1) || '-oneilsmith', f || '-o', f || '-oneilsmith-1', f || '-oneilsmith-2', f || '-oneilsmith-3', f || '-oneilsmith-4', f || '-oneilsmith-5']) AS s FROM w)
    SELECT member_id, CAST(generate_subscripts(s, 1) AS INT) AS place, 'https://www.linkedin.com/in/' || unnest(s) AS url FROM l""")
def simple_profile_candidates(spark, d) -> DataFrame:
    """I15."""
    return match.simple_profile_candidates(spark.sql(_PEOPLE, customer=spark.read.parquet(f"{d}/customer.parquet")))


@query(f"{with_views('firms')} SELECT firm_id, 'a-b-' || regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g') || '-co' AS slug FROM firms")
def company_slugs(spark, d) -> DataFrame:
    """I16: the second rule for a company's slug."""
    name = F.concat(F.lit("A.  B - "), "company_name", F.lit(" & Co."))
    return view(spark, d, "firms").select("firm_id", names.linkedin_slug(name).alias("slug"))


@query(f"{with_views('job_logs')}, r AS (SELECT job_id, log_id, status, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, log_id DESC) AS place FROM job_logs) SELECT job_id, log_id, status, place FROM r WHERE place <= 5")
def latest_logs(spark, d) -> DataFrame:
    """The latest five of each job."""
    return jobs.latest(view(spark, d, "job_logs"))


@query("SELECT doc_id, source AS company_name, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '…' ELSE text END AS description FROM documents ORDER BY doc_id LIMIT 5")
def list_preview(spark, d) -> DataFrame:
    """The first five rows of a list, long texts cut."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("company_name"), F.col("text").alias("description"))
    return firm_list.preview(rows, order="doc_id")[1]


@query(f"""{with_views('members')}, k AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(trim(name))), '\\s+', ' ', 'g'), '[^a-z0-9\\s\\-'']', '', 'g')) AS pk FROM members),
    f AS (SELECT firm_id, pk, min(member_id) AS first FROM k WHERE member_id % 3 = 0 GROUP BY ALL) SELECT k.firm_id AS page_id, member_id, CASE WHEN first IS NULL OR first % 2 = 0 THEN title ELSE 'Own ' || first END AS title,
    CASE WHEN first % 5 = 0 THEN 'https://www.linkedin.com/in/own' || first ELSE coalesce(linkedin_url, '') END AS linkedin_url, CASE WHEN first % 7 < 3 THEN 'We back ' || first ELSE specialization END AS specialization, CASE WHEN first % 4 = 1 THEN 'own' || first || '@example.org' ELSE coalesce(email, '') END AS email,
    CASE WHEN first % 5 = 0 THEN 'High' ELSE 'Low' END AS confidence FROM k LEFT JOIN f ON f.firm_id = k.firm_id AND f.pk = k.pk""")
def preferred_profiles(spark, d) -> DataFrame:
    """What a person's own page says goes before what the team page says."""
    m = view(spark, d, "members").withColumn("page_id", F.col("firm_id"))
    own = lambda test, *parts: F.when(F.expr(test), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise("")
    key = F.col("member_id").cast("string")
    details = m.filter("member_id % 3 = 0").select("page_id", F.col("member_id").alias("seq"), F.upper("name").alias("name"), own("member_id % 2 = 1", "Own ", key).alias("title"), own("member_id % 5 = 0", "https://www.linkedin.com/in/own", key).alias("linkedin_url"), own("member_id % 7 < 3", "We back ", key).alias("philosophy"), own("member_id % 4 = 1", "own", key, "@example.org").alias("email"))
    return match.prefer_profile(m.withColumn("confidence", F.lit("Low")), details)


def _sql_cells(have: dict[str, str], labels: list[tuple[str, str]]) -> str:
    """JSON of a row for the other engine. have: field to SQL; labels: (field, label)."""
    return "to_json({" + ", ".join(f"'{l}': " + (f"coalesce(CAST({have[f]} AS VARCHAR), '')" if f in have else "''") for f, l in labels) + "})"


_FIRM_SQL = {x: x for x in ("company_name", "website_url", "website_verified", "verification_message", "investor_type", "investment_stages", "investment_niches")}
_MEMBER_SQL = {x: x for x in ("vc_firm", "name", "title", "specialization", "linkedin_url", "email")} | {"decision_maker_tier": tiers.sql("title")}
_COMPANY_SQL = {x: x for x in ("vc_firm", "portfolio_company", "investment_date", "investment_niche")}


def _sheets(spark, d) -> dict[str, tuple[DataFrame, str]]:
    members = view(spark, d, "members").withColumn("decision_maker_tier", tiers.tier(F.col("title")))
    return {"firms": (view(spark, d, "firms"), "firm_id"), "members": (members, "member_id"), "portfolio": (view(spark, d, "portfolio"), "company_id")}


def _rows(sheet: str, df: DataFrame, key: str, labels: list[tuple[str, str]]) -> DataFrame:
    return df.select(F.lit(sheet).alias("sheet"), F.col(key).cast("long").alias("row_id"), export.cells(df, dict(labels)).alias("cells"))


@query(f"{with_views('firms', 'members')} SELECT 'Firms' AS sheet, firm_id AS row_id, CAST({_sql_cells(_FIRM_SQL, export.SHORT_SHEETS['Firms'])} AS VARCHAR) AS cells FROM firms UNION ALL SELECT 'Team Members', member_id, CAST({_sql_cells(_MEMBER_SQL, export.SHORT_SHEETS['Team Members'])} AS VARCHAR) FROM members")
def short_exports(spark, d) -> DataFrame:
    """The rows of the short export, 13 and 16 columns under their labels."""
    t = _sheets(spark, d)
    return _rows("Firms", *t["firms"], export.SHORT_SHEETS["Firms"]).unionByName(_rows("Team Members", *t["members"], export.SHORT_SHEETS["Team Members"]))


_FULL = {"VC Firms": ("firms", _FIRM_SQL, "firm_id"), "Team Members": ("members", _MEMBER_SQL, "member_id"), "Portfolio Companies": ("portfolio", _COMPANY_SQL, "company_id")}
_fields = lambda sheet: [(export.snake(c), c) for c in export.SHEETS[sheet]]


@query(f"{with_views('firms', 'members', 'portfolio')} " + " UNION ALL ".join(f"SELECT '{sheet}' AS sheet, {key} AS row_id, CAST({_sql_cells(have, _fields(sheet))} AS VARCHAR) AS cells FROM {table}" for sheet, (table, have, key) in _FULL.items()))
def export_sheets(spark, d) -> DataFrame:
    """B1: the rows of the full export's sheets of firms, members and companies, 20, 20 and 9 columns; report_sheets has the other three."""
    t = _sheets(spark, d)
    return reduce(DataFrame.unionByName, (_rows(sheet, *t[table], _fields(sheet)) for sheet, (table, _, _) in _FULL.items()))


#: The other three sheets of the full export: the query that makes them, and its column of names.
_PERCENT = {"linkedin_coverage": "linkedin_pct", "email_coverage": "email_pct", "specialization_coverage": "special_pct", "tier1_percent": "tier1_pct", "tier2_percent": "tier2_pct", "tier3_percent": "tier3_pct"}
_REPORTS = {"Investment Thesis": ("firm_thesis", "vc_firm"), "Processing Summary": ("processing_summary", "firm_name"), "Data Quality": ("quality_metrics", "firm_name")}


@query(" UNION ALL ".join(f"SELECT '{sheet}' AS sheet, {name} AS row_name, CAST({_sql_cells({f: _PERCENT.get(f, f) for f, _ in _fields(sheet)}, _fields(sheet))} AS VARCHAR) AS cells FROM ({ORACLES[q]})" for sheet, (q, name) in _REPORTS.items()))
def report_sheets(spark, d) -> DataFrame:
    """B1: the rows of the full export's sheets of theses, processing and quality, 15, 10 and 11 columns under their labels."""
    rows = (QUERIES[q](spark, d).select(F.lit(sheet).alias("sheet"), F.col(name).alias("row_name"), "*") for sheet, (q, name) in _REPORTS.items())
    return reduce(DataFrame.unionByName, (df.select("sheet", "row_name", export.cells(df, {_PERCENT.get(f, f): c for f, c in _fields(sheet)}).alias("cells")) for df, sheet in zip(rows, _REPORTS, strict=True)))


_TEMPLATE = {"firms": ("firms", _FIRM_SQL, "firm_id"), "team": ("members", _MEMBER_SQL, "member_id"), "portfolio": ("s", _COMPANY_SQL | {"recency_category": "recency_category"}, "company_id")}
_template_rows = lambda t, n, labels: f"SELECT '{t}' AS template, '{n}' AS sheet, {_TEMPLATE[n][2]} AS row_id, CAST({_sql_cells(_TEMPLATE[n][1], list(labels.items()))} AS VARCHAR) AS cells FROM {_TEMPLATE[n][0]}"


@query(f"{with_views('firms', 'members', 'portfolio')}, {DATED}, {SCORED} " + " UNION ALL ".join(_template_rows(t, n, labels) for t, sheets in dims.TEMPLATE_SHEETS.items() for n, labels in sheets.items()))
def template_sheets(spark, d) -> DataFrame:
    """The rows of each sheet of the 8 templates, under that template's labels."""
    tables = _sheets(spark, d)
    p, key = tables["portfolio"]
    of = {"firms": tables["firms"], "team": tables["members"], "portfolio": (p.withColumn("recency_category", dates.recency_category(F.col("investment_date"), F.lit(AS_OF).cast("date"))), key)}
    rows = (_rows(n, *of[n], list(labels.items())).select(F.lit(t).alias("template"), "sheet", "row_id", "cells") for t, sheets in dims.TEMPLATE_SHEETS.items() for n, labels in sheets.items())
    return reduce(DataFrame.unionByName, rows)


@query(f"WITH v AS (SELECT page_id, url, length({_VISIBLE}) AS n FROM pages), m AS (SELECT *, CASE WHEN contains(url, '/team') OR contains(url, '/people') OR contains(url, '/about') THEN 1000 ELSE 100 END AS least FROM v) SELECT page_id, least, n >= least AS enough FROM m")
def enough_content(spark, d) -> DataFrame:
    """Pages of people need 1000 visible characters, others 100."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    least = text.least_chars(F.col("url"))
    return p.select("page_id", least.alias("least"), (F.length(text.visible_text(F.col("html"))) >= least).alias("enough"))


#: Archived pages of firms and candidates for them, the same text for both engines. Pages are long or short, and speak of a portfolio or don't.
_ARCHIVED = """SELECT firm_id, '/team' AS path, concat('People of ', company_name, repeat(' and friends', 25)) AS content FROM firms UNION ALL SELECT firm_id, '/portfolio', concat('Our Portfolio at ', company_name, repeat(' and more', 25)) FROM firms WHERE firm_id % 4 <> 0
    UNION ALL SELECT firm_id, '/companies', concat(CASE WHEN firm_id % 2 = 0 THEN 'All companies' ELSE 'All of them' END, ' of ', company_name, repeat(' as well', 30)) FROM firms WHERE firm_id % 3 <> 0 UNION ALL SELECT firm_id, '/investments', 'Holdings: none yet' FROM firms"""
_TRIED = "(VALUES ('/team', 1), ('/portfolio', 2), ('/companies', 3), ('/investments', 4))"


def _archive(spark, d) -> tuple[DataFrame, DataFrame]:
    """(candidates: site, url, place; pages: url, content)."""
    f = view(spark, d, "firms")
    url = F.concat(F.lit("https://h"), F.col("firm_id").cast("string"), F.col("path"))
    c = spark.sql(f"SELECT firm_id, x.path AS path, x.place AS place FROM {{firms}}, {_TRIED} AS x(path, place)", firms=f)
    p = spark.sql(_ARCHIVED.replace("FROM firms", "FROM {firms}"), firms=f)
    return c.select(F.col("firm_id").alias("site"), url.alias("url"), "place"), p.select(url.alias("url"), "content")


_ARCHIVE_SQL = f"""{with_views('firms')}, a AS ({_ARCHIVED}), k AS (SELECT firm_id AS site, 'https://h' || firm_id || x.path AS url, x.place, content FROM (SELECT firm_id, x.path, x.place FROM firms, {_TRIED} AS x(path, place)) x LEFT JOIN a USING (firm_id, path))"""


@query(f"""{_ARCHIVE_SQL}, g AS (SELECT * FROM k WHERE site % 5 = 0 OR place IN (2, 3)), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place) AS r FROM g WHERE length(content) >= 200 AND regexp_matches(lower(content), 'portfolio|investment|companies|holdings')) SELECT site, url, place FROM r WHERE r <= 3""")
def portfolio_waterfall(spark, d) -> DataFrame:
    """the first three usable pages of a firm that speak of a portfolio, of those that were found; where none was found, of the standard ones."""
    candidates, archive = _archive(spark, d)
    candidates = explore.with_fallback(candidates.filter("site % 5 <> 0 AND place IN (2, 3)"), candidates)
    return explore.waterfall(candidates, archive, (F.length("content") >= 200) & text.of_portfolio(F.col("content")), 3).select("site", "url", "place")


@query(f"""{_ARCHIVE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place) AS r FROM k WHERE length(content) >= 200), t AS (SELECT site, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS combined, string_agg(url, ' ' ORDER BY place) AS sources, count(*) AS n, max(place) AS last FROM r WHERE r <= 2 GROUP BY 1)
    SELECT site, combined, sources, CAST(CASE WHEN n = 2 THEN last ELSE 4 END AS BIGINT) AS attempted FROM t""")
def combined_pages(spark, d) -> DataFrame:
    """the texts of the first two usable pages of each firm as one, where they come from, and how many candidates were tried."""
    candidates, archive = _archive(spark, d)
    return explore.combined(candidates, archive, F.length("content") >= 200, 2).withColumn("sources", F.array_join("sources", " "))


@query(f"{with_views('firms', 'processed')}, t AS (SELECT company_name, min(firm_id) AS firm_id FROM firms GROUP BY 1) SELECT t.firm_id, t.company_name, f.investment_niches AS thesis FROM firms f JOIN t USING (company_name) WHERE f.firm_id = t.firm_id AND t.firm_id NOT IN (SELECT firm_id FROM processed)")
def new_thesis_rows(spark, d) -> DataFrame:
    """Thesis rows that aren't stored yet, under the first id of their firm's name."""
    f = view(spark, d, "firms")
    ids = f.groupBy("company_name").agg(F.min("firm_id").alias("firm_id"))
    thesis = f.select("company_name", F.col("investment_niches").alias("thesis"), F.col("firm_id").alias("seq"))
    rows = thesis.join(ids, "company_name").select("firm_id", "company_name", "thesis", "seq")
    return export.new_rows(rows, view(spark, d, "processed"), ["firm_id"], "seq").drop("seq")
