"""Domain views over the supplied tables: one text for both engines ({supplier} and so on name the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-02"

FIRMS = """
SELECT s_suppkey AS firm_id, s_name AS company_name,
       CASE s_suppkey % 4
         WHEN 0 THEN concat('https://www.firm', CAST(s_suppkey AS STRING), '.example.com/')
         WHEN 1 THEN concat('firm', CAST(s_suppkey AS STRING), '.example.org')
         WHEN 2 THEN concat('http://Firm', CAST(s_suppkey AS STRING), '.example.net/About?x=1#top')
         ELSE '' END AS website_url,
       CASE WHEN s_acctbal < 0 THEN 'No' ELSE 'Yes' END AS website_verified,
       CASE WHEN s_acctbal < 0 THEN 'Page not found (404)' ELSE '' END AS verification_message,
       CASE s_suppkey % 3 WHEN 0 THEN 'Venture Capital (VC)' WHEN 1 THEN 'Micro VC' ELSE '' END AS investor_type,
       CASE s_suppkey % 3 WHEN 0 THEN 'Seed, Series A' WHEN 1 THEN 'Series B' ELSE '' END AS investment_stages,
       CASE s_suppkey % 4 WHEN 0 THEN 'SaaS, FinTech, Cybersecurity, BioTech' WHEN 1 THEN 'Deep Tech' WHEN 2 THEN 'CleanTech, AgriTech' ELSE '' END AS investment_niches
FROM {supplier}"""

MEMBERS = """
SELECT m.member_id, m.firm_id, s.s_name AS vc_firm, m.name, m.title, m.linkedin_url, m.email, m.specialization
FROM (
  SELECT c_custkey AS member_id, (c_custkey * 7) % (SELECT count(*) FROM {supplier}) AS firm_id,
         CASE c_custkey % 5
           WHEN 0 THEN concat('José  Ramos', CAST(c_custkey % 40 AS STRING)) WHEN 1 THEN concat('jose ramos', CAST(c_custkey % 40 AS STRING))
           WHEN 2 THEN concat('Smith', CAST(c_custkey % 40 AS STRING), ' Ann') WHEN 3 THEN concat('Ann Smith', CAST(c_custkey % 40 AS STRING))
           ELSE c_name END AS name,
         CASE c_custkey % 18
           WHEN 0 THEN 'Managing Partner' WHEN 1 THEN 'General Partner, ABC Capital' WHEN 2 THEN 'Venture Partner' WHEN 3 THEN 'Principal' WHEN 4 THEN 'VP'
           WHEN 5 THEN 'Senior Associate' WHEN 6 THEN 'Analyst' WHEN 7 THEN 'Data Analyst' WHEN 8 THEN 'CFO' WHEN 9 THEN 'Growth Marketing Manager'
           WHEN 10 THEN 'Limited Partner, Investments' WHEN 11 THEN 'Venture Scout' WHEN 12 THEN 'Software Engineer' WHEN 13 THEN ''
           WHEN 14 THEN 'Portfolio Manager' WHEN 15 THEN 'Head of Investor Relations' WHEN 16 THEN 'MD' ELSE 'Sr. Associate' END AS title,
         CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' ELSE concat('https://www.linkedin.com/in/p', CAST(c_custkey AS STRING)) END AS linkedin_url,
         CASE WHEN c_custkey % 3 = 0 THEN concat('p', CAST(c_custkey AS STRING), '@example.com') END AS email,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS specialization
  FROM {customer}) m
JOIN {supplier} s ON s.s_suppkey = m.firm_id
WHERE m.firm_id % 9 <> 0"""

PORTFOLIO = """
SELECT p.company_id, p.firm_id, s.s_name AS vc_firm, p.portfolio_company, p.investment_date, p.investment_niche
FROM (
  SELECT o_orderkey AS company_id, (o_custkey * 11) % (SELECT count(*) FROM {supplier}) AS firm_id,
         concat('Company ', CAST(o_orderkey AS STRING)) AS portfolio_company,
         CASE o_orderkey % 6
           WHEN 0 THEN 'Unknown' WHEN 1 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
           WHEN 2 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS investment_date,
         CASE substring(o_orderpriority, 1, 1)
           WHEN '1' THEN 'SaaS, FinTech' WHEN '2' THEN 'Seed stage SaaS' WHEN '3' THEN 'Series A, BioTech' WHEN '4' THEN 'growth, Cybersecurity' ELSE '' END AS investment_niche
  FROM {orders}) p
JOIN {supplier} s ON s.s_suppkey = p.firm_id
WHERE p.firm_id % 7 <> 0"""

JOB_LOGS = """
SELECT event_id AS log_id, user_id % 20 AS job_id, ts AS created_at, concat('https://site', CAST(user_id AS STRING), '.example.com') AS url,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status,
       5 AS fields_total,
       CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 3 ELSE 5 END AS fields_filled,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 97 = 0 THEN 'not json' WHEN event_type = 'click' THEN '["aum","headquarters"]' ELSE '[]' END AS empty_fields,
       CASE WHEN event_type = 'error' THEN
         CASE event_id % 5 WHEN 0 THEN 'Request failed with status code 403' WHEN 1 THEN 'timeout of 10000ms exceeded' WHEN 2 THEN 'empty page' WHEN 3 THEN 'OpenAI parse error' ELSE 'boom' END END AS error_detail,
       CAST(floor(value * 100) AS BIGINT) AS duration_ms
FROM {events}"""

PROCESSED = """
SELECT s_suppkey AS firm_id, s_name AS company_name,
       CASE s_suppkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END AS status
FROM {supplier} WHERE s_suppkey % 2 = 0"""

#: Jobs from orders: one for each order of the first 20 customers' groups.
JOBS = """
SELECT o_orderkey AS job_id, o_custkey % 10 AS owner_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 MINUTE END AS heartbeat_at,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR AS completed_at,
       CAST(10 + o_orderkey % 90 AS INT) AS firm_count, CAST(o_orderkey % 10 AS INT) AS processed_count,
       o_orderkey % 3 <> 0 AS has_file, o_orderkey % 50000 + 1000 AS input_tokens, o_orderkey % 9000 + 100 AS output_tokens
FROM {orders}"""

VIEWS = {"firms": FIRMS, "members": MEMBERS, "portfolio": PORTFOLIO, "job_logs": JOB_LOGS, "processed": PROCESSED, "jobs": JOBS}
TABLES = ("supplier", "customer", "orders", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **tables)


def with_views(*names: str) -> str:
    """The views as common table expressions for the other engine."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
