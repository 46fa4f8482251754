"""Queries of taxonomies: types, stages, niches, specialisations, filings, profiles and URL patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions import dims
from firmlens.plans.fixtures import view, with_views
from firmlens.plans.records import tag
from firmlens.plans.registry import query


def _words(d: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(label, w) for label, ws in d.items() for w in ws]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_STAGES, _TYPES = _words(dims.INVESTMENT_STAGES), _words(dims.INVESTOR_TYPES)


@query(f"{with_views('portfolio')}, k(label, word) AS (VALUES {_values(_STAGES)}) SELECT company_id, label, count(*) AS hits, 'High' AS confidence FROM portfolio, k WHERE contains(lower(investment_niche), word) GROUP BY ALL")
def stage_tags(spark, d) -> DataFrame:
    """Stages by their keywords; confidence is High where any is found."""
    return tag(view(spark, d, "portfolio"), _STAGES, "company_id", "investment_niche").withColumn("confidence", F.lit("High"))


@query(f"{with_views('firms')}, k(label, word) AS (VALUES {_values(_TYPES)}), h AS (SELECT firm_id, label FROM firms, k WHERE contains(lower(investor_type), word) GROUP BY ALL) SELECT f.firm_id, coalesce(string_agg(label, ', ' ORDER BY label), '') AS types, CASE WHEN count(label) > 0 THEN 'High' ELSE 'Low' END AS confidence FROM firms f LEFT JOIN h USING (firm_id) GROUP BY f.firm_id")
def investor_type_tags(spark, d) -> DataFrame:
    """Investor types; Low confidence without any."""
    f = view(spark, d, "firms")
    t = tag(f, _TYPES, "firm_id", "investor_type").groupBy("firm_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("types"))
    return f.select("firm_id").join(t, "firm_id", "left").select("firm_id", F.coalesce("types", F.lit("")).alias("types"), F.when(F.col("types").isNotNull(), "High").otherwise("Low").alias("confidence"))


@query(f"{with_views('firms')}, k(category, sub, label) AS (VALUES {_values(dims.niche_labels())}), n AS (SELECT firm_id, trim(unnest(string_split(investment_niches, ','))) AS niche FROM firms) SELECT DISTINCT firm_id, niche, category, sub FROM n JOIN k ON lower(niche) = lower(label)")
def niche_tags(spark, d) -> DataFrame:
    """Niches of firms placed in the tree. The dimension is small and fixed."""
    k = F.broadcast(dims.frame(spark, dims.niche_labels(), "category string, sub string, label string"))
    n = view(spark, d, "firms").select("firm_id", F.explode(F.split("investment_niches", ",")).alias("niche")).withColumn("niche", F.trim("niche"))
    return n.join(k, F.lower("niche") == F.lower("label")).select("firm_id", "niche", "category", "sub").distinct()


@query(f"{with_views('portfolio')}, k(word) AS (VALUES {_values([(w,) for w in dims.SPECIALISATIONS])}) SELECT company_id, string_agg(word, ',' ORDER BY word) AS tags FROM portfolio, k WHERE contains(lower(investment_niche), word) GROUP BY company_id")
def specialisation_tags(spark, d) -> DataFrame:
    """I20."""
    low = F.lower("investment_niche")
    tags = F.filter(F.array(*map(F.lit, sorted(dims.SPECIALISATIONS))), lambda w: low.contains(w))
    return view(spark, d, "portfolio").select("company_id", F.array_join(tags, ",").alias("tags")).filter("tags <> ''")


_FILING = "CASE firm_id % 3 WHEN 0 THEN 'Our Investment strategy: ' || repeat('early stage technology and healthcare ', 3) || '. More.' WHEN 1 THEN 'A private equity and saas fund' ELSE 'Nothing to tell' END"


@query(f"{with_views('firms')}, t AS (SELECT firm_id, {_FILING} AS t FROM firms), x AS (SELECT firm_id, list_filter([{', '.join(repr(w) for w in dims.FILING_STRATEGIES)}], lambda w: contains(lower(t), w)) AS s, list_filter([{', '.join(repr(w) for w in dims.FILING_ASSETS)}], lambda w: contains(lower(t), w)) AS a, trim(regexp_extract(t, '(?i)investment strategy[:\\s]+([^.]{{50,500}})', 1)) AS p FROM t) SELECT firm_id, array_to_string(s, ',') AS strategies, array_to_string(a, ',') AS assets, coalesce(nullif(p, ''), 'Investment strategy found in SEC filings') AS description, CASE WHEN p <> '' THEN 'High' ELSE 'Medium' END AS confidence FROM x WHERE len(s) + len(a) > 0")
def filing_tags(spark, d) -> DataFrame:
    """Strategies, assets and the strategy's sentence of a filing."""
    t = view(spark, d, "firms").selectExpr("firm_id", f"{_FILING} AS t")
    low = F.lower("t")
    some = lambda ws: F.filter(F.array(*map(F.lit, ws)), lambda w: low.contains(w))
    x = t.select("firm_id", some(dims.FILING_STRATEGIES).alias("s"), some(dims.FILING_ASSETS).alias("a"), F.trim(F.regexp_extract("t", r"(?i)investment strategy[:\s]+([^.]{50,500})", 1)).alias("p"))
    return x.filter(F.size("s") + F.size("a") > 0).select("firm_id", F.array_join("s", ",").alias("strategies"), F.array_join("a", ",").alias("assets"), F.coalesce(F.nullif("p", F.lit("")), F.lit("Investment strategy found in SEC filings")).alias("description"), F.when(F.col("p") != "", "High").otherwise("Medium").alias("confidence"))


_TEMPLATE = "CASE job_id % 5 WHEN 0 THEN 'vc' WHEN 1 THEN 'people' WHEN 2 THEN 'local' WHEN 3 THEN 'other' END"


@query(f"{with_views('jobs')}, k(template, profile) AS (VALUES {_values(dims.TEMPLATE_PROFILES.items())}) SELECT coalesce(profile, 'general') AS profile, count(*) AS jobs FROM (SELECT {_TEMPLATE} AS template FROM jobs) j LEFT JOIN k USING (template) GROUP BY 1")
def job_profiles(spark, d) -> DataFrame:
    """The profile of a job's template, else the general one."""
    k = F.broadcast(dims.frame(spark, list(dims.TEMPLATE_PROFILES.items()), "template string, profile string"))
    j = view(spark, d, "jobs").selectExpr(f"{_TEMPLATE} AS template")
    return j.join(k, "template", "left").groupBy(F.coalesce("profile", F.lit("general")).alias("profile")).agg(F.count(F.lit(1)).alias("jobs"))


@query(f"{with_views('firms')}, w(p, n) AS (VALUES {', '.join(f'({p!r}, {n})' for p, n in dims.WATERFALL_PATHS)}), q(p) AS (VALUES {_values([(p,) for p in dims.PORTFOLIO_PATHS])}), f AS (SELECT firm_id, regexp_replace(website_url, '/$', '') AS b FROM firms WHERE website_url LIKE 'http%') SELECT firm_id, b || p AS url, n AS priority, 'waterfall' AS kind FROM f, w UNION ALL SELECT firm_id, b || p, 4, 'portfolio' FROM f, q")
def url_patterns(spark, d) -> DataFrame:
    """The URLs that are tried for each site, from fixed lists of paths."""
    f = view(spark, d, "firms").filter("website_url LIKE 'http%'").select("firm_id", F.regexp_replace("website_url", "/$", "").alias("b"))
    rows = [(p, n, "waterfall") for p, n in dims.WATERFALL_PATHS] + [(p, 4, "portfolio") for p in dims.PORTFOLIO_PATHS]
    items = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("n"), F.lit(k).alias("k")) for p, n, k in rows)))
    return f.select("firm_id", "b", items.alias("x")).select("firm_id", F.concat("b", "x.p").alias("url"), F.col("x.n").alias("priority"), F.col("x.k").alias("kind"))
