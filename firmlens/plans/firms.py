"""Queries over firms, members and portfolio, each with its SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import dates, tiers
from firmlens.operators import aggregate
from firmlens.plans.fixtures import AS_OF, view, with_views
from firmlens.plans.registry import query

TIER = tiers.sql("title")
WHEN = r"CASE WHEN regexp_matches(investment_date, '^\d{4}$') THEN TRY_CAST(investment_date || '-01-01' AS DATE) WHEN regexp_matches(investment_date, '^\d{4}-\d{2}$') THEN TRY_CAST(investment_date || '-01' AS DATE) WHEN regexp_matches(investment_date, '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(investment_date AS DATE) END"
D = f"DATE '{AS_OF}'"
BEFORE = {n: f"(date_trunc('month', {D} - INTERVAL {n} MONTH)::DATE + (day({D}) - 1)::INT)" for n in (6, 12)}
TIERED = f"t AS (SELECT *, {TIER} AS tier FROM members)"
DATED = f"d AS (SELECT *, {WHEN} AS dt FROM portfolio)"
NICHES = "n AS (SELECT d.*, trim(u.x) AS niche, company_id * 100 + u.i AS seq FROM d, (SELECT company_id AS cid, unnest(string_split(investment_niche, ',')) AS x, generate_subscripts(string_split(investment_niche, ','), 1) AS i FROM portfolio) u WHERE u.cid = d.company_id AND trim(u.x) <> '')"
MONTHS = f"(date_diff('day', dt, {D}) / 30.0)"
SCORE = f"CASE WHEN dt IS NULL THEN 0 ELSE CAST(floor(CASE WHEN {MONTHS} <= 6 THEN 100 - {MONTHS} / 6 * 20 WHEN {MONTHS} <= 12 THEN 80 - ({MONTHS} - 6) / 6 * 20 WHEN {MONTHS} <= 24 THEN 60 - ({MONTHS} - 12) / 12 * 30 ELSE greatest(0.0, 30 - ({MONTHS} - 24) / 36 * 30) END + 0.5) AS INT) END"
CATEGORY = f"CASE WHEN {MONTHS} <= 6 THEN 'Very Recent' WHEN {MONTHS} <= 12 THEN 'Recent' WHEN {MONTHS} <= 24 THEN 'Moderate' ELSE 'Old' END"
SCORED = f"s AS (SELECT *, {SCORE} AS recency_score, {CATEGORY} AS recency_category FROM d)"


def _three(spark, d):
    return view(spark, d, "firms"), view(spark, d, "members"), view(spark, d, "portfolio")


_MEMBER_COUNTS = "mc AS (SELECT {k}, count(*) AS n_members, count(*) FILTER (tier = 'Tier 1') AS tier1_count, count(*) FILTER (tier = 'Tier 2') AS tier2_count, count(*) FILTER (tier = 'Tier 3') AS tier3_count, count(*) FILTER (length(linkedin_url) > 0) AS n_linkedin, count(*) FILTER (length(email) > 0) AS n_email, count(*) FILTER (length(specialization) > 0) AS n_special FROM t GROUP BY {k})"


def _thesis_sql(k: str, key: str) -> str:
    has = lambda *ks: "count(*) FILTER (" + " OR ".join(f"contains(lower(portfolio_company || ' ' || investment_niche), '{x}')" for x in ks) + ")"
    return f"""{with_views('firms', 'members', 'portfolio')}, {TIERED}, {DATED}, {NICHES}, {_MEMBER_COUNTS.format(k=k)},
        kp AS (SELECT {k}, string_agg(name || ' (' || title || ')', '; ' ORDER BY member_id) AS key_people FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY member_id) AS r FROM t WHERE tier = 'Tier 1') WHERE r <= 5 GROUP BY {k}),
        sc AS (SELECT {k}, count(*) AS n, {has('seed', 'pre-seed')} AS s, {has('series a', 'series-a')} AS a, {has('series b', 'series-b')} AS b, {has('growth', 'series c', 'series d')} AS g,
                 count(*) FILTER (dt >= {BEFORE[6]}) AS last_6, count(*) FILTER (dt >= {BEFORE[12]}) AS last_12 FROM d GROUP BY {k}),
        e1 AS (SELECT {k}, niche, count(*) AS c, min(seq) AS q FROM n WHERE dt >= {BEFORE[6]} GROUP BY {k}, niche),
        e AS (SELECT {k}, string_agg(niche, ', ' ORDER BY r) AS emerging FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY c DESC, q) AS r FROM e1) WHERE r <= 3 GROUP BY {k})
        SELECT f.firm_id, f.company_name AS vc_firm, website_url, coalesce(nullif(investor_type, ''), 'Not specified') AS investor_type,
          coalesce(nullif(array_to_string(list_transform(string_split(investment_niches, ','), lambda x: trim(x))[1:3], ', '), ''), 'Not specified') AS primary_focus_areas,
          coalesce(emerging, 'No recent investment data available') AS emerging_interests, coalesce(nullif(investment_stages, ''), 'Not specified') AS preferred_stages,
          CASE WHEN coalesce(sc.n, 0) = 0 THEN 'Unknown' WHEN s > a AND s > b THEN '$500K - $2M (Seed stage focus)' WHEN a > b AND a > g THEN '$2M - $10M (Series A focus)' WHEN b > 0 OR g > 0 THEN '$10M - $50M+ (Growth stage focus)' ELSE 'Varies by stage' END AS average_check_size,
          CASE WHEN last_6 > 0 THEN last_6 || ' investment' || CASE WHEN last_6 > 1 THEN 's' ELSE '' END || ' in last 6 months' WHEN last_12 > 0 THEN last_12 || ' investment' || CASE WHEN last_12 > 1 THEN 's' ELSE '' END || ' in last 12 months' ELSE 'Investment pace unknown' END AS recent_investment_pace,
          coalesce(key_people, 'Not identified') AS key_decision_makers, coalesce(n_members, 0) AS total_team_size, coalesce(tier1_count, 0) AS tier1_count, coalesce(tier2_count, 0) AS tier2_count,
          coalesce(sc.n, 0) AS portfolio_size, coalesce(last_6, 0) AS recent_portfolio_count,
          concat_ws('; ', CASE WHEN investment_niches <> '' THEN 'Focused on ' || array_to_string(string_split(investment_niches, ',')[1:2], ' and ') END,
            CASE WHEN investment_stages <> '' THEN 'Invests in ' || array_to_string(string_split(investment_stages, ',')[1:2], ' and ') || ' companies' END,
            CASE WHEN last_6 > 0 THEN last_6 || ' recent investment' || CASE WHEN last_6 > 1 THEN 's' ELSE '' END || ' in last 6 months' END,
            CASE WHEN tier1_count > 0 THEN tier1_count || ' senior partner' || CASE WHEN tier1_count > 1 THEN 's' ELSE '' END || ' available' END) AS talking_points
        FROM firms f LEFT JOIN mc ON mc.{k} = f.{key} LEFT JOIN kp ON kp.{k} = f.{key} LEFT JOIN sc ON sc.{k} = f.{key} LEFT JOIN e ON e.{k} = f.{key}"""


@query(_thesis_sql("firm_id", "firm_id"))
def firm_thesis(spark, d) -> DataFrame:
    """E15 (with D2, E10 to E14): the firm thesis summary."""
    return aggregate.thesis(*_three(spark, d), AS_OF)


@query(_thesis_sql("vc_firm", "company_name"))
def firm_thesis_by_name(spark, d) -> DataFrame:
    """E15 with D1: members and portfolio joined by the firm's name."""
    return aggregate.thesis(*_three(spark, d), AS_OF, "vc_firm")


_COUNTS = f"{_MEMBER_COUNTS.format(k='firm_id')}, pc AS (SELECT firm_id, count(*) AS np FROM portfolio GROUP BY firm_id), c AS (SELECT f.*, coalesce(n_members, 0) AS nm, coalesce(tier1_count, 0) AS t1, coalesce(tier2_count, 0) AS t2, coalesce(tier3_count, 0) AS t3, coalesce(n_linkedin, 0) AS nl, coalesce(n_email, 0) AS ne, coalesce(n_special, 0) AS ns, coalesce(np, 0) AS np FROM firms f LEFT JOIN mc USING (firm_id) LEFT JOIN pc USING (firm_id))"


@query(f"""{with_views('firms', 'members', 'portfolio')}, {TIERED}, {_COUNTS}
    SELECT firm_id, company_name AS firm_name, website_url AS website,
      CASE WHEN website_verified = 'No' OR nm = 0 OR np = 0 THEN 'Warning' ELSE 'Success' END AS status,
      CASE WHEN website_verified = 'No' THEN coalesce(nullif(verification_message, ''), 'Website verification failed') WHEN nm = 0 AND np = 0 THEN 'No team members or portfolio companies found' WHEN nm = 0 THEN 'No team members found' WHEN np = 0 THEN 'No portfolio companies found' ELSE '' END AS error_message,
      nm AS team_members_found, t1 AS tier1_count, t2 AS tier2_count, t3 AS tier3_count, np AS portfolio_companies_found,
      CASE WHEN website_verified = 'No' THEN 'Partial - Website not accessible' WHEN nm = 0 AND np = 0 THEN 'Minimal' WHEN nm = 0 THEN 'Partial - Missing team data' WHEN np = 0 THEN 'Partial - Missing portfolio data' ELSE 'Complete' END AS data_completeness
    FROM c""")
def processing_summary(spark, d) -> DataFrame:
    """E1, E2."""
    return aggregate.processing_summary(*_three(spark, d))


def _pct(a, n="nm"):
    return f"CASE WHEN {n} > 0 THEN CAST(floor({a} / {n} * 100 + 0.5) AS BIGINT) ELSE 0 END"


_PCTS = ", ".join(f"{_pct(a)} AS {b}" for a, b in (("nl", "lp"), ("ne", "ep"), ("ns", "sp"), ("t1", "p1"), ("t2", "p2"), ("t3", "p3")))
_SHOWN = "lp || '%' AS linkedin_pct, ep || '%' AS email_pct, sp || '%' AS special_pct, p1 || '%' AS tier1_pct, p2 || '%' AS tier2_pct, p3 || '%' AS tier3_pct"


@query(f"""{with_views('firms', 'members', 'portfolio')}, {TIERED}, {_COUNTS}, p AS (SELECT *, {_PCTS} FROM c),
    x AS (SELECT count(*) AS nf, sum(nm)::BIGINT AS nm, sum(nl)::BIGINT AS nl, sum(ne)::BIGINT AS ne, sum(ns)::BIGINT AS ns, sum(t1)::BIGINT AS t1, sum(t2)::BIGINT AS t2, sum(t3)::BIGINT AS t3, sum(np)::BIGINT AS np FROM c), y AS (SELECT *, {_PCTS} FROM x)
    SELECT company_name AS firm_name, nm AS team_members_found, {_SHOWN}, np AS portfolio_companies,
      CAST(floor(lp * 0.3::DOUBLE + ep * 0.2::DOUBLE + sp * 0.2::DOUBLE + least(nm / 10, 1.0::DOUBLE) * 100 * 0.3::DOUBLE + 0.5) AS BIGINT) || '/100' AS data_quality_score,
      coalesce(nullif(concat_ws('; ', CASE WHEN nm = 0 THEN 'No team members found' WHEN nm < 3 THEN 'Few team members found' END, CASE WHEN lp < 30 THEN 'Low LinkedIn coverage' END, CASE WHEN ep = 0 THEN 'No emails found' END, CASE WHEN np = 0 THEN 'No portfolio companies' END, CASE WHEN website_verified = 'No' THEN 'Website not accessible' END), ''), 'Good extraction') AS extraction_notes
    FROM p UNION ALL SELECT '=== OVERALL SUMMARY ===', nm, {_SHOWN}, np, 'Avg team: ' || CAST(floor(nm / nf + 0.5) AS BIGINT), nf || ' firms processed' FROM y""")
def quality_metrics(spark, d) -> DataFrame:
    """E3, E4, E5."""
    return aggregate.quality_metrics(*_three(spark, d))


@query(f"{with_views('portfolio')}, {DATED}, {SCORED} SELECT company_id, firm_id, investment_date, recency_score, recency_category FROM s")
def recency(spark, d) -> DataFrame:
    """Recency of each investment."""
    return aggregate.with_recency(view(spark, d, "portfolio"), AS_OF).select("company_id", "firm_id", "investment_date", "recency_score", "recency_category")


@query(f"""{with_views('portfolio')}, {DATED}, {SCORED}, {NICHES.replace('n AS', 'n0 AS')}, n AS (SELECT n0.*, s.recency_category FROM n0 JOIN s USING (company_id)),
    c AS (SELECT firm_id, niche, count(*) AS k, count(*) FILTER (recency_category = 'Very Recent') AS r, min(seq) AS q, min(seq) FILTER (recency_category = 'Very Recent') AS rq FROM n GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY k DESC, q) AS pr FROM c),
    a AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY r DESC, rq) AS er FROM p WHERE pr > 3 AND r > 0 AND r / k > 0.5),
    pf AS (SELECT firm_id, string_agg(niche, ', ' ORDER BY pr) AS f FROM p WHERE pr <= 3 GROUP BY firm_id), ei AS (SELECT firm_id, string_agg(niche, ', ' ORDER BY er) AS e FROM a WHERE er <= 3 GROUP BY firm_id),
    v AS (SELECT firm_id, count(*) FILTER (recency_category = 'Very Recent') AS v FROM s GROUP BY firm_id), w AS (SELECT *, CASE WHEN v >= 3 THEN 'Very Active' WHEN v >= 2 THEN 'Active' WHEN v >= 1 THEN 'Moderate' ELSE 'Slow' END AS pace FROM v)
    SELECT firm_id, coalesce(f, '') AS primary_focus, coalesce(e, '') AS emerging_interests, pace AS investment_pace,
      concat_ws(' ', CASE WHEN e IS NOT NULL THEN 'Showing increased interest in ' || e || '.' END, CASE WHEN v >= 2 THEN 'Currently ' || lower(pace) || ' in making new investments.' ELSE 'Investment activity has slowed recently.' END) AS recent_trends
    FROM w LEFT JOIN pf USING (firm_id) LEFT JOIN ei USING (firm_id)""")
def portfolio_thesis(spark, d) -> DataFrame:
    """E6, E7, E8."""
    return aggregate.portfolio_thesis(aggregate.with_recency(view(spark, d, "portfolio"), AS_OF))


@query(f"""{with_views('portfolio')}, {DATED}, {SCORED}, {NICHES.replace('n AS', 'n0 AS')}, n AS (SELECT n0.*, s.recency_category FROM n0 JOIN s USING (company_id)),
    r AS (SELECT firm_id, count(*) AS n FROM s WHERE recency_category IN ('Very Recent', 'Recent') GROUP BY firm_id),
    c AS (SELECT firm_id, niche, count(*) AS k, min(seq) AS q FROM n WHERE recency_category IN ('Very Recent', 'Recent') GROUP BY ALL),
    g AS (SELECT firm_id, count(*) AS kinds, string_agg(niche, ', ' ORDER BY q) FILTER (k >= 2) AS top FROM c GROUP BY firm_id),
    j AS (SELECT f.firm_id, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds, top FROM (SELECT DISTINCT firm_id FROM portfolio) f LEFT JOIN r USING (firm_id) LEFT JOIN g USING (firm_id))
    SELECT firm_id, CASE WHEN n = 0 THEN 'Insufficient recent investment data' ELSE concat_ws('; ', CASE WHEN top <> '' THEN 'Concentrated focus on ' || top END, CASE WHEN n >= 3 THEN 'High investment velocity - actively deploying capital' END, CASE WHEN kinds >= 4 THEN 'Diversified portfolio approach across multiple sectors' WHEN kinds <= 2 THEN 'Highly focused investment strategy' END) END AS patterns,
      CASE WHEN n >= 3 THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM j""")
def investment_patterns(spark, d) -> DataFrame:
    """E9."""
    return aggregate.investment_patterns(aggregate.with_recency(view(spark, d, "portfolio"), AS_OF))


@query(f"{with_views('members')} SELECT member_id, title, {TIER} AS tier, {tiers.sql('title', 'priority')} AS priority, {tiers.sql('title', 'description')} AS description FROM members")
def decision_maker_tiers(spark, d) -> DataFrame:
    """I1."""
    t = F.col("title")
    return view(spark, d, "members").select("member_id", "title", tiers.tier(t).alias("tier"), tiers.tier_priority(t).alias("priority"), tiers.tier_description(t).alias("description"))


@query(f"{with_views('members')}, {TIERED} SELECT 'tier1' AS wanted, member_id, tier FROM t WHERE tier = 'Tier 1' UNION ALL SELECT 'tier1-2', member_id, tier FROM t WHERE tier IN ('Tier 1', 'Tier 2', 'Tier 3') UNION ALL SELECT 'all', member_id, tier FROM t")
def tier_filters(spark, d) -> DataFrame:
    """The three filters over members, one below the other."""
    m = aggregate.with_tier(view(spark, d, "members")).select("member_id", "tier")
    allowed = {"tier1": ["Tier 1"], "tier1-2": ["Tier 1", "Tier 2", "Tier 3"], "all": list(tiers.PRIORITY)}
    parts = [m.filter(F.col("tier").isin(ts)).select(F.lit(k).alias("wanted"), "member_id", "tier") for k, ts in allowed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{with_views('firms', 'members', 'portfolio')}, {TIERED}, k AS (SELECT firm_id, count(*) AS n FROM members GROUP BY firm_id),
    a AS (SELECT avg(n) AS avg_members, min(n) AS min_members, max(n) AS max_members FROM k), f AS (SELECT count(*) AS n_members, round(100.0::DOUBLE * count(*) FILTER (length(linkedin_url) > 0) / count(*), 4) AS linkedin_fill, round(100.0::DOUBLE * count(*) FILTER (length(email) > 0) / count(*), 4) AS email_fill, round(100.0::DOUBLE * count(*) FILTER (length(title) > 0) / count(*), 4) AS title_fill FROM members)
    SELECT tier, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share, any_value(round(avg_members, 6)) AS avg_members, any_value(min_members) AS min_members, any_value(max_members) AS max_members, any_value(linkedin_fill) AS linkedin_fill, any_value(email_fill) AS email_fill, any_value(title_fill) AS title_fill FROM t, a, f GROUP BY tier""")
def coverage_audit(spark, d) -> DataFrame:
    """Members per firm, fill rates and tier shares."""
    m = aggregate.with_tier(view(spark, d, "members"))
    per = m.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("avg_members"), F.min("n").alias("min_members"), F.max("n").alias("max_members"))
    fill = lambda c: F.round(F.lit(100.0) * F.count_if(F.length(c) > 0) / F.count(F.lit(1)), 4).alias(f"{c.split('_')[0]}_fill")
    fills = m.agg(fill("linkedin_url"), fill("email"), fill("title"))
    by = m.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))  # four rows
    by = by.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))
    return by.crossJoin(per).crossJoin(fills)  # one row each


@query(f"{with_views('members')}, {TIERED} SELECT member_id, tier, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY member_id) AS r FROM t) WHERE r <= 10")
def tier_samples(spark, d) -> DataFrame:
    """The first ten members of each tier."""
    m = aggregate.with_tier(view(spark, d, "members"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("tier").orderBy("member_id"))).filter("place <= 10").select("member_id", "tier", "place")


@query(f"{with_views('members')}, {TIERED}, p AS (SELECT *, {tiers.sql('title', 'priority')} AS priority FROM t) SELECT member_id, firm_id, priority, row_number() OVER (PARTITION BY firm_id ORDER BY priority, member_id) AS place FROM p")
def members_by_priority(spark, d) -> DataFrame:
    """G1: members of each firm in the order of tier priority."""
    m = aggregate.with_tier(view(spark, d, "members"))
    return m.select("member_id", "firm_id", F.col("tier_priority").alias("priority"), F.row_number().over(Window.partitionBy("firm_id").orderBy("tier_priority", "member_id")).alias("place"))


@query(f"{with_views('firms', 'members', 'portfolio')} SELECT firm_id, company_name, 'members' AS missing FROM firms WHERE firm_id NOT IN (SELECT firm_id FROM members) UNION ALL SELECT firm_id, company_name, 'portfolio' FROM firms WHERE firm_id NOT IN (SELECT firm_id FROM portfolio)")
def firms_without_data(spark, d) -> DataFrame:
    """D6."""
    f, m, p = _three(spark, d)
    gone = lambda other, name: f.join(other, "firm_id", "left_anti").select("firm_id", "company_name", F.lit(name).alias("missing"))
    return gone(m, "members").unionByName(gone(p, "portfolio"))


@query(f"{with_views('firms', 'processed')} SELECT f.firm_id, f.company_name, CASE WHEN EXISTS (SELECT 1 FROM processed p WHERE p.company_name = f.company_name AND p.status = 'completed') THEN 'done' ELSE 'todo' END AS state FROM firms f")
def resume(spark, d) -> DataFrame:
    """What is done (semi join with the ledger) and what is left (anti join)."""
    f, p = view(spark, d, "firms"), view(spark, d, "processed").filter("status = 'completed'")
    part = lambda how, s: f.join(p, "company_name", how).select("firm_id", "company_name", F.lit(s).alias("state"))
    return part("left_semi", "done").unionByName(part("left_anti", "todo"))


@query(f"{with_views('firms')} SELECT firm_id, array_to_string(list_filter(['websiteUrl', 'investorType', 'investmentStages', 'investmentNiches'], lambda x, i: [website_url, investor_type, investment_stages, investment_niches][i] = ''), ',') AS empty_fields FROM firms WHERE website_url = '' OR investor_type = '' OR investment_stages = '' OR investment_niches = ''")
def empty_critical_fields(spark, d) -> DataFrame:
    """C10."""
    cols = {"website_url": "websiteUrl", "investor_type": "investorType", "investment_stages": "investmentStages", "investment_niches": "investmentNiches"}
    empty = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(n)) for c, n in cols.items())))
    return view(spark, d, "firms").select("firm_id", F.array_join(empty, ",").alias("empty_fields")).filter("empty_fields <> ''")


@query(f"{with_views('firms', 'portfolio')} SELECT f.firm_id, p.company_id, p.portfolio_company FROM firms f JOIN portfolio p USING (firm_id) WHERE f.investment_niches = '' AND lower(p.investment_niche) LIKE '%saas%'")
def niche_gaps(spark, d) -> DataFrame:
    """K6 with D2: portfolio rows that could fill a firm's missing niches."""
    f, _, p = _three(spark, d)
    return f.filter("investment_niches = ''").join(p, "firm_id").filter(F.lower("investment_niche").contains("saas")).select("firm_id", "company_id", "portfolio_company")


@query(f"{with_views('firms', 'members', 'portfolio')} SELECT f.firm_id, f.investor_type = '' AS need_types, f.investment_stages = '' AS need_stages, f.investment_niches = '' AS need_niches, count(DISTINCT m.member_id) < 5 AS need_people, count(DISTINCT p.company_id) < 10 AS need_companies FROM firms f LEFT JOIN members m USING (firm_id) LEFT JOIN portfolio p USING (firm_id) GROUP BY ALL")
def missing_groups(spark, d) -> DataFrame:
    """K6: which groups of data are missing."""
    f, m, p = _three(spark, d)
    n = lambda df, c: df.groupBy("firm_id").agg(F.count(F.lit(1)).alias(c))
    df = f.join(n(m, "_m"), "firm_id", "left").join(n(p, "_p"), "firm_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.select("firm_id", none("investor_type").alias("need_types"), none("investment_stages").alias("need_stages"), none("investment_niches").alias("need_niches"), (F.coalesce("_m", F.lit(0)) < 5).alias("need_people"), (F.coalesce("_p", F.lit(0)) < 10).alias("need_companies"))


@query(f"{with_views('portfolio')}, {DATED} SELECT company_id, dt AS parsed_date, {BEFORE[6]} AS six_months_ago, dt >= {BEFORE[6]} AS is_recent FROM d")
def date_arithmetic(spark, d) -> DataFrame:
    """Dates as text, and the day six months before."""
    day = F.lit(AS_OF).cast("date")
    when = dates.parsed(F.col("investment_date"))
    return view(spark, d, "portfolio").select("company_id", when.alias("parsed_date"), dates.months_before(day, 6).alias("six_months_ago"), (when >= dates.months_before(day, 6)).alias("is_recent"))
