"""Summaries of firms: aggregates of members and portfolio are made once each and joined to the firms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import dates, tiers


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, dates.rounded(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def plural(n: Column, noun: str, rest: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n > 1, "s").otherwise(""), F.lit(f" {rest}"))


def with_tier(members: DataFrame) -> DataFrame:
    return members.withColumns({"tier": tiers.tier(F.col("title")), "tier_priority": tiers.tier_priority(F.col("title"))})


def with_recency(portfolio: DataFrame, as_of: str) -> DataFrame:
    d = F.lit(as_of).cast("date")
    return portfolio.withColumns({"recency_score": dates.recency_score(F.col("investment_date"), d), "recency_category": dates.recency_category(F.col("investment_date"), d)})


def member_counts(members: DataFrame, by: str = "firm_id") -> DataFrame:
    """Members of each firm by tier, and how many have a profile, an e-mail and a specialisation. members: with tier."""
    some = lambda c: F.count_if(F.length(c) > 0)
    return members.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_members"),
        *(F.count_if(F.col("tier") == f"Tier {i}").alias(f"tier{i}_count") for i in (1, 2, 3)),
        some("linkedin_url").alias("n_linkedin"),
        some("email").alias("n_email"),
        some("specialization").alias("n_special"),
    )


def key_people(members: DataFrame, by: str = "firm_id", seq: str = "member_id", n: int = 5) -> DataFrame:
    """The first n Tier 1 members in order, "name (title)". members: with tier."""
    first = members.filter("tier = 'Tier 1'").withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(seq))).filter(F.col("_n") <= n)
    item = F.struct(F.col("_n"), F.concat("name", F.lit(" ("), "title", F.lit(")")).alias("s"))
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "; ").alias("key_people"))


def stage_counts(portfolio: DataFrame, as_of: str, by: str = "firm_id") -> DataFrame:
    """Counts behind check size and pace."""
    d = F.lit(as_of).cast("date")
    text = F.lower(F.concat("portfolio_company", F.lit(" "), "investment_niche"))
    has = lambda *ks: F.count_if(text.rlike("|".join(ks)))
    when = dates.parsed(F.col("investment_date"))
    return portfolio.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_portfolio"),
        has("seed", "pre-seed").alias("n_seed"),
        has("series a", "series-a").alias("n_a"),
        has("series b", "series-b").alias("n_b"),
        has("growth", "series c", "series d").alias("n_growth"),
        F.count_if(when >= dates.months_before(d, 6)).alias("last_6"),
        F.count_if(when >= dates.months_before(d, 12)).alias("last_12"),
    )


def check_size() -> Column:
    n, s, a, b, g = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_portfolio", "n_seed", "n_a", "n_b", "n_growth"))
    return (
        F.when(n == 0, "Unknown")
        .when((s > a) & (s > b), "$500K - $2M (Seed stage focus)")
        .when((a > b) & (a > g), "$2M - $10M (Series A focus)")
        .when((b > 0) | (g > 0), "$10M - $50M+ (Growth stage focus)")
        .otherwise("Varies by stage")
    )


def pace() -> Column:
    return (
        F.when(F.col("last_6") > 0, plural(F.col("last_6"), "investment", "in last 6 months"))
        .when(F.col("last_12") > 0, plural(F.col("last_12"), "investment", "in last 12 months"))
        .otherwise("Investment pace unknown")
    )


def niches(portfolio: DataFrame) -> DataFrame:
    """A row for each comma-separated niche: niche and seq, its place in the firm's order."""
    parts = F.posexplode(F.split("investment_niche", ","))
    return portfolio.select("*", parts.alias("_at", "_niche")).withColumn("niche", F.trim("_niche")).filter("niche <> ''").withColumn("seq", F.struct("company_id", "_at")).drop("_at", "_niche")


def top_niches(rows: DataFrame, count: Column, n: int, name: str, by: str = "firm_id", sep: str | None = ", ") -> DataFrame:
    """The n niches with the highest positive count; ties by first place."""
    c = rows.groupBy(by, "niche").agg(count.alias("c"), F.min("seq").alias("seq")).filter("c > 0")
    top = c.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("c"), "seq"))).filter(F.col("_r") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_r", "niche"))), lambda x: x["niche"])
    return top.groupBy(by).agg((items if sep is None else F.array_join(items, sep)).alias(name))


def emerging_interests(portfolio: DataFrame, as_of: str, by: str = "firm_id") -> DataFrame:
    recent = portfolio.filter(dates.parsed(F.col("investment_date")) >= dates.months_before(F.lit(as_of).cast("date"), 6))
    return top_niches(niches(recent), F.count(F.lit(1)), 3, "emerging_interests", by)


def thesis(firms: DataFrame, members: DataFrame, portfolio: DataFrame, as_of: str, by: str = "firm_id") -> DataFrame:
    """The firm thesis summary. Firms join by `by`: firm_id, or vc_firm against company_name."""
    key = {"firm_id": "firm_id", "vc_firm": "company_name"}[by]
    tiered = with_tier(members)
    right = lambda df: df.withColumnRenamed(by, key)
    df = firms.join(right(member_counts(tiered, by)), key, "left").join(right(key_people(tiered, by)), key, "left")
    df = df.join(right(stage_counts(portfolio, as_of, by)), key, "left").join(right(emerging_interests(portfolio, as_of, by)), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    two = lambda c: F.array_join(F.slice(F.split(c, ","), 1, 2), " and ")
    focus = F.array_join(F.slice(F.transform(F.split("investment_niches", ","), lambda x: F.trim(x)), 1, 3), ", ")
    points = F.concat_ws(
        "; ",
        F.when(F.length("investment_niches") > 0, F.concat(F.lit("Focused on "), two("investment_niches"))),
        F.when(F.length("investment_stages") > 0, F.concat(F.lit("Invests in "), two("investment_stages"), F.lit(" companies"))),
        F.when(F.col("last_6") > 0, plural(F.col("last_6"), "recent investment", "in last 6 months")),
        F.when(F.col("tier1_count") > 0, plural(F.col("tier1_count"), "senior partner", "available")),
    )
    return df.select(
        F.col("firm_id"),
        F.col("company_name").alias("vc_firm"),
        F.col("website_url"),
        F.coalesce(_text(F.col("investor_type")), F.lit("Not specified")).alias("investor_type"),
        F.coalesce(_text(focus), F.lit("Not specified")).alias("primary_focus_areas"),
        F.coalesce("emerging_interests", F.lit("No recent investment data available")).alias("emerging_interests"),
        F.coalesce(_text(F.col("investment_stages")), F.lit("Not specified")).alias("preferred_stages"),
        check_size().alias("average_check_size"),
        pace().alias("recent_investment_pace"),
        F.coalesce("key_people", F.lit("Not identified")).alias("key_decision_makers"),
        zero("n_members").alias("total_team_size"),
        zero("tier1_count").alias("tier1_count"),
        zero("tier2_count").alias("tier2_count"),
        zero("n_portfolio").alias("portfolio_size"),
        zero("last_6").alias("recent_portfolio_count"),
        points.alias("talking_points"),
    )


def _counts(firms: DataFrame, members: DataFrame, portfolio: DataFrame) -> DataFrame:
    p = portfolio.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n_portfolio"))
    df = firms.join(member_counts(with_tier(members)), "firm_id", "left").join(p, "firm_id", "left")
    return df.fillna(0, ["n_members", "tier1_count", "tier2_count", "tier3_count", "n_linkedin", "n_email", "n_special", "n_portfolio"])


def processing_summary(firms: DataFrame, members: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Status, error text and completeness of each firm: the first case that holds."""
    df = _counts(firms, members, portfolio)
    no_site, no_team, no_portfolio = F.col("website_verified") == "No", F.col("n_members") == 0, F.col("n_portfolio") == 0
    ladder = lambda a, b, c, d, e: F.when(no_site, a).when(no_team & no_portfolio, b).when(no_team, c).when(no_portfolio, d).otherwise(e)
    failed = F.coalesce(_text(F.col("verification_message")), F.lit("Website verification failed"))
    return df.select(
        "firm_id",
        F.col("company_name").alias("firm_name"),
        F.col("website_url").alias("website"),
        F.when(no_site | no_team | no_portfolio, "Warning").otherwise("Success").alias("status"),
        ladder(failed, F.lit("No team members or portfolio companies found"), F.lit("No team members found"), F.lit("No portfolio companies found"), F.lit("")).alias("error_message"),
        F.col("n_members").alias("team_members_found"),
        "tier1_count",
        "tier2_count",
        "tier3_count",
        F.col("n_portfolio").alias("portfolio_companies_found"),
        ladder(*(F.lit(x) for x in ("Partial - Website not accessible", "Minimal", "Partial - Missing team data", "Partial - Missing portfolio data", "Complete"))).alias("data_completeness"),
    )


def quality_metrics(firms: DataFrame, members: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Coverage of each firm, its quality score and notes, and a row of grand totals."""
    df = _counts(firms, members, portfolio)
    n = F.col("n_members")
    share = lambda c: percent(F.col(c), n)
    shares = {"linkedin_pct": share("n_linkedin"), "email_pct": share("n_email"), "special_pct": share("n_special"), **{f"tier{i}_pct": share(f"tier{i}_count") for i in (1, 2, 3)}}
    per = df.withColumns(shares)
    score = dates.rounded(F.col("linkedin_pct") * 0.3 + F.col("email_pct") * 0.2 + F.col("special_pct") * 0.2 + F.least(n / 10, F.lit(1.0)) * 100 * 0.3)
    notes = F.concat_ws(
        "; ",
        F.when(n == 0, "No team members found").when(n < 3, "Few team members found"),
        F.when(F.col("linkedin_pct") < 30, "Low LinkedIn coverage"),
        F.when(F.col("email_pct") == 0, "No emails found"),
        F.when(F.col("n_portfolio") == 0, "No portfolio companies"),
        F.when(F.col("website_verified") == "No", "Website not accessible"),
    )
    pct = lambda c: F.concat(F.col(c).cast("string"), F.lit("%")).alias(c)
    cols = [pct(c) for c in shares]
    rows = per.select(F.col("company_name").alias("firm_name"), n.alias("team_members_found"), *cols, F.col("n_portfolio").alias("portfolio_companies"), F.concat(score.cast("string"), F.lit("/100")).alias("data_quality_score"), F.coalesce(_text(notes), F.lit("Good extraction")).alias("extraction_notes"))
    sums = df.agg(F.count(F.lit(1)).alias("n_firms"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_members", "n_linkedin", "n_email", "n_special", "tier1_count", "tier2_count", "tier3_count", "n_portfolio")))
    total = sums.withColumns(shares)
    size = F.when(F.col("n_firms") > 0, dates.rounded(n / F.col("n_firms"))).otherwise(0)
    return rows.unionByName(total.select(F.lit("=== OVERALL SUMMARY ===").alias("firm_name"), n.alias("team_members_found"), *cols, F.col("n_portfolio").alias("portfolio_companies"), F.concat(F.lit("Avg team: "), size.cast("string")).alias("data_quality_score"), F.concat(F.col("n_firms").cast("string"), F.lit(" firms processed")).alias("extraction_notes")))


def portfolio_thesis(portfolio: DataFrame, by: str = "firm_id") -> DataFrame:
    """Primary focus, emerging interests, pace and trend of each firm's scored portfolio."""
    rows = niches(portfolio)
    recent = F.count_if(F.col("recency_category") == "Very Recent")
    primary = top_niches(rows, F.count(F.lit(1)), 3, "primary_focus", by, None)
    c = rows.groupBy(by, "niche").agg(F.count(F.lit(1)).alias("n"), recent.alias("r"), F.min(F.when(F.col("recency_category") == "Very Recent", F.col("seq"))).alias("seq")).filter("r > 0 AND r / n > 0.5")
    c = c.join(primary, by).filter(~F.array_contains("primary_focus", F.col("niche")))
    top = c.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("r"), "seq"))).filter("_r <= 3")
    rising = top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "niche"))), lambda x: x["niche"]), ", ").alias("emerging"))
    firms = portfolio.groupBy(by).agg(recent.alias("very_recent"))
    v = F.col("very_recent")
    df = firms.join(primary, by, "left").join(rising, by, "left").withColumn("investment_pace", F.when(v >= 3, "Very Active").when(v >= 2, "Active").when(v >= 1, "Moderate").otherwise("Slow"))
    trend = F.concat_ws(
        " ",
        F.when(F.col("emerging").isNotNull(), F.concat(F.lit("Showing increased interest in "), F.col("emerging"), F.lit("."))),
        F.when(v >= 2, F.concat(F.lit("Currently "), F.lower("investment_pace"), F.lit(" in making new investments."))).otherwise("Investment activity has slowed recently."),
    )
    return df.select(by, F.coalesce(F.array_join("primary_focus", ", "), F.lit("")).alias("primary_focus"), F.coalesce("emerging", F.lit("")).alias("emerging_interests"), "investment_pace", trend.alias("recent_trends"))


def investment_patterns(portfolio: DataFrame, by: str = "firm_id") -> DataFrame:
    """Patterns of recent investments and the confidence in them."""
    recent = portfolio.filter(F.col("recency_category").isin("Very Recent", "Recent"))
    n = recent.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    c = niches(recent).groupBy(by, "niche").agg(F.count(F.lit(1)).alias("c"), F.min("seq").alias("seq"))
    d = c.groupBy(by).agg(F.count(F.lit(1)).alias("kinds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("c") >= 2, F.struct("seq", "niche")))), lambda x: x["niche"]), ", ").alias("top"))
    df = portfolio.select(by).distinct().join(n, by, "left").join(d, by, "left").fillna(0, ["n", "kinds"])
    found = F.concat_ws(
        "; ",
        F.when(F.length("top") > 0, F.concat(F.lit("Concentrated focus on "), F.col("top"))),
        F.when(F.col("n") >= 3, "High investment velocity - actively deploying capital"),
        F.when(F.col("kinds") >= 4, "Diversified portfolio approach across multiple sectors").when(F.col("kinds") <= 2, "Highly focused investment strategy"),
    )
    return df.select(by, F.when(F.col("n") == 0, "Insufficient recent investment data").otherwise(found).alias("patterns"), F.when(F.col("n") >= 3, "High").when(F.col("n") >= 2, "Medium").otherwise("Low").alias("confidence"))
