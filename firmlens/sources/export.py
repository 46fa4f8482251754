"""Writing results: a table for each sheet, plain or sectioned CSV, inserts of what isn't there yet."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions import text

# Column labels of the exports, in their order.
SHORT_MEMBER = {"vc_firm": "VC Firm", "name": "Name", "title": "Title", "linkedin_url": "LinkedIn URL", "email": "Email", "specialization": "Specialization", "tier": "Decision Maker Tier"}

#: The short export: (field, label).
SHORT_SHEETS = {
    "Firms": [
        ("company_name", "Firm Name"), ("website_url", "Website"), ("description", "Description"), ("website_verified", "Website Verified"), ("investor_type", "Investor Type"), ("investment_stages", "Investment Stages"),
        ("investment_niches", "Investment Niches"), ("investment_thesis", "Investment Thesis"), ("aum", "AUM"), ("sector_focus", "Sector Focus"), ("geographic_focus", "Geographic Focus"), ("founded_year", "Founded Year"), ("headquarters", "Headquarters"),
    ],
    "Team Members": [
        ("vc_firm", "Firm Name"), ("name", "Name"), ("title", "Title"), ("linkedin_url", "LinkedIn"), ("email", "Email"), ("portfolio_companies", "Portfolio Companies"), ("decision_maker_tier", "Tier"), ("specialization", "Specialization"),
        ("investment_focus", "Investment Focus"), ("stage_preference", "Stage Preference"), ("check_size_range", "Check Size Range"), ("geographic_focus", "Geographic Focus"), ("investment_thesis", "Investment Thesis"), ("notable_investments", "Notable Investments"),
        ("years_experience", "Years Experience"), ("background", "Background"),
    ],
}
#: The full export: the columns of its sheets.
SHEETS = {
    "VC Firms": [
        "companyName", "websiteUrl", "description", "websiteVerified", "verificationMessage", "investorType", "investorTypeConfidence",
        "investorTypeSourceUrl", "investmentStages", "investmentStagesConfidence", "investmentStagesSourceUrl", "investmentNiches",
        "nichesConfidence", "nichesSourceUrl", "investmentThesis", "aum", "sectorFocus", "geographicFocus", "foundedYear", "headquarters",
    ],
    "Team Members": [
        "vcFirm", "name", "title", "jobFunction", "specialization", "linkedinUrl", "email", "portfolioCompanies", "investmentFocus",
        "stagePreference", "checkSizeRange", "geographicFocus", "investmentThesis", "notableInvestments", "yearsExperience", "background",
        "dataSourceUrl", "confidenceScore", "decisionMakerTier", "tierPriority",
    ],
    "Portfolio Companies": [
        "vcFirm", "portfolioCompany", "investmentDate", "websiteUrl", "investmentNiche", "dataSourceUrl", "confidenceScore", "recencyScore",
        "recencyCategory",
    ],
    "Investment Thesis": [
        "vcFirm", "websiteUrl", "investorType", "primaryFocusAreas", "emergingInterests", "preferredStages", "averageCheckSize",
        "recentInvestmentPace", "keyDecisionMakers", "totalTeamSize", "tier1Count", "tier2Count", "portfolioSize", "recentPortfolioCount",
        "talkingPoints",
    ],
    "Processing Summary": [
        "firmName", "website", "status", "errorMessage", "teamMembersFound", "tier1Count", "tier2Count", "tier3Count", "portfolioCompaniesFound",
        "dataCompleteness",
    ],
    "Data Quality": [
        "firmName", "teamMembersFound", "linkedInCoverage", "emailCoverage", "specializationCoverage", "tier1Percent", "tier2Percent",
        "tier3Percent", "portfolioCompanies", "dataQualityScore", "extractionNotes",
    ],
}


def snake(label: str) -> str:
    """The field behind a column of the full export: investorType is investor_type."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), label).replace("linked_in", "linkedin")


def cells(df: DataFrame, labels: dict[str, str]) -> Column:
    """A row of a sheet as JSON: every column under its label, as text, empty where the table has no such field. labels: field to label."""
    return F.to_json(F.struct(*((text.exported(F.col(c)) if c in df.columns else F.lit("")).alias(l) for c, l in labels.items())))


def clean(df: DataFrame) -> DataFrame:
    """Every column as text; null, NaN and "nan" empty."""
    return df.select(*(text.exported(F.col(c)).alias(c) for c in df.columns))


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(l) for c, l in labels.items() if c in df.columns))


def sheet(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Every column of a template's sheet, as text under its label; empty where the table has no such field."""
    return df.select(*((text.exported(F.col(c)) if c in df.columns else F.lit("")).alias(l) for c, l in labels.items()))


def with_placeholder(df: DataFrame, note: str) -> DataFrame:
    """A table without rows gets one that says so in its first column."""
    marker = df.sparkSession.range(1).select(*((F.lit(note) if i == 0 else F.lit("")).cast("string").alias(c) for i, c in enumerate(df.columns)))
    none = clean(df).limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return clean(df).unionByName(marker.join(none, F.col("_n") == 0).drop("_n"))


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.csv(f"{path}/{name}", header=True, quote='"', escape='"') if kind == "csv" else w.parquet(f"{path}/{name}")


def csv_line(df: DataFrame) -> Column:
    return F.concat_ws(",", *(text.csv_field(F.col(c)) for c in df.columns))


def sectioned(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(section, seq, line): "=== TITLE ===", the header and the rows of each table in the order of its key, then an empty line."""
    parts = []
    for i, (title, (df, key)) in enumerate(tables.items()):
        spark = df.sparkSession
        head = spark.createDataFrame([(i, -2, f"=== {title} ==="), (i, -1, ",".join(df.columns)), (i, 2**62, "")], "section int, seq long, line string")
        parts += [head, df.select(F.lit(i).alias("section"), F.col(key).cast("long").alias("seq"), csv_line(df).alias("line"))]
    return reduce(DataFrame.unionByName, parts)


def write_sectioned(tables: dict[str, tuple[DataFrame, str]], path: str) -> None:
    sectioned(tables).orderBy("section", "seq").select("line").write.mode("overwrite").text(path)


def wide(df: DataFrame, sections: dict[str, str], data: str = "data") -> DataFrame:
    """One column for each user section of a map, under its label."""
    return df.select("name", "site", *(F.coalesce(F.element_at(data, k), F.lit("")).alias(v) for k, v in sections.items()))


def new_rows(df: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows whose keys aren't stored yet, of equal keys the first in the given order."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("_row"))
    return first.join(stored.select(*keys), keys, "left_anti").select("_row.*")


def sample(firms: DataFrame, members: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """n firms by a seeded hash of their name, with their members nested."""
    picked = firms.orderBy(F.md5(F.concat("company_name", F.lit(str(seed))))).limit(n)
    nested = members.join(F.broadcast(picked.select("firm_id")), "firm_id", "left_semi").groupBy("firm_id").agg(F.array_sort(F.collect_list(F.struct("member_id", "name", "title"))).alias("members"))
    return picked.join(nested, "firm_id", "left")


def page(df: DataFrame, key: str, at: int, size: int = 50) -> DataFrame:
    return df.orderBy(key).offset(at * size).limit(size)


def page_counts(df: DataFrame, size: int = 50) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def search(df: DataFrame, column: str, term: str, literal: bool = False) -> DataFrame:
    """Anywhere in the column, without case. % and _ in the term are wildcards unless `literal`."""
    if literal:
        return df.filter(F.lower(column).contains(term.lower()))
    return df.filter(F.col(column).ilike(f"%{term}%"))


def long_values(df: DataFrame, key: str, columns: list[str], most: int = 1000) -> DataFrame:
    """Values that are longer than a cell takes: key, column, length."""
    rows = df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.length(F.col(c).cast("string")).alias("length")) for c in columns))).alias("x"))
    return rows.select(key, "x.*").filter(F.col("length") > most)


def ordered_content(pages: DataFrame, key: str | list[str], rank: str, seq: str, body: str) -> DataFrame:
    """Pages of a site joined in the order of their category, then as they came."""
    items = F.array_sort(F.collect_list(F.struct(rank, seq, body)))
    return pages.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x[body]), "\n\n").alias("content"))
