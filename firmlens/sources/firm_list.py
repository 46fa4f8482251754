"""Reading and standardising lists of firms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of columns, in the order in which they are tried.
NAME_COLUMNS = ["company name", "firm name", "name", "company", "firm", "organization", "organisation", "vc firm", "fund name"]
URL_COLUMNS = ["company website url", "website url", "website", "url", "corporate website", "company url", "site", "homepage", "web"]
TEXT_COLUMNS = ["linkedin description", "description", "about", "summary", "overview", "bio"]
URL_LIKE = r"^(https?://|www\.)"
MAX_FIRMS = 10_000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row; trimmed; blank lines skipped; ragged rows allowed."""
    return spark.read.csv(path, header=True, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", quote='"', escape='"')


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """A list of URLs by hand, one on each line."""
    url = F.trim("value")
    return spark.read.text(path).filter(url.startswith("http")).select(url.alias("company_name"), url.alias("website_url"), F.lit("").alias("description"))


def _plain(s: str) -> str:
    return re.sub(r"[\s_-]", "", s.lower())


def find_column(columns: list[str], wanted: list[str]) -> str | None:
    """The first wanted name that a column has: exactly, else without case, else without spaces and dashes."""
    for same in (lambda a, b: a == b, lambda a, b: a.strip().lower() == b.lower(), lambda a, b: _plain(a) == _plain(b)):
        for w in wanted:
            for c in columns:
                if same(c, w):
                    return c
    return None


def find_url_column(df: DataFrame, sample: int = 5) -> str | None:
    """A column by name whose content confirms it, else the first with URLs, else the one by name."""
    named = find_column(df.columns, URL_COLUMNS)
    like = df.limit(sample).agg(*(F.max(F.coalesce(F.lower(F.trim(F.col(f"`{c}`"))).rlike(URL_LIKE), F.lit(False)).cast("int")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    holds = [c for i, c in enumerate(df.columns) if like[f"c{i}"]]
    return named if named in holds else holds[0] if holds else named


def preview(df: DataFrame, n: int = 5, cut: int = 150, order: str | None = None) -> tuple[list[str], DataFrame]:
    """The header, and the first rows (in the given order) with long texts cut."""
    df = df.orderBy(order) if order else df
    short = lambda c: F.when(F.length(c) > cut, F.concat(F.substring(c, 1, cut), F.lit("…"))).otherwise(F.col(c)).alias(c)
    return df.columns, df.limit(n).select(*(short(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def detect(df: DataFrame) -> dict[str, str | None]:
    mapping = {"company_name": find_column(df.columns, NAME_COLUMNS), "website_url": find_url_column(df), "description": find_column(df.columns, TEXT_COLUMNS)}
    if not mapping["website_url"]:
        raise ValueError(f"No column with website URLs. Your file has columns: {', '.join(df.columns)}")
    return mapping


def standardise(df: DataFrame, mapping: dict[str, str | None] | None = None) -> DataFrame:
    """company_name, website_url, description and reject_reason (null: accepted). The name falls back to the URL."""
    m = mapping or detect(df)
    value = lambda k: F.trim(F.coalesce(F.col(f"`{m[k]}`").cast("string"), F.lit(""))) if m.get(k) else F.lit("")
    url, name = value("website_url"), value("company_name")
    reason = F.when(url.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "e-mail in the URL column").when(url == "", "no URL")
    return df.select(F.coalesce(F.nullif(name, F.lit("")), url).alias("company_name"), url.alias("website_url"), value("description").alias("description"), reason.alias("reject_reason"), *([F.col("row_no")] if "row_no" in df.columns else []))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter("reject_reason IS NULL").drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter("reject_reason IS NOT NULL")


def check_count(df: DataFrame, most: int = MAX_FIRMS) -> DataFrame:
    """Raises if a list has more firms than allowed; reads no more rows than it must."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} firms")
    return df


def from_directory(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("name").alias("company_name"), F.col("url").alias("website_url"), F.lit("").alias("description"))
