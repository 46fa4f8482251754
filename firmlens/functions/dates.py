"""Dates held as text, recency of investments, and date arithmetic. Every function takes the reference date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """`YYYY`, `YYYY-MM` or `YYYY-MM-DD` as a date; anything else is null."""
    return F.when(text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), text.try_cast("date"))


def months_ago(text: Column, as_of: Column) -> Column:
    """Months of 30 days, with fractions."""
    return F.datediff(as_of, parsed(text)) / F.lit(30.0)


def recency_score(text: Column, as_of: Column) -> Column:
    """100 to 80 within 6 months, to 60 within 12, to 30 within 24, then to 0; 0 for unreadable dates."""
    m = months_ago(text, as_of)
    raw = (
        F.when(m <= 6, 100 - m / 6 * 20)
        .when(m <= 12, 80 - (m - 6) / 6 * 20)
        .when(m <= 24, 60 - (m - 12) / 12 * 30)
        .otherwise(F.greatest(F.lit(0.0), 30 - (m - 24) / 36 * 30))
    )
    return F.when(m.isNull(), 0).otherwise(F.floor(raw + 0.5)).cast("int")


def recency_category(text: Column, as_of: Column) -> Column:
    m = months_ago(text, as_of)
    return F.when(m <= 6, "Very Recent").when(m <= 12, "Recent").when(m <= 24, "Moderate").otherwise("Old")


def months_before(as_of: Column, n: int) -> Column:
    """The same day of the month n months before; days past the month's end run over into the next."""
    return F.date_add(F.trunc(F.add_months(as_of, -n), "MM"), F.dayofmonth(as_of) - 1)


def elapsed_minutes(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60_000_000).cast("long")


def duration_text(seconds: Column) -> Column:
    """"1h 5m", "5m" or "<1m"."""
    h, m = F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise("<1m")


def rounded(x: Column) -> Column:
    """Half up: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5)).cast("long")
