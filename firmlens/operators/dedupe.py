"""Dedupe and merging of records, with an explicit order column; never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).filter("_r = 1").drop("_r")


def last_value_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of a key, at the place of the first: adds first_seq."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_x"), F.min(seq).alias("first_seq"))
    return out.select(key, *(F.col(f"_x.{c}") for c in rest), "first_seq")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _in_order(seq: str, c: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(seq, c))), lambda x: x[c])


def merge_records(df: DataFrame, key: str, seq: str, fields: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """One record for each key: of each field the first value that isn't empty, of each list column the union in order."""
    firsts = [F.min_by(filled(F.col(c)), F.when(filled(F.col(c)).isNotNull(), F.col(seq))).alias(c) for c in fields]
    unions = [F.array_distinct(F.filter(F.transform(F.flatten(_in_order(seq, c)), lambda x: F.trim(x)), lambda x: x != "")).alias(c) for c in lists]
    return df.groupBy(key).agg(*firsts, *unions, F.count(F.lit(1)).alias("records"), F.min(seq).alias("first_seq"))


def union_lists(a: Column, b: Column) -> Column:
    """Trimmed, not empty, distinct."""
    return F.array_distinct(F.filter(F.transform(F.concat(a, b), lambda x: F.trim(x)), lambda x: x != ""))
