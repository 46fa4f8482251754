"""What the corpus operators share: tables, the shared folder, small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words: space and the controls 0x09 to 0x0D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster
    names it. Only where it is unset (tests on one machine) a fresh one is made."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        got = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(got)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(got)
    return got


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there and a
    lost executor costs no more than a read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := "_" + name).lower() in taken:
            pass
        out.append(name)
    return out


#: Keys with more than one in so many rows are joined by broadcast, so there are at most so many of them.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left joined with right, which has one row for each key and says in `count` how many rows of left have it. Hot keys,
    at most `HOT_SHARE`, are broadcast, so that no task has all rows of one. Both sides are read twice: they should be written tables."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    keys = F.broadcast(right.filter(hot))
    rest = left.join(keys.select(key), key, "left_anti").join(right.filter(~hot), key)
    return left.join(keys, key).select(*rest.columns).unionByName(rest)


def text_of(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))
