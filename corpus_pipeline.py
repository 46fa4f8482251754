"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents.

Defined results, stage by stage. Quality rules: a null or empty text, and one of fewer than ten words, goes; repeated rows are judged each;
without labels only the base rule acts. Near duplicates: of each class of texts the row with the smallest doc_id stays (a null id comes last, ties
are broken by the text's hash), and of rows that are equal in id and text the least by its other columns. Decontamination: a document that holds a benchmark
item goes; without a benchmark all stay. Mixture: each leaf gives a prefix of its seeded order, within the largest budget at which
every domain gives its target share; a null source or language is a leaf of its own. Shards: every row gets a shard and a gapless position in it; ties
in id are numbered by the text's checksum. Very long texts are worked on whole. An empty table gives an empty table in every stage, and other
columns of documents, whatever their names, come through all stages but for shard, slot and vslot, which the last one sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import decontaminate, lshforest, mixing, quality, sharding
from firmlens.llm.common import cut, fresh, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The quality rules are learned and MinHash is hashing: SQL can't express them. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame) -> tuple[DataFrame, str]:
    """The columns that the stages read, and whole rows set aside, whose columns no operator's own can replace."""
    (row,) = fresh(docs, "row")
    return docs.select(*COLUMNS[:4], F.struct(*docs.columns).alias(row)), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    # the verdict is computed in a projection and written with it; a filter on it would be pushed
    # below that projection, and its parts would be computed again
    rows, row = _aside(docs)
    (flag,) = fresh(docs, "keep")
    judged = quality.judge(rows, rules).select(f"{row}.*", F.col("kept").alias(flag))
    return cut(judged, "judged").filter(flag).drop(flag)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lshforest.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _aside(docs)
    return mixing.mix(rows, None, max_epochs=1).select(f"{row}.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 8).select(*docs.columns, "shard", "slot", "vslot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
