"""Connected components by alternating stars. Each round is two aggregations and joins on
edges; no neighbourhood is collected, and the edges of a round are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to its smallest; small: its smaller ones and itself."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(low, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges: u long, v long. Returns node and root, the component's smallest node, for every node of an edge."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(_star(_star(now, True).distinct(), False).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
