"""Which strings of a group are held by which texts of the same group: one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Needles in one automaton, and characters of the texts that it is built for, about.
NEEDLES, CHARS = 50_000, 8_000_000


class _Finder:
    """The needles of a unit. The automaton is built when the first text comes."""

    def __init__(self):
        self.needles: set[str] = set()
        self.machine = None

    def __call__(self, text: str) -> set[str]:
        import ahocorasick

        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for n in self.needles - {""}:
                self.machine.add_word(n, n)
            if len(self.machine):
                self.machine.make_automaton()
        found = {n for _, n in self.machine.iter(text)} if len(self.machine) else set()
        return found | ({""} & self.needles)  # every text holds the empty string


def contained(needles: DataFrame, texts: DataFrame, key: str, needle_blocks: int = NEEDLES, text_chars: int = CHARS) -> DataFrame:
    """key, needle, text: every needle that is a part of a text with the same key, once. needles: key, needle; texts: key, text; nulls are left out.

    A unit is a block of a key's needles and a block of its texts, so that no group is bound to one task: a key with many needles has several automata, and
    one with many texts has each of them in several tasks. The work is reading each text once for each block of needles; no pairs are made but those that are found."""
    schema = needles.schema[key].dataType
    n = needles.filter(F.col("needle").isNotNull()).select(F.col(key).alias("k"), "needle").distinct()
    t = texts.filter(F.col("text").isNotNull()).select(F.col(key).alias("k"), "text").distinct()
    blocks = n.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / needle_blocks).cast("int").alias("n_blocks"))
    blocks = blocks.join(t.groupBy("k").agg(F.greatest(F.ceil(F.sum(F.length("text")) / text_chars), F.lit(1)).cast("int").alias("t_blocks")), "k")
    own = lambda c, b: F.pmod(F.xxhash64(c), F.col(b)).cast("int")
    each = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    a = n.join(blocks, "k").select("k", own("needle", "n_blocks").alias("x"), each("t_blocks").alias("y"), F.lit(False).alias("is_text"), F.col("needle").alias("s"))
    b = t.join(blocks, "k").select("k", each("n_blocks").alias("x"), own("text", "t_blocks").alias("y"), F.lit(True).alias("is_text"), F.col("text").alias("s"))
    dealt = a.unionByName(b).repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "is_text")

    def run(batches):
        unit, find = None, _Finder()
        for batch in batches:
            out = ([], [], [])
            for k, x, y, is_text, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, x, y) != unit:
                    unit, find = (k, x, y), _Finder()
                if is_text:
                    for needle in find(s):
                        for column, value in zip(out, (k, needle, s), strict=True):
                            column.append(value)
                else:
                    find.needles.add(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], to_arrow_type(schema)), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["k", "needle", "text"])

    return dealt.mapInArrow(run, f"k {schema.simpleString()}, needle string, text string").withColumnRenamed("k", key)
