"""Quality rules: a learned decision list over native text statistics.

`stats` computes the statistics with DataFrame functions only. `fit` learns an ordered list of
threshold conjunctions by sequential covering (grow by information gain, prune on held-out rows)
from a bounded sample of labelled rows, and `verdict` emits the list as one ordered Spark
conditional expression.

Defined results: a null or empty text has no words, so it fails the base rule; without labels of
both classes the list is empty and keeps what passes the base; repeated rows are judged each for
itself, and a labelled id that several rows share teaches once, by the row with the least hash of its text; very long texts are judged whole,
as arrays of 64-bit numbers; of rules that cover a row the first decides, and among equal gains the first feature and threshold in order is
taken; an empty table gives an empty result; other columns of the input are kept, and those with the names of statistics or verdicts are
replaced.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import WS, WS_CLASS, fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bound on the labelled rows that are used for fitting; the driver sees their statistics only.
MAX_TRAIN = 8000

FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "distinct_share", "end_share")


def stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_digits,
    n_distinct and n_ends. Each word is hashed once to 64 bits; repeated 5-word windows are found by the hashes of their words'
    hashes within one text, and the sort is only made for texts in which a window recurs."""
    t, words, lines, word_hash, windows, recurs, order, places = fresh(docs, "t", "words", "lines", "word_hash", "windows", "recurs", "order", "places")
    n_chars = lambda c: F.char_length(c).cast("long")
    without = lambda chars: n_chars(F.col(t)) - n_chars(F.translate(t, chars, ""))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumns(
        {
            words: F.filter(F.split(t, WS_CLASS), lambda x: x != ""),
            lines: F.filter(F.split(t, "\n"), lambda x: F.translate(x, WS, "") != ""),
            "word_chars": n_chars(F.translate(t, WS, "")),
            "n_symbols": without(SYMBOLS),
            "n_digits": without("0123456789"),
            "n_ends": without(".!?"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            word_hash: F.transform(words, lambda x: F.xxhash64(x)),
        }
    ).drop(words, lines, t)
    window = lambda i: F.xxhash64(*(F.get(F.col(word_hash), i + k) for k in range(WINDOW)))
    df = df.withColumns(
        {
            "n_distinct": F.size(F.array_distinct(word_hash)).cast("long"),
            windows: F.when(F.size(word_hash) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(word_hash) - WINDOW), window)).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop(word_hash)
    df = df.withColumn(recurs, F.size(F.array_distinct(windows)) < F.size(windows))
    df = df.withColumn(order, F.when(F.col(recurs), F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(order)
    same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
    df = df.withColumn(places, F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    p = F.col(places)
    steps = F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return df.drop(windows, recurs, order, places)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / words
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars"),
        "symbol_share": share("n_symbols"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": share("n_repeat_words"),
        "digit_share": share("n_digits"),
        "distinct_share": share("n_distinct"),
        "end_share": share("n_ends"),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects rows for which every (feature, op, threshold) holds; op is "<" or ">="."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def holds(self, row: dict) -> bool:
        return all(row[f] < t if op == "<" else row[f] >= t for f, op, t in self.terms)


def _cuts(rows: list[dict], f: str, n: int = 40) -> list[float]:
    v = sorted(r[f] for r in rows)
    return sorted({v[min(len(v) - 1, i * len(v) // n)] for i in range(1, n)}) if v else []


def learn(rows: list[tuple[dict, bool]], max_rules: int = 12, max_terms: int = 4, min_precision: float = 0.9, min_cover: int = 4) -> list[Rule]:
    """Sequential covering. rows: (features, is_bad). Every third row is held out for pruning.
    A rule is accepted if its precision on all rows still uncovered reaches `min_precision`, so
    that good documents stay."""
    left = list(rows)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = [x for i, x in enumerate(left) if i % 3], [x for i, x in enumerate(left) if i % 3 == 0]
        if sum(bad for _, bad in grow) < min_cover:
            break
        cuts = {f: _cuts([r for r, bad in grow if bad], f) + _cuts([r for r, _ in grow], f) for f in FEATURES}
        terms: list[tuple[str, str, float]] = []
        now = grow
        while len(terms) < max_terms:
            p0, n0 = sum(bad for _, bad in now), sum(not bad for _, bad in now)
            if not n0 or not p0:
                break
            before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
            for f in FEATURES:
                order = sorted(now, key=lambda x: x[0][f])
                at, p, n = 0, 0, 0
                for t in sorted(set(cuts[f])):
                    while at < len(order) and order[at][0][f] < t:
                        p, n, at = p + order[at][1], n + (not order[at][1]), at + 1
                    for op, pp, nn in (("<", p, n), (">=", p0 - p, n0 - n)):
                        if pp >= min_cover and pp + nn < p0 + n0:
                            gain = pp * (math.log2(pp / (pp + nn)) - before)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, op, t))
            if not best[1]:
                break
            terms.append(best[1])
            now = [x for x in now if Rule((best[1],), 0, 0).holds(x[0])]
        if not terms:
            break

        def worth(ts):
            got = [bad for r, bad in prune if Rule(tuple(ts), 0, 0).holds(r)]
            return (2 * sum(got) - len(got)) / len(got) if got else -1.0

        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms.pop()
        got = [bad for r, bad in left if Rule(tuple(terms), 0, 0).holds(r)]
        if len(got) < min_cover or sum(got) / len(got) < min_precision:
            break
        rules.append(Rule(tuple(terms), sum(got) / len(got), len(got)))
        left = [x for x in left if not rules[-1].holds(x[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, bad: Column | None = None, max_train: int = MAX_TRAIN, **how) -> list[Rule]:
    """Learns from at most `max_train` labelled rows, those with the smallest hash of doc_id.
    labels: doc_id, quality (0 is bad). The joined side is bounded by `max_train`. Rows that the
    base rule rejects teach nothing and are left out."""
    bad = F.col("quality") == 0 if bad is None else bad
    picked = labels.filter("doc_id IS NOT NULL").select("doc_id", bad.alias("_bad")).filter("_bad IS NOT NULL").orderBy(F.xxhash64("doc_id"), "_bad").limit(max_train)
    # one row for each id, so that no more than max_train reach the driver: the one with the least hash of its text
    of = docs.select("doc_id", "text").join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").groupBy("doc_id", "_bad").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    df = stats(of)
    # the rows are few; a filter here would be pushed below the projections and repeat their work
    got = df.select("doc_id", "_bad", base_failed().alias("_failed"), *(c.alias(f"f_{k}") for k, c in features().items())).collect()
    got = [r for r in got if not r["_failed"]]
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return learn([({k: float(r[f"f_{k}"]) for k in FEATURES}, bool(r["_bad"])) for r in got], **how)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that rejects or 0), as ordered conditional expressions."""
    f = features()
    at = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for k, op, t in rule.terms:
            holds = holds & ((f[k] < t) if op == "<" else (f[k] >= t))
        at = at.when(holds, F.lit(i))
    at = at.otherwise(F.lit(0))
    return at == 0, at


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with statistics, base_failed, rule and kept."""
    keep, at = verdict(rules)
    return stats(docs, text).withColumns({"base_failed": base_failed(), "rule": at}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
