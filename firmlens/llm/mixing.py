"""Mixing sources to target weights: hierarchical budgeting over domain, language and source.

A budget of tokens flows down a tree of weights. A node whose subtree can't supply its share
gives what it lacks to its siblings, and only what all siblings together can't take goes up
to the ancestors. A leaf supplies at most `max_epochs` times its tokens. Within a leaf, each
epoch orders the documents by a seeded hash; whole epochs are taken in full and the last one
gives a prefix, up to and without the document that would pass the budget.

The prefix is found without putting a leaf into one task: hashes are cut into 2**BUCKET_BITS
equal ranges, tokens are summed by leaf and range (a small table), whole ranges under the budget are
taken, and only the range in which the budget ends is ordered row by row. Rows that are equal in id and text are taken or left together.

Defined results: a null text has no tokens; null domain, language or source is a leaf of its own
("?"); repeated rows count each; ties in the hash are ordered by id, then text hash; an empty
table gives an empty result; other columns are kept, and clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import WS_CLASS, cut, fresh

BUCKET_BITS = 12
LEVELS = ("domain", "lang", "source")
#: Production parameters: shares of the four domains; languages and sources within get equal parts.
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.2, "forum": 0.2, "code": 0.2}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def domain_of(source: Column) -> Column:
    """The domain of a source: src0 to src19 are dealt to four; anything else is web."""
    n = F.try_to_number(F.regexp_extract(source, r"^src(\d{1,6})$", 1), F.lit("999999")).cast("int")
    return F.coalesce(F.element_at(F.array(*(F.lit(x) for x in ("web", "books", "forum", "code"))), F.pmod(n, F.lit(4)) + 1), F.lit("web"))


@dataclass
class Node:
    name: str
    weight: float = 1.0
    children: list[Node] = field(default_factory=list)
    supply: float = 0.0  # of a leaf: the most it can give
    budget: float = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else self.supply

    def leaves(self, path: tuple[str, ...] = ()):
        if not self.children:
            yield path, self
        for c in self.children:
            yield from c.leaves((*path, c.name))


def allocate(node: Node, budget: float) -> float:
    """Sets the budgets below `node`; returns what its subtree couldn't take."""
    node.budget = min(budget, node.capacity())
    if node.children:
        open_, left = {i: c.weight for i, c in enumerate(node.children)}, node.budget
        share = [0.0] * len(node.children)
        while open_ and left > 1e-9:
            total = sum(open_.values())
            part = {i: left * w / total if total > 0 else left / len(open_) for i, w in open_.items()}
            full = [i for i in open_ if part[i] >= node.children[i].capacity() - 1e-9]
            if not full:  # all siblings can take their parts
                share = [part.get(i, s) for i, s in enumerate(share)]
                break
            for i in full:  # what is missing here is dealt to the siblings that are left
                share[i] = node.children[i].capacity()
                left -= share[i]
                del open_[i]
        for c, s in zip(node.children, share, strict=True):
            allocate(c, s)
    return budget - node.budget


def tree(leaves: list[tuple[tuple[str, ...], float]], weight: Callable[[int, str], float], max_epochs: int) -> Node:
    """leaves: ((domain, lang, source), tokens)."""
    root = Node("root")
    known: dict[tuple[str, ...], Node] = {(): root}
    for path, tokens in sorted(leaves):
        for depth, name in enumerate(path):
            if path[: depth + 1] not in known:
                node = known[path[: depth + 1]] = Node(name, weight(depth, name))
                known[path[:depth]].children.append(node)
        known[path].supply = tokens * max_epochs
    return root


def fitting_budget(node: Node, level: int = 1) -> float:
    """The largest budget at which every node down to this level (1: domains, 2: their languages, 3: their sources) can give its target share."""
    total = sum(c.weight for c in node.children)
    if level < 1 or total <= 0:
        return node.capacity()
    return min(fitting_budget(c, level - 1) * total / c.weight for c in node.children if c.weight > 0)


def weights(depth: int, name: str) -> float:
    return (DOMAIN_WEIGHTS.get(name, 0.05), LANG_WEIGHTS.get(name, 0.05), 1.0)[depth]


#: Up to so many leaves the tree of budgets is made on the driver and the plan is broadcast; beyond, budgets are found level by level in Spark and joined.
MAX_LEAVES = 1_000_000


def budgets(leaf: DataFrame, names: list[str], weight: Callable[[int, str], float], max_epochs: int, budget: float | None, level: int = 1) -> DataFrame:
    """leaf (names, n) with budget: what `allocate` gives each leaf, without a tree on the driver. The children of a node, in the order of capacity over weight, take all
    that they have as long as that is less than their part of what is left; from the first that has more, all get the same multiple of their weights."""
    from pyspark.sql.types import DoubleType

    levels = [leaf.select(*names, (F.coalesce("n", F.lit(0)).cast("double") * max_epochs).alias("cap"))]
    for depth in range(len(names) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*names[:depth]).agg(F.sum("cap").alias("cap")))
    of = lambda depth: F.udf(lambda name: float(weight(depth, name)), DoubleType())  # noqa: E731  once for each node, and the rule is the caller's
    levels = [df.withColumn("w", of(depth)(names[depth])) for depth, df in enumerate(levels)]
    total = levels[0].agg(F.sum("cap")).first()[0] or 0.0
    if budget is None:
        fits = levels[level - 1].select(*names[:level], F.col("cap").alias("fits"), "w")
        for depth in range(level - 1, -1, -1):
            up = fits.groupBy(*names[:depth]).agg((F.min(F.when(F.col("w") > 0, F.col("fits") / F.col("w"))) * F.sum("w")).alias("fits"))
            if depth:
                above = levels[depth - 1].join(up, names[:depth])
                up = above.select(*names[:depth], F.coalesce("fits", "cap").alias("fits"), "w")
            fits = up
        fits = fits.first()["fits"]
        budget = total if fits is None else fits
    given = None
    for depth, df in enumerate(levels):
        rows = df.withColumn("budget", F.lit(min(float(budget), total))) if given is None else df.join(given, names[:depth])
        # children without a weight have equal parts of what the others can't take
        rows = rows.withColumn("w", F.greatest("w", F.lit(1e-12)))
        above = Window.partitionBy(*names[:depth]) if depth else Window.partitionBy(F.lit(0))  # domains are few
        order = above.orderBy(F.col("cap") / F.col("w"), names[depth])
        left = F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn("_level", left / rest)
        rows = rows.withColumn("_open", F.when(F.col("cap") > F.col("w") * F.col("_level") + 1e-9, F.col("_level")))
        level = F.first("_open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        given = rows.select(*names[: depth + 1], F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * level)).alias("budget"))
    return leaf.join(given, names)


def mix(docs: DataFrame, budget: float | None, weight: Callable[[int, str], float] = weights, max_epochs: int = 1, seed: int = 7, domain: Column | None = None, tokens: Column | None = None, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """docs with domain, leaf_tokens, leaf_budget, epoch (from 0) and n_tokens: a row for each time that a document is taken. budget: tokens; None: the
    largest at which every node down to `level` can give its target share (`fitting_budget`)."""
    domain = domain_of(F.col("source")) if domain is None else domain
    tokens = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WS_CLASS), lambda x: x != "")).cast("long") if tokens is None else tokens
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    spark = docs.sparkSession
    *names, t, take, bucket, end, piece, before, upto_here, part_sum = fresh(docs, *(f"level{i}" for i in range(len(LEVELS))), "text_hash", "take", "bucket", "last", "place", "before", "sum", "n")
    df = docs.drop("epoch", "leaf_tokens", "leaf_budget").withColumns({"n_tokens": tokens, t: F.xxhash64(text), **dict(zip(names, map(known, (domain, F.col("lang"), F.col("source"))), strict=True))})
    seeded = F.xxhash64(F.lit(seed), "epoch", key, t)
    place = F.struct(seeded.alias("h"), F.col(key).alias("k"), F.col(t).alias("t"))
    # the texts are read once for their counts; everything up to the last step works on this narrow table
    narrow = cut(df.select(*names, key, t, "n_tokens"), "mix")
    leaves = cut(narrow.groupBy(*names).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")), "leaves")
    few = leaves.limit(MAX_LEAVES + 1).count() <= MAX_LEAVES
    if few:
        rows = leaves.collect()  # a row for each leaf
        root = tree([(tuple(r[x] for x in names), float(r["n"])) for r in rows], weight, max_epochs)
        allocate(root, fitting_budget(root, level) if budget is None else budget)
        supply = {tuple(r[x] for x in names): r["n"] for r in rows}
        given = spark.createDataFrame([(*path, supply[path], node.budget) for path, node in root.leaves() if path in supply], ", ".join(f"{x} string" for x in names) + ", n long, budget double")
    else:
        given = cut(budgets(leaves, names, weight, max_epochs, budget, level), "budgets")
    want = F.floor(F.col("budget") + 1e-6).cast("long")
    # whole epochs first, then what is left
    taken = F.greatest(F.least(want - F.col("epoch") * F.col("n"), F.col("n")), F.lit(0))
    plans = given.withColumn("epoch", F.explode(F.array(*map(F.lit, range(max_epochs))))).filter((F.col("epoch") * F.col("n") < want) | ((F.col("epoch") == 0) & (F.col("n") == 0)))
    plans = plans.select(*names, "epoch", F.col("n").alias("leaf_tokens"), want.alias("leaf_budget"), taken.alias(take))  # leaves x epochs
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    part = [*names, "epoch"]
    partial = narrow.join(small(plans.filter(F.col(take) < F.col("leaf_tokens"))), names).withColumn(piece, place)
    partial = partial.withColumn(bucket, F.shiftright(F.col(piece)["h"], 64 - BUCKET_BITS))  # in the order of the hashes
    # leaves x epochs x 2**BUCKET_BITS rows at most
    sums = partial.groupBy(*part, bucket, take).agg(F.sum("n_tokens").alias(part_sum))
    run = sums.withColumn(before, F.coalesce(F.sum(part_sum).over(Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = run.filter((F.col(before) <= F.col(take)) & (F.col(before) + F.col(part_sum) > F.col(take))).select(*part, bucket, before)
    inside = partial.join(small(edge), [*part, bucket])  # a row for each partial leaf and epoch
    upto = inside.withColumn(upto_here, F.col(before) + F.sum("n_tokens").over(Window.partitionBy(*part).orderBy(piece)))
    last = upto.groupBy(*part, bucket).agg(F.max(F.when(F.col(upto_here) <= F.col(take), F.col(piece))).alias(end))
    ends = plans.join(last, part, "left")
    chosen = df.join(small(ends), names)
    chosen = chosen.filter(
        (F.col(take) >= F.col("leaf_tokens"))
        | (F.shiftright(seeded, 64 - BUCKET_BITS) < F.col(bucket))
        | (F.col(end).isNotNull() & (place <= F.col(end)))
    )
    return chosen.withColumn("domain", F.col(names[0])).drop(*names, t, take, bucket, end)


def shares(mixed: DataFrame, weight: Callable[[int, str], float] = weights) -> DataFrame:
    """domain, lang, source, tokens, taken_share, target_share of every node of the tree (null below the node's level): shares among the
    siblings that the mix has. A row for each node."""
    leaf = mixed.select("domain", *(F.coalesce(F.col(x).cast("string"), F.lit("?")).alias(x) for x in LEVELS[1:]), "n_tokens").groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    out = None
    for depth in range(len(LEVELS)):
        own, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        name = F.col(LEVELS[depth])
        rule = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}.get(LEVELS[depth], {}) if weight is weights else {}
        w = F.lit(weight(depth, ""))
        for k, v in rule.items():
            w = F.when(name == k, F.lit(v)).otherwise(w)
        level = leaf.groupBy(*own).agg(F.sum("tokens").alias("tokens"))
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))  # of a node: domains are few
        level = level.withColumns({"taken_share": F.col("tokens") / F.sum("tokens").over(siblings), "target_share": w / F.sum(w).over(siblings)})
        level = level.select(*own, *(F.lit(None).cast("string").alias(x) for x in LEVELS[depth + 1 :]), "tokens", "taken_share", "target_share")
        out = level if out is None else out.unionByName(level)
    return out
