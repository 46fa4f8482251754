"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of hashed 5-word shingles. Equal texts are one node. Each node has a label of `MAX_DEPTH` MinHashes in
each of `TREES` tries. A trie is the sorted table of its labels, range-partitioned over all tasks; what two
neighbours share is their longest common prefix, and a node that shares less than the shortest useful prefix with both
of its neighbours is alone there and leaves.

Matching begins with whole labels, and prefixes are shortened level by level. On each level the nodes under one
prefix are compared: a pair belongs to the first trie in which it meets and to the longest prefix on which it meets
anywhere, so it is verified once in all. Signatures rule out pairs that are far below the threshold; the others are
verified on their shingle sets. After a level the recall is measured: a link of similarity s would have been found with the chance
p(s) that one of the tries shows a common prefix, so each link found stands for 1 / p(s) links. The prefixes are shortened
until the recall reaches `TARGET_RECALL` in every band of similarity; a link at the threshold itself is added to the lowest
band as a guard, so that links which are too rare to be seen count as well.

Before that, groups of at least `HEAVY` nodes under one prefix are settled: some members of a group give a leader, the set of shingles that most of them hold;
leaders that share a prefix join the one with the most nodes; and a node whose similarity with its leader is at least 9/10 belongs to its class. The Jaccard
distance is a metric, so any two nodes of a class are at most 1/10 + 1/10 apart: they are linked, and no pair within a class is ever compared. Their links are counted from the
size of the class. The work on a large group of near copies grows with its nodes, not with its pairs.

What is left of large groups is dealt to tasks as pairs of blocks, each pair of blocks in one task, so that a group of any size is spread
and every pair in it is met; blocks of the same class aren't paired. Only counts and spanning edges leave a task, never all pairs.

Defined results: null or empty texts and texts without words have no links and form a class of equal texts;
a text with fewer than five words is one shingle; repeated rows are in one class; very long texts make blocks smaller
(`BLOCK_BYTES`); an empty table gives an empty result; other columns are dropped by `near_classes` and kept by `keep_first`.
Nodes are 64-bit hashes of texts and shingles 64-bit hashes of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import cut, fresh, join_counted
from firmlens.llm.components import components
from firmlens.llm.shingles import group_hashes

WORDS = 5
NUM, DEN = 4, 5  # similarity of at least 4/5
TREES = 20
MAX_DEPTH = 8
#: Prefixes are shortened to these lengths in turn, as far as the recall needs it.
DEPTHS = (8, 5, 4, 3, 2, 1)
TARGET_RECALL = 0.9999
#: A pair whose signatures agree in less than this share is not verified. At a similarity of 0.8 such a signature has a chance of about 1e-7.
NEAR = 0.62
HEAVY = 64  # nodes under one prefix that are settled
SETTLE_DEPTH = 5  # of such a prefix
VOTERS = 33  # about so many members give a group's leader
SALT_ROWS = 512  # members that one task compares with a leader, about
PAIRWISE = 24  # groups up to this size are compared many at a time
BLOCK = 256  # nodes in a block of a group, at most
BLOCK_BYTES = 32 << 20  # of shingles in a block, about
BANDS = 4  # of similarity, from the threshold to 1
BINS = 20  # in which links are counted
#: Nodes in tries up to this number are broadcast as a filter (8 bytes each), and nodes with candidates up to a quarter of it with their
#: units (32 bytes each), so that only texts and sets that are needed are exchanged; beyond, they are joined by a shuffle.
BROADCAST_NODES = 2_000_000


def chance(similarity: float, depth: int) -> float:
    """That two nodes share a prefix of this depth in one of the tries."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(target: float | None = None) -> int:
    """The longest prefix whose chance at the threshold itself reaches the target: no shorter one is ever needed."""
    target = TARGET_RECALL if target is None else target
    return next((d for d in DEPTHS if chance(NUM / DEN, d) >= target), DEPTHS[-1])


def measured_recall(found: dict[int, int], depth: int) -> float:
    """found: links by bin of similarity. The least recall of the bands at this depth."""
    low, worst = NUM / DEN, 1.0
    for band in range(BANDS):
        n, total = (1, 1 / chance(low, depth)) if band == 0 else (0, 0.0)
        for b in range(band * BINS // BANDS, (band + 1) * BINS // BANDS):
            n += found.get(b, 0)
            total += found.get(b, 0) / chance(low + (1 - low) * b / BINS, depth)
        worst = min(worst, n / total if n else 1.0)
    return worst


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(1, 2**63, TREES * MAX_DEPTH, dtype=np.uint64)
    return draw(), draw() * np.uint64(2) + np.uint64(1)


def minhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash of the sets that begin at `starts`, none empty. A minimum over n hashes is about 2**64 / n, so its leading bits say little
    for large sets: the bits are taken from a mix of all of it."""
    out = np.empty((len(starts), TREES * MAX_DEPTH), np.uint16)
    for k, (seed, mult) in enumerate(zip(*_seeds(), strict=True)):
        out[:, k] = _mixed(np.minimum.reduceat((hashes ^ seed) * mult, starts)) >> np.uint64(48)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows)])


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, node (hash of the text), n (shingles) and sig (16 bits of each MinHash, trie by trie)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for rows, hashes, starts in group_hashes(b.column(2), WORDS):
                n = len(rows)
                sizes = np.diff(np.append(starts, len(hashes)))
                full = np.flatnonzero(sizes)
                sig = np.zeros((n, TREES * MAX_DEPTH), np.uint16)
                if len(full):
                    sig[full] = minhashes(hashes, starts[full])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, n), b.column(1).slice(rows.start, n), pa.array(sizes.astype(np.int64)), _binary(sig)], ["k", "node", "n", "sig"])

    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"k {kind}, node long, n long, sig binary")


def _common_prefixes(batches):
    """Sorted labels (a byte for the trie, then two for each MinHash) and nodes. Adds lcp, the longest prefix that a label
    shares with a neighbour. The neighbours across a partition's ends are not seen: its first and last row count as matched."""
    held = None

    def batch(label, node, lcp):
        return pa.RecordBatch.from_arrays([_binary(label), pa.array(node), pa.array(lcp.astype(np.int8))], ["label", "node", "lcp"])

    for b in batches:
        if not b.num_rows:
            continue
        label = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        node = b.column(1).to_numpy()
        before = np.full(1, MAX_DEPTH)
        if held:
            label, node, before = np.concatenate([held[0], label]), np.concatenate([held[1], node]), held[2]
        same = np.logical_and.accumulate(label[1:] == label[:-1], axis=1).sum(1)
        both = np.concatenate([before, np.maximum(same - 1, 0) // 2])
        yield batch(label[:-1], node[:-1], np.maximum(both[:-1], both[1:]))
        held = label[-1:], node[-1:], both[-1:]
    if held:
        yield batch(held[0], held[1], np.full(1, MAX_DEPTH))


def _labels(depth: int) -> Column:
    """The label of this length in each trie, from sig."""
    return F.array(*(F.concat(F.lit(bytes([t])), F.substring("sig", 1 + 2 * MAX_DEPTH * t, 2 * depth)) for t in range(TREES)))


def tries(nodes: DataFrame, shortest: int) -> DataFrame:
    """label, node, lcp of the nodes that may share at least the shortest prefix with a neighbour in a trie. nodes: node, n, sig."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.filter("n > 0").select("node", F.explode(_labels(MAX_DEPTH)).alias("label")).select("label", "node")
    dealt = rows.repartitionByRange(n, "label", "node").sortWithinPartitions("label", "node")
    return dealt.mapInArrow(_common_prefixes, "label binary, node long, lcp byte").filter(F.col("lcp") >= shortest)


def _groups_of(batches, names: int):
    """Record batches cut so that rows that are equal in the first `names` columns are never parted."""
    rest: list[pa.RecordBatch] = []

    def same(a, i, b, j):
        return all(a.column(c)[i] == b.column(c)[j] for c in range(names))

    for b in batches:
        if not b.num_rows:
            continue
        # the last group of the batch may go on
        cutoff = b.num_rows - 1
        ids = [b.column(c).to_numpy(zero_copy_only=False) for c in range(names)]
        while cutoff > 0 and all(x[cutoff - 1] == x[-1] for x in ids):
            cutoff -= 1
        if cutoff == 0 and rest and same(rest[-1], rest[-1].num_rows - 1, b, 0):
            rest.append(b)
            continue
        out = [*rest, b.slice(0, cutoff)] if cutoff else rest
        if out:
            yield pa.Table.from_batches(out).combine_chunks()
        rest = [b.slice(cutoff)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the lowest one that the pairs (a, b) connect it with."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _prefixes(sig: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the prefix of this depth in each trie."""
    x = sig.reshape(len(sig), TREES, MAX_DEPTH)
    h = np.full((len(sig), TREES), depth, np.uint64)
    for k in range(depth):
        h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + x[:, :, k])
    return h


def _pairs(new: np.ndarray, size: np.ndarray, side: np.ndarray, pairwise: int):
    """Pairs of positions within units, some at a time. side: 0 and 1 are two blocks, whose nodes are only paired across; 2: one block."""
    group = np.repeat(np.arange(len(new)), size)
    small = size[group] <= pairwise
    for o in range(1, min(pairwise, int(size.max()))):
        i = np.flatnonzero((group[o:] == group[:-o]) & small[o:])
        for x in range(0, len(i), 50_000):
            a = i[x : x + 50_000]
            a = a[(side[a] == 2) | (side[a] != side[a + o])]
            yield a, a + o
    for g in np.flatnonzero(size > pairwise):
        at = np.arange(new[g], new[g] + size[g])
        if side[at[0]] == 2:
            a, b = np.triu_indices(len(at), 1)
            a, b = at[a], at[b]
        else:
            left, right = at[side[at] == 0], at[side[at] == 1]
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        for x in range(0, len(a), 50_000):
            yield a[x : x + 50_000], b[x : x + 50_000]


def candidates(new, size, side, tree, lead, n, sig, depth: int, before: int | None, pairwise: int = PAIRWISE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that belong to this trie and depth, not to one class, and whose sizes and signatures don't rule them out. before: the depth of the last level."""
    here = _prefixes(sig, depth)
    longer = _prefixes(sig, before) if before else None
    out = [np.zeros((2, 0), np.int64)]
    for a, b in _pairs(new, size, side, pairwise):
        keep = (DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b])) & (lead[a] != lead[b])
        a, b = a[keep], b[keep]
        keep = (here[a] == here[b]).argmax(1) == tree[a]  # the first trie in which they meet
        a, b = a[keep], b[keep]
        if longer is not None:
            keep = ~(longer[a] == longer[b]).any(1)  # or they were met before
            a, b = a[keep], b[keep]
        keep = (sig[a] == sig[b]).mean(1) >= NEAR
        out.append(np.stack([a[keep], b[keep]]))
    a, b = np.concatenate(out, 1)
    return a, b


def _units(t: pa.Table):
    """Columns unit, side, tree, node, lead, n, sig as arrays, and where the units begin and how long they are."""
    unit, side, tree, node, lead, n = (t.column(c).to_numpy().astype(np.int64) for c in range(6))
    sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(len(unit), -1)
    new = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    return unit, side, tree, node, lead, n, sig, new, np.diff(np.append(new, len(unit)))


def _find(depth: int, before: int | None, pairwise: int):
    """Rows in the order of (unit, node). Keeps those with a candidate in their unit."""

    def run(batches):
        for t in _groups_of(batches, 1):
            unit, side, tree, node, lead, n, sig, new, size = _units(t)
            a, b = candidates(new, size, side, tree, lead, n, sig, depth, before, pairwise)
            at = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(unit[at]), pa.array(side[at].astype(np.int8)), pa.array(tree[at].astype(np.int8)), pa.array(node[at]), pa.array(lead[at])], ["unit", "side", "tree", "node", "lead"])

    return run


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of the pairs (a, b) of sorted sets: pair by pair where they are few, else by products of
    0/1 matrices of the shingles that several sets hold, in slices."""
    use = np.unique(np.concatenate([a, b]))
    words = sum(len(sets[i]) for i in use)
    if len(a) * (2e-5 + 4e-8 * words / len(use)) < 2e-10 * len(use) * words:
        out = np.zeros(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            out[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        return out
    flat = np.concatenate([sets[i] for i in use])
    owner = np.repeat(np.arange(len(use)), [len(sets[i]) for i in use])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    col = np.cumsum(np.append(True, flat[1:] != flat[:-1])) - 1
    keep = np.bincount(col)[col] > 1
    col, owner = col[keep], owner[keep]
    if len(col):
        col = np.cumsum(np.append(True, col[1:] != col[:-1])) - 1
    width = int(col[-1]) + 1 if len(col) else 0
    both = np.zeros((len(use), len(use)), np.float32)
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(col, (lo, lo + 4096))
        m = np.zeros((len(use), min(4096, width - lo)), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        both += m @ m.T
    return both[np.searchsorted(use, a), np.searchsorted(use, b)].astype(np.int64)


def _verify(depth: int, before: int | None, pairwise: int):
    """Rows in the order of (unit, node), with shingles. Gives node, n_links and low, the smallest node that the node
    reaches within the unit; with no low, links by bin of similarity in place of the node."""

    def run(batches):
        for t in _groups_of(batches, 1):
            _, side, tree, node, lead, n, sig, new, size = _units(t)
            a, b = candidates(new, size, side, tree, lead, n, sig, depth, before, pairwise)
            if not len(a):
                continue
            by = np.argsort(np.searchsorted(new, a, "right"), kind="stable")
            a, b = a[by], b[by]
            sets = [np.frombuffer(x, np.uint64) for x in t.column(7).to_pylist()]
            part = np.flatnonzero(np.diff(np.searchsorted(new, a, "right"), prepend=-1))
            inter = np.concatenate([_shared(sets, a[i:j], b[i:j]) for i, j in zip(part, np.append(part[1:], len(a)), strict=True)])
            link = (DEN + NUM) * inter >= NUM * (n[a] + n[b])
            a, b, inter = a[link], b[link], inter[link]
            similar = inter / (n[a] + n[b] - inter)
            bins = np.clip(((similar - NUM / DEN) * BINS / (1 - NUM / DEN)).astype(np.int64), 0, BINS - 1)
            low = _lowest(len(node), a, b)
            count = np.bincount(np.concatenate([a, b]), minlength=len(node))
            at = np.flatnonzero(count)
            hist = np.bincount(bins, minlength=BINS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[at], np.arange(BINS)])), pa.array(np.concatenate([count[at], hist])), pa.array(np.concatenate([node[low[at]], np.zeros(BINS, np.int64)]), mask=np.repeat([False, True], [len(at), BINS]))],
                ["node", "n_links", "low"],
            )

    return run


def _leaders(batches):
    """Rows in the order of g: g, shingles. The set of the shingles that more than half of a group's rows hold, and its signature."""
    for t in _groups_of(batches, 1):
        g = t.column(0).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column(1).to_pylist()]
        for i, j in zip(new := np.flatnonzero(np.append(True, g[1:] != g[:-1])), np.append(new[1:], len(g)), strict=True):
            values, votes = np.unique(np.concatenate(sets[i:j]), return_counts=True)
            most = values[2 * votes > j - i]
            if len(most):
                yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 1]), pa.array([most.tobytes()], pa.binary()), _binary(minhashes(most, np.zeros(1, np.int64)))], ["g", "shingles", "sig"])


def _close(batches):
    """Rows in the order of (g, salt, is member): a leader's set, then its members' sets. Keeps the members at 9/10 or more."""
    leader = None
    for b in batches:
        keep = []
        for k, (g, member, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4), strict=True)):
            x = np.frombuffer(raw.as_buffer(), np.uint64)
            if not member:
                leader = g, x
            elif leader and leader[0] == g:
                y = leader[1]
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 19 * both >= 9 * (len(x) + len(y)):
                    keep.append(k)
        yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(keep, pa.int64())), b.column(0).take(pa.array(keep, pa.int64()))], ["node", "g"])


def settle(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """node, lead (the smallest node of its class), size (of its class) of the nodes that are settled; None if no group is heavy. members: label, node, lcp."""
    rows = members.filter(F.col("lcp") >= SETTLE_DEPTH).select(F.xxhash64(F.substring("label", 1, 1 + 2 * SETTLE_DEPTH)).alias("g"), "node")
    heavy = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= HEAVY), "heavy")
    if heavy.isEmpty():
        return None
    # each node goes with the largest of its groups, and some of those that do vote for its leader
    best = rows.join(heavy, "g").groupBy("node").agg(F.max(F.struct("c", "g")).alias("b")).select("node", "b.g")
    best = cut(best, "best")
    chosen = best.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    voters = best.join(chosen, "g").filter(F.pmod(F.xxhash64("node", F.lit("vote")), F.ceil(F.col("c") / VOTERS)) == 0)
    dealt = voters.join(sets.select("node", "shingles"), "node").select("g", "shingles").repartition("g").sortWithinPartitions("g")
    leaders = cut(dealt.mapInArrow(_leaders, "g long, shingles binary, sig binary"), "leaders")
    # a leader joins the one with the most nodes of those that share a prefix with it
    named = leaders.join(chosen, "g").select("g", "c", F.explode(_labels(SETTLE_DEPTH)).alias("label"))
    most = named.groupBy("label").agg(F.max(F.struct("c", "g")).alias("m"))
    joined = named.join(most, "label").groupBy("g").agg(F.max("m").alias("m")).select("g", F.col("m.g").alias("to"))
    todo = cut(best.join(joined, "g").select("node", F.col("to").alias("g")), "led")
    parts = todo.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    heads = leaders.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.lit(0).cast("long").alias("node"), "shingles")
    tails = todo.join(parts, "g").select("g", F.pmod(F.xxhash64("node", "g"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "node").join(sets.select("node", "shingles"), "node")
    both = heads.unionByName(tails.select(heads.columns)).repartition("g", "salt").sortWithinPartitions("g", "salt", "member")
    near = cut(both.mapInArrow(_close, "node long, g long"), "close")
    classes = near.groupBy("g").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return near.join(classes, "g").select("node", "lead", "size")


def units(members: DataFrame, depth: int) -> DataFrame:
    """unit, side, tree, node, lead: the nodes under each prefix of this depth, dealt as pairs of blocks. members: label, node, lcp, n, lead.
    Classes of at least `BLOCK` nodes under a prefix have blocks of their own, which aren't paired with each other."""
    tree = F.conv(F.hex(F.substring("label", 1, 1)), 16, 10).cast("byte").alias("tree")
    rows = members.filter(F.col("lcp") >= depth).select(F.xxhash64(F.substring("label", 1, 1 + 2 * depth)).alias("prefix"), tree, "node", "n", "lead")
    # nodes that aren't settled count together
    rows = rows.withColumn("part", F.when(F.col("lead").isNull(), F.lit(0)).otherwise(F.col("lead"))).withColumn("at", F.xxhash64("prefix", "part"))
    found = rows.groupBy("at", "prefix", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("words"))
    found = found.withColumn("own_class", F.when(F.col("c") >= BLOCK, F.col("part")).otherwise(0))
    blocks = F.greatest(F.ceil(F.sum("c") / BLOCK), F.ceil(8 * F.sum("words") / BLOCK_BYTES)).cast("int").alias("blocks")
    groups = found.groupBy("prefix", "own_class").agg(F.sum("c").alias("nodes"), blocks)
    in_prefix = Window.partitionBy("prefix")
    groups = groups.select("prefix", "own_class", "blocks", F.sum("blocks").over(in_prefix).cast("int").alias("total"), (F.sum("blocks").over(in_prefix.orderBy("own_class")) - F.col("blocks")).cast("int").alias("lo"), F.sum("nodes").over(in_prefix).alias("all"))
    groups = groups.filter((F.col("all") > 1) & ((F.col("own_class") == 0) | (F.col("total") > F.col("blocks"))))
    size = cut(found.join(groups, ["prefix", "own_class"]).select("at", "c", "own_class", "blocks", "total", "lo"), "prefixes")
    placed = join_counted(rows, size, "at", "c").withColumn("own", F.col("lo") + F.pmod(F.xxhash64("node", "prefix"), F.col("blocks")).cast("int"))
    # each node goes to the unit of its block with every block
    others = F.sequence(F.lit(0), F.col("total") - 1)
    apart = F.filter(others, lambda x: (x < F.col("lo")) | (x >= F.col("lo") + F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.when(F.col("own_class") == 0, others).otherwise(apart)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    # what lies within a block is compared in a unit of its own
    unit = F.xxhash64("prefix", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    return dealt.select(unit, side.cast("byte").alias("side"), "tree", "node", F.coalesce("lead", "node").alias("lead"))


def links(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """node, n_links, low: for every node with links, in one or several rows. nodes: node, n, sig, written."""
    shortest = prefix_depth()
    found_in = cut(tries(nodes, shortest), "tries")
    members = cut(found_in.join(nodes.select("node", "n"), "node"), "members")
    sets = texts_of(docs, members.select("node").distinct(), text).mapInArrow(_shingle_sets, "node long, shingles binary")
    # from here on n is the number of different shingles
    sets = cut(sets.join(nodes.drop("n"), "node").select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"), "sig", "shingles"), "sets")
    settled, out, seen, before = settle(members, sets), None, {}, None
    if settled is None:
        members = members.withColumn("lead", F.lit(None).cast("long"))
    else:
        settled = cut(settled, "settled")
        members = cut(members.join(settled.select("node", "lead"), "node", "left"), "members")
        out = settled.select("node", (F.col("size") - 1).alias("n_links"), F.col("lead").alias("low"))
    for depth in (d for d in DEPTHS if d >= shortest):
        todo = units(members, depth).join(sets.select("node", "n", "sig"), "node").select("unit", "side", "tree", "node", "lead", "n", "sig")
        dealt = todo.repartition("unit").sortWithinPartitions("unit", "node")
        near = cut(dealt.mapInArrow(_find(depth, before, PAIRWISE), "unit long, side byte, tree byte, node long, lead long"), "candidates")
        small = near.count() <= BROADCAST_NODES // 4
        todo = sets.join(F.broadcast(near) if small else near, "node").select("unit", "side", "tree", "node", "lead", "n", "sig", "shingles")
        dealt = todo.repartition("unit").sortWithinPartitions("unit", "node")
        got = cut(dealt.mapInArrow(_verify(depth, before, PAIRWISE), "node long, n_links long, low long"), "links")
        for r in got.filter("low IS NULL").groupBy("node").agg(F.sum("n_links").alias("n")).collect():  # BINS rows
            seen[r["node"]] = seen.get(r["node"], 0) + r["n"]
        got = got.filter("low IS NOT NULL")
        out = got if out is None else out.unionByName(got)
        if measured_recall(seen, depth) >= TARGET_RECALL:
            break
        before = depth
    return out


def _shingle_sets(batches):
    for b in batches:
        for rows, hashes, starts in group_hashes(b.column(1), WORDS):
            ends = np.append(starts[1:], len(hashes))
            sets = [np.unique(hashes[i:j]).tobytes() for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(rows)), pa.array(sets, pa.binary())], ["node", "shingles"])


def texts_of(docs: DataFrame, fam: DataFrame, text: str) -> DataFrame:
    """node and text of the nodes in families, a row each."""
    rows = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("t"))
    only = fam.select("node")
    if only.count() <= BROADCAST_NODES:
        only = F.broadcast(only)
    return rows.join(only, "node", "left_semi").groupBy("node").agg(F.first("t").alias("t"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node, class_id (the class's smallest key), n_links (different texts at or above the threshold),
    n_copies (rows with the same text) and is_first (one row of the class, or all that are equal to it)."""
    docs = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    sigs = cut(signatures(docs, key, text), "signatures")
    nodes = cut(sigs.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    verified = links(nodes, docs, text)
    counts = verified.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    comp = components(verified.filter("low <> node").select(F.col("node").alias("u"), F.col("low").alias("v")))
    info = counts.join(comp, "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("_class"))
    rank = F.struct(F.col("k").isNull().alias("x"), F.col("k"), F.col("node"))
    per_node = sigs.groupBy("node").agg(F.min(rank).alias("_r"), F.count(F.lit(1)).alias("n_copies"))
    known = cut(per_node.join(info, "node", "left").withColumn("_class", F.coalesce("_class", "node")), "classed")
    best = cut(known.groupBy("_class").agg(F.min("_r").alias("_best"), F.count(F.lit(1)).alias("_nodes")), "firsts")
    placed = cut(join_counted(known, best, "_class", "_nodes").select("node", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "_best"), "placed")
    out = join_counted(sigs.select("k", "node"), placed, "node", "n_copies")
    first = rank.eqNullSafe(F.col("_best"))
    return out.select(F.col("k").alias(key), "node", F.col("_best.k").alias("class_id"), "n_links", "n_copies", first.alias("is_first"))


def unordered(kind) -> bool:
    """Whether values of this type have no order (maps and what holds them)."""
    return "map<" in kind.simpleString() or kind.simpleString() in ("variant", "interval")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each class. Of rows that are equal in key and text the least by all its columns stays."""
    here = fresh(docs, "null", "key", "node")

    def ids(k: Column, node: Column) -> list[Column]:
        return [x.alias(h) for x, h in zip((k.isNull(), F.coalesce(k.cast("string"), F.lit("")), node), here, strict=True)]

    first = near_classes(docs, key, text).filter("is_first").select(*ids(F.col(key), F.col("node"))).distinct()
    rows = docs.select("*", *ids(F.col(key), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    # whole rows are exchanged once: what drops equal rows deals them out as the join needs them
    # key and text are the same in all rows of a group, so only the other columns are compared
    col = lambda c: F.col(f"`{c}`")
    others = [c for c in docs.columns if c not in (key, text)]
    whole, order = (F.struct(*(f(c).alias(f"c{i}") for i, c in enumerate(others))) for f in (col, lambda c: F.to_json(F.struct(col(c))) if unordered(docs.schema[c].dataType) else col(c)))
    least = F.min_by(whole, order) if any(unordered(docs.schema[c].dataType) for c in others) else F.min(whole)
    one = rows.groupBy(*here).agg(*([least.alias("row")] if others else []), *(F.first(col(c)).alias(f"same{i}") for i, c in enumerate((key, text))))
    kept = [F.col(f"same{(key, text).index(c)}").alias(c) if c in (key, text) else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns]
    return one.join(first, here, "left_semi").select(*kept)
