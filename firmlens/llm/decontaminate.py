"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other parameters has the same
template. Windows of `WINDOW` template tokens of the benchmark are the build side of a hash join and every
window of every document probes it. Matches of a document and an item are then held against each other: a
slot's value in the item must go to one value in the document wherever it occurs, and back. What is left
must cover `COVERAGE` of the item's tokens.

The benchmark is joined in blocks of at most `BLOCK_WINDOWS` windows, the bound of what is broadcast; of several blocks each one's matches are written before the next is made.

The cost of a pair of document and item is linear in their equal windows, however often a text repeats them.

Defined results: null and empty texts match nothing; items of fewer than `WINDOW` tokens, and windows of mostly placeholders,
can't be matched; equal items are reported each; repeated rows are reported each; an empty table on either side gives an empty
result; clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut, fresh
from firmlens.llm.tokens import _byte_groups

WINDOW = 5
LITERALS = 2  # of a window's tokens at least so many are no placeholders
COVERAGE = 0.6
AGREE = 2 / 3  # of the matched slots must agree
MIN_TOKENS = 8  # or the whole item, if it is shorter
BLOCK_WINDOWS = 1_000_000
REMEMBER = 300_000

NUM, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"<num>", b"<name>", b"<unit>"))
UNITS = frozenset("% $ € £ mm cm m km in ft yd mi mile miles mg g kg lb lbs oz ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent degrees c f kmh mph".split())
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
_number = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?([a-zµ%€£$]{0,3})")
_CAP, _END, _NUM, _UNIT, _NOTHING = 1, 2, 4, 8, 16


class _Words(dict):
    """Word (bytes) to a number; hash[number] of its normal form and flags[number]. Bounded."""

    def __init__(self):
        self.hash, self.flags = np.zeros(REMEMBER, np.uint64), np.zeros(REMEMBER, np.uint8)

    def __missing__(self, word):
        i = len(self)
        if i >= len(self.hash):  # only within one group of texts, which is bounded
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        s = word.decode(errors="replace")
        core = s.strip(".,;:!?\"'()[]{}«»“”„…*#|<>&-_~`¿¡")
        low = core.lower()
        flags = 0
        if s.rstrip("\"')]»”").endswith((".", "!", "?", ":")):
            flags |= _END
        if low in NUMBERS or (m := _number.fullmatch(low)) and (not m[1] or m[1] in UNITS):
            flags |= _NUM
        elif low in UNITS or s in UNITS:
            flags |= _UNIT
        elif not core:
            flags |= _NOTHING
        elif core[0].isupper() and len(core) > 1 and not core.isupper():
            flags |= _CAP
        self.hash[i], self.flags[i] = xxhash.xxh64_intdigest(low), flags
        self[word] = i
        return i


_here = _Words()


def templates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template tokens, hashes of the words behind them, positions among the words, start of each text)
    of all texts one after another. A capitalised word is a name unless a sentence begins with it; a unit is one after a number."""
    if len(_here) > REMEMBER // 2:
        _here.clear()
    words, starts = [], []
    for t in texts:
        starts.append(len(words))
        words += t.split()
    i = np.fromiter(map(_here.__getitem__, words), np.int64, len(words))
    flags, h = _here.flags[i], _here.hash[i]
    first = np.zeros(len(words) + 1, bool)
    first[starts] = True
    keep = np.flatnonzero(flags & _NOTHING == 0)
    text_of = np.searchsorted(starts, keep, "right") - 1
    new = np.bincount(text_of, minlength=len(texts)) if len(keep) else np.zeros(len(texts), np.int64)
    f, h = flags[keep], h[keep]
    begin = np.cumsum(new) - new
    before = np.concatenate([[np.uint8(_END)], f[:-1]]) if len(f) else f
    before[begin[new > 0]] = _END
    t = h.copy()
    num = f & _NUM > 0
    t[(f & _CAP > 0) & (before & _END == 0)] = NAME
    t[num] = NUM
    t[(f & _UNIT > 0) & (before & _NUM > 0)] = UNIT
    return t, h, keep, begin


def _windows(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of template tokens, and whether it has literals enough."""
    n = len(t) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    step = np.uint64(0x9E3779B97F4A7C15)
    literal = ((t != NUM) & (t != NAME) & (t != UNIT)).astype(np.int8)
    h, lit = t[:n].copy(), literal[:n].copy()
    for k in range(1, WINDOW):
        h = (h ^ (h >> np.uint64(32))) * step + t[k : n + k]
        lit += literal[k : n + k]
    return h ^ (h >> np.uint64(29)), lit >= LITERALS


class Items:
    """The build side: windows of a block of benchmark items, sorted by hash."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.ids = [k for k, _ in rows]
        t, h, _, begin = templates([(x or "").encode() for _, x in rows])
        size = np.diff(np.append(begin, len(t)))
        self.t = [t[b : b + n] for b, n in zip(begin, size, strict=True)]
        self.h = [h[b : b + n] for b, n in zip(begin, size, strict=True)]
        keys, item, pos = [], [], []
        for i, x in enumerate(self.t):
            w, ok = _windows(x)
            keys.append(w[ok])
            item.append(np.full(int(ok.sum()), i))
            pos.append(np.flatnonzero(ok))
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item, self.pos = (np.concatenate([np.zeros(0, np.int64), *x])[order] for x in (item, pos))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in w, rows of the index) of all equal pairs."""
        at = np.flatnonzero(self.bits[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, w[at], "left"), np.searchsorted(self.key, w[at], "right")
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), rows


def consistent(pairs: list[tuple[int, int, tuple[int, int]]]) -> tuple[set[int], bool]:
    """pairs: (position in the item, kind, (item value, document value)) of matched slots. A slot agrees if most
    slots with its item value have its document value, and the other way round; returns the positions that agree, and whether all values are the same."""
    forth, back = defaultdict(Counter), defaultdict(Counter)
    for _, kind, (a, b) in pairs:
        forth[kind, a][b] += 1
        back[kind, b][a] += 1
    most = lambda c, x: 2 * c[x] > sum(c.values())
    ok = {p for p, kind, (a, b) in pairs if most(forth[kind, a], b) and most(back[kind, b], a)}
    return ok, all(a == b for p, _, (a, b) in pairs if p in ok)


def align(p: np.ndarray, q: np.ndarray, length: int) -> dict[int, int]:
    """p, q: positions in the document and in the item of equal windows. Maps tokens of the item to tokens of the document. The
    diagonal (p - q) with the most windows comes first, of equals the one that begins first; a token keeps what it has got. Each window is looked at
    once, and no more when all tokens of the item have got theirs."""
    diagonals, where, n = np.unique(p - q, return_inverse=True, return_counts=True)
    begin = np.full(len(diagonals), np.iinfo(np.int64).max)
    np.minimum.at(begin, where, p)
    rank = np.empty(len(diagonals), np.int64)
    rank[np.lexsort((begin, -n))] = np.arange(len(diagonals))
    order = np.lexsort((p, rank[where]))
    at: dict[int, int] = {}
    for x in range(0, len(order), 4096):
        some = order[x : x + 4096]
        for d, i in zip(p[some].tolist(), q[some].tolist(), strict=True):
            for k in range(WINDOW):
                at.setdefault(i + k, d + k)
        if len(at) == length:
            break
    return at


def judge_pair(items: Items, i: int, t: np.ndarray, h: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[float, bool] | None:
    """p, q: positions in the document (t, h) and in the item i of equal windows. Returns (coverage, verbatim) if the document holds the item."""
    it, ih = items.t[i], items.h[i]
    at = align(p, q, len(it))
    slots = [(x, int(it[x]), (int(ih[x]), int(h[y]))) for x, y in at.items() if it[x] in (NUM, NAME, UNIT)]
    ok, same = consistent(slots)
    if len(ok) < AGREE * len(slots):
        return None
    covered = sum(x in ok or it[x] not in (NUM, NAME, UNIT) for x in at)
    if covered < COVERAGE * len(it) or covered < min(MIN_TOKENS, len(it)):
        return None
    return covered / len(it), same


def _probe(items, key_kind: pa.DataType, item_kind: pa.DataType):
    def run(batches):
        idx: Items = items.value
        for b in batches:
            for i, j in _byte_groups(b.column(1)):
                texts = [x or b"" for x in b.column(1).slice(i, j - i).to_pylist()]
                t, h, _, begin = templates(texts)
                w, ok = _windows(t)
                at, row = idx.find(np.where(ok, w, np.uint64(0)))
                size = np.diff(np.append(begin, len(t)))
                doc = np.searchsorted(begin + size, at, "right")
                inside = at + WINDOW <= begin[doc] + size[doc] if len(at) else np.zeros(0, bool)
                doc, at, row = doc[inside], at[inside], row[inside]
                by = np.lexsort((idx.item[row], doc))
                doc, p, which, q = doc[by], at[by] - begin[doc[by]], idx.item[row[by]], idx.pos[row[by]]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (which[1:] != which[:-1]))) if len(doc) else np.zeros(0, np.int64)
                out = []
                for x, y in zip(new.tolist(), np.append(new[1:], len(doc)).tolist()):
                    d, k = int(doc[x]), int(which[x])
                    if got := judge_pair(idx, k, t[begin[d] : begin[d] + size[d]], h[begin[d] : begin[d] + size[d]], p[x:y], q[x:y]):
                        out.append((b.column(0)[i + d].as_py(), idx.ids[k], got[0], "verbatim" if got[1] else "reparameterised"))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (key_kind, item_kind, pa.float64(), pa.string()), strict=True)], ["k", "item_id", "coverage", "kind"])

    return run


def blocks(benchmark: DataFrame, item: str, text: str):
    """The benchmark's rows in blocks of about `BLOCK_WINDOWS` windows; one block is held at a time."""
    rows, n = [], 0
    for r in benchmark.select(item, text).toLocalIterator():
        rows.append((r[0], r[1]))
        n += len((r[1] or "").split())
        if n >= BLOCK_WINDOWS:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: key, item_id, coverage, kind."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = [docs.schema[key].dataType, benchmark.schema[item].dataType]
    schema = f"k {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, coverage double, kind string"
    rows = docs.select(key, F.col(text).cast("string").cast("binary").alias("_text"))
    todo, parts = blocks(benchmark, item, item_text), []
    block = next(todo, None)
    while block is not None:
        items = spark.sparkContext.broadcast(Items(block))
        part = rows.mapInArrow(_probe(items, *map(to_arrow_type, kinds)), schema)
        block = next(todo, None)
        if parts or block is not None:  # of several blocks each is probed and written before the next one is made, and then let go
            part = cut(part, "matches")
            items.destroy()
        parts.append(part)
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return out.withColumnRenamed("k", key)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item. A row with a null key is judged like any other."""
    h, name, other = fresh(docs, "hash", "key", "text_hash")
    hashed = docs.withColumn(h, F.xxhash64(F.col(text)))
    found = matches(hashed.select(F.struct(F.col(key).alias("key"), F.col(h).alias("hash")).alias("id"), text), benchmark, "id", text, item, item_text)
    bad = found.select(F.col("id.key").alias(name), F.col("id.hash").alias(other)).distinct()
    return hashed.join(bad, hashed[key].eqNullSafe(F.col(name)) & (F.col(h) == F.col(other)), "left_anti").select(*docs.columns)
