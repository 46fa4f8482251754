"""Suffix-array dedup of repeated 100-byte strings over a whole corpus.

Sorting every suffix would ship the corpus many times over, so suffixes are sampled by content: of each
100-byte window the 32-byte piece with the least hash is an anchor, and equal windows have
equal anchors at equal offsets. The suffixes at anchors, each with the 68 bytes before it, stand
for all windows, so sampling loses no repeat:

1. of anchors with equal contexts (68 bytes before, 100 from the anchor on) all but the first occurrence are removed
   outright, and pieces that only occur in one context are done;
2. for pieces with several contexts, the first occurrence of each context gets its bytes from the text. These
   suffixes are range-partitioned by their leading bytes, at sampled splitters; a bucket is sorted by multikey quicksort on
   8-byte words, and the common prefixes of neighbours give the runs of suffixes that share any number of bytes. The bytes before the anchors
   are sorted backwards in the same way. A window that begins d bytes before its anchor is repeated where the runs of 100 - d
   bytes from the anchor on and of d bytes before it meet;
3. no run crosses the boundary of two buckets, because splitters lie between different leading pieces. Only pieces with more than
   `HOT` contexts are too large for a bucket; their windows are compared across all tasks, by a grouped minimum over the windows' bytes.

Defined results: a null text is empty; a null key comes first; rows with one key and different texts are
ordered by the texts' hash, and rows that are equal in both are one document (each gets its result);
texts under 100 bytes keep everything; very long texts are worked on whole; an empty table gives an empty result; other columns are dropped.
In step 1 pieces and contexts are compared by 64-bit hashes each (128 bits together); all later comparisons are of bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import cut
from firmlens.llm.tokens import _byte_groups

LENGTH, PIECE = 100, 32
SPAN = LENGTH - PIECE + 1  # pieces in a window
LEFT = LENGTH - PIECE  # bytes before an anchor that a window can reach
#: Contexts of one piece beyond which its windows are compared over all tasks.
HOT = 50_000
#: Hot pieces up to this number are broadcast (9 bytes each); beyond, they are joined by a shuffle.
BROADCAST_HOT = 1_000_000
NO_KEY = -(2**63)

_rng = np.random.default_rng(100)
_byte_a, _byte_b = (_rng.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_Q_INVERSE = np.uint64(pow(int(_Q), -1, 2**64))
_pow: dict[str, np.ndarray] = {}


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("q", ())) < n:
        size = 1 << n.bit_length()
        _pow.update(q=_powers(_Q, size), i=_powers(_Q_INVERSE, size))
    return _pow["q"], _pow["i"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w elements, by doubling."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:n], x[w - have : w - have + n])


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """T with (T[j] - T[i]) * Q**i a hash of buf[i:j]."""
    _, inverse = _pows(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_b[buf] * inverse[: len(buf)], out=out[1:])
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in buf of the anchors of all 100-byte windows within documents, and their pieces' hashes."""
    if len(buf) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, w = _byte_a[buf], 1
    while w < PIECE:
        h = h[:-w] * np.uint64(pow(int(_P), w, 2**64)) + h[w:]
        w *= 2
    h = _mix(h)
    o = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(o, SPAN, np.minimum)
    # windows that leave their document don't count
    inside = np.zeros(len(buf) + 1, np.int8)
    ok = ends - starts >= LENGTH
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, ends[ok] - LENGTH + 1, -1)
    least = np.where(np.cumsum(inside[: len(least)], dtype=np.int8) > 0, least, np.uint32(0))
    pad = np.zeros(SPAN - 1, np.uint32)
    at = np.flatnonzero(o == _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum))
    return at, h[at]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = [t or b"" for t in texts.to_pylist()]
    lens = np.array([len(x) for x in data], np.int64)
    ends = np.cumsum(lens)
    return np.frombuffer(b"".join(data), np.uint8), ends - lens, ends


def _emit_anchors(batches):
    """doc, tie, text -> h, ctx, doc, tie, pos, lr (bytes before * 128 + bytes from the anchor on). Contexts that a text
    repeats leave as stretches of it: pos is where one begins and lr its length, negative; h deals them out evenly."""
    for b in batches:
        for i, j in _byte_groups(b.column(2)):
            buf, starts, ends = _buffer(b.column(2).slice(i, j - i))
            at, h = anchors(buf, starts, ends)
            row = np.searchsorted(ends, at, "right")
            left = np.minimum(at - starts[row], LEFT)
            right = np.minimum(ends[row] - at, LENGTH)
            t = prefix_hash(buf)
            q, _ = _pows(len(t))
            ctx = _mix((t[at + right] - t[at - left]) * q[at - left] ^ ((left * 128 + right).astype(np.uint64) * _P))
            doc, tie = (b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in range(2))
            pos, lr = (at - starts[row]).astype(np.int32), (left * 128 + right).astype(np.int32)
            own = _mix(_mix(ctx ^ h * _Q) + row.astype(np.uint64) * _P)
            order = np.argsort(own, kind="stable")
            again = np.zeros(len(at), bool)
            again[order[1:][own[order][1:] == own[order][:-1]]] = True
            rest, rep = np.flatnonzero(~again), np.flatnonzero(again)
            lo, hi, r = pos[rep] - left[rep], pos[rep] + right[rep], row[rep]
            first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (lo[1:] > hi[:-1]))) if len(rep) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(rep)) - 1 if len(rep) else first
            where = r[first]
            cols = (
                (h[rest].view(np.int64), tie[where] ^ lo[first]),
                (ctx[rest].view(np.int64), lo[first]),
                (doc[row[rest]], doc[where]),
                (tie[row[rest]], tie[where]),
                (pos[rest], lo[first]),
                (lr[rest], lo[first] - hi[last]),
            )
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t) for x, t in zip(cols, types, strict=True)], ["h", "ctx", "doc", "tie", "pos", "lr"])


def _emit_first_pass(batches):
    """Rows in the order of (h, ctx, doc, tie, pos). Gives kind 0: removed bytes pos to pos + n; kind 1: the
    first occurrence of a context whose piece has other contexts. Only one row is kept from batch to batch."""
    names = ["kind", "h", "doc", "tie", "pos", "n"]
    last = None  # the row before: h, ctx, doc, tie, pos
    held = None  # the last first occurrence: (h, doc, tie, pos, whether one with the same h stood before it)
    for b in batches:
        if not b.num_rows:
            continue
        every = [b.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
        own, shared = every[5] < 0, every[5] >= 0
        h, ctx, doc, tie, pos, lr = (x[own] for x in every)
        yield _batch([(np.zeros(len(h), np.int8), h, doc, tie, pos, -lr)], names)
        h, ctx, doc, tie, pos, lr = (x[shared] for x in every)
        if not len(h):
            continue
        as_before = [x == np.concatenate([[x[0] if last is None else last[k]], x[:-1]]) for k, x in enumerate((h, ctx, doc, tie, pos))]
        same = as_before[0] & as_before[1]
        if last is None:
            same[0] = False
        # a row that is there twice is one document, no repeat
        again, head = np.flatnonzero(same & ~(as_before[2] & as_before[3] & as_before[4])), np.flatnonzero(~same)
        left = lr[again] // 128
        out = [(np.zeros(len(again), np.int8), h[again], doc[again], tie[again], pos[again] - left, left + lr[again] % 128)]
        last = (h[-1], ctx[-1], doc[-1], tie[-1], pos[-1])
        if len(head):
            cols = [np.concatenate([[x], y]) if held else y for x, y in zip(held[:4] if held else (0,) * 4, (h[head], doc[head], tie[head], pos[head]), strict=True)]
            hh = cols[0]
            equal = hh[1:] == hh[:-1]
            prev = np.concatenate([[held[4] if held else False], equal])
            nxt = np.concatenate([equal, [False]])
            done = (prev | nxt)[:-1]
            pick = np.flatnonzero(done)
            out.append((np.ones(len(pick), np.int8), *(c[pick] for c in cols), np.zeros(len(pick), np.int32)))
            held = (*(c[-1] for c in cols), bool(prev[-1]))
        yield _batch(out, names)
    if held and held[4]:
        yield _batch([(np.ones(1, np.int8), *(np.array([x]) for x in held[:4]), np.zeros(1, np.int32))], names)


def _batch(parts, names) -> pa.RecordBatch:
    kinds = {"kind": pa.int8(), "pos": pa.int32(), "n": pa.int32(), "lo": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kinds.get(k, pa.int64())) for k, x in zip(names, zip(*parts, strict=True), strict=True)], names)


def _emit_contexts(batches):
    """doc, tie, text, heads (position of each and whether its piece is hot, or null) -> hot, lead, doc, tie, pos, left, right, bytes."""
    for b in batches:
        docs = np.flatnonzero(b.column(3).is_valid().to_numpy(zero_copy_only=False))
        for some in np.array_split(docs, max(1, len(docs) // 200)):
            out = []
            for i in some.tolist():
                text = b.column(2)[i].as_py()
                doc, tie = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for x in b.column(3)[i].as_py():
                    p = x["pos"]
                    left, right = min(p, LEFT), min(len(text) - p, LENGTH)
                    out.append((x["hot"], text[p : p + PIECE], doc, tie, p, left, right, text[p - left : p].rjust(LEFT, b"\0") + text[p : p + right].ljust(LENGTH, b"\0")))
            if out:
                types = (pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["hot", "lead", "doc", "tie", "pos", "left", "right", "bytes"])


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte strings: sorted by 8-byte words, each word only among those that are equal so far."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(n, np.int64)  # of the sorted rows: number of the run of equals
    group[1:] = np.cumsum(words[order[1:], 0] != words[order[:-1], 0])
    for k in range(1, words.shape[1]):
        tied = np.flatnonzero(np.append(group[1:] == group[:-1], False) | np.append(False, group[1:] == group[:-1]))
        if not len(tied):
            break
        sub = tied[np.lexsort((words[order[tied], k], group[tied]))]
        order[tied] = order[sub]
        w = words[order, k]
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (w[1:] != w[:-1]))]) if n else group
    return order


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte strings, and how many leading bytes each shares with the one before it in that order."""
    order = multikey_order(rows)
    common = np.zeros(len(rows), np.int64)
    for x in range(1, len(rows), 100_000):
        a, b = rows[order[x - 1 : x + 99_999]], rows[order[x : x + 100_000]]
        differ = a[: len(b)] != b
        common[x : x + len(b)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def repeated_windows(doc, tie, pos, left, right, ctx: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """[(rows, d)]: rows whose window that begins d bytes before the anchor also occurs, at the same offset, in an earlier row.
    ctx: the bytes around each anchor, padded; left and right say how many are there."""
    first = np.lexsort((pos, tie, doc))  # the earliest first
    doc, tie, pos, left, right, ctx = (x[first] for x in (doc, tie, pos, left, right, ctx))
    after, shared_after = suffix_order(ctx[:, LEFT:])
    before, shared_before = suffix_order(ctx[:, LEFT - 1 :: -1])
    run_after, run_before = np.empty(len(ctx), np.int64), np.empty(len(ctx), np.int64)
    out = []
    for d in range(LEFT + 1):
        ok = np.flatnonzero((left >= d) & (right >= LENGTH - d))
        if len(ok) < 2:
            continue
        # numbers of the runs of suffixes that share LENGTH - d bytes from the anchor on, and d bytes before it
        run_after[after] = np.cumsum(shared_after < LENGTH - d)
        run_before[before] = np.cumsum(shared_before < d)
        key = run_after[ok] * (len(ctx) + 1) + run_before[ok]
        by = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[by[1:]] == key[by[:-1]]) + 1
        x, y = ok[by[again]], ok[by[again - 1]]
        own = (doc[x] == doc[y]) & (tie[x] == tie[y]) & (pos[x] == pos[y])  # a row that is there twice
        if not own.all():
            out.append((first[x[~own]], d))
    return out


def _emit_repeats(batches):
    """Rows in the order of lead. Gives doc, tie, pos, n of repeated windows, merged where they adjoin around an anchor."""
    from firmlens.llm.lshforest import _groups_of

    names = ["doc", "tie", "pos", "n"]
    for t in _groups_of(batches, 1):
        doc, tie, pos, left, right = (t.column(c).to_numpy() for c in range(1, 6))
        ctx = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(len(doc), LEFT + LENGTH)
        out = []
        for rows, d in repeated_windows(doc, tie, pos.astype(np.int64), left, right, ctx):
            out.append((doc[rows], tie[rows], pos[rows] - d, rows))
        if not out:
            continue
        dd, tt, pp, rr = (np.concatenate(x) for x in zip(*out, strict=True))
        by = np.lexsort((pp, rr))
        dd, tt, pp, rr = dd[by], tt[by], pp[by], rr[by]
        begin = np.flatnonzero(np.append(True, (rr[1:] != rr[:-1]) | (pp[1:] != pp[:-1] + 1)))
        end = np.append(begin[1:], len(pp)) - 1
        yield _batch([(dd[begin], tt[begin], pp[begin], (pp[end] - pp[begin] + LENGTH).astype(np.int32))], names)


def _emit_windows(batches):
    """Every window around each anchor: its bytes, doc, tie, pos."""
    off = np.arange(2001, dtype=np.int32) * LENGTH
    for b in batches:
        doc, tie, pos, left, right = (b.column(c).to_numpy(zero_copy_only=False) for c in range(1, 6))
        data = b.column(6).to_pylist()
        for x in range(0, len(data), 2000):
            ctx = np.frombuffer(b"".join(data[x : x + 2000]), np.uint8).reshape(-1, LEFT + LENGTH)
            at = slice(x, x + len(ctx))
            for d in range(LEFT + 1):
                ok = np.flatnonzero((left[at] >= d) & (right[at] >= LENGTH - d))
                window = np.ascontiguousarray(ctx[ok, LEFT - d : LEFT - d + LENGTH])
                packed = pa.Array.from_buffers(pa.binary(), len(ok), [None, pa.py_buffer(off[: len(ok) + 1]), pa.py_buffer(window)])
                yield pa.RecordBatch.from_arrays([packed, pa.array(doc[at][ok]), pa.array(tie[at][ok]), pa.array((pos[at][ok] - d).astype(np.int32))], ["w", "doc", "tie", "pos"])


def _finish(batches):
    """key, text, spans (packed, or null) -> key, n_bytes, n_removed, n_spans, kept_sha256."""
    for b in batches:
        out = []
        for text, spans in zip(b.column(1), b.column(2), strict=True):
            text = text.as_buffer() if text.is_valid else b""
            n = len(text)
            if spans.is_valid and len(spans):
                x = spans.values.to_numpy(zero_copy_only=False)
                lo, size = x >> 32, x & 0xFFFFFFFF
                diff = np.zeros(n + 1, np.int32)
                np.add.at(diff, lo, 1)
                np.add.at(diff, lo + size, -1)
                gone = np.cumsum(diff[:n]) > 0
                edge = np.diff(gone.astype(np.int8), prepend=0)
                out.append((n, int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
            else:
                out.append((n, 0, 0, hashlib.sha256(text).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(base: DataFrame, n: int) -> DataFrame:
    """base: doc, tie, text. Returns doc, tie, pos, n, which may overlap."""
    found = base.mapInArrow(_emit_anchors, "h long, ctx long, doc long, tie long, pos int, lr int")
    dealt = found.repartition("h").sortWithinPartitions("h", "ctx", "doc", "tie", "pos")
    first = cut(dealt.mapInArrow(_emit_first_pass, "kind byte, h long, doc long, tie long, pos int, n int"), "first-pass")
    gone = first.filter("kind = 0").select("doc", "tie", "pos", "n")
    heads = first.filter("kind = 1")
    hot = cut(heads.groupBy("h").count().filter(F.col("count") > HOT).select("h", F.lit(True).alias("hot")), "hot")  # one row of HOT at most
    n_hot = hot.count()
    heads = heads.join(F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot, "h", "left") if n_hot else heads.withColumn("hot", F.lit(False))
    by_doc = heads.groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("heads"))  # at most a text's positions
    contexts = base.join(by_doc, ["doc", "tie"], "left").select("doc", "tie", "text", "heads").mapInArrow(_emit_contexts, "hot boolean, lead binary, doc long, tie long, pos int, left int, right int, bytes binary")
    # written first: range partitioning reads its input twice, once for the splitters
    contexts = cut(contexts, "contexts")
    cols = ["lead", "doc", "tie", "pos", "left", "right", "bytes"]
    buckets = contexts.filter("NOT hot").select(*cols).repartitionByRange(4 * n, "lead").sortWithinPartitions("lead")
    repeats = buckets.mapInArrow(_emit_repeats, "doc long, tie long, pos int, n int")
    if n_hot:
        windows = contexts.filter("hot").select(*cols).mapInArrow(_emit_windows, "w binary, doc long, tie long, pos int")
        place = F.struct("doc", "tie", "pos")
        least = windows.groupBy("w").agg(F.min(place).alias("p"))
        later = windows.join(least, "w").filter(place > F.col("p"))
        repeats = repeats.unionByName(later.select("doc", "tie", "pos", F.lit(LENGTH).alias("n")))
    return gone.unionByName(repeats)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), F.xxhash64(body).alias("tie"), body.cast("binary").alias("text"))
    # the anchors are found where the texts are read; both later passes share one exchange of the texts
    spans = removed_spans(base, n)
    packed = spans.groupBy("doc", "tie").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")).alias("spans"))
    out = base.join(packed, ["doc", "tie"], "left")
    out = out.select(F.when(F.col("doc") != NO_KEY, F.col("doc")).alias("k"), "text", "spans").mapInArrow(_finish, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("k", key)
