"""BPE encoding and decoding with forced boundaries.

A token is a string of bytes, and merges only ever make tokens of the vocabulary. So two bytes that stand side by side inside no
token are never merged: between them is a certain cut, and what is left of it doesn't change what is right of it. The table of all
65,536 byte pairs is proved once from the whole vocabulary. Texts are cut there and where the library's own splitting cuts them; the fragments, which
are short and repeat often, are encoded each by itself, each different one once, and their ids are concatenated.

Decoding gathers the bytes of all ids at once; bytes that are no UTF-8 become U+FFFD, as in the library.

Special strings inside a text are one token each, as is the library's default. Texts with characters on which the pattern's tables and
the library's may differ are split by the library's splitter and then go the same way. Texts of over `PIECE_BYTES` are worked on in pieces.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows count each; texts of any length are encoded whole; an empty
table gives an empty result; other columns, whatever their names, are dropped. A vocabulary that splits texts in another way is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.tokens import OTHER, UNSURE, _byte_groups, byte_chars, check_splitting, class_table, code_points, library, pieces, pre_token_starts

#: What a worker remembers: fragments and their bytes. Longer fragments than `LONG` are never remembered.
REMEMBER, REMEMBER_BYTES, LONG = 500_000, 32 << 20, 4096
PIECE_BYTES = 4_000_000


def token_bytes(tok) -> list[bytes]:
    """The bytes of each id. Added tokens stand for themselves."""
    back = {c: b for b, c in byte_chars().items()}
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for s, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
    return out


def inside_pairs(tok) -> np.ndarray:
    """inside[256 * a + b]: whether the bytes a, b stand side by side in a token of the vocabulary (added tokens aside)."""
    back = {c: b for b, c in byte_chars().items()}
    inside = np.zeros(1 << 16, bool)
    for s in tok.get_vocab(with_added_tokens=False):
        b = np.array([back[c] for c in s if c in back], np.int64)
        inside[256 * b[:-1] + b[1:]] = True
    return inside


class ForcedEncoder:
    """Encodes as the library does, fragment by fragment."""

    def __init__(self, path: str):
        self.tok = library(path)
        check_splitting(self.tok)
        added = self.tok.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("the vocabulary's special strings take in what stands around them")
        self.special = {t.content.encode(): i for i, t in added.items() if t.content}
        self.find_special = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.inside = inside_pairs(self.tok)
        self.kinds = class_table()
        self.chars = byte_chars()
        self.latin = {ord(c): b for b, c in self.chars.items()}
        pieces_ = token_bytes(self.tok)
        self.bytes = np.frombuffer(b"".join(pieces_), np.uint8)
        self.width = np.array([len(x) for x in pieces_], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, list[int]] = {s: [i] for s, i in self.special.items()}
        self.held = 0

    def _fragments(self, values: list[bytes]) -> list[list[int]]:
        """The ids of each of these different fragments."""
        if len(self.ids) > REMEMBER or self.held > REMEMBER_BYTES:
            self._forget()
        known, merge, table, out = self.ids, self.tok.model.tokenize, self.chars, []
        for v in values:
            got = known.get(v)
            if got is None:
                got = [t.id for t in merge(v.decode("latin1").translate(table))]
                if len(v) <= LONG:
                    known[v] = got
                    self.held += len(v)
            out.append(got)
        return out

    def _library_starts(self, text: str) -> Iterator[int]:
        """Where the library's splitter cuts a text, in bytes."""
        at = 0
        for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            yield at
            at += len(s)  # a character for each byte

    def _starts(self, texts: pa.Array, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a fragment, and which of those begin one only because of their pair."""
        at, cp = code_points(buf)
        kind = self.kinds[cp]
        odd = set((np.searchsorted(off, at[kind == UNSURE], "right") - 1).tolist())
        kind[kind == UNSURE] = OTHER
        for s in self.special:
            odd.update(np.flatnonzero(np.asarray(pc.match_substring(texts, s.decode()))).tolist())
        new_row = np.zeros(len(at) + 1, bool)
        new_row[np.searchsorted(at, off)] = True
        start = np.zeros(len(buf), bool)
        start[at[pre_token_starts(cp, kind, new_row[:-1])]] = True
        whole = np.zeros(len(buf), bool)  # bytes of special strings, but for the first of each
        for k in sorted(odd):
            lo, hi = int(off[k]), int(off[k + 1])
            start[lo:hi] = False
            raw, done = buf[lo:hi].tobytes(), 0
            for m in chain(self.find_special.finditer(raw) if self.special else (), (None,)):
                end = m.start() if m else hi - lo
                start[lo + done + np.fromiter(self._library_starts(raw[done:end].decode()), np.int64)] = True
                if m:
                    start[lo + end] = True
                    whole[lo + end + 1 : lo + m.end()] = True
                    done = m.end()
        forced = np.zeros(len(buf), bool)
        forced[1:] = ~self.inside[buf[:-1].astype(np.int64) * 256 + buf[1:]]
        forced &= ~start & ~whole
        return start | forced, forced

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """texts: strings without nulls. (All ids one after another, where each text's ids begin and the last ones end, each text's forced cuts)."""
        texts = texts.cast(pa.string())
        owner = None
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > PIECE_BYTES:
            # cut before spaces that follow something else: no token holds such a pair, and no splitting looks across it
            parts = [list(pieces(t, PIECE_BYTES // 4)) for t in texts.to_pylist()]
            owner = np.cumsum([0, *map(len, parts)])
            texts = pa.array(list(chain.from_iterable(parts)), pa.string())
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
        off = (off - off[0]).astype(np.int64)
        if len(buf):
            start, forced = self._starts(texts, buf, off)
            begin = np.flatnonzero(start)
            frags = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(buf)).astype(np.int32)), pa.py_buffer(buf)]).dictionary_encode()
            got = self._fragments(frags.dictionary.to_pylist())
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.int64, int(size.sum()))
            first = np.cumsum(size) - size
            which = frags.indices.to_numpy()
            end = np.append(0, np.cumsum(size[which]))
            ids = flat[np.arange(end[-1]) + np.repeat(first[which] - end[:-1], size[which])]
            bounds = end[np.searchsorted(begin, off)]
            cuts = np.append(0, np.cumsum(forced))[off]
        else:
            ids, bounds, cuts = np.zeros(0, np.int64), np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)
        if owner is not None:
            bounds, cuts = bounds[owner], cuts[owner]
        return ids, bounds, np.diff(cuts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of the text of each run of ids."""
        size = self.width[ids]
        end = np.append(0, np.cumsum(size))
        raw = self.bytes[np.arange(end[-1]) + np.repeat(self.at[ids] - end[:-1], size)].tobytes()
        cut = end[bounds].tolist()
        return [raw[i:j].decode("utf-8", "replace").encode() for i, j in zip(cut[:-1], cut[1:], strict=True)]


_here: dict[str, ForcedEncoder] = {}


def encoder(path: str) -> ForcedEncoder:
    """One for each worker process."""
    if path not in _here:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _here[path] = ForcedEncoder(path)
    return _here[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (packed as little-endian 32-bit integers), n_tokens and n_forced (cuts that only byte pairs give) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for i, j in _byte_groups(texts, 1_000_000):
                ids, bounds, cuts = enc.encode(texts.slice(i, j - i))
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), packed.cast(pa.binary()), pa.array(np.diff(bounds)), pa.array(cuts)], ["k", "ids", "n_tokens", "n_forced"])

    out = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"k {kind}, ids binary, n_tokens long, n_forced long")
    return out.withColumnRenamed("k", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text of each row's packed ids. Null ids are no ids."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            packed = pc.fill_null(b.column(1), b"")
            for i, j in _byte_groups(packed, 1_000_000):
                part = packed.slice(i, j - i)
                flat = np.frombuffer(b"".join(part.to_pylist()), "<u4").astype(np.int64)
                bounds = np.append(0, np.cumsum(pc.binary_length(part).to_numpy().astype(np.int64) // 4))
                texts = pa.array([t.decode() for t in enc.decode(flat, bounds)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), texts], ["k", "text"])

    out = rows.select(F.col(key), F.col(ids).alias("_ids")).mapInArrow(run, f"k {kind}, text string")
    return out.withColumnRenamed("k", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and n_forced: digests of what `encode` and `decode` give, in one pass."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for i, j in _byte_groups(texts, 1_000_000):
                ids, bounds, cuts = enc.encode(texts.slice(i, j - i))
                wide, cut = memoryview(ids.astype("<u4").tobytes()), (4 * bounds).tolist()
                of_ids = [sha(wide[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                of_text = [sha(t) for t in enc.decode(ids, bounds)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(of_ids), pa.array(of_text), pa.array(cuts)], ["k", "n_tokens", "ids_sha256", "decoded_sha256", "n_forced"])

    out = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_forced long")
    return out.withColumnRenamed("k", key)
