"""Token counts by the whole-token shortcut, and the encoder that the binary output shares.

Which vocabulary strings encode alone as exactly one token is proved once, on the driver, by
encoding every one of them with the library. Pre-tokens of many texts are found at once from the classes of their
characters; each different pre-token is looked up once: those that the proof covers count as one token, and only the
rest go through the library's merges. What a worker remembers is bounded.

Texts with special strings (one token each, as is the library's default), and with characters on which the
pattern's Unicode tables and the library's may differ, go to the library whole. A vocabulary that splits texts in
another way is refused.

Defined results: a null or empty text has no tokens; repeated rows count each; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: The pattern that byte-level vocabularies of this family split text with (a fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes agree in the regular expression module and the library.
SURE = r"\x00-\u0530\u2000-\u206f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
REMEMBER = 1_000_000
GROUP_CHARS = 4_000_000
PIECE_CHARS = 16_000_000



def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in vocabularies of this family (a fixed rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def byte_strings(tok) -> dict[int, str]:
    """The vocabulary's strings as text, where their bytes are whole characters."""
    back = {c: b for b, c in byte_chars().items()}
    out = {}
    for s, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            out[i] = bytes(back[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue
    return out


def prove_whole(path: str) -> dict[str, int]:
    """{string: id} of the vocabulary strings that the library encodes, alone, as that one token."""
    tok = library(path)
    items = list(byte_strings(tok).items())
    got = tok.encode_batch([s for _, s in items], add_special_tokens=False)
    return {s: i for (i, s), e in zip(items, got, strict=True) if e.ids == [i]}


def specials(tok) -> list[tuple[str, int]]:
    return [(t.content, i) for i, t in tok.get_added_tokens_decoder().items() if t.content]


def check_splitting(tok) -> None:
    """Raises unless the file splits texts as `PRE_TOKEN` says and changes no character first."""
    spec = json.loads(tok.to_str())
    if spec.get("normalizer"):
        raise ValueError("the vocabulary normalises texts; only byte-level files without a normalizer are read here")
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the vocabulary doesn't split texts by the byte-level pattern")
    if type(tok.model).__name__ != "BPE":
        raise ValueError("the vocabulary isn't merged pair by pair")


LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)


def class_table() -> np.ndarray:
    """The class of each character below 0x10000, by the pattern's own classes; what isn't in `SURE` is UNSURE."""
    every = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x10000)))
    out = np.full(0x10000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"), (UNSURE, rf"[^{SURE}]")):
        out[[m.start() for m in regex.finditer(pattern, every)]] = kind
    out[0xD800:0xE000] = UNSURE
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each character of UTF-8 bytes begins, its code point; 0xFFFF for those beyond 0xFFFF)."""
    if not (buf >= 0x80).any():
        return np.arange(len(buf), dtype=np.int32), buf.astype(np.uint16)
    at = np.flatnonzero((buf & 0xC0) != 0x80).astype(np.int32)
    cp = buf[at].astype(np.uint16)
    more = np.flatnonzero(cp >= 0xC0)
    lead, x = cp[more], at[more]
    tail = lambda k, some: buf[x[some] + k].astype(np.uint16) & 0x3F
    two, three = lead < 0xE0, (lead >= 0xE0) & (lead < 0xF0)
    out = np.full(len(more), 0xFFFF, np.uint16)
    out[two] = (lead[two] & 0x1F) << 6 | tail(1, two)
    out[three] = (lead[three] & 0xF) << 12 | tail(1, three) << 6 | tail(2, three)
    cp[more] = out
    return at, cp


def pre_token_starts(cp: np.ndarray, kind: np.ndarray, new_row: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token. kind: their classes, none UNSURE; new_row: where texts begin."""
    n = len(cp)
    start = new_row.copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    end = np.append(run[1:], n)
    # the last character of whitespace before something else is a space that joins it, or stands alone
    blank = (kind[run] == SPACE) & (end < n)
    blank[blank] = ~new_row[end[blank]]
    nxt = end[blank]
    start[nxt - 1] = True
    start[nxt[cp[nxt - 1] == 32]] = False
    # 's, 't, 're, 've, 'm, 'll and 'd: an apostrophe that begins a pre-token and has no other mark after it
    quote = run[(cp[run] == 39) & (end - run == 1) & (end < n)]
    quote = quote[start[quote] & ~new_row[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        c1 = cp[quote + 1]
        c2 = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        c2[(quote + 2 < n) & new_row[np.minimum(quote + 2, n - 1)]] = 0
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        cut = quote[one | two]
        start[cut + 1] = False
        rest = cut + 2 + two[one | two]
        start[rest[rest < n]] = True
    return start


class Encoder:
    """Counts or encodes texts exactly as the library does.

    Pre-tokens of many texts are found at once; each different one is looked up once. Those that the proof covers are known
    from the start, and the library merges the rest. What has been merged is remembered, up to `REMEMBER` pre-tokens."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tok = library(path)
        check_splitting(self.tok)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 0x10000 else "<u4")
        self.special = [s for s, _ in specials(self.tok)]
        self.byte_chars = byte_chars()
        self.kinds = class_table()
        self.whole = {s.encode(): i for s, i in whole.items()}
        self._forget()

    def _forget(self) -> None:
        self.entry = {s: k for k, s in enumerate(self.whole)}
        self.flat = np.fromiter(self.whole.values(), self.dtype, len(self.whole))
        self.size = np.ones(len(self.whole), np.int32)
        self.start = np.arange(len(self.whole), dtype=np.int64)

    def _merge(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of pre-tokens one after another, how many each has), by the library's merges."""
        merge, table = self.tok.model.tokenize, self.byte_chars
        ids = [[t.id for t in merge(v.decode("latin1").translate(table))] for v in values]
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int32, len(ids))

    def _entries(self, values: list[bytes]) -> np.ndarray:
        """The numbers of pre-tokens in the store; what isn't there is merged and added."""
        if len(self.entry) > REMEMBER:
            self._forget()
        get = self.entry.get
        at = np.fromiter([get(v, -1) for v in values], np.int64, len(values))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = [values[k] for k in missing], len(self.size)
            flat, size = self._merge(new)
            self.entry.update(zip(new, range(first, first + len(size)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size, dtype=np.int64) - size])
            self.flat = np.concatenate([self.flat, flat])
            self.size = np.concatenate([self.size, size])
            at[missing] = np.arange(first, first + len(size))
        return at

    def _known(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(entry of each pre-token, where each text's pre-tokens begin, texts that the library must take whole)."""
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), []
        at, cp = code_points(buf)
        kind = self.kinds[cp]
        odd = set((np.searchsorted(off, at[kind == UNSURE], "right") - 1).tolist())
        kind[kind == UNSURE] = OTHER
        for s in self.special:
            odd.update(np.flatnonzero(np.asarray(pc.match_substring(texts, s))).tolist())
        new_row = np.zeros(len(at) + 1, bool)
        new_row[np.searchsorted(at, off)] = True
        start = at[pre_token_starts(cp, kind, new_row[:-1])]
        tokens = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(buf)).astype(np.int32)), pa.py_buffer(buf)])
        d = tokens.dictionary_encode()
        entry = self._entries(d.dictionary.to_pylist())[d.indices.to_numpy()]
        return entry, np.searchsorted(start, off), sorted(odd)

    def _whole(self, texts: pa.Array, k: int) -> list[int]:
        """The library's ids of a text that can't be taken apart as a whole; special strings in it are one token each."""
        out: list[int] = []
        for piece in pieces(texts[k].as_py(), PIECE_CHARS):
            out += self.tok.encode(piece, add_special_tokens=False).ids
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """texts: strings without nulls. The number of tokens of each."""
        texts, owner = _cut_long(texts)
        entry, first, odd = self._known(texts)
        total = np.append(0, np.cumsum(self.size[entry], dtype=np.int64))
        out = total[first[1:]] - total[first[:-1]]
        for k in odd:
            out[k] = len(self._whole(texts, k))
        return out if owner is None else np.add.reduceat(out, owner)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings without nulls. (All ids one after another, where each text's ids begin and the last ones end)."""
        texts, owner = _cut_long(texts)
        entry, first, odd = self._known(texts)
        size = self.size[entry].astype(np.int64)
        end = np.append(0, np.cumsum(size))
        ids = self.flat[np.arange(end[-1]) + np.repeat(self.start[entry] - end[:-1], size)]
        bounds = end[first]
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for k in odd:
                parts[k] = np.array(self._whole(texts, k), self.dtype)
            ids, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, bounds if owner is None else np.append(bounds[owner], bounds[-1])


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A long text in pieces, cut before spaces that follow a character other than whitespace."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _cut_long(texts: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
    """Texts of over `PIECE_CHARS` bytes in their pieces, and where each text's pieces begin; None if there are none."""
    texts = texts.cast(pa.string())
    if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= PIECE_CHARS:
        return texts, None
    parts = [list(pieces(t, PIECE_CHARS // 4)) for t in texts.to_pylist()]
    n = np.array([len(p) for p in parts])
    return pa.array([x for p in parts for x in p], pa.string()), np.cumsum(n) - n


_here: dict = {}


def encoder(path: str, whole) -> Encoder:
    """One for each worker process."""
    if path not in _here:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _here[path] = Encoder(path, whole.value)
    return _here[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of each row."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))  # at most the vocabulary
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path, whole)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for i, j in _byte_groups(texts):
                some = texts.slice(i, j - i)
                n = enc.count(some)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pc.cast(pc.binary_length(some), pa.int64()), pa.array(n), pa.array(n > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(key, docs[text].cast("string").alias("_text")).mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)


def _byte_groups(texts: pa.Array, size: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes of text, or one row, without making Python strings."""
    n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    at, before = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(n, before + size, "right")))
        yield at, end
        at, before = end, int(n[end - 1])
