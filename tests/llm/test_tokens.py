import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from firmlens.llm import idfile, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(PATH, tokens.prove_whole(PATH))


def texts():
    rng = random.Random(5)
    bits = ["the", "thereof", " ", "  ", "\n", " \n", "\n \n", "\t", "\xa0", " ", "　", "1", "2024", "don't", "'s", "é", "ñ", "ß", "…", "!!", "<|endoftext|>", "中文", "あ", "՘", "😀", "\x1c", "\x85", "\r\n", "<|", "x" * 50]
    return ["", " ", "\n", "a  b", "a \n b", "<|endoftext|>", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(3000))]


def arrow(some):
    return pa.array(some, pa.string())


def test_counts_and_ids_equal_the_library(enc):
    want = [e.ids for e in enc.tok.encode_batch(texts(), add_special_tokens=False)]
    for _ in range(2):
        assert enc.count(arrow(texts())).tolist() == [len(x) for x in want]
        ids, bounds = enc.encode(arrow(texts()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert enc.count(arrow([])).tolist() == [] and enc.count(arrow(["", ""])).tolist() == [0, 0]
    some = arrow(texts()).slice(50, 70)
    assert enc.count(some).tolist() == [len(x) for x in want[50:120]]


def test_contractions(enc):
    rng = random.Random(8)
    some = ["".join(rng.choice(["'", "s", "re", "ll", "l", "ve", "d", "m", "t", " ", "!", "a", "1", "\n", "S"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert enc.count(arrow(some)).tolist() == [len(e.ids) for e in enc.tok.encode_batch(some, add_special_tokens=False)]


def test_what_is_forgotten_is_merged_again(enc, monkeypatch):
    want = enc.count(arrow(texts())).tolist()
    monkeypatch.setattr(tokens, "REMEMBER", 1)
    assert enc.count(arrow(texts())).tolist() == enc.count(arrow(texts())).tolist() == want


def test_pieces_do_not_change_the_ids(enc, monkeypatch):
    t = " ".join(texts())
    want, bounds = enc.encode(arrow(["x", t, ""]))
    assert "".join(tokens.pieces(t, 40)) == t
    monkeypatch.setattr(tokens, "PIECE_CHARS", 160)
    got, cut = enc.encode(arrow(["x", t, ""]))
    assert got.tolist() == want.tolist() and cut.tolist() == bounds.tolist()
    assert enc.count(arrow(["x", t, ""])).tolist() == np.diff(bounds).tolist()


def test_other_ways_of_splitting_are_refused():
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            tokens.check_splitting(tokens.library(public_tokenizers.path(name)))


def test_sure_characters_have_the_same_classes(enc):
    pre = regex.compile(tokens.PRE_TOKEN)
    for lo, hi in ((0, 0x530), (0x2000, 0x206F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)):
        for c in [*range(lo, min(hi, lo + 0x600) + 1), hi]:
            s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}"
            spans = [m.span() for m in pre.finditer(s)]
            assert [x[1] for x in enc.tok.pre_tokenizer.pre_tokenize_str(s)] == spans, hex(c)
            _, cp = tokens.code_points(np.frombuffer(s.encode(), np.uint8))
            assert cp.tolist() == list(map(ord, s))
            new = np.zeros(len(s), bool)
            new[0] = True
            assert np.flatnonzero(tokens.pre_token_starts(cp, enc.kinds[cp], new)).tolist() == [a for a, _ in spans], hex(c)


def test_count_tokens(spark):
    df = spark.createDataFrame([(1, "the cat", "x"), (2, None, "y"), (3, "", "z"), (1, "the cat", "x"), (4, "word " * 3000, "")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.count_tokens(df, PATH).collect()))
    assert got == [(1, 7, 2, False), (1, 7, 2, False), (2, 0, 0, False), (3, 0, 0, False), (4, 15000, 3001, True)]
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (1000, 10**9), (300, 300), (200, 2**40)):
        v = np.sort(rng.integers(0, top, n))
        ef, end = idfile.EliasFano.load(idfile.EliasFano.of(v).dump(), 0)
        assert ef.select(np.arange(n)).tolist() == v.tolist()
        assert [int(ef.select([i])[0]) for i in range(0, n, 7)] == v[::7].tolist()
        if n == 1000 and top > 10**6:
            assert end * 8 < n * (2.6 + np.log2(top / n)) + 400
    gap = np.array([0] * 70 + [10**6] * 70)
    assert idfile.EliasFano.of(gap).select(np.arange(140)).tolist() == gap.tolist()


@pytest.mark.parametrize("width", [2, 4])
def test_block(width):
    keys, sizes = np.array([-(2**62), 5, 5, 2**62 + 1]), np.array([3, 1, 2, 1, 4])
    ids = [np.arange(n, dtype=f"<u{width}") + 70000 * (width == 4) for n in sizes]
    b = idfile.Block(idfile.pack_block(keys, 1, sizes, [x.tobytes() for x in ids], width))
    assert b.keys() == [None, *keys.tolist()] and b.n == 5
    assert [b.ids(i).tolist() for i in range(5)] == [x.tolist() for x in ids]


def test_file_round_trip(spark, tmp_path, enc):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(None, "no key"), (7, "twice"), (7, "twice"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).createOrReplaceTempView("d")
    out = str(tmp_path / "ids")
    idfile.write_ids(spark.table("d"), out, PATH)
    got = sorted(idfile.read_ids(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in got] == [True] + [False] * (len(rows) - 1)
    assert [r["doc_id"] for r in got[1:]] == sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [[*e.ids, 2] for e in enc.tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((-1 if k is None else k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, _), x in zip(rows, ids))
    idfile.write_ids(spark.table("d").limit(0), out + "0", PATH)
    assert idfile.read_ids(spark, out + "0").count() == 0
