import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    return bpe.ForcedEncoder(PATH)


def texts():
    rng = random.Random(5)
    bits = ["the", "thereof", " ", "  ", "\n", " \n", "\n \n", "\t", "\xa0", "　", "1", "2024", "don't", "'s", "é", "ñ", "ß", "…", "!!", "<|endoftext|>", "中文", "あ", "՘", "😀", "\x1c", "\x85", "\r\n", "<|", "x" * 50, "qzjxk", "\x00", "ТЕСТ", "한국", "שלום", "zzqqvv", "​", "é"]
    any_char = ["".join(chr(rng.choice([rng.randrange(32, 0x2500), rng.randrange(0x2500, 0xD800), rng.randrange(0x10000, 0x1F9FF)])) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    return ["", " ", "\n", "a  b", "a \n b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(3000)), *any_char, "a" * 5000, " ".join(["word"] * 3000)]


def test_ids_and_texts_equal_the_library(enc):
    some = texts()
    want = [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]
    for _ in range(2):  # the second time everything is known
        ids, bounds, cuts = enc.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert cuts.sum() > 0
    assert [t.decode() for t in enc.decode(ids, bounds)] == [enc.tok.decode(x, skip_special_tokens=False) for x in want] == some
    part = pa.array(some, pa.string()).slice(50, 70)
    ids, bounds, _ = enc.encode(part)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want[50:120]


def test_any_ids_decode_as_the_library(enc):
    rng = np.random.default_rng(4)
    runs = [rng.integers(0, 50257, rng.integers(0, 30)) for _ in range(500)]
    got = enc.decode(np.concatenate(runs), np.append(0, np.cumsum([len(r) for r in runs])))
    assert [t.decode() for t in got] == [enc.tok.decode(r.tolist(), skip_special_tokens=False) for r in runs]


def test_forced_pairs_stand_inside_no_token(enc):
    for raw in bpe.token_bytes(enc.tok)[:-1]:
        assert all(enc.inside[256 * a + b] for a, b in zip(raw, raw[1:]))
    assert not enc.inside[256 * ord("x") + ord(" ")] and enc.inside[256 * ord("t") + ord("h")]
    # letters only: the splitter cuts nothing here, byte pairs do
    assert enc.encode(pa.array(["zqjxqkvq" * 20]))[2][0] > 0


def test_pieces_and_forgetting_do_not_change_the_ids(enc, monkeypatch):
    t = " ".join(texts())
    want = enc.tok.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PIECE_BYTES", 400)
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    monkeypatch.setattr(bpe, "LONG", 2)
    ids, bounds, _ = enc.encode(pa.array(["x", t, ""]))
    assert ids[bounds[1] : bounds[2]].tolist() == want and bounds[3] == bounds[2]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.ForcedEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark, enc):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = [(1, "the cat"), (2, None), (2, ""), (None, "zqjxq <|endoftext|>"), (1, "the cat"), (9, "é中 " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "ids": F.lit("x"), "n_tokens": F.lit(2)})
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    want = []
    for k, t in rows:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids
        text = enc.tok.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())))
    assert [r[:4] for r in got] == sorted(want, key=str)
    coded = bpe.encode(docs, PATH)
    assert sorted((r["doc_id"], r["text"]) for r in bpe.decode(coded, PATH).filter("doc_id is not null").collect()) == sorted((k, t or "") for k, t in rows if k)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0 and bpe.encode(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, enc):
    from firmlens.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_forced_boundary_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.tok.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(enc.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
