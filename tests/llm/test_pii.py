import hashlib
import random
import re
from collections import Counter

import numpy as np
from firmlens.llm import bilstmcrf, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = "".join(c for c in m[0] if c in "0123456789")
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), k))
    return [(a, b, list(PATTERNS)[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def test_base_patterns():
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "@@", ".", "1", "4539578763621486", "+", "+1 (301) 555-0346", "127.0.0.1", "999.1.1.1", " ", "-", "(", ")", "%", "é", "1.2.3.4.5.6.7.8", "x@y.de", "x@y.de.", "\n", "00000001.2.3.4", "1-2", "5 "]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("9" * 100000 + " a" * 10 + "b" * 100000) == []


def test_gradient():
    m = bilstmcrf.new_model(("a",), hidden=3, emb=4)
    rng = np.random.default_rng(0)
    e, tags = rng.standard_normal((6, 2, 3)).astype(np.float32), np.array([[0, 1, 2, 2, 0, 0], [1, 2, 0, 0, 1, 2]]).T
    trans = m.transitions()
    loss, de, _ = bilstmcrf.crf_loss(e, tags, trans)
    e2 = e.copy()
    e2[2, 1, 0] += 0.01
    assert abs((bilstmcrf.crf_loss(e2, tags, trans)[0] - loss) / 0.01 - de[2, 1, 0]) < 1e-2


def test_held_out_spans():
    """Recall of each kind over spans that the base patterns miss, and the share of added spans that lie on labelled ones."""
    rng = random.Random(99)
    rows = [pii.sample(rng, 300, 0.2) for _ in range(300)]
    have, hit, added, right = Counter(), Counter(), Counter(), Counter()
    for (t, want), (own, every) in zip(rows, pii.all_spans(pii.default_model(), [t for t, _ in rows])):
        for a, b, k in want:
            if not any(x < b and y > a for x, y, _ in own):
                have[k] += 1
                hit[k] += (a, b, k) in every
        for s in set(every) - set(own):
            added[s[2]] += 1
            right[s[2]] += any(a < s[1] and b > s[0] for a, b, _ in want)
    assert set(have) == set(pii.KINDS)
    for k in pii.KINDS:
        assert have[k] > 100 and hit[k] / have[k] >= 0.9 and right[k] / added[k] >= 0.9, (k, hit[k], have[k], right[k], added[k])


def test_spans_of_any_length():
    find = lambda t: [(k, t[a:b]) for a, b, k in pii.all_spans(pii.default_model(), [t])[0][1]]
    say = "the thing and the than of on "
    long = "anonstrachment" * 9
    assert find(f"{say}{long}(at)thanla(dot)org {say}") == [("email", f"{long}(at)thanla(dot)org")]
    assert find(say + "4465758382889437 4465758382889437 " + say) == [("card", "4465758382889437")] * 2
    # one region of many thousand characters, with spans all over it
    many = "".join(f"{say}({300 + i}) 555-0{100 + i} " for i in range(300))
    assert find("0123456789" * 20_000) == find("aB3" * 20_000)[1:] == []
    assert find(many) == [("phone", f"({300 + i}) 555-0{100 + i}") for i in range(300)]


def test_regions_hold_whole_words():
    t = "é " * 50 + "x" * 5000 + "7" + "y" * 5000 + " a" * 50 + "\n\n9"
    got = pii.regions(t)
    assert [t[a:b].count("é") for a, b in got] == [pii.WORDS_AROUND, 0] and got[1][1] == len(t)
    assert pii.regions("nothing here") == [] and pii.regions("7") == [(0, 1)]


def test_resolve():
    t = "call 4465758382889437 4465758382889437 now (301) 555-0346."
    assert [t[a:b] for a, b in pii.resolve("card", t, *pii.grow("card", t, 7, 10))] == ["4465758382889437"] * 2
    assert [t[a:b] for a, b in pii.resolve("phone", t, 39, len(t))] == ["(301) 555-0346"]
    assert pii.resolve("ip", t, 0, len(t)) == [] and pii.grow("phone", t, 45, 47) == (43, 48)


def test_emissions_do_not_depend_on_what_else_is_laid_out():
    m = pii.default_model()
    words = ["call (301) 555-0346 " * 9, "nothing 7", "mail a (at) b (dot) org " * 20]
    together = pii.decode(m, words, [pii.regions(w) for w in words])
    assert together == [pii.decode(m, [w], [pii.regions(w)])[0] for w in words]


def test_find(spark):
    rows = [(1, "mail thon.34@mail7.example.com now"), (2, None), (3, ""), (4, "nothing here"), (5, "call (301) 555-0346 today, ok"), (6, "word " * 3000 + "4539578763621486 " + "end " * 3000), (1, "mail thon.34@mail7.example.com now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_email"], r["n_card"], r["spans"], r["base_sha256"]) for r in pii.find(df).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == got[1] == (1, 1, 0, "email:5:30", sha("email:5:30"))
    assert [g[3] for g in got[2:5]] == ["", "", ""]
    assert got[5][4] == sha("") and got[5][3] == "phone:5:19"
    assert got[6][3] == "card:15000:15016"
    assert pii.find(df.limit(0)).count() == 0
