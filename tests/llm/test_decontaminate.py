import random
import time
from collections import Counter

from firmlens.llm import decontaminate

ITEMS = [
    (1, "A train leaves Boston at 40 km per hour and reaches Denver after 12 hours so how far is Boston from Denver in km"),
    (2, "The quick brown fox that jumped over the lazy dog was never seen in this town again by anyone"),
    (3, "too short"),
    (4, None),
]


def test_matches(spark):
    docs = spark.createDataFrame(
        [
            (10, "Intro words come here. " + ITEMS[0][1] + " and more words follow it."),
            (11, "A train leaves Paris at 75 km per hour and reaches Lyon after 3 hours so how far is Paris from Lyon in km"),
            # the slots disagree: Paris is Rome later on
            (12, "A train leaves Paris at 75 km per hour and reaches Lyon after 3 hours so how far is Rome from Oslo in km"),
            (13, "the quick brown fox that jumped over the lazy dog was never noticed in this town again by anyone"),
            (14, "The quick brown fox that did other things over the lazy dog in a town"),
            (15, None),
            (16, ""),
            (17, "word " * 50000 + ITEMS[1][1]),
            (10, "Intro words come here. " + ITEMS[0][1] + " and more words follow it."),
            (None, ITEMS[1][1]),
        ],
        "doc_id long, text string",
    ).withColumn("item_id", __import__("pyspark").sql.functions.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["kind"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(0, 2, "verbatim"), (10, 1, "verbatim"), (10, 1, "verbatim"), (11, 1, "reparameterised"), (13, 2, "verbatim"), (17, 2, "verbatim")]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [12, 14, 15, 16]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 == decontaminate.matches(docs, bench.limit(0)).count()


def test_consistency():
    n = 7
    ok, same = decontaminate.consistent([(0, n, (1, 5)), (4, n, (1, 5)), (6, n, (1, 9)), (7, n, (2, 8))])
    assert ok == {0, 4, 7} and not same


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1])], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 1)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == want and len(want) == 2


def judge_by_hand(item, doc):
    """Windows as tuples, every diagonal in turn."""
    w, special = decontaminate.WINDOW, {int(x) for x in (decontaminate.NUM, decontaminate.NAME, decontaminate.UNIT)}
    t, h, _, begin = decontaminate.templates([item.encode(), doc.encode()])
    t, h, n = t.tolist(), h.tolist(), int(begin[1])
    it, ih, dt, dh = t[:n], h[:n], t[n:], h[n:]
    ok = lambda x: sum(v not in special for v in x) >= decontaminate.LITERALS
    hits = [(p, q) for p in range(len(dt) - w + 1) for q in range(n - w + 1) if dt[p : p + w] == it[q : q + w] and ok(it[q : q + w])]
    if not hits:
        return None
    many, first = Counter(p - q for p, q in hits), {}
    for p, q in hits:
        first.setdefault(p - q, p)
    at = {}
    for d in sorted(many, key=lambda d: (-many[d], first[d])):
        for p, q in hits:
            if p - q == d:
                for k in range(w):
                    at.setdefault(q + k, p + k)
    slots = [(q, it[q], (ih[q], dh[p])) for q, p in at.items() if it[q] in special]
    good, same = decontaminate.consistent(slots)
    covered = sum(q in good or it[q] not in special for q in at)
    if len(good) < decontaminate.AGREE * len(slots) or covered < decontaminate.COVERAGE * n or covered < min(decontaminate.MIN_TOKENS, n):
        return None
    return covered / n, "verbatim" if same else "reparameterised"


def variants(n, seed=5):
    """Items, and for each a text that holds it with other numbers, names and units, alike in all places, or (False) at odds with themselves."""
    rng = random.Random(seed)
    names, units = ["Boston", "Denver", "Paris", "Lyon", "Rome", "Oslo", "Anna", "Peter", "Maria", "Kenji"], ["km", "kg", "hours", "days", "euros", "miles"]
    words = "train leaves with when then shop sells carries how many does each after before price total find paid left walks red box field water round".split()
    items, docs = [], []
    for k in range(n):
        shape = [rng.choice(["w", "w", "w", "w", "n", "u", "N"]) for _ in range(rng.randint(18, 40))]
        text = [rng.choice(words) for _ in shape]
        slots = [rng.randrange(2) for _ in shape]
        fill = lambda a, b, u: " ".join(("what " if not i else "") + (str(a[s]) if c == "n" else f"{a[s]} {u[s]}" if c == "u" else b[s] if c == "N" else w) for i, (c, w, s) in enumerate(zip(shape, text, slots)))
        draw = lambda: (rng.sample(range(10, 10000), 2), rng.sample(names, 2), rng.sample(units, 2))
        items.append((k, fill(*draw())))
        docs.append((k, "Some words come before this. " + fill(*draw()) + ". and some after it"))
        odd = " ".join((str(rng.randint(10, 10000)) if c in "nu" else rng.choice(names) if c == "N" else rng.choice(words)) if rng.random() < 0.6 else w for c, w in zip(shape, text))
        docs.append((n + k, odd))
    return items, docs


def test_reparameterised_questions(spark):
    """Recall over 300 items with other parameters, and what is found in texts that only share words with an item."""
    items, docs = variants(300)
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    own = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
    assert len(own) >= 0.95 * 300 and all(r["doc_id"] == r["item_id"] for r in found)


def test_equals_brute_force(spark):
    items, docs = variants(12, 6)
    docs += [(100, items[0][1] + " " + items[1][1]), (101, " ".join([items[2][1]] * 3)), (102, items[3][1][: len(items[3][1]) * 2 // 3]), (103, None), (104, items[4][1][40:])]
    items += [(50, "a b c d e a b c d e a b c d e"), (51, None)]
    docs += [(105, "a b c d e " * 4), (106, "x a b c d e a b")]
    want = [(k, i, *got) for k, d in docs for i, x in items if (got := judge_by_hand(x or "", d or ""))]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["kind"]) for r in got) == sorted(want) and len(want) > 14


def test_a_long_repetitive_text_is_linear():
    items = decontaminate.Items(ITEMS)
    run = decontaminate._probe(type("B", (), {"value": items}), decontaminate.pa.int64(), decontaminate.pa.int64())
    batch = decontaminate.pa.RecordBatch.from_arrays([decontaminate.pa.array([1]), decontaminate.pa.array([(ITEMS[0][1] + " ").encode() * 90_000])], ["k", "t"])
    began = time.process_time()
    assert [b.num_rows for b in run([batch])] == [1]
    assert batch.nbytes > 10_000_000 and time.process_time() - began < 60


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], 5, 6, 7), (2, "fine", 8, 9, 10)], "doc_id long, text string, _hash int, _key int, __key int")
    assert [tuple(r) for r in decontaminate.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()] == [(2, "fine", 8, 9, 10)]
