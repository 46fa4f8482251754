"""Quality rules, URL rules, sharding, mixing, and the pipeline, each against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from firmlens.llm import mixing, quality, sharding, urlrules
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h i j k l", "a b c d e " * 6, "x\nx\n\nx \nx", "# * $ é ß\u00a0x\x1cy z " * 3, "same line here\n" * 20, "it " * 40, " ".join(str(i) for i in range(30000)) + " 1 2 3 4 5",
]


def test_stats(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate([*TEXTS, *("".join(rng.choice(["a ", "b ", "c\n", "# ", "é "]) for _ in range(rng.randint(1, 60))) for _ in range(200))])]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(df, []).collect()}
    assert got == {k: brute_stats(t) for k, t in rows}
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, []).collect()}
    for k, t in rows:
        n, _, _, _, c = brute_stats(t)
        assert kept[k] == (not (n < 10 or 100 * c > 20 * n))
    assert quality.judge(df.limit(0), []).count() == 0


def brute_features(t):
    n, chars, symbols, dup, repeat = brute_stats(t)
    w, one = WORD.findall(t), max(n, 1)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    count = lambda some: sum(c in some for c in t) / one
    return {"n_words": n, "mean_word": chars / one, "symbol_share": symbols / one, "dup_line_share": dup / max(lines, 1), "repeat_share": repeat / one, "digit_share": count("0123456789"), "distinct_share": len(set(w)) / one, "end_share": count(".!?")}


def test_clashing_names(spark):
    cols = "_t _words _lines _word_hash _windows _recurs _order _places _level0 _take _bucket _place _last _before _sum _n _in_slot _slot_base".split()
    df = spark.createDataFrame([(1, "a b c " * 5, "en", "src0", *cols)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in cols))
    for out in (quality.judge(df, []), mixing.mix(df, None), sharding.shard(df, 2)):
        row = out.first()
        assert [row[c] for c in cols] == cols


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        bad = k % 5 == 0
        out.append((k, " ".join(x + "###" if bad else x for x in w) + ".", 0 if bad else 1))
    return out


def test_learned_list(spark):
    train = spark.createDataFrame(labelled(300, 1), "doc_id long, text string, quality int")
    rules = quality.fit(train.drop("quality"), train.select("doc_id", "quality"))
    assert 1 <= len(rules) <= 12 and all(r.precision >= 0.9 for r in rules)
    test = labelled(200, 2)
    got = {r["doc_id"]: (r["kept"], r["rule"]) for r in quality.judge(spark.createDataFrame(test, "doc_id long, text string, quality int"), rules).collect()}
    assert sum(got[k][0] == bool(q) for k, _, q in test) / len(test) > 0.97  # held-out accuracy
    assert all(kept == (rule == 0) for kept, rule in got.values())
    # every verdict is that of the first rule that holds, on features computed by hand
    for k, t, _ in test:
        x = brute_features(t)
        assert got[k][1] == next((i for i, r in enumerate(rules, 1) if r.holds(x)), 0)
    # an id that several rows share teaches once
    twice = train.drop("quality").unionByName(train.drop("quality"))
    assert quality.fit(twice, train.select("doc_id", "quality")) == rules
    assert quality.fit(train.drop("quality"), train.select("doc_id", "quality").limit(0)) == []


def test_url_rules(spark):
    rng = random.Random(3)
    hosts = ["example.com", "a.example.com", "b.com", "net", "x.net", "example.net", "EXAMPLE.net", "q.org", "casino-win.example.com", "mycasino.org", ""]
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/77x', '/de/8', '/de/9', '/es/1', '/login', '/loginx', '/EN/7'])}{rng.choice(['', '?a=/en/', '#x://'])}") for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme/en/"), (1003, "://com/en/"), (1003, "://com/en/"), (None, "x://com")]
    want = []
    for k, u in rows:
        rest = u[u.index("://") + 3 :] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        hits = [r for r in (*urlrules.CONTRACT, *urlrules.PATTERNS) if re.search(r.pattern, host + path)]
        best = max(hits, key=lambda r: (r.listed, len(r.name), r.action, r.name), default=None)
        want.append((k, host, path, best.name if best and best.listed else None, best.action if best else "allow"))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/"} == {w[3] for w in want} - {None}
    assert urlrules.judge(df.limit(0)).count() == 0


def test_words_of_the_contract(spark, tmp_path):
    """The contract's list as it stands there, over the query and its SQL."""
    import duckdb
    from firmlens.llm import queries

    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.action for r in urlrules.CONTRACT} == words
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "http://x.net/de/casino", "http://EXAMPLE.net/de/7", "http://w.example.net/de/81", "http://org/es/", "http://net/de"]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(path)
    want = [(0, "com/en/", "block"), (1, "example.com/en/7", "allow"), (2, "net/de/", "allow"), (3, "net/de/", "allow"), (4, "example.net/de/8", "block"), (5, "org/es/", "block"), (6, None, "allow")]
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in queries.op9_url_rules(spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert con.sql(f"SELECT page_id, rule, verdict FROM ({queries.oracle_sql()['op9_url_rules']}) ORDER BY page_id").fetchall() == want


def test_tokens_are_derived_from_the_expression():
    need = urlrules.needed
    assert need(r"(^|[^a-z0-9])casino([^a-z0-9]|$)") == [["casino"]] * 4
    assert need(r"/(login|signin|signup)(/|$)") == [[x] for x in ("login", "login", "signin", "signin", "signup", "signup")]
    assert need(urlrules.host_rule("block", "example.com/en/7").pattern) == [["com", "en", "example"]] * 2
    # what may go on isn't whole; optional parts may be missing; classes that hold letters are no edges
    for pattern in (r"casino", r"[a-z]casino/", r"(?i)/casino/", r"/casino", r".casino.", r"/(?:casino)+x"):
        assert need(pattern) == [[]], pattern
    assert need(r"/casinos?") == [[], []] and need(r"/casinos?/") == [["casino"], ["casinos"]]
    assert need(r"/a+b/c/") == [["c"]] and need(r"[/.]ab[^a-z0-9]+cd\b") == [["ab", "cd"]] and need(r"/ab\d/cd/") == [["cd"]]


@pytest.mark.parametrize("broadcast", [20_000, 5])
def test_rules_from_a_table(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", broadcast)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAB1") for _ in range(rng.randint(1, 3)))
    urls = [(i, f"http://{word()}.{word()}.com/{word()}/{word()}-{word()}{rng.choice(['', '/', '?q=1', '/é' + word()])}") for i in range(300)]
    forms = [r"(^|[^a-z0-9]){0}([^a-z0-9]|$)", r"^([^/]*\.)?{0}\.com/", r"/{0}", r"/({0}|{1})(/|$)", r"\b{0}-{1}", r"[.]{0}[./]{1}?", r"{0}[0-9]*/{1}", r"^{0}$"]
    rules = sorted({(rng.choice(["allow", "block"]), f"r{i % 90}{'x' * (i % 5)}", rng.choice(forms).format(word(), word()), bool(i % 3)) for i in range(400)})
    rules = list({r[1]: r for r in rules}.values())
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (r["matched"], r["verdict"]) for r in urlrules.judge(df, spark.createDataFrame(rules, "action string, name string, pattern string, listed boolean")).collect()}
    for k, u in urls:
        rest = re.split(r"[?#]", u.split("://")[1])[0]
        host, path = rest[: rest.index("/")].lower(), rest[rest.index("/") :]
        best = max((r for r in rules if re.search(r[2], host + path)), key=lambda r: (r[3], len(r[1]), r[0], r[1]), default=None)
        assert got[k] == ((best[1], best[0]) if best else (None, "allow")), u
    assert urlrules.judge(df, spark.createDataFrame([], "action string, name string, pattern string, listed boolean")).filter("verdict = 'allow' AND matched IS NULL").count() == 300


def test_many_rules_are_found_by_their_tokens(spark):
    """100,000 rules: a list of hosts and one of words, of which a URL meets few."""
    rules = spark.range(100_000).select(F.lit("block").alias("action"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(r"^([^/]*\.)?h"), "id", F.lit(r"\.com/"))).otherwise(F.concat(F.lit("(^|[^a-z0-9])w"), "id", F.lit("([^a-z0-9]|$)"))).alias("pattern"), F.lit(False).alias("listed"))
    urls = [(0, "http://h10.com/w11"), (1, "http://www.h99998.com/x"), (2, "http://xh10.com/aw11/w11a"), (3, "http://a.org/h10.com/"), (4, "http://a.org/x-w99999"), (5, None)]
    got = {r["page_id"]: r["matched"] for r in urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {0: "n11", 1: "n99998", 2: None, 3: None, 4: "n99999", 5: None}


def test_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 500), "é" * rng.randint(0, 400), "x") for _ in range(1500)] + [(None, None, "y"), (7, "big " * 20000, "z"), (7, "t", "a"), (7, "t", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = str(tmp_path / "map")
    got = sharding.shard(df, 8, path, n_slots=256).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    # sizes, checksums and positions by hand: within a slot by id (null first), checksum and size, slots of a shard in order
    data = lambda r: (r["text"] or "").encode()
    assert all(r["size"] == len(data(r)) + 1 and r["text_crc32"] == zlib.crc32(data(r)) for r in got)
    for k in by:
        order = [(r["vslot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])]
        assert order == sorted(order)
    one = sharding.load_map(spark, path)
    assert one.version == 1 and all(one.shard_of[r["vslot"]] == r["shard"] for r in got)
    sizes = sharding.slot_sizes(sharding.with_sizes(df, n_slots=256))
    grown = sharding.rebalance(one, sizes, 9)
    sharding.save_map(spark, grown, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == one
    moved = [(a, b) for a, b in zip(one.shard_of, grown.shard_of) if a != b]
    assert moved and all(b == 8 for _, b in moved)
    # one id or null that many rows share lies in many slots
    hot = spark.createDataFrame([(None, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert sharding.with_sizes(hot, n_slots=256).select("vslot").distinct().count() > 100
    less = sharding.rebalance(one, sizes, 7)
    assert max(less.shard_of) == 6
    assert sharding.shard(df.limit(0), 8).count() == 0


def test_even_shards(spark):
    rows = [(i, "x" * (i * 37 % 300)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)


def tree_of(supplies, weights):
    root = mixing.Node("root")
    for d, leaves in supplies.items():
        n = mixing.Node(d, weights[d])
        n.children = [mixing.Node(k, 1.0, supply=s) for k, s in leaves.items()]
        root.children.append(n)
    return root


def test_budgets():
    root = tree_of({"a": {"x": 10, "y": 100}, "b": {"z": 20}, "c": {"w": 500}}, {"a": 0.5, "b": 0.3, "c": 0.2})
    assert mixing.allocate(root, 200) == 0
    got = {p[-1]: n.budget for p, n in root.leaves()}
    # b can't take its 60; a gets 5 parts and c 2 of the 180 that are left, but a takes 110 at most and c gets the rest
    assert got == {"x": 10, "y": 100, "z": 20, "w": 70}
    root.children[0].children[1].supply = 200
    mixing.allocate(root, 200)
    got = {p[-1]: n.budget for p, n in root.leaves()}
    # now a takes its part, and y what x lacks
    assert got["x"] == 10 and got["z"] == 20 and got["y"] == pytest.approx(180 * 5 / 7 - 10) and got["w"] == pytest.approx(180 * 2 / 7)
    root.children[0].children[1].supply = 100
    assert sum(got.values()) == pytest.approx(200)
    assert mixing.allocate(root, 10_000) == pytest.approx(10_000 - 630)


@pytest.mark.parametrize("bits", [12, 1])
def test_mix(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "BUCKET_BITS", bits)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "other", None]), "c") for i in range(600)]
    rows += [(1, rows[1][1], rows[1][2], rows[1][3], "c"), (None, None, "en", "src0", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string").repartition(4)
    for budget, epochs in ((None, 1), (None, 3), (2000.0, 2), (0.0, 1)):
        got = mixing.mix(df, budget, max_epochs=epochs).collect()
        leaf = defaultdict(list)
        for r in got:
            leaf[r["domain"], r["lang"], r["source"]].append(r)
        for rs in leaf.values():
            taken = sum(r["n_tokens"] for r in rs)
            last = max(r["epoch"] for r in rs)
            assert taken <= rs[0]["leaf_budget"] and last < epochs
            if rs[0]["leaf_budget"] and last >= 0:
                # a prefix: the next document would have passed the budget
                assert rs[0]["leaf_budget"] - taken <= 100
            full = [sum(r["n_tokens"] for r in rs if r["epoch"] == e) for e in range(last)]
            assert all(x == rs[0]["leaf_tokens"] for x in full)
        again = mixing.mix(df.repartition(7), budget, max_epochs=epochs).collect()
        assert sorted((str(r["doc_id"]), r["epoch"]) for r in got) == sorted((str(r["doc_id"]), r["epoch"]) for r in again)
        if budget == 2000.0:
            assert 1500 < sum(r["n_tokens"] for r in got) <= 2000
    assert mixing.mix(df.limit(0), None).count() == 0


def brute_budgets(leaves, budget, weight, epochs):
    """leaves: {path: tokens}. Water is poured into the tree until the budget is gone: parts by weight, what is full drops out."""
    def pour(prefix, amount):
        depth = len(prefix)
        under = lambda p: sum(n * epochs for k, n in leaves.items() if k[: len(p)] == p)
        if prefix in leaves:
            return {prefix: min(amount, under(prefix))}
        names = sorted({k[depth] for k in leaves if k[:depth] == prefix})
        got, open_, left = {}, set(names), min(amount, under(prefix))
        while open_ and left > 1e-9:
            total = sum(weight(depth, n) for n in open_)
            full = {n for n in open_ if left * weight(depth, n) / total >= under((*prefix, n)) - 1e-9}
            for n in full or open_:
                got[n] = under((*prefix, n)) if full else left * weight(depth, n) / total
            if not full:
                break
            left -= sum(got[n] for n in full)
            open_ -= full
        out = {}
        for n in names:
            out |= pour((*prefix, n), got.get(n, 0.0))
        return out

    return pour((), budget)


@pytest.mark.parametrize("on_driver", [True, False])
def test_mix_by_hand(spark, monkeypatch, on_driver):
    """Budgets of the whole tree and the prefix of every leaf, recomputed; the tree may be too large for the driver."""
    if not on_driver:
        monkeypatch.setattr(mixing, "MAX_LEAVES", 3)
    rng = random.Random(15)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["en", "en", "de", "fr"]), f"src{rng.choice([0, 0, 0, 0, 1, 2, 3, 5])}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for budget, epochs in ((3000.0, 1), (9000.0, 3), (None, 2)):
        docs = [(r["doc_id"], r["text"].count("w"), (("web", "books", "forum", "code")[int(r["source"][3:]) % 4], r["lang"], r["source"]), [r[f"h{e}"] for e in range(epochs)]) for r in df.select("*", *(F.xxhash64(F.lit(7), F.lit(e), "doc_id", F.xxhash64("text")).alias(f"h{e}") for e in range(epochs))).collect()]
        leaves = Counter()
        for _, n, path, _ in docs:
            leaves[path] += n
        if budget is None:
            domains = Counter()
            for p, n in leaves.items():
                domains[p[0]] += n * epochs
            total = sum(mixing.weights(0, k) for k in domains)
            budget = min(n * total / mixing.weights(0, k) for k, n in domains.items())
            args = {"budget": None}
        else:
            args = {"budget": budget}
        budgets = brute_budgets(dict(leaves), budget, mixing.weights, epochs)
        want = []
        for path, b in budgets.items():
            left = int(b + 1e-6)
            for e in range(epochs):
                take = min(left, leaves[path])
                if take <= 0 and not (e == 0 and leaves[path] == 0):
                    break
                left -= take
                at = 0
                for k, n, _, h in sorted((d for d in docs if d[2] == path), key=lambda d: (d[3][e], d[0])):
                    at += n
                    if take < leaves[path] and at > take:
                        break
                    want.append((k, e))
        mixed = mixing.mix(df, **args, max_epochs=epochs)
        assert sorted((r["doc_id"], r["epoch"]) for r in mixed.collect()) == sorted(want)
        got = mixing.shares(mixed).collect()
        tops = {r["domain"]: r for r in got if r["lang"] is None}
        assert sum(r["taken_share"] for r in tops.values()) == pytest.approx(1) and tops["web"]["target_share"] == pytest.approx(0.4)
        if args["budget"] is None:  # every domain can give its share, so each has it but for a document in each leaf and epoch
            assert all(abs(r["taken_share"] - r["target_share"]) < 0.1 for r in tops.values())


def test_budgets_of_any_number_of_leaves(spark):
    """Random trees: what Spark finds level by level is what the tree on the driver gives."""
    rng = random.Random(16)
    weight = lambda depth, name: {"a": 3.0, "b": 1.0, "z": 0.0}.get(name, 0.5)
    for _ in range(4):
        leaves = {(rng.choice("abz"), rng.choice("xyz"), f"s{rng.randint(0, 9)}"): rng.choice([0, 1, 7, 100, 5000]) for _ in range(40)}
        df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "d string, l string, s string, n long")
        for budget in (0.0, 500.0, 20_000.0, 1e9, None):
            root = mixing.tree([(p, float(n)) for p, n in leaves.items()], weight, 2)
            mixing.allocate(root, mixing.fitting_budget(root) if budget is None else budget)
            got = {(r["d"], r["l"], r["s"]): r["budget"] for r in mixing.budgets(df, ["d", "l", "s"], weight, 2, budget).collect()}
            assert got == pytest.approx({p: node.budget for p, node in root.leaves()}, abs=1e-3)
        for level in (2, 3):
            mixing.allocate(root, mixing.fitting_budget(root, level))
            got = {(r["d"], r["l"], r["s"]): r["budget"] for r in mixing.budgets(df, ["d", "l", "s"], weight, 2, None, level).collect()}
            assert got == pytest.approx({p: node.budget for p, node in root.leaves()}, abs=1e-3)


def test_languages_give_their_shares_where_asked(spark):
    rows = [(i, "w " * 10, lang, "src0") for i, lang in enumerate(["en"] * 100 + ["de"] * 12 + ["fr"] * 50 + ["es"] * 50)] + [(1000 + i, "w " * 10, "en", f"src{i % 3 + 1}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for level, most in ((1, 1.0), (2, 0.03)):
        off = [abs(r["taken_share"] - r["target_share"]) for r in mixing.shares(mixing.mix(df, None, level=level)).collect() if r["lang"] and r["source"] is None and r["domain"] == "web"]
        assert max(off) <= most and (level == 2 or max(off) > 0.05)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, name):
    """Empty tables, ties, repeated rows, nulls and clashing columns: a defined result in each stage."""
    stage, d = dict(corpus_pipeline.STAGES)[name], str(tmp_path)
    say = "some plain words of a text that is long enough to be kept by the base rule, number"
    rows = [(1, f"{say} one.", "en", "src0", 1), (1, f"{say} one.", "en", "src0", 1), (1, f"{say} two and more of it.", "de", "src1", 1), (None, f"{say} none at all here.", None, None, None), (2, None, "en", "src0", 0), (3, "", "en", "src2", 0)]
    names = "_key _hash _node _null _t kept rule vslot epoch domain".split()
    docs = spark.createDataFrame([(*r, *names) for r in rows], DOCS + ", " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert stage(spark, docs.limit(0), d).count() == 0
    out = stage(spark, docs, d)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    got = sorted(map(key, out.collect()))
    every = sorted((str(r[0]), str(r[1])) for r in rows)
    if name == "quality_rules":
        assert got == [k for k in every if len(k[1]) > 10]
    elif name == "near_duplicates":
        assert got == sorted({k for k in every if k != ("3", "")})  # equal rows are one; null and empty texts are one class, whose least id stays
    elif name == "decontamination":
        assert got == every
    elif name == "mixture":
        assert set(got) <= set(every)
    else:
        slots = sorted((r["shard"], r["slot"]) for r in out.collect())
        assert got == every and slots == [(k, i) for k in range(8) for i in range(sum(s == k for s, _ in slots))]
    extra = {"shards": {"vslot"}}.get(name, set())
    assert out.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(out.columns)
    row = out.first()
    assert all(row[c] == c for c in names if c not in extra)


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    item = say(30)
    rows = [(i, say(60) + ".", "en", f"src{i % 4}", 1) for i in range(200)]
    rows += [(300, rows[0][1], "en", "src0", 1), (301, rows[1][1] + " end", "en", "src1", 1), (302, say(40) + " " + item + " " + say(20), "de", "src2", 1), (303, "too short", "en", "src3", 1), (304, None, None, None, None)]
    rows += [(400 + i, " ".join(x + "###" for x in say(60).split()), "en", "src1", 1) for i in range(60)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 400), 0) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, d)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {r[0] for r in rows if r[0] < 303}
    near = corpus_pipeline.near_duplicates(spark, kept, d)
    assert near.columns == docs.columns and {r[0] for r in near.collect()} == {*range(200), 302}
    clean = corpus_pipeline.decontamination(spark, near, d)
    assert clean.columns == docs.columns and {r[0] for r in clean.collect()} == set(range(200))
    mixed = corpus_pipeline.mixture(spark, clean, d)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 200
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in mixed.collect()}
