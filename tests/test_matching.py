"""Matching, assignment, exploration and page rules against brute force and by hand."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from firmlens.functions import dims, text
from firmlens.operators import explore, jobs, match, pages
from firmlens.operators.contain import contained
from pyspark.sql import functions as F
from test_operators import brute_explore

LI = "https://www.linkedin.com/in/"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("blocks", [(50_000, 8_000_000), (3, 40)])
def test_contained(spark, blocks):
    rng = random.Random(1)
    word = lambda a, b: "".join(rng.choice("ab ") for _ in range(rng.randint(a, b)))
    needles = {(k, word(0, 4)) for k in ("x", "y", "z") for _ in range(30)} | {("only", "a")}
    texts = {(k, word(0, 20)) for k in ("x", "y", "w") for _ in range(40)} | {("z", "ab" * 200)}
    n = spark.createDataFrame([*needles, *needles, ("x", None)], "k string, needle string")
    t = spark.createDataFrame([*texts, ("y", None)], "k string, text string")
    want = sorted((k, a, b) for k, a in needles for j, b in texts if k == j and a in b)
    assert rows(contained(n, t, "k", *blocks), "k", "needle", "text") == want
    assert contained(n.limit(0), t, "k").count() == contained(n, t.limit(0), "k").count() == 0


def greedy(members, urls):
    """In member order, the best URL that is still free."""
    out, taken = [], set()
    letters = lambda s: "".join(c for c in s.lower() if "a" <= c <= "z")
    for page, mid, name in sorted(members):
        p = name.split()
        f, l = (letters(p[0]) if p else ""), (letters(p[-1]) if len(p) > 1 else "")
        best = None
        for upage, url, near, context, seq in urls:
            slug = url.split("/in/")[1]
            has = lambda s: f in s.lower() and l in s.lower()
            pattern = l and slug[1:2] == "-" and slug[0].isalpha() and l in slug and slug[0] == f[:1]
            rank = 1 if has(near) else 2 if has(context) else 3 if has(slug) else 4 if pattern else None
            if page == upage and f and rank and (page, url) not in taken and (best is None or (rank, seq) < best[0]):
                best = (rank, seq), url
        if best:
            taken.add((page, best[1]))
            out.append((page, mid, best[1], ("High", "Medium", "Medium", "Low")[best[0][0] - 1]))
    return sorted(out)


def test_assignment_is_the_greedy_order(spark):
    rng = random.Random(7)
    first, last = ["Ann", "Bo", "Anna", "Smith", "Li", "B."], ["Smith", "Ann", "Lee", "Li", ""]
    members, urls = [], []
    for page in range(60):
        names = [f"{rng.choice(first)} {rng.choice(last)}".strip() for _ in range(rng.randint(1, 12))] + (["Ann Smith"] * 9 + ["Smith Ann"] * 4 if page < 3 else [])
        rng.shuffle(names)
        members += [(page, 100 * page + i, n) for i, n in enumerate(names)]
        for k in range(rng.randint(0, 14)):
            a, b, c = (f"{rng.choice(first)} {rng.choice(last)}" for _ in range(3))
            slug = rng.choice([a.lower().replace(" ", "-").replace(".", ""), f"{a[0].lower()}-{b.split()[0].lower()}", f"x{k}"])
            urls.append((page, f"{LI}{slug}-{k}", b if k % 3 else "", c if k % 2 else "", k))
    m = spark.createDataFrame(members, "page_id long, member_id long, name string")
    u = spark.createDataFrame(urls, "page_id long, url string, near string, context string, seq long")
    assert rows(match.assign_profiles(m, u), "page_id", "member_id", "url", "confidence") == greedy(members, urls)
    assert match.assign_profiles(m, u.limit(0)).count() == 0


def test_members_of_one_name_are_served_in_one_round(spark, monkeypatch):
    members = [(1, i, "Ann Smith") for i in range(40)]
    urls = [(1, f"{LI}ann-smith-{k}", "", "", k) for k in range(30)]
    rounds = []
    cut = match.cut
    monkeypatch.setattr(match, "cut", lambda df, name: (rounds.append(name), cut(df, name))[1])
    got = match.assign_profiles(spark.createDataFrame(members, "page_id long, member_id long, name string"), spark.createDataFrame(urls, "page_id long, url string, near string, context string, seq long"))
    assert rows(got, "member_id", "url") == [(i, f"{LI}ann-smith-{i}") for i in range(30)]
    assert rounds.count("fixed") == 2  # one that serves all, one that finds nobody left


def test_matches_of_a_firm_with_a_third_of_all_members(spark):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 4)))
    members = [(1 if i % 3 == 0 else i % 17 + 2, i, f"{part().title()} {part().title()}" if i % 10 else part().title()) for i in range(400)]
    m = spark.createDataFrame(members, "firm_id long, member_id long, name string")
    employees = [(f, n.upper()[: rng.randint(2, 8)]) for f, _, n in members] + [(1, "")]
    e = spark.createDataFrame(employees, "firm_id long, employee string")
    want = sorted((f, i, y) for f, i, n in members for g, y in employees if f == g and (y.lower() in n.lower() or n.lower() in y.lower()))
    assert rows(match.external_employees(m, e), "firm_id", "member_id", "employee") == want
    a, b = m.alias("a"), m.alias("b")
    from firmlens.functions.names import names_match

    pairs = a.join(b, F.expr("a.firm_id = b.firm_id AND a.member_id < b.member_id")).filter(names_match(F.col("a.name"), F.col("b.name")))
    assert rows(match.name_variations(m), "firm_id", "a", "b") == sorted(map(tuple, pairs.select("a.firm_id", "a.member_id", "b.member_id").collect()))
    texts = [(f, 1000 + i, f"{rng.choice(['Led by', 'investment:', 'met'])} {n} and {rng.choice(members)[2]}") for f, i, n in members[::2]]
    t = spark.createDataFrame(texts, "firm_id long, company_id long, text string")
    want = sorted((f, i, c) for f, i, n in members for g, c, s in texts if f == g and n.lower() in s.lower() and ("led" in s.lower() or "investment" in s.lower()))
    assert rows(match.led_investments(m, t), "firm_id", "member_id", "company_id") == want
    emails = [(f, f"{rng.choice([n.split()[0], n.replace(' ', '.'), n.replace(' ', ''), n[0] + n.split()[-1]]).lower()}{rng.choice(['', 'x'])}@e.org", i) for f, i, n in members]

    def fits(local, name):
        p = name.lower().split()
        f, l = p[0], p[-1] if len(p) > 1 else ""
        return (f in local and l in local) or local in (f, f"{f}.{l}", f + l, f[0] + l)

    best = {}
    for f, i, n in members:
        hit = min(((s, x) for g, x, s in emails if f == g and fits(x.split("@")[0], n)), default=None)
        if hit:
            best[f, i] = hit[1]
    pm = m.withColumnRenamed("firm_id", "page_id")
    assert {(r["page_id"], r["member_id"]): r["email"] for r in match.email_of_member(pm, spark.createDataFrame(emails, "page_id long, email string, seq long")).collect()} == best


def test_a_page_that_is_found_again_with_a_better_order(spark):
    edges = {"r": [("late", 5), ("a", 2)], "a": [("late", 1), ("b", 2)], "late": [("c", 1)], "b": [("a", 1)]}
    data = [("f", u, v, p, i) for u, l in edges.items() for i, (v, p) in enumerate(l)]
    e = spark.createDataFrame(data, "firm string, from_url string, to_url string, priority int, seq long")
    got = [(r["url"], r["depth"]) for r in explore.explore(e, spark.createDataFrame([("f", "r")], "firm string, url string")).orderBy("visit").collect()]
    assert got == brute_explore(edges, "r", 3, 20) == [("r", 0), ("a", 1), ("late", 2), ("c", 3), ("b", 2)]


def test_firm_records_take_the_first_that_is_filled(spark):
    visited = spark.createDataFrame([("f", "u1", 1), ("f", "u2", 2), ("f", "u3", 3), ("g", "u9", 1)], "firm string, url string, visit int")
    facts = spark.createDataFrame([("u1", "", None, []), ("u2", "two", None, None), ("u3", "three", "hq", ["a", "b"])], "url string, d string, h string, l array<string>")
    got = {r["firm"]: tuple(r)[1:] for r in explore.firm_records(visited, facts, ["d", "h"], ["l"]).collect()}
    assert got == {"f": (3, "two", 2, "hq", 3, ["a", "b"], 3), "g": (1, None, None, None, None, None, None)}


def links_of(page, *items):
    return [(page, u, n, i) for i, (n, u) in enumerate(items)]


def test_listings_carry_their_prefix(spark):
    d = "https://d.example"
    one = links_of(f"{d}/l?page=1", *((f"Firm {i}", f"{d}/firms/{i}") for i in range(3)), ("About", f"{d}/about"), ("x", f"{d}/firms/short"), ("n" * 151, f"{d}/firms/long"), ("Chat", "https://x.com/firms/a"))
    two = links_of(f"{d}/l?page=2", *((f"News {i}", f"{d}/news/{i}") for i in range(9)), ("Firm 2", f"{d}/Firms/2/"), ("Firm 7", f"{d}/firms/7"), ("Firm 8", f"{d}/firms/8."), ("Else", "https://other.example/firms/9"))
    three = links_of(f"{d}/l?page=3", ("Firm 7 again", f"{d}/firms/7/"), ("Last", f"{d}/firms/last"))
    never = links_of(f"{d}/l?page=4", *((f"Firm {i}", f"{d}/firms/{i}") for i in range(20, 30)))
    links = spark.createDataFrame(one + two + three + never, "url string, link string, txt string, seq long")
    nxt = spark.createDataFrame([(f"{d}/l?page={i}", f"{d}/l?page={i + 1}") for i in (1, 2, 3)], "url string, next_url string")
    got = rows(explore.listing(links, nxt, spark.createDataFrame([(f"{d}/l?page=1",)], "start string")), "place", "name", "url")
    assert got == [(1, f"Firm {i}", f"{d}/firms/{i}") for i in range(3)] + [(2, "Else", "https://other.example/firms/9"), (2, "Firm 7", f"{d}/firms/7"), (2, "Firm 8", f"{d}/firms/8"), (3, "Last", f"{d}/firms/last")]
    # of prefixes that are equally common the first seen
    tie = spark.createDataFrame(links_of(f"{d}/t", *((f"{k} {i}", f"{d}/{k}/{i}") for i in range(3) for k in ("zz", "aa"))), "url string, link string, txt string, seq long").withColumn("page_id", F.lit(1))
    assert {r["name"][:2] for r in pages.directory_entries(tie).collect()} == {"zz"}


def test_bios_are_whole_containers(spark):
    html = f"""<section><h2>Team of Ann Smith and others</h2><p>{'long ' * 900}end</p></section><div><span class="big name">BO LEE</span> runs</div><h3>Cy Young</h3><article><h4>Ann Smith</h4>second</article>"""
    p = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    people = spark.createDataFrame([(1, "Ann Smith"), (1, "Bo Lee"), (1, "Cy Young"), (1, "Nobody"), (1, ""), (2, "Ann Smith")], "page_id long, name string")
    got = {r["name"]: r["bio"] for r in pages.bio_section(p, people).collect()}
    assert set(got) == {"Ann Smith", "Bo Lee"}  # a heading without a container tells nothing
    assert got["Ann Smith"].startswith("Team of Ann Smith") and got["Ann Smith"].endswith("long end") and len(got["Ann Smith"]) > 4500
    assert got["Bo Lee"] == "BO LEE runs"


def test_short_texts_are_one_chunk(spark):
    texts = ["", "short", "x" * 15000, "y" * 15001, "z" * 14500 + " " * 450 + "z" * 99, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [(r["i"], r["s"], r["n"]) for r in df.select("i", F.explode(text.chunks(F.col("t"))).alias("c")).select("i", F.col("c.start_at").alias("s"), F.length("c.chunk").alias("n")).orderBy("i", "s").collect()]
    # the second chunk of the fifth text has 99 characters between its spaces
    assert got == [(0, 0, 0), (1, 0, 5), (2, 0, 15000), (3, 0, 15000), (3, 14500, 501), (4, 0, 15000)]


def test_sections_are_cleaned_after_fifteen(spark):
    given = [(f"Key {i}", f"L{i}", "d") for i in range(20)]
    given[0], given[1], given[2] = ("", "L", "d"), ("k", None, None), ("k", "", "d")
    df = spark.createDataFrame([(given,)], "s array<struct<key string, label string, desc string>>")
    got = df.select(text.sections(F.col("s")).alias("s")).first()["s"]
    assert [tuple(x) for x in got][:2] == [("k", "Section", ""), ("key_3", "L3", "d")] and len(got) == 13


def test_combined_pages(spark):
    c = spark.createDataFrame([("s", f"u{i}", i) for i in range(1, 6)] + [("none", "v", 1)], "site string, url string, place int")
    p = spark.createDataFrame([("u2", "two"), ("u3", "three"), ("u5", "five"), ("v", "")], "url string, content string")
    got = {r["site"]: tuple(r)[1:] for r in explore.combined(c, p, F.length("content") > 0, 2).collect()}
    assert got == {"s": ("two\n\n---\n\nthree", ["u2", "u3"], 3), "none": ("", [], 1)}


def test_rows_of_large_jobs_are_numbered_by_ranges(spark):
    df = spark.range(900).select((F.col("id") % 7 * (F.col("id") % 3)).alias("job_id"), F.col("id").alias("log_id"), F.timestamp_seconds(F.col("id") * 37 % 500).alias("created_at"))
    want = rows(jobs.eta(df), "job_id", "log_id", "i", "eta_s")
    for large in (0, 60):
        assert rows(jobs.eta(df, large), "job_id", "log_id", "i", "eta_s") == want
    assert sorted(r[2] for r in want if r[0] == 0) == list(range(1, sum(r[0] == 0 for r in want) + 1))


#: Names with nicknames, one first letter in several spellings, middle names, rows that share a key, and no key.
SPELLED = [(1, "Robert Q Smith"), (1, "Robert Q Smith"), (1, "Bob R Smith"), (None, "Ann Lee"), (None, "ann  lee"), (2, "  "), (3, None), (4, "Bob"), (5, "Kate A A B Maria"), (6, "x " * 120 + "y")]


def test_profile_candidates_are_the_first_of_each_slug(spark):
    nick = defaultdict(list)
    for r in dims.nicknames(spark).collect():
        nick[r["name"]].append(r)
    want = {}
    for k, full in SPELLED:
        w = (full or "").lower().split()
        if not w:
            continue
        first, last, mids = w[0], w[-1], w[1:-1]
        least = min((r["ord"] for r in nick[first]), default=None)
        for f, v in [(first, 0), *((r["variant"], r["at"] + 1) for r in nick[first] if r["ord"] == least)]:
            made = [(f"{f}-{last}", "Medium" if v else "High", "first-last"), (f + last, "Medium", "firstlast"), (f"{f}.{last}", "Low", "first.last"), (f"{f[0]}-{last}", "Low", "f-last")]
            made += [(f"{f}-{m}-{last}", "Medium", t) for x in mids for m, t in ((x, "first-middle-last"), (x[0], "first-m-last"))]
            made += [(f"{f}-{last}-{i}", "Low", f"first-last-{i}") for i in (1, 2, 3)]
            for at, (slug, c, m) in enumerate(made):
                row = (v * 100 + at, c, m)
                want[k, slug] = min(want.get((k, slug), row), row)
    df = match.profile_candidates(spark.createDataFrame(SPELLED, "member_id long, name string"), dims.nicknames(spark))
    got = sorted(((r["member_id"], r["url"].removeprefix("https://www.linkedin.com/in/"), r["seq"], r["confidence"], r["method"]) for r in df.collect()), key=str)
    assert got == sorted(((*k, *v) for k, v in want.items()), key=str)


def test_profile_candidates_shuffle_names_only(spark):
    """Slugs are many times the names: they aren't exchanged, and compared between rows only for keys that several rows have."""
    df = match.profile_candidates(spark.createDataFrame(SPELLED, "member_id long, name string"), dims.nicknames(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*slug", plan)
    assert all("> 1)" in part for part in plan.split("Window [row_number()")[1:])


def test_page_rows_leave_in_blocks(monkeypatch):
    """A batch of many pages with many rows each is handed on while it is read, not once all of it is."""
    monkeypatch.setattr(pages, "JOB_ROWS", 100)
    walked = []

    def walk(html, url):
        walked.append(html)
        yield from ((f"{url}{i}", None) for i in range(30))

    batch = pa.RecordBatch.from_arrays([pa.array([*range(49), None]), pa.array(["u"] * 50), pa.array(["h"] * 49 + [None])], ["page_id", "url", "html"])
    out = pages.page_rows(walk, ["a", "b"])(iter([batch, batch.slice(0, 0), batch]))
    first = next(out)
    assert first.num_rows == 100 and len(walked) == 4
    rest = list(out)
    assert len(walked) == 100 and max(b.num_rows for b in rest) == 100
    got = [tuple(r.values()) for b in [first, *rest] for r in b.to_pylist()]
    assert got == [(k, i, f"u{i}", None) for k in [*range(49), None] * 2 for i in range(30)]
    assert list(pages.page_rows(walk, ["a", "b"])(iter([]))) == []


def test_exploration_broadcasts_bounded_tables(spark, monkeypatch):
    """Beyond the bound the tables of an exploration aren't sent to the driver; the visits are the same."""
    monkeypatch.setattr(explore, "BROADCAST_ROWS", 1)
    edges = spark.createDataFrame([(f, a, b, 1, i) for f in "xy" for i, (a, b) in enumerate([("1", "2"), ("1", "3"), ("3", "1")])], "firm string, from_url string, to_url string, priority int, seq long")
    hints = []
    monkeypatch.setattr(type(edges), "hint", lambda self, name, hint=type(edges).hint: hints.append(name) or hint(self, name))
    got = explore.explore(edges, spark.createDataFrame([("x", "1"), ("y", "1")], "firm string, url string"))
    assert rows(got, "firm", "url", "depth", "visit") == [(f, u, d, v) for f in "xy" for u, d, v in (("1", 0, 1), ("2", 1, 2), ("3", 1, 3))]
    assert hints and set(hints) == {"shuffle_hash"}
