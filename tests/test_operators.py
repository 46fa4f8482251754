import datetime as dt

import pytest
from firmlens.functions import dates, names, text, tiers, urls
from firmlens.operators import dedupe, explore, jobs, match, pages
from firmlens.plans import records
from firmlens.sources import export, firm_list, store
from pyspark.sql import functions as F


def one(spark, value, f, *args):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"), *args)).first()[0]


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("General Partner, ABC Capital", "Tier 1"), ("CEO", "Tier 1"), ("MD", "Tier 1"), ("Principal", "Tier 2"), ("Sr. Associate", "Tier 2"), ("Head of Investor Relations", "Tier 2"),
        ("Investment Manager", "Tier 2"), ("Analyst", "Tier 3"), ("Data Analyst", "Tier 3"), ("Portfolio Manager", "Exclude"), ("Venture Partner", "Exclude"), ("Limited Partner, Investments", "Tier 1"),
        ("Growth Marketing Manager", "Tier 1"), ("Marketing Manager", "Exclude"), ("", "Tier 3"), (None, "Tier 3"), ("Venture Scout", "Tier 3"), ("Software Engineer", "Exclude"), ("Associé", "Exclude"),
    ],
)
def test_tiers(spark, title, want):
    assert one(spark, title, tiers.tier) == want


def test_recency(spark):
    d = F.lit("2024-07-01").cast("date")
    got = [(one(spark, x, dates.recency_score, d), one(spark, x, dates.recency_category, d)) for x in ("2024-07-01", "2024-01-03", "2023", "Unknown", "2010-01", "")]
    assert got == [(100, "Very Recent"), (80, "Very Recent"), (44, "Moderate"), (0, "Old"), (0, "Old"), (0, "Old")]
    assert spark.range(1).select(dates.months_before(F.lit("2001-08-31").cast("date"), 6)).first()[0] == dt.date(2001, 3, 3)


def test_names(spark):
    assert one(spark, "  José   Ramírez-O'Neil. ", names.person_key) == "jose ramirez-o'neil"
    assert one(spark, "José Ramos", names.spaced_key) == "jos ramos"
    assert one(spark, "Smith Ann", names.same_person_key) == one(spark, "ann  SMITH", names.same_person_key)


def test_urls(spark):
    assert one(spark, "firm.example/", urls.with_scheme) == "https://firm.example"
    assert one(spark, "https://A.example/X/?q=1#t", urls.origin_path_lower) == "https://a.example/x"
    assert one(spark, "not a url", urls.host) is None and one(spark, "not a url", urls.skip) is True
    base = F.lit("https://a.example/b/c?d")
    assert [one(spark, x, urls.absolute, base) for x in ("/t", "t", "//x.org/y", "http://z.org")] == ["https://a.example/t", "https://a.example/b/t", "https://x.org/y", "http://z.org"]
    assert one(spark, "https://www.linkedin.com/in/x", urls.skip) and not one(spark, "https://acme.com/", urls.skip)


def test_text(spark):
    merge = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.merge_text(F.col("a"), F.col("b"))).first()[0]
    assert [merge(None, "x"), merge("x y", "X"), merge("x", "x y"), merge("a; b", "b; c"), merge("", None)] == ["x", "x y", "x y", "a; b; c", ""]
    assert one(spark, 'a"b,c', text.csv_field) == '"a""b,c"'
    assert one(spark, "info@x.com", text.generic_mailbox) and not one(spark, "information@x.com", text.generic_mailbox)
    assert one(spark, "# A title \nmore", text.title) == "A title"
    assert one(spark, "Request failed with status code 404", text.error_class) == "http_error"


@pytest.mark.parametrize("header", ["Company Name,Company Website URL,LinkedIn Description", "name,website,description", "Firm Name,URL,About", "company,corporate website,description"])
def test_firm_list(spark, tmp_path, header):
    (tmp_path / "f.csv").write_text(f"{header}\n Acme , https://acme.com ,Text\n\n,https://b.org\nNo site,,x\nMail,a@b.com,y\n")
    df = firm_list.standardise(firm_list.read_csv(spark, str(tmp_path / "f.csv")))
    assert sorted(map(tuple, firm_list.accepted(df).collect())) == [("Acme", "https://acme.com", "Text"), ("https://b.org", "https://b.org", "")]
    assert sorted(r["reject_reason"] for r in firm_list.rejected(df).collect()) == ["e-mail in the URL column", "no URL"]


def test_firm_list_errors(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Wrong Column 1,Wrong Column 2\na,b\n")
    with pytest.raises(ValueError, match="Your file has columns: Wrong Column 1, Wrong Column 2"):
        firm_list.detect(firm_list.read_csv(spark, str(tmp_path / "f.csv")))
    with pytest.raises(ValueError, match="more than 3"):
        firm_list.check_count(spark.range(5), 3)
    (tmp_path / "u.txt").write_text(" https://a.org \nnothing\nhttp://b.org\n")
    assert firm_list.read_urls(spark, str(tmp_path / "u.txt")).count() == 2
    columns, shown = firm_list.preview(spark.createDataFrame([("x" * 200, 1)], "t string, n int"))
    assert columns == ["t", "n"] and shown.first()[0] == "x" * 150 + "…"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", float("nan")), (2, None, 1.5)], "id int, s string, v double")
    export.write_tables({"t": export.clean(df)}, str(tmp_path / "x"), "csv")
    assert sorted((r["id"], r["s"], r["v"]) for r in spark.read.csv(str(tmp_path / "x/t"), header=True).fillna("").collect()) == [("1", "a,b", ""), ("2", "", "1.5")]
    assert [tuple(r) for r in export.with_placeholder(df.limit(0), "No rows").collect()] == [("No rows", "", "")]
    assert export.with_placeholder(df, "No rows").count() == 2
    export.write_sectioned({"A": (df, "id")}, str(tmp_path / "y"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "y")).collect()][:3] == ["=== A ===", "id,s,v", '1,"a,b",NaN']
    for _ in range(2):
        store.insert_absent(df.select("id", "s"), str(tmp_path / "z"), ["id"], "s")
    assert spark.read.parquet(str(tmp_path / "z")).count() == 2
    firms = spark.createDataFrame([(i, f"f{i}") for i in range(9)], "firm_id long, company_name string")
    members = spark.createDataFrame([(1, 3, "n", "t")], "member_id long, firm_id long, name string, title string")
    a, b = (export.sample(firms, members).orderBy("firm_id").collect() for _ in range(2))
    assert a == b and len(a) == 5


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("b", 3, None), ("a", 4, "z")], "k string, seq long, v string")
    once = dedupe.first_wins(df, "k", "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, dedupe.first_wins(once, "k", "seq").collect())) == [("a", 1, "x"), ("b", 3, None)]
    assert [tuple(r) for r in dedupe.last_value_wins(df, "k", "seq").orderBy("first_seq").collect()] == [("a", 4, "z", 1), ("b", 3, None, 3)]
    m = dedupe.merge_records(df.withColumn("l", F.array(F.col("v"), F.lit(" t "))), "k", "seq", ["v"], ("l",)).orderBy("k").collect()
    assert (m[0]["v"], m[0]["l"], m[1]["v"]) == ("x", ["x", "t", "z"], None)


def test_greedy_assignment(spark):
    members = spark.createDataFrame([(1, 1, "Ann Smith"), (1, 2, "Ann Smith"), (1, 3, "Bo Lee"), (1, 4, "Cy")], "page_id long, member_id long, name string")
    links = spark.createDataFrame(
        [(1, "https://l/in/ann-smith", "Ann Smith", "", 1), (1, "https://l/in/ann-smith-2", "", "with Ann Smith", 2), (1, "https://l/in/b-lee", "", "", 3)],
        "page_id long, url string, near string, context string, seq long",
    )
    got = sorted((r["member_id"], r["url"][-5:], r["confidence"]) for r in match.assign_profiles(members, links).collect())
    assert got == [(1, "smith", "High"), (2, "ith-2", "Medium"), (3, "b-lee", "Low")]


HTML = """<html><head><meta property="og:url" content="https://www.linkedin.com/in/meta-one"></head><body>
<div class="member"><h3>Ann Smith</h3><a href="https://www.linkedin.com/in/ann-smith?x=1">in</a></div><div class="member"><h3>Bo Lee</h3><span data-linkedin="https://linkedin.com/in/bo-lee">Bo</span></div>
<script type="application/ld+json">{"@type":"Person","name":"Cy Young","sameAs":["https://www.linkedin.com/in/cy-young"]}</script>
<a href="/team/ann-smith">Ann Smith</a><a href="/careers/x">Jobs</a><a class="card" href="/who/bo">Bo Lee</a><a href="#top">x</a><button class="tab" data-url="/team?region=eu">Europe</button>
<a href="https://acme.io/"><img src="/i/acme-logo.png" alt=""></a><a href="https://twitter.com/x">tw</a><img src="/i/beta_corp.svg"><table><tr><td>Acme portfolio</td><td>1</td></tr><tr><td>Beta</td></tr></table><p>nothing <b>unclosed"""


def test_page_jobs(spark):
    df = spark.createDataFrame([(1, "https://firm.example/team", HTML), (2, "https://firm.example/none", ""), (3, None, None)], "page_id long, url string, html string")
    rows = lambda x, *c: sorted(tuple(r[k] for k in c) for r in x.collect())
    assert rows(pages.profile_links(df), "link", "source") == [("https://linkedin.com/in/bo-lee", "data"), ("https://www.linkedin.com/in/ann-smith", "anchor"), ("https://www.linkedin.com/in/cy-young", "jsonld"), ("https://www.linkedin.com/in/meta-one", "meta")]
    assert rows(pages.profile_pages(df), "link", "name") == [("https://firm.example/team/ann-smith", "Ann Smith"), ("https://firm.example/who/bo", "Bo Lee")]
    assert rows(pages.portfolio_candidates(df), "name") == [("acme",), ("beta corp",)]
    assert rows(pages.company_cells(df), "name") == [("Acme portfolio",), ("Beta",)]
    assert rows(pages.tab_links(df), "link", "label") == [("https://firm.example/team?region=eu", "Europe")]


def test_directory_entries(spark):
    rows = [(1, "https://d.example/list", f"https://d.example/profile/c{i}", f"Company {i}", i) for i in range(4)] + [(1, "https://d.example/list", "https://d.example/about", "About", 9)]
    rows += [(2, "https://e.example/list", f"https://c{i}.org/", f"Company {i}", i) for i in range(3)] + [(2, "https://e.example/list", "https://x.com/e", "Follow", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, link string, txt string, seq long")
    assert sorted((r["page_id"], r["name"]) for r in pages.directory_entries(df).collect()) == [(1, f"Company {i}") for i in range(4)] + [(2, f"Company {i}") for i in range(3)]


def brute_explore(edges, root, depth, cap):
    todo, seen, out, n = [(0, 0, 0, root)], set(), [], 0
    while todo and len(out) < cap:
        todo.sort()
        p, d, _, u = todo.pop(0)
        if u in seen:
            continue
        seen.add(u)
        out.append((u, d))
        if d < depth:
            for v, q in edges.get(u, []):
                n += 1
                todo.append((q, d + 1, n, v))
    return out


def test_explore(spark):
    edges = {"r": [("a", 2), ("b", 1), ("c", 3)], "b": [("r", 1), ("d", 1)], "d": [("e", 1)], "e": [("f", 1)], "f": [("g", 1)], "a": [("d", 5), ("h", 4)], **{f"n{i}": [(f"n{i + 1}", 1)] for i in range(30)}}
    rows = [(x, u, v, p, i) for x in ("one", "two") for u, l in edges.items() for i, (v, p) in enumerate(l)]
    df = spark.createDataFrame(rows, "firm string, from_url string, to_url string, priority int, seq long")
    roots = spark.createDataFrame([("one", "r"), ("two", "n0")], "firm string, url string")
    for depth, cap in ((3, 6), (9, 4)):
        got = {x: [] for x in ("one", "two")}
        for r in explore.explore(df, roots, depth, cap).orderBy("visit").collect():
            got[r["firm"]].append((r["url"], r["depth"]))
        assert got == {"one": brute_explore(edges, "r", depth, cap), "two": brute_explore(edges, "n0", depth, cap)}


def test_follow_and_expand(spark):
    p = spark.createDataFrame([("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", None)], "url string, next_url string")
    s = spark.createDataFrame([("a1",), ("b1",)], "start string")
    assert sorted((r["start"], r["url"], r["place"]) for r in explore.follow(p, s).collect()) == [("a1", "a1", 1), ("a1", "a2", 2), ("a1", "a3", 3), ("b1", "b1", 1)]
    assert explore.follow(p, s, 2).count() == 3
    f = spark.createDataFrame([("x", "u1")], "company_name string, website_url string")
    e = spark.createDataFrame([("y", "u1"), ("z", "u2"), ("z", "u2")], "name string, url string")
    assert sorted(map(tuple, explore.expand(f, e).collect())) == [("x", "u1"), ("z", "u2")]
    c = spark.createDataFrame([("s", "u1", "team"), ("s", "u9", "team")], "site string, url string, category string")
    got = explore.crawl_statistics(c, spark.createDataFrame([("u1", "text")], "url string, content string"), F.length("content") > 2).first()
    assert tuple(got) == ("s", "team", 2, 1, 1, 1)


def test_estimate_is_linear(spark):
    df = jobs.estimate(spark.createDataFrame([(50,), (100,)], "firm_count int"), F.lit(200.0)).orderBy("firm_count").collect()
    assert df[1]["cost"] == pytest.approx(2 * df[0]["cost"]) and df[0]["duration"] == "<1m"


def test_tags_and_percent(spark):
    df = spark.createDataFrame([(1, "A seed fund"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in records.tag(df, [("Seed", "seed"), ("Fund", "fund"), ("Fund", "a seed")]).orderBy("label").collect()] == [(1, "Fund", 2), (1, "Seed", 1)]
