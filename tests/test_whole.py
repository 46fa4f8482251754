"""Queries do their whole job, and operators against results by hand."""

import json
import re
from collections import defaultdict

import __spark_entry__  # noqa: F401, registers every query
import pytest
from firmlens.functions import dims, names, text, urls
from firmlens.operators import match, pages
from firmlens.plans import records
from firmlens.plans.fixtures import view
from firmlens.plans.registry import ORACLES, QUERIES
from firmlens.sources import export
from pyspark.sql import functions as F
from test_operators import brute_explore

SF = "/root/testdata/sf0.001"


def test_no_query_leaves_rows_out():
    """No registered query or its SQL works on a sample of ids of the tables that it matches."""
    for name in ("email_matches", "employee_matches", "led_investments", "portfolio_candidates", "portfolio_cells", "cost_estimate", "team_bios"):
        assert all(x not in ORACLES[name] for x in ("company_id % 20", "company_id % 50", "member_id % 2 = 0)", "member_id % 4 = 0)", "job_id % 10", "member_id % 5 = 4"))


def test_every_company_job_and_member(spark):
    at = lambda name, c: {r[0] for r in QUERIES[name](spark, SF).select(c).collect()}
    ids = lambda name, c: {r[0] for r in view(spark, SF, name).select(c).collect()}
    assert at("cost_estimate", "job_id") == ids("jobs", "job_id")
    assert at("portfolio_cells", "name") == ids("portfolio", "portfolio_company")
    assert {x[1:] for x in at("portfolio_candidates", "name")} == {str(x) for x in ids("portfolio", "company_id")}
    assert at("team_bios", "member_id") == ids("members", "member_id")


def test_led_investments_by_hand(spark):
    m, p = view(spark, SF, "members").collect(), view(spark, SF, "portfolio").collect()
    want = set()
    for c in p:
        named = sorted((x["member_id"], x["name"]) for x in m if x["firm_id"] == c["firm_id"] and x["member_id"] % 10 == c["company_id"] % 10)
        if named and c["company_id"] % 4 != 2:
            told = ("round led by ", "an investment of ", "", "led by ")[c["company_id"] % 4] + " and ".join(n for _, n in named).lower()
            want |= {(x["firm_id"], x["member_id"], c["company_id"]) for x in m if x["firm_id"] == c["firm_id"] and x["name"].lower() in told}
    assert {tuple(r) for r in QUERIES["led_investments"](spark, SF).select("firm_id", "member_id", "company_id").collect()} == want


def test_explored_sites_to_the_usual_bounds(spark, tmp_path):
    """A chain of 6 pages ends at depth 3, a star of 30 at 20 pages; two small pages are all visited."""
    a = lambda *to: "".join(f'<a href="{x}">x</a>' for x in to)
    rows = [(i, f"https://chain.example/{i}", a(f"/{i + 1}")) for i in range(6)] + [(10, "https://star.example/", a(*(f"/s{i:02}" for i in range(30))))] + [(20, "https://two.example/a", a("/b", "/a"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    edges, roots = defaultdict(lambda: defaultdict(list)), {}
    for r in records._edges(spark, str(tmp_path)).orderBy("seq").collect():
        edges[r["firm"]][r["from_url"]].append((r["to_url"], r["priority"]))
        roots[r["firm"]] = min(r["from_url"], roots.get(r["firm"], r["from_url"]))
    got = defaultdict(list)
    for r in records.explored_sites(spark, str(tmp_path)).orderBy("visit").collect():
        got[r["firm"]].append((r["url"], r["depth"]))
    assert got == {k: brute_explore(edges[k], roots[k], 3, 20) for k in roots}
    assert [len(got[f"{k}.example"]) for k in ("chain", "star", "two")] == [4, 20, 2]


def test_left_joins_keep_what_is_unmatched(spark):
    m = spark.createDataFrame([(1, 1, "José  Ramos"), (1, 2, "Bo Lee"), (2, 3, "jose ramos")], "page_id long, member_id long, name string")
    links = spark.createDataFrame([(1, 5, "u5", "jose ramos"), (1, 4, "u4", "Jose Ramos")], "page_id long, seq long, link string, name string")
    assert sorted(map(tuple, match.profile_page_of_member(m, links).collect())) == [(1, 1, "u4"), (1, 2, None), (2, 3, None)]
    f = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "firm_id long, company_name string")
    r = spark.createDataFrame([("A", "x"), ("A", "w"), ("C", "y")], "company_name string, value string")
    got = match.registry_attributes(f, {"one": r, "two": r.limit(0)}).orderBy("firm_id").collect()
    assert list(map(tuple, got)) == [(1, "A", "w", None), (2, "B", None, None), (3, "A", "w", None)]


def test_pagination_links(spark):
    rows = [("/team?page=2", "2"), ("/team?page=2", "Next"), ("/team/3", "3"), ("/team/ann", "Ann"), ("/people/4", "Next"), ("/team/all", "Load More"), ("/page/about", "About")]
    df = spark.createDataFrame([(1, h, "https://f.example" + h, t, i) for i, (h, t) in enumerate(rows)], "page_id long, href string, link string, txt string, seq int")
    assert sorted((r["link"][17:], r["seq"]) for r in pages.pagination_links(df).collect()) == [("/team/3", 2), ("/team/all", 5), ("/team?page=2", 0)]


def test_templates_and_path_lists(spark):
    assert [len(dims.PATH_LISTS[k]) for k in ("waterfall", "standard", "portfolio", "team", "team_fallback")] == [12, 14, 17, 10, 13]
    assert len(dims.TEMPLATE_SHEETS) == 8
    rows = QUERIES["template_sheets"](spark, SF).collect()
    n = {"firms": view(spark, SF, "firms").count(), "team": view(spark, SF, "members").count(), "portfolio": view(spark, SF, "portfolio").count()}
    assert len(rows) == sum(n[s] for sheets in dims.TEMPLATE_SHEETS.values() for s in sheets)
    members = {r["member_id"]: r for r in view(spark, SF, "members").collect()}
    for r in rows:
        cells = json.loads(r["cells"])
        assert list(cells) == list(dims.TEMPLATE_SHEETS[r["template"]][r["sheet"]].values())
        if r["sheet"] == "team":
            assert cells["Email"] == (members[r["row_id"]]["email"] or "") if "Email" in cells else True


def test_assembled_content_holds_the_text_of_every_page(spark, tmp_path):
    rows = [(1, "https://a.example/news/1", "<p>news</p>"), (2, "https://A.example/team", "<p>we <b>all</b></p><script>x</script>"), (3, "https://a.example/", "home"), (4, "https://a.example/team/z", "more"), (5, "https://a.example", "home too"), (6, "https://b.example/x", None), (7, "nowhere", "lost"), (2001, "https://a.example/team/y", "late")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = defaultdict(list)
    for r in records.assembled_content(spark, str(tmp_path)).orderBy("rank", "block").collect():
        got[r["site"]].append(r["content"])
    assert got == {"a.example": ["home\n\nhome too", "we all\n\nmore", "late", "news"], "b.example": [""], None: ["lost"]}


@pytest.mark.parametrize("name", ["liveness", "live_progress"])
def test_streams_end_in_the_shared_folder(spark, name):
    assert QUERIES[name](spark, SF).inputFiles()


def test_walker_is_linear_in_unclosed_tags():
    w = pages.Walker("<div>" * 20_000 + "text " * 3 + "<p>a</p>" * 20_000)
    assert len(w.items) == 40_000 and w.items[-1].text == "a"
    assert w.items[0].start(7)[:7] == "text te"


def test_walker_texts():
    w = pages.Walker("<div>a<ul><li>b<li>c</ul>d<br>e</div>f<script>x</script></p>g")
    assert [(x["tag"], x["text"]) for x in w.items] == [("div", "abcde"), ("ul", "bc"), ("li", "bc"), ("li", "c"), ("br", ""), ("script", "")]
    assert w.scripts[0][1] == "x"


def test_new_rows_keep_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, k string")
    assert sorted(map(tuple, export.new_rows(df, df.filter("k = 'b'").select("k"), ["k"], "id").collect())) == [(1, "a")]


def test_messages_previews_and_slugs(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("Request FORBIDDEN", text.site_error) == "Access blocked - website has anti-bot protection" and one("odd", text.site_error) == "Failed to fetch: odd"
    assert one("usage exhausted", text.verification_error) == "Verification temporarily unavailable (rate limit)" and one("odd", text.verification_error) == "Verification unavailable"
    assert one("A & B - Capital, Inc.", names.linkedin_slug) == "a-b-capital-inc"
    assert [len(export.SHEETS[k]) for k in export.SHEETS] == [20, 20, 9, 15, 10, 11] and [len(v) for v in export.SHORT_SHEETS.values()] == [13, 16]
    assert [export.snake(x) for x in ("linkedinUrl", "linkedInCoverage", "aum", "tier1Count")] == ["linkedin_url", "linkedin_coverage", "aum", "tier1_count"]


def test_names_of_one_word_are_assigned(spark):
    m = spark.createDataFrame([(1, 1, "Cher")], "page_id long, member_id long, name string")
    u = spark.createDataFrame([(1, "https://www.linkedin.com/in/cher", "Cher", "", 0)], "page_id long, url string, near string, context string, seq long")
    assert [tuple(r) for r in match.assign_profiles(m, u).collect()] == [(1, 1, "https://www.linkedin.com/in/cher", "High")]


def brute_assignment(members, links):
    """page by page, member by member, link by link."""
    out = []
    for page in sorted({p for p, _, _ in members}):
        taken = set()
        for _, mid, name in sorted(x for x in members if x[0] == page):
            w = name.lower().split()
            first, last = ("".join(c for c in x if c.isascii() and c.isalpha()) for x in (w[0], w[-1] if len(w) > 1 else ""))
            found = []
            for _, url, near, context, seq in (x for x in links if x[0] == page):
                slug = url.split("/in/")[1].lower()
                rank = 1 if first in near.lower() and last in near.lower() else 2 if first in context.lower() and last in context.lower() else 3 if first in slug and last in slug else 4 if last and slug[1:2] == "-" and slug[0] == first[0] and last in slug else None
                if rank and url not in taken:
                    found.append((rank, seq, url))
            if found:
                rank, _, url = min(found)
                taken.add(url)
                out.append((page, mid, url, ("High", "Medium", "Medium", "Low")[rank - 1]))
    return sorted(out)


def test_assigned_profiles_by_hand(spark):
    m = [(r["firm_id"], r["member_id"], r["name"]) for r in view(spark, SF, "members").collect()]
    got = QUERIES["assigned_profiles"](spark, SF).collect()
    links = [(p, f"https://www.linkedin.com/in/{re.sub('[^a-z]+', '-', n.lower())}-{i}", n, f"{n} {t}", i) for p, i, n, t in ((r["firm_id"], r["member_id"], r["name"], r["title"]) for r in view(spark, SF, "members").collect())]
    assert sorted(map(tuple, got)) == brute_assignment(m, links)


def test_rules_by_literal_rows(spark):
    """Categories of pages and classes of errors, without the patterns' own constants."""
    rows = [
        ("https://f.example/team", "", "team", 1), ("https://f.example/x", "Meet the Team", "team", 1), ("https://f.example/portfolio-companies", "", "portfolio", 2), ("https://f.example/x", "Our Portfolio", "portfolio", 2), ("https://f.example/about-us", "", "team", 1),
        ("https://f.example/about", "", "about", 3), ("https://f.example/x", "Our story", "about", 3), ("https://f.example/get-in-touch", "", "contact", 4), ("https://f.example/insights/1", "", "news", 5), ("https://f.example/x", "Press", "news", 5), ("https://f.example/x", "y", "other", 5),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "link string, txt string").select(urls.category(F.col("link"), F.col("txt")), urls.category_priority(F.col("link"), F.col("txt")))
    assert [tuple(r) for r in df.collect()] == [r[2:] for r in rows]
    errors = [("Request failed with status code 403", "scraper_blocked"), ("Too many requests: 429", "scraper_blocked"), ("status code 502", "http_error"), ("timeout of 10000ms exceeded", "http_error"), ("No content", "no_content"), ("OpenAI gave nothing", "llm_empty"), ("boom", "unknown")]
    got = spark.createDataFrame([(m,) for m, _ in errors], "m string").select(text.error_class(F.col("m"))).collect()
    assert [r[0] for r in got] == [c for _, c in errors]
