"""Queries of the page jobs that need team pages, listings and payloads: Spark builds such pages from members and
portfolio, a page for each firm, and the other engine says from the views what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.operators import explore, match, pages
from firmlens.operators.shared import cut
from firmlens.plans import columns
from firmlens.plans.fixtures import view, with_views
from firmlens.plans.records import GREEDY, NAMED
from firmlens.plans.registry import query


def _joined(df: DataFrame, seq: str, item) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), item.alias("x"))))
    return df.groupBy("firm_id").agg(F.array_join(F.transform(items, lambda x: x["x"]), "\n").alias("html"))


def _site():
    return F.concat(F.lit("https://site"), F.col("firm_id").cast("string"), F.lit(".example.com/team"))


def _s(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def team_pages(spark, d) -> DataFrame:
    """Blocks of people with a profile anchor, a link to their page and a tab."""
    m = view(spark, d, "members")
    block = _s('<div class="member card"><h3>', F.col("name"), '</h3><p>', F.col("title"), " of the firm, ", F.col("name"), " has been here for years.</p>", '<a href="/team/p', F.col("member_id"), '">', F.col("name"), "</a>", F.when(F.length("linkedin_url") > 0, _s('<a href="', F.col("linkedin_url"), '">profile</a>')).otherwise(""), '<a class="tab" href="/group/', F.col("member_id") % 3, '">group</a></div>')
    html = _joined(m, "member_id", block).withColumn("html", F.concat(F.lit("<html><body><script>load('/api/team/v2')</script>"), "html", F.lit("</body></html>")))
    return html.select(F.col("firm_id").alias("page_id"), _site().alias("url"), "html")


def portfolio_pages(p: DataFrame) -> DataFrame:
    """Logos that link outwards, and a table of companies."""
    logos = _joined(p, "company_id", _s('<a href="https://c', F.col("company_id"), '.example.org/home"><img src="/l/x-logo.png" alt="', F.col("portfolio_company"), '"></a>'))
    rows = _joined(p, "company_id", _s("<tr><td>", F.col("portfolio_company"), "</td><td>", F.col("investment_niche"), "</td></tr>")).withColumnRenamed("html", "_t")
    both = logos.join(rows, "firm_id")
    return both.select(F.col("firm_id").alias("page_id"), _site().alias("url"), F.concat("html", F.lit("<table><tr><th>Portfolio</th></tr>"), "_t", F.lit("</table>")).alias("html"))


def listing_pages(spark, d) -> DataFrame:
    """A listing in markdown with a next page, by firm."""
    m = view(spark, d, "members")
    page = _joined(m, "member_id", _s("[", F.col("name"), "](/profile/p", F.col("member_id"), ")"))
    url = _s("https://list.example.com/f", F.col("firm_id"), "?page=", F.col("firm_id") % 4 + 1)
    tail = F.when(F.col("firm_id") % 4 < 3, _s("\n[Next](https://list.example.com/f", F.col("firm_id"), "?page=", F.col("firm_id") % 4 + 2, ")")).otherwise("")
    return page.select(F.col("firm_id").alias("page_id"), url.alias("url"), F.concat(F.lit("# Firm\n"), "html", tail, F.lit("\nSee https://firm"), F.col("firm_id").cast("string"), F.lit(".example.org/ and https://www.linkedin.com/company/firm"), F.col("firm_id").cast("string")).alias("html"))


def payloads(spark, d) -> DataFrame:
    m = view(spark, d, "members")
    people = F.array_sort(F.collect_list(F.struct("member_id", "name", "title")))
    j = m.groupBy("firm_id").agg(F.to_json(F.struct(people.alias("team"))).alias("html"))
    return j.select(F.col("firm_id").alias("page_id"), _site().alias("url"), "html")


M, P = with_views("members"), with_views("portfolio")
SITE = "'https://site' || firm_id || '.example.com'"


@query(f"{M} SELECT DISTINCT firm_id AS page_id, linkedin_url AS link, 'anchor' AS source FROM members WHERE linkedin_url <> ''")
def team_profile_links(spark, d) -> DataFrame:
    """J3, J4."""
    return pages.profile_links(team_pages(spark, d)).select("page_id", "link", "source")


@query(f"{M} SELECT firm_id AS page_id, {SITE} || '/team/p' || member_id AS link, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name FROM (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY member_id) AS r FROM members)")
def team_profile_pages(spark, d) -> DataFrame:
    """J8."""
    return pages.profile_pages(team_pages(spark, d)).filter("link LIKE '%/team/p%'").select("page_id", "link", "name")


@query(f"{M} SELECT DISTINCT firm_id AS page_id, {SITE} || '/group/' || (member_id % 3) AS link, 'group' AS label FROM members")
def team_tabs(spark, d) -> DataFrame:
    """J18."""
    return pages.tab_links(team_pages(spark, d)).select("page_id", "link", "label")


@query(f"{M} SELECT DISTINCT firm_id AS page_id, {SITE} || e AS endpoint FROM members, (VALUES ('/api/team/v2'), ('/api/team'), ('/api/people'), ('/api/members'), ('/wp-json/wp/v2/team'), ('/api/v1/team')) v(e)")
def team_api(spark, d) -> DataFrame:
    """J16."""
    return pages.api_endpoints(team_pages(spark, d))


@query(f"{P} SELECT firm_id AS page_id, 'c' || company_id AS name, 'https://c' || company_id || '.example.org/home' AS link FROM portfolio")
def portfolio_candidates(spark, d) -> DataFrame:
    """J9."""
    return pages.portfolio_candidates(portfolio_pages(view(spark, d, "portfolio"))).select("page_id", "name", "link")


@query(f"{P} SELECT firm_id AS page_id, portfolio_company AS name FROM portfolio")
def portfolio_cells(spark, d) -> DataFrame:
    """J10."""
    return pages.company_cells(portfolio_pages(view(spark, d, "portfolio"))).select("page_id", "name")


@query(f"{M} SELECT firm_id AS page_id, 'https://list.example.com/profile/p' || member_id AS link, name AS text FROM members UNION ALL SELECT DISTINCT firm_id, 'https://list.example.com/f' || firm_id || '?page=' || (firm_id % 4 + 2), 'Next' FROM members WHERE firm_id % 4 < 3 UNION ALL SELECT DISTINCT firm_id, 'https://firm' || firm_id || '.example.org/', '' FROM members UNION ALL SELECT DISTINCT firm_id, 'https://www.linkedin.com/company/firm' || firm_id, '' FROM members")
def listing_links(spark, d) -> DataFrame:
    """J2."""
    return pages.markdown_links(listing_pages(spark, d)).select("page_id", "link", "text")


@query(f"{M} SELECT DISTINCT firm_id AS page_id, CASE WHEN firm_id % 4 < 3 THEN 'https://list.example.com/f' || firm_id || '?page=' || (firm_id % 4 + 2) END AS next_url FROM members")
def listing_next(spark, d) -> DataFrame:
    """J12."""
    return pages.next_page(listing_pages(spark, d)).select("page_id", "next_url")


@query(f"{M} SELECT DISTINCT firm_id AS page_id, 'https://firm' || firm_id || '.example.org/' AS site, 'https://www.linkedin.com/company/the-firm-' || firm_id AS linkedin, 'slug' AS basis, FALSE AS is_directory, 'Firm' AS title FROM members")
def listing_facts(spark, d) -> DataFrame:
    """J14, J15, J19, I32."""
    from firmlens.functions import text

    p = listing_pages(spark, d).withColumn("company_name", _s("The Firm, ", F.col("page_id")))
    return pages.own_site(p).join(pages.company_profile(p), "page_id").join(pages.known_directory(p), "page_id").join(p.select("page_id", text.title(F.col("html")).alias("title")), "page_id")


@query(f"{M} SELECT firm_id AS page_id, name, title FROM members")
def payload_people(spark, d) -> DataFrame:
    """J20."""
    return pages.json_people(payloads(spark, d)).select("page_id", "name", "title")


#: The text of a card on a team page.
_CARD = "name || title || ' of the firm, ' || name || ' has been here for years.' || name || CASE WHEN length(linkedin_url) > 0 THEN 'profile' ELSE '' END || 'group'"
_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"""{M}, b AS (SELECT firm_id, member_id, name, {_SQUEEZED.format(_CARD)} AS bio FROM members), r AS (SELECT a.firm_id, a.member_id, a.name, o.bio, row_number() OVER (PARTITION BY a.firm_id, a.member_id ORDER BY o.member_id) AS r FROM b a JOIN b o ON a.firm_id = o.firm_id AND contains(lower(o.name), lower(a.name)))
    SELECT firm_id AS page_id, member_id, name, bio FROM r WHERE r = 1""")
def team_bios(spark, d) -> DataFrame:
    """For every member the card around the first heading that holds their name."""
    m = view(spark, d, "members").select(F.col("firm_id").alias("page_id"), "member_id", "name")
    return m.join(pages.bio_section(team_pages(spark, d), m), ["page_id", "name"]).select("page_id", "member_id", "name", "bio")


@query(f"{M} SELECT firm_id AS page_id, count(*) AS members, count(DISTINCT nullif(linkedin_url, '')) AS links FROM members GROUP BY firm_id")
def team_page_counts(spark, d) -> DataFrame:
    """Members and profile links of each team page."""
    m = view(spark, d, "members").groupBy(F.col("firm_id").alias("page_id")).agg(F.count(F.lit(1)).alias("members"))
    n = pages.profile_links(team_pages(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return m.join(n, "page_id", "left").select("page_id", "members", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""{M.replace('WITH', 'WITH RECURSIVE')}, {NAMED}, w AS (SELECT firm_id, string_agg({_CARD}, chr(10) ORDER BY member_id) AS page FROM members GROUP BY 1),
    u AS (SELECT firm_id AS page_id, linkedin_url AS url, left({_SQUEEZED.format(_CARD)}, 200) AS near, left({_SQUEEZED.format('page')}, 500) AS context, member_id AS seq FROM members JOIN w USING (firm_id) WHERE length(linkedin_url) > 0), {GREEDY}""")
def team_assignment(spark, d) -> DataFrame:
    """D9 over J3: each profile of a team page goes to one member."""
    m = view(spark, d, "members")
    u = pages.profile_links(team_pages(spark, d)).select("page_id", F.col("link").alias("url"), "near", "context", "seq")
    return match.assign_profiles(m.select(F.col("firm_id").alias("page_id"), "member_id", "name"), u)


@query(f"{M}, k AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(trim(name))), '\\s+', ' ', 'g'), '[^a-z0-9\\s\\-'']', '', 'g')) AS pk FROM members) SELECT firm_id AS page_id, member_id, {SITE} || '/team/p' || min(member_id) OVER (PARTITION BY firm_id, pk) AS link FROM k")
def member_profile_pages(spark, d) -> DataFrame:
    """D12 over J8: every member with the first page of their name, or none."""
    m = view(spark, d, "members").select(F.col("firm_id").alias("page_id"), "member_id", "name")
    return match.profile_page_of_member(m, pages.profile_pages(team_pages(spark, d), 2**31))  # no cap


@query(f"{M} SELECT DISTINCT firm_id AS page_id, linkedin_url AS link FROM members WHERE linkedin_url <> ''")
def team_profile_urls(spark, d) -> DataFrame:
    """All profile URLs in a page's text, without a walk through its tags."""
    return pages.profile_urls(team_pages(spark, d))


def directory_pages(spark, d) -> DataFrame:
    """A listing in HTML, by firm: an entry for each member under one path, a few other links of its own and one to another site."""
    m = view(spark, d, "members")
    page = _joined(m, "member_id", _s('<li><a href="/profile/p', F.col("member_id"), '">', F.trim("name"), "</a></li>"))
    html = F.concat(F.lit('<html><body><a href="/about">About</a><a href="https://elsewhere.example/x">Elsewhere</a><ul>'), "html", F.lit("</ul></body></html>"))
    return page.select(F.col("firm_id").alias("page_id"), _s("https://list.example.com/f", F.col("firm_id")).alias("url"), html.alias("html"))


@query(f"{M}, n AS (SELECT firm_id, count(*) AS c FROM members GROUP BY 1) SELECT firm_id AS page_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, 'https://list.example.com/profile/p' || member_id AS url, CAST(1 + row_number() OVER (PARTITION BY firm_id ORDER BY member_id) + 1 AS BIGINT) AS seq FROM members JOIN n USING (firm_id) WHERE c >= 3")
def directory_entries(spark, d) -> DataFrame:
    """The entries of each listing that has three or more under one path."""
    got = pages.directory_entries(columns.page_anchors(directory_pages(spark, d)))
    return got.withColumn("seq", F.col("seq").cast("long"))


#: Home pages of firms, the same text for both engines: an anchor, structured data, structured data that can't be read before some that can, a sameAs that is no list, nothing.
_HOME = r"""CASE firm_id % 6
    WHEN 0 THEN concat('<p>See https://www.linkedin.com/company/other</p><a class="x" href="//www.linkedin.com/company/c', CAST(firm_id AS STRING), '?trk=1#top">in</a><a href="https://linkedin.com/company/later">in</a>')
    WHEN 1 THEN concat('<script type="application/ld+json">{"@type": "Organization", "sameAs": ["https://twitter.com/x", "https://www.linkedin.com/company/s', CAST(firm_id AS STRING), '"]}</script>')
    WHEN 2 THEN concat('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"sameAs": ["https://www.linkedin.com/company/t', CAST(firm_id AS STRING), '", "https://www.linkedin.com/company/u"]}</script>')
    WHEN 3 THEN concat('<script type="application/ld+json">{"sameAs": "https://www.linkedin.com/company/w', CAST(firm_id AS STRING), '"}</script>')
    WHEN 4 THEN concat('<a href="www.linkedin.com/company/n', CAST(firm_id AS STRING), '#x">in</a>') ELSE '<p>nothing</p>' END"""
_NAME = "concat('The Ünited & Sons -  Firm ', CAST(firm_id AS STRING))"


@query(f"""{with_views('firms')} SELECT firm_id AS page_id, CASE firm_id % 6 WHEN 0 THEN 'https://www.linkedin.com/company/c' || firm_id WHEN 1 THEN 'https://www.linkedin.com/company/s' || firm_id WHEN 2 THEN 'https://www.linkedin.com/company/t' || firm_id WHEN 4 THEN 'https://www.linkedin.com/company/n' || firm_id
      ELSE 'https://www.linkedin.com/company/the-nited-sons-firm-' || firm_id END AS linkedin, CASE firm_id % 6 WHEN 0 THEN 'anchor' WHEN 4 THEN 'anchor' WHEN 1 THEN 'structured' WHEN 2 THEN 'structured' ELSE 'slug' END AS basis FROM firms""")
def company_profiles(spark, d) -> DataFrame:
    """The LinkedIn page of each firm from an anchor, structured data, or its name."""
    return pages.company_profile(view(spark, d, "firms").selectExpr("firm_id AS page_id", f"{_NAME} AS company_name", f"{_HOME} AS html"))


def paged_listings(spark, d) -> DataFrame:
    """Listings of three pages in markdown, by firm. The second page has more links to news than entries, and the last one only two entries."""
    f, m = view(spark, d, "firms").select("firm_id"), view(spark, d, "members").select("firm_id", "member_id", "name")
    at = lambda n: _s("https://dir.example.com/f", F.col("firm_id"), f"?page={n}")
    line = lambda kind, key: _s("[", F.col("name"), f"](/{kind}/{key}", F.col("member_id"), ")")
    body = lambda rows, item: _joined(rows, "member_id", item)
    news = m.filter("member_id % 4 < 2")
    one = body(news, line("profile", "p"))
    two = body(m.filter("member_id % 4 = 2"), line("profile", "p")).withColumnRenamed("html", "a").join(body(news, line("news", "n")), "firm_id", "full")
    out = []
    for n, rows in ((1, one), (2, two), (3, f.withColumn("html", F.lit("")))):
        text = F.concat_ws("\n", F.lit("# List\n[About us](/about)\n[Elsewhere](https://elsewhere.example/x)\n[x](/profile/short)"), *([F.col("a")] if n == 2 else []), F.col("html"))
        fixed = {1: [], 2: [_s("[Extra](/profile/x", F.col("firm_id"), ")")], 3: [_s("[Last one](/profile/y", F.col("firm_id"), ")"), _s("[Last two](/profile/z", F.col("firm_id"), "/)")]}[n]
        tail = _s("[Next](", at(n % 3 + 1), ")")
        out.append(f.join(rows, "firm_id", "left").select(F.col("firm_id").alias("page_id"), at(n).alias("url"), F.concat_ws("\n", text, *fixed, tail).alias("html")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""{with_views('firms', 'members')}, c AS (SELECT firm_id, count(*) FILTER (member_id % 4 < 2) AS c1, count(*) FILTER (member_id % 4 = 2) AS c2 FROM members GROUP BY 1),
    x AS (SELECT firm_id, 1 AS place, trim(name) AS name, 'https://dir.example.com/profile/p' || member_id AS url FROM members JOIN c USING (firm_id) WHERE member_id % 4 < 2 AND c1 >= 3
      UNION ALL SELECT firm_id, 2, trim(name), 'https://dir.example.com/profile/p' || member_id FROM members JOIN c USING (firm_id) WHERE member_id % 4 = 2 AND c1 >= 3 UNION ALL SELECT firm_id, 2, 'Extra', 'https://dir.example.com/profile/x' || firm_id FROM c WHERE c1 >= 3
      UNION ALL SELECT firm_id, 3, 'Last one', 'https://dir.example.com/profile/y' || firm_id FROM c WHERE c1 >= 3 AND c2 >= 2 UNION ALL SELECT firm_id, 3, 'Last two', 'https://dir.example.com/profile/z' || firm_id || '/' FROM c WHERE c1 >= 3 AND c2 >= 2)
    SELECT 'https://dir.example.com/f' || firm_id || '?page=1' AS start, place, name, url FROM x""")
def followed_entries(spark, d) -> DataFrame:
    """Listings of three pages are followed; the prefix found on the first page filters the others before any detection, so that
    neither the many links to news on the second nor the few entries of the last one mislead."""
    p = cut(paged_listings(spark, d), "listings")
    by_page = pages.markdown_links(p.select(F.xxhash64("url").alias("page_id"), "url", "html")).join(p.select(F.xxhash64("url").alias("page_id"), "url"), "page_id")
    links = by_page.filter("text <> ''").select("url", "link", F.col("text").alias("txt"), "seq")
    starts = p.filter("url LIKE '%page=1'").select(F.col("url").alias("start"))
    return explore.listing(cut(links, "links"), pages.next_page(p).select("url", "next_url"), starts)


def profile_sites(spark, d) -> DataFrame:
    """Sites of firms: a home page with a meta tag, a team page with anchors, data attributes and links to people, structured data, and a page for each person."""
    m, f = view(spark, d, "members"), view(spark, d, "firms").select("firm_id")
    base, li = _s("https://g", F.col("firm_id"), ".example.com"), "https://www.linkedin.com/in/"
    home = f.select("firm_id", F.lit("/").alias("path"), _s(f'<html><head><meta property="og:see_also" content="{li}home', F.col("firm_id"), '"></head><body><p>Hi</p></body></html>').alias("html"))
    card = F.when(F.col("member_id") % 3 == 0, _s(f'<div><a href="{li}m', F.col("member_id"), '">in</a></div>')).when(F.col("member_id") % 3 == 1, _s(f'<span data-profile="{li}m', F.col("member_id"), '">x</span>')).otherwise("")
    team = _joined(m, "member_id", F.concat(card, _s('<a href="/team/p', F.col("member_id"), '">', F.col("name"), "</a>"))).select("firm_id", F.lit("/team").alias("path"), "html")
    about = f.select("firm_id", F.lit("/about").alias("path"), _s('<script type="application/ld+json">[{"@type": "Person", "name": "Cy", "sameAs": ["https://x.example/cy", "', li, "cy", F.col("firm_id"), '"]}, {"@type": "Thing", "sameAs": "', li, 'no"}]</script>', f'<a href="{li}home', F.col("firm_id"), '">again</a>').alias("html"))
    own = m.select("firm_id", _s("/team/p", F.col("member_id")).alias("path"), _s(f'<a href="{li}m', F.col("member_id"), '">me</a><script type="application/ld+json">{"@type": "Person", "sameAs": "', li, "p", F.col("member_id"), '"}</script>').alias("html"))
    every = home.unionByName(team).unionByName(about).unionByName(own)
    return every.select("firm_id", base.alias("base"), "path", F.xxhash64("firm_id", "path").alias("page_id"), F.concat(base, "path").alias("url"), "html")


@query(f"""{with_views('firms', 'members')}, n AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY member_id) AS nth FROM members), g AS (SELECT firm_id, 'https://g' || firm_id || '.example.com' AS base FROM firms),
    x AS (SELECT firm_id, 'home' || firm_id AS who, 'meta' AS source, base || '/' AS page FROM g UNION ALL SELECT firm_id, 'm' || member_id, CASE member_id % 3 WHEN 0 THEN 'anchor' ELSE 'data' END, base || '/team' FROM n JOIN g USING (firm_id) WHERE member_id % 3 < 2
      UNION ALL SELECT firm_id, 'cy' || firm_id, 'jsonld', base || '/about' FROM g UNION ALL SELECT firm_id, 'm' || member_id, 'anchor', base || '/team/p' || member_id FROM n JOIN g USING (firm_id) WHERE member_id % 3 = 2 AND nth <= 20
      UNION ALL SELECT firm_id, 'p' || member_id, 'jsonld', base || '/team/p' || member_id FROM n JOIN g USING (firm_id) WHERE nth <= 20)
    SELECT firm_id AS firm, 'https://www.linkedin.com/in/' || who AS link, source, page FROM x""")
def firm_profile_links(spark, d) -> DataFrame:
    """The profiles that the pages of a firm and the pages of its people name, each from the first page that has it."""
    p = cut(profile_sites(spark, d), "sites")
    place = F.when(F.col("path") == "/", 1).when(F.col("path") == "/team", 2).when(F.col("path") == "/about", 3)
    site = p.select(F.col("firm_id").alias("firm"), "base", "url", place.alias("place"), (F.col("path") == "/team").alias("is_team")).filter("place IS NOT NULL")
    return pages.firm_profile_links(site, p.select("page_id", "url", "html"))
