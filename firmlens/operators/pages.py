"""Table functions over page content. Tags that regular expressions can't nest are walked by the standard parser in Arrow batches."""

from __future__ import annotations

import json
import re
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import names, urls
from firmlens.operators.shared import cut

PROFILE = r"https?://(?:[a-z]+\.)?linkedin\.com/in/[A-Za-z0-9_%.-]+"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What profile links look like, what isn't one, tables of companies, common endpoints.
PROFILE_PATHS = ("/team/", "/people/", "/bio/", "/profile/", "/staff/", "/about/team/", "/our-team/")
NOT_PROFILES = ("/careers", "/jobs", "/contact", "/privacy", "/terms", "/blog", "/news", "/press", "mailto:", "tel:", "#")
COMPANY_WORDS = ("portfolio", "company", "companies", "investment")
API_PATTERNS = ("/api/team", "/api/people", "/api/members", "/wp-json/wp/v2/team", "/api/v1/team")
PEOPLE_KEYS = ("data", "team", "people", "members")
HEADINGS, NAME_CLASSES = ("h1", "h2", "h3", "h4", "h5", "h6"), {"name", "team-member-name"}
BIO_PATHS, BIO_PAGES = ("/team/", "/people/", "/partner/", "/about/"), 20
DIRECTORY_HOSTS = ("clutch.co", "crunchbase.com", "f6s.com", "angel.co", "wellfound.com", "producthunt.com")


class Walker(HTMLParser):
    """A flat list of elements with their depth, attributes, text and the text around them. All text lies in one list of pieces; an
    element knows where its own begin and end there, so that a piece is stored once, however many elements are open."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.items: list[Element] = []
        self.open: list[Element] = []
        self.of_tag: dict[str, int] = {}  # how many elements of a tag are open
        self.scripts: list[tuple[Element, str]] = []
        self.pieces: list[str] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        item = Element(self.pieces, tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None)
        self.items.append(item)
        if tag in VOID:
            item.end = item.begin
        else:
            self.open.append(item)
            self.of_tag[tag] = self.of_tag.get(tag, 0) + 1

    def handle_endtag(self, tag):
        while self.of_tag.get(tag):  # each element is closed once
            item = self.open.pop()
            item.end = len(self.pieces)
            self.of_tag[item["tag"]] -= 1
            if item["tag"] == tag:
                return

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] in ("script", "style"):
            self.scripts.append((self.open[-1], data))
        else:
            self.pieces.append(data)


class Element:
    __slots__ = ("_text", "attrs", "begin", "end", "pieces", "tag", "up")

    def __init__(self, pieces: list[str], tag: str, attrs: dict[str, str], up: Element | None):
        self.pieces, self.tag, self.attrs, self.up = pieces, tag, attrs, up
        self.begin, self.end, self._text = len(pieces), None, None

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = "".join(self.pieces[self.begin : self.end])
        return self._text

    def start(self, n: int) -> str:
        """At least the first n characters once space is squeezed, or all of the text."""
        end = len(self.pieces) if self.end is None else self.end
        out, at = "", self.begin
        while at < end and len(_squeeze(out)) < n:
            more = min(end, at + 16)
            out += "".join(self.pieces[at:more])
            at = more
        return out

    def __getitem__(self, name: str):
        return getattr(self, name)


def _squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def _around(x: dict, n: int) -> str:
    """The text of the nearest element around, up to n characters."""
    up = x["up"] or x
    while up["up"] and len(_squeeze(up.start(20))) < 20:
        up = up["up"]
    return _squeeze(up.start(n))[:n]


#: Rows that a page job holds before it hands them on.
JOB_ROWS = 1000


def page_rows(walk, names: list[str]):
    """What a page job does with its batches: pages are taken out of a batch one by one, and rows leave in blocks of JOB_ROWS, so that
    a task's memory is a batch of pages and one page's elements, however many rows the pages of a batch give."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("seq", pa.int64()), *((n, pa.string()) for n in names)])
        block = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows = []
        for b in batches:
            for page, url, html in zip(*(b.column(k) for k in range(3)), strict=True):
                page = page.as_py()
                for i, r in enumerate(walk(html.as_py(), url.as_py())):
                    rows.append((page, i, *r))
                    if len(rows) >= JOB_ROWS:
                        yield block(rows)
                        rows = []
        if rows:
            yield block(rows)

    return run


def _page_job(pages: DataFrame, walk, *names: str) -> DataFrame:
    """walk(html, url) yields rows of texts, named by names; page_id and seq come first."""
    schema = ", ".join(["page_id long", "seq long", *(f"{n} string" for n in names)])
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(page_rows(walk, list(names)), schema)


def profile_links(pages: DataFrame) -> DataFrame:
    """Profile anchors with near and wider context, data attributes, JSON-LD people and meta tags; the first of each URL."""

    def walk(html, url):
        w, seen = Walker(html), set()
        found = []
        for x in w.items:
            a = x["attrs"]
            if x["tag"] == "a" and re.match(PROFILE, a.get("href", "")):
                found.append((re.match(PROFILE, a["href"])[0], _squeeze(x["text"]), _around(x, 200), _around(x["up"] or x, 500), "anchor"))
            for k, v in a.items():
                if k.startswith("data-") and (m := re.search(PROFILE, v)):
                    found.append((m[0], _squeeze(x["text"])[:100], _around(x, 200), _around(x, 500), "data"))
            if x["tag"] == "meta" and (m := re.search(PROFILE, a.get("content", ""))):
                found.append((m[0], "", "", "", "meta"))
        for x, s in w.scripts:
            if x["attrs"].get("type") == "application/ld+json":
                try:
                    data = json.loads(s)
                except ValueError:
                    continue
                for p in data if isinstance(data, list) else [data]:
                    same = p.get("sameAs", []) if isinstance(p, dict) and p.get("@type") == "Person" else []
                    for v in [same] if isinstance(same, str) else same:
                        if m := re.search(PROFILE, v):
                            found.append((m[0], p.get("name", ""), p.get("name", ""), p.get("jobTitle", ""), "jsonld"))
        for f in found:
            if f[0] not in seen:
                seen.add(f[0])
                yield f

    return _page_job(pages, walk, "link", "text", "near", "context", "source")


def profile_pages(pages: DataFrame, cap: int = 200) -> DataFrame:
    """Links from a team page to pages of its people: (page_id, seq, link, name)."""

    def walk(html, url):
        found = {}
        for x in Walker(html).items:
            href = x["attrs"].get("href", "")
            if x["tag"] != "a" or not href or any(n in href.lower() for n in NOT_PROFILES):
                continue
            card = any("card" in (y["attrs"].get("class", "")) for y in (x, x["up"] or x))
            if any(p in href.lower() for p in PROFILE_PATHS) or card:
                found[href] = _squeeze(x["text"])
        yield from list(found.items())[:cap]

    got = _page_job(pages, walk, "href", "name")
    return got.join(pages.select("page_id", "url"), "page_id").select("page_id", "seq", urls.absolute(F.col("href"), F.col("url")).alias("link"), "name")


def portfolio_candidates(pages: DataFrame) -> DataFrame:
    """Companies on a portfolio page: logos by their text or file name, outbound links; the first of each origin or name."""

    def walk(html, url):
        own, seen = re.sub(r"^https?://(www\.)?|/.*$", "", url or ""), set()
        for x in Walker(html).items:
            a = x["attrs"]
            name = link = ""
            if x["tag"] == "img":
                stem = re.sub(r"\.[a-z]+$", "", a.get("src", "").split("/")[-1])
                name = _squeeze(a.get("alt", "")) or re.sub(r"[-_]+", " ", re.sub(r"(?i)[-_]?logo", "", stem)).strip()
                link = x["up"]["attrs"].get("href", "") if x["up"] and x["up"]["tag"] == "a" else ""
            elif x["tag"] == "a" and re.match(r"https?://", a.get("href", "")):
                name, link = _squeeze(x["text"]), a["href"]
            host = re.sub(r"^https?://(www\.)?|/.*$", "", link)
            if host and (host == own or re.search(r"(twitter|x|facebook|linkedin|instagram|youtube|google|apple|microsoft)\.com$", host)):
                continue
            key = host or name.lower()
            if len(name or host) > 1 and key not in seen and (name or host):
                seen.add(key)
                yield name or host.split(".")[0], link

    return _page_job(pages, walk, "name", "link")


def company_cells(pages: DataFrame) -> DataFrame:
    """First cells of the rows of tables that speak of companies."""

    def walk(html, url):
        seen, fits = set(), {}
        for x in Walker(html).items:
            row = x["up"]
            if x["tag"] == "td" and row and row["tag"] == "tr" and id(row) not in seen:
                seen.add(id(row))
                table = _nearest(x, "table")
                if table and id(table) not in fits:  # a table is searched once, not for each row
                    fits[id(table)] = any(k in table["text"].lower() for k in COMPANY_WORDS)
                if table and _squeeze(x["text"]) and fits[id(table)]:
                    yield (_squeeze(x["text"]),)

    return _page_job(pages, walk, "name")


def _nearest(x: dict, tag: str) -> dict | None:
    while x is not None and x["tag"] != tag:
        x = x["up"]
    return x


def tab_links(pages: DataFrame) -> DataFrame:
    """Tabs, filters and regions of a team page: the last of each link."""

    def walk(html, url):
        found = {}
        for x in Walker(html).items:
            a = x["attrs"]
            target = a.get("href") or a.get("data-url") or a.get("data-href") or ""
            words = " ".join((a.get("class", ""), a.get("role", ""), " ".join(k for k in a))).lower()
            if target and not target.startswith("#") and re.search(r"tab|filter|region|category", words):
                found[target] = _squeeze(x["text"])
        yield from found.items()

    got = _page_job(pages, walk, "href", "label")
    return got.join(pages.select("page_id", "url"), "page_id").select("page_id", "seq", urls.absolute(F.col("href"), F.col("url")).alias("link"), "label")


def bio_section(pages: DataFrame, people: DataFrame) -> DataFrame:
    """What a page tells of a person: page_id, name, bio. It is the whole text of the nearest div, section or article around the first heading (or element of a
    class for names) that holds the name, whatever its case. people: page_id, name. A page is read once for all of its people."""
    asked = people.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_set("name"))).alias("url"))
    named = pages.drop("url").join(asked, "page_id").select("page_id", "url", "html")

    def walk(html, asked):
        import ahocorasick

        open_ = {}  # names that no heading has held yet, by lower case
        for name in json.loads(asked):
            open_.setdefault(name.lower(), []).append(name)
        finder = ahocorasick.Automaton()
        for name in open_:
            if name:
                finder.add_word(name, name)
        if not len(finder):
            return
        finder.make_automaton()
        for x in Walker(html).items:
            if x["tag"] in HEADINGS or NAME_CLASSES & set(x["attrs"].get("class", "").split()):
                for low in sorted({n for _, n in finder.iter(x["text"].lower())}):
                    box = x
                    while box and box["tag"] not in ("div", "section", "article"):
                        box = box["up"]
                    told = _squeeze(box["text"]) if box else ""
                    for name in open_.pop(low, []):
                        if told:
                            yield name, told

    return _page_job(named, walk, "name", "bio").drop("seq")


def contact_of_page(pages: DataFrame) -> DataFrame:
    """The first e-mail, LinkedIn profile and Twitter link of each page."""
    one = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    mail = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
    return pages.select("page_id", F.coalesce(one(f"mailto:{mail}"), one(mail)).alias("email"), one(f"({PROFILE})").alias("linkedin"), one(r"(https?://(?:www\.)?(?:twitter|x)\.com/[A-Za-z0-9_]+)").alias("twitter"))


def profile_urls(pages: DataFrame) -> DataFrame:
    """All different profile URLs in the text of a page."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)(https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+)"), F.lit(1))
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("link"))


def markdown_links(pages: DataFrame) -> DataFrame:
    """[text](url) links, then bare URLs that no link holds; in order."""
    md = r"\[([^\]]+)\]\(([^)\s]+)\)"
    text_of = F.regexp_extract_all("html", F.lit(md), F.lit(1))
    url_of = F.regexp_extract_all("html", F.lit(md), F.lit(2))
    pairs = F.posexplode(F.arrays_zip(text_of.alias("t"), url_of.alias("u")))
    a = pages.select("page_id", "url", pairs.alias("seq", "x")).select("page_id", "seq", urls.absolute(F.col("x.u"), F.col("url")).alias("link"), F.col("x.t").alias("text"))
    rest = F.regexp_replace("html", md, " ")
    b = pages.select("page_id", F.posexplode(F.regexp_extract_all(rest, F.lit(r"(https?://[^\s<>()\"']+)"), F.lit(1))).alias("seq", "link")).select("page_id", (F.col("seq") + 1_000_000).alias("seq"), "link", F.lit("").alias("text"))
    both = a.unionByName(b)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("seq"))).filter("_r = 1").drop("_r")


def next_page(pages: DataFrame) -> DataFrame:
    """The next page of a listing: rel=next, a link that says next, ?page=N+1 or /page/N+1 if the content names it."""
    rel = F.nullif(F.regexp_extract("html", r'rel="next"[^>]*href="([^"]+)"', 1), F.lit(""))
    rel2 = F.nullif(F.regexp_extract("html", r'href="([^"]+)"[^>]*rel="next"', 1), F.lit(""))
    said = F.nullif(F.regexp_extract("html", r'(?i)href="([^"]+)"[^>]*>\s*(?:next|next page|›|»)\s*<', 1), F.lit(""))
    md = F.nullif(F.regexp_extract("html", r"(?i)\[(?:next|next page|›|»)\]\(([^)\s]+)\)", 1), F.lit(""))
    n = F.coalesce(F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("int"), F.regexp_extract("url", r"/page/(\d+)", 1).try_cast("int"), F.lit(1)) + 1
    query = F.concat(F.lit("page="), n.cast("string"))
    path = F.concat(F.lit("/page/"), n.cast("string"))
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/page/\d+/?$", "")
    by_query = F.when(F.col("html").contains(query), F.concat(bare, F.lit("?"), query))
    by_path = F.when(F.col("html").contains(path), F.concat(F.regexp_replace(bare, "/$", ""), path))
    return pages.select("page_id", "url", F.coalesce(urls.absolute(F.coalesce(rel, rel2, said, md), F.col("url")), by_query, by_path).alias("next_url"))


def pagination_links(links: DataFrame) -> DataFrame:
    """Links to further pages: the link speaks of a page or team, and its text says next, more or page or it ends in a number; each
    once, where it stands first. links: page_id, href, link, txt, seq."""
    t = F.lower("txt")
    spoken = F.col("href").contains("page") | F.col("href").contains("team")
    further = t.contains("next") | t.contains("more") | t.contains("page") | F.col("href").rlike(r"page=\d+") | F.col("href").rlike(r"/\d+$")
    return links.filter(spoken & further).groupBy("page_id", "link").agg(F.min("seq").alias("seq"))


def own_site(pages: DataFrame) -> DataFrame:
    """On a directory's page of an entry: the first URL that is neither the directory's nor a platform's."""
    found = F.regexp_extract_all("html", F.lit(r"(https?://[^\s\"'<>()]+)"), F.lit(1))
    mine = urls.registered_domain(F.col("url"))
    return pages.select("page_id", F.get(F.filter(found, lambda x: (urls.registered_domain(x) != mine) & ~urls.skip(x)), F.lit(0)).alias("site"))


def company_profile(pages: DataFrame) -> DataFrame:
    """The company's LinkedIn page: the first anchor to one, else the first in a sameAs list of structured data, else made from the company's name.
    pages: page_id, company_name, html."""
    anchor = F.nullif(F.regexp_extract("html", r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*linkedin\.com/company/[^\"']*)[\"']", 1), F.lit(""))
    bare = F.regexp_replace(anchor, r"[?#].*$", "")
    whole = F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).when(~bare.startswith("http"), F.concat(F.lit("https://"), bare)).otherwise(bare)
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    same = F.transform(scripts, lambda x: F.coalesce(F.try_variant_get(F.try_parse_json(x), "$.sameAs", "array<string>"), F.array().cast("array<string>")))
    said = F.get(F.filter(F.flatten(same), lambda x: x.contains("linkedin.com/company/")), F.lit(0))
    made = F.concat(F.lit("https://www.linkedin.com/company/"), names.linkedin_slug(F.col("company_name")))
    return pages.select("page_id", F.coalesce(whole, said, made).alias("linkedin"), F.when(anchor.isNotNull(), "anchor").when(said.isNotNull(), "structured").otherwise("slug").alias("basis"))


def api_endpoints(pages: DataFrame) -> DataFrame:
    """Endpoints that scripts name, and the common ones of the site."""
    named = F.regexp_extract_all("html", F.lit(r"[\"'](/api/[A-Za-z0-9_/.-]+|https?://[^\"'\s]+/api/[^\"'\s]+)[\"']"), F.lit(1))
    common = F.transform(F.array(*map(F.lit, API_PATTERNS)), lambda p: F.concat(urls.origin(F.col("url")), p))
    every = F.array_distinct(F.concat(F.transform(named, lambda x: urls.absolute(x, F.col("url"))), common))
    return pages.select("page_id", F.explode(every).alias("endpoint"))


def json_people(payloads: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """Rows of a people list in a JSON text: the array at the top, or under data, team, people or members."""
    v = F.try_parse_json(F.col(body))
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$", *(f"$.{k}" for k in PEOPLE_KEYS))]
    rows = payloads.select(key, F.posexplode(F.coalesce(*lists)).alias("seq", "_x"))
    at = lambda *ps: F.coalesce(*(F.try_variant_get("_x", f"$.{p}", "string") for p in ps))
    return rows.select(key, "seq", at("name", "fullName").alias("name"), at("title", "role").alias("title"))


def known_directory(pages: DataFrame) -> DataFrame:
    h = urls.host(F.col("url"))
    return pages.select("page_id", F.exists(F.array(*map(F.lit, DIRECTORY_HOSTS)), lambda x: (h == x) | h.endswith(F.concat(F.lit("."), x))).alias("is_directory"))


def listing_entries(links: DataFrame, key: str = "page_id") -> DataFrame:
    """key, name, url, seq, pattern: the entries of a listing. Links under a prefix that is known already (column `known`, or null) if there are any; else those under the
    commonest path prefix, of equals the first seen, if it has three and 30 percent of the page's own links; else links to other sites if there are three. Names have 2 to 150
    characters, and links to platforms are none. links: key, url, link, txt, seq, known. pattern: the prefix that was used."""
    name, link = F.trim("txt"), F.regexp_replace("link", r"[.,;)>]+$", "")
    x = links.select(key, "url", "seq", "known", name.alias("name"), link.alias("link")).filter((F.length("name") >= 2) & (F.length("name") <= 150))
    x = cut(x, "named")  # read three times below, and pages are taken apart once
    x = x.filter(~F.coalesce(urls.skip(F.col("link")), F.lit(True)))
    own = F.coalesce(urls.host(F.col("link")) == urls.host(F.col("url")), F.lit(False))
    path = F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    first = F.nullif(F.regexp_extract(path, r"^/*([^/]+)/+[^/]", 1), F.lit(""))
    x = x.withColumns({"own": own, "path": path, "fits": F.coalesce(path.startswith(F.col("known")), F.lit(False)), "prefix": F.when(own & first.isNotNull(), F.concat(F.lit("/"), first, F.lit("/")))})
    totals = x.groupBy(key).agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_out"), F.count_if("fits").alias("n_known"))
    groups = x.filter("prefix IS NOT NULL").groupBy(key, "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    best = groups.join(totals, key).filter("n >= 3 AND n >= 0.3 * n_own").groupBy(key).agg(F.max_by("prefix", F.struct("n", -F.col("at"))).alias("best"))
    j = x.join(totals, key).join(best, key, "left")
    pattern = F.when(F.col("n_known") > 0, F.col("known")).otherwise(F.col("best"))
    inside = F.col("own") & F.col("path").startswith(F.col("best"))
    fit = F.when(F.col("n_known") > 0, F.col("fits")).when(F.col("best").isNotNull(), inside).otherwise(~F.col("own") & (F.col("n_out") >= 3))
    return j.filter(fit).select(key, "name", F.col("link").alias("url"), "seq", pattern.alias("pattern"))


def entry_key(url: Column) -> Column:
    """What two entries of one site share."""
    return F.regexp_replace(F.lower(url), "/$", "")


def directory_entries(links: DataFrame) -> DataFrame:
    """The entries of each HTML page, of equal URLs the first: page_id, name, url, seq."""
    got = listing_entries(links.withColumns({"known": F.lit(None).cast("string"), "txt": F.regexp_replace("txt", r"\s+", " ")}))
    return got.groupBy("page_id", entry_key(F.col("url")).alias("_k")).agg(F.min_by(F.struct("name", "url", "seq"), "seq").alias("_e")).select("page_id", "_e.*")


def firm_profile_links(site_pages: DataFrame, archive: DataFrame) -> DataFrame:
    """firm, link, source, page: the profiles that a firm's pages name, each from the first page that has it: its own pages in their order, then the pages of people
    to which its team page links, the first 20 of these links. site_pages: firm, base, url, place, is_team; archive: page_id, url, html."""
    own = site_pages.select("firm", "base", "url", "place", "is_team").join(archive, "url")
    href = F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("at", "href")
    spoken = reduce(lambda a, b: a | b, (F.col("href").contains(p) for p in BIO_PATHS))
    full = F.when(F.col("href").startswith("/"), F.concat("base", "href")).when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat("base", F.lit("/"), "href"))
    bios = own.filter("is_team").select("firm", "base", "place", href).filter(spoken).withColumn("url", full).filter((F.col("url") != F.col("base")) & (F.size(F.split("url", "/")) > 3))
    nth = F.row_number().over(Window.partitionBy("firm").orderBy("place", "at"))
    bios = bios.withColumn("nth", nth).filter(F.col("nth") <= BIO_PAGES).groupBy("firm", "url").agg(F.min("nth").alias("nth"))
    order = own.select("firm", "url", F.struct(F.lit(0).alias("kind"), "place").alias("o")).unionByName(bios.select("firm", "url", F.struct(F.lit(1).alias("kind"), F.col("nth").alias("place")).alias("o")))
    seen = archive.join(order.select("url").distinct(), "url", "left_semi")
    found = profile_links(seen).select("page_id", "link", "source", "seq").join(seen.select("page_id", "url"), "page_id")
    got = order.join(found, "url").groupBy("firm", "link").agg(F.min_by(F.struct("source", F.col("url").alias("page")), F.struct("o", "seq", "url")).alias("_f"))
    return got.select("firm", "link", "_f.*")
