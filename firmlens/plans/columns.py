"""Queries of the column functions: names, URLs, text, classes, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import dims, names, text, urls
from firmlens.plans.fixtures import view, with_views
from firmlens.plans.registry import query

_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower(trim(name))), '\s+', ' ', 'g'), '[^a-z0-9\s\-'']', '', 'g'))"
_SPACED = r"regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g')), '\s+', ' ', 'g')"
_PARTS = r"list_filter(regexp_split_to_array(trim(name), '\s+'), lambda x: x <> '')"


@query(f"""{with_views('members')} SELECT member_id, {_KEY} AS person_key, regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g'), '\\s+', '-', 'g') AS hyphen_key, {_SPACED} AS spaced_key,
    {_PARTS}[1] AS first, CASE WHEN len({_PARTS}) > 2 THEN array_to_string({_PARTS}[2:-2], ' ') ELSE '' END AS middle, CASE WHEN len({_PARTS}) > 1 THEN {_PARTS}[-1] ELSE '' END AS last,
    trim(regexp_replace(regexp_replace(lower(vc_firm), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS firm_slug FROM members""")
def name_keys(spark, d) -> DataFrame:
    """I3, I4, I5, I16."""
    n = F.col("name")
    return view(spark, d, "members").select("member_id", names.person_key(n).alias("person_key"), names.hyphen_key(n).alias("hyphen_key"), names.spaced_key(n).alias("spaced_key"), *(c.alias(k) for k, c in names.parts(n).items()), names.company_slug(F.col("vc_firm")).alias("firm_slug"))


@query(f"""{with_views('members')}, k AS (SELECT *, {_KEY} AS pk FROM members), s AS (SELECT *, CASE WHEN len(string_split(pk, ' ')) = 2 THEN array_to_string(list_sort(string_split(pk, ' ')), ' ') ELSE pk END AS sk FROM k)
    SELECT firm_id, sk AS same_key, count(*) AS records, min(member_id) AS first_member FROM s GROUP BY ALL HAVING count(*) > 1""")
def same_person(spark, d) -> DataFrame:
    """Records of one person in a firm, by canonical key."""
    m = view(spark, d, "members").withColumn("same_key", names.same_person_key(F.col("name")))
    return m.groupBy("firm_id", "same_key").agg(F.count(F.lit(1)).alias("records"), F.min("member_id").alias("first_member")).filter("records > 1")


_H = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_O = r"nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), '')"
_P = r"(CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)', 2) = '' THEN '/' ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)', 2) END)"
_PLATFORM = " OR ".join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in dims.SKIP_DOMAINS)


@query(f"""SELECT page_id, regexp_replace(CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'https://' || trim(url) END, '/$', '') AS with_scheme,
    lower(regexp_replace({_O} || {_P}, '/$', '')) AS origin_path, regexp_replace(url, '[?#].*$', '') AS without_query, {_O} || {_P} AS same_host,
    array_to_string(list_slice(string_split({_H}, '.'), -2, -1), '.') AS registered_domain FROM pages""")
def url_forms(spark, d) -> DataFrame:
    """I6, I9."""
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.with_scheme(u).alias("with_scheme"), urls.origin_path_lower(u).alias("origin_path"), urls.without_query(u).alias("without_query"), urls.same_host(u, u).alias("same_host"), urls.registered_domain(u).alias("registered_domain"))


@query(f"""WITH x AS (SELECT page_id, url, {_H} AS h, {_P} AS p FROM pages) SELECT page_id, length(url) > 500 OR regexp_matches(h, '^(img|cdn|static|assets|media|images|s3|files|r|go|redirect|track|click|out)\\.') OR starts_with(p, '/redirect') OR starts_with(p, '/go/') OR starts_with(p, '/out/') OR {_PLATFORM} AS skipped FROM x""")
def skip_urls(spark, d) -> DataFrame:
    """I10."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.skip(F.col("url")).alias("skipped"))


@query(f"""{with_views('firms')}, u AS (SELECT firm_id, website_url AS url FROM firms WHERE starts_with(website_url, 'http')), v AS (SELECT firm_id, unnest(list_distinct([url, regexp_replace(url, '^(https?://)www\\.', '\\1'), regexp_replace(regexp_replace(url, '^(https?://)www\\.', '\\1'), '^(https?://)', '\\1www.'), regexp_replace(url, '^http://', 'https://')])) AS variant FROM u) SELECT * FROM v""")
def host_variants(spark, d) -> DataFrame:
    """I8."""
    return view(spark, d, "firms").filter(F.col("website_url").startswith("http")).select("firm_id", F.explode(urls.host_variants(F.col("website_url"))).alias("variant"))


_LINKS = r"""l AS (SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS txt, i AS seq FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*<')) AS a, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*<'), 1) AS i FROM pages))"""
_ABS = r"""(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href WHEN starts_with(href, '/') THEN o || href ELSE regexp_replace(o || p, '[^/]*$', '') || href END)"""
_ABSOLUTE = f"ab AS (SELECT page_id, url, txt, seq, {_ABS} AS link FROM (SELECT *, {_O} AS o, {_P} AS p FROM l))"
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(link), '{'|'.join(u)}') OR regexp_matches(lower(txt), '{'|'.join(t)}') THEN '{n}'" for n, _, u, t in dims.PAGE_CATEGORIES) + " ELSE 'other' END"
_PRI = "CASE cat " + " ".join(f"WHEN '{n}' THEN {p}" for n, p, _, _ in dims.PAGE_CATEGORIES) + " ELSE 5 END"


def links(spark, d) -> DataFrame:
    """(page_id, url, link, text, seq, href) of a page's links, absolute, and as they are written."""
    return page_anchors(spark.read.parquet(f"{d}/pages.parquet"))


def page_anchors(pages: DataFrame) -> DataFrame:
    anchors = F.posexplode(F.regexp_extract_all("html", F.lit(r'(<a [^>]*href="[^"]*"[^>]*>[^<]*<)'), F.lit(1)))
    a = pages.select("page_id", "url", anchors.alias("seq", "_a"))
    href = F.regexp_extract("_a", r'href="([^"]*)"', 1)
    return a.select("page_id", "url", urls.absolute(href, F.col("url")).alias("link"), F.trim(F.regexp_extract("_a", ">([^<]*)<", 1)).alias("txt"), (F.col("seq") + 1).alias("seq"), href.alias("href"))


@query(f"WITH {_LINKS}, {_ABSOLUTE}, c AS (SELECT *, {_CAT} AS cat FROM ab), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY seq) AS r FROM c) SELECT page_id, link, txt AS text, cat AS category, {_PRI} AS priority, seq FROM f WHERE r = 1")
def page_links(spark, d) -> DataFrame:
    """Links of each page, first text of each, with category and priority."""
    first = links(spark, d).withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("seq"))).filter("_r = 1")
    return first.select("page_id", "link", F.col("txt").alias("text"), urls.category(F.col("link"), F.col("txt")).alias("category"), urls.category_priority(F.col("link"), F.col("txt")).alias("priority"), "seq")


_CAPS = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.CATEGORY_CAPS.items()) + " END"


@query(f"WITH {_LINKS}, {_ABSOLUTE}, c AS (SELECT *, {_CAT} AS category FROM ab), f AS (SELECT page_id, link, category, min(seq) AS seq FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY seq, link) AS place FROM f) SELECT page_id, category, link, place FROM k WHERE place <= {_CAPS}")
def capped_links(spark, d) -> DataFrame:
    """the first links of each category, as many as its cap."""
    f = links(spark, d).withColumn("category", urls.category(F.col("link"), F.col("txt"))).groupBy("page_id", "link", "category").agg(F.min("seq").alias("seq"))
    caps = F.create_map(*(F.lit(x) for kv in dims.CATEGORY_CAPS.items() for x in kv))
    k = f.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "category").orderBy("seq", "link")))
    return k.filter(F.col("place") <= F.element_at(caps, F.col("category"))).select("page_id", "category", "link", "place")


@query(f"WITH {_LINKS}, {_ABSOLUTE}, c AS (SELECT *, {_CAT} AS category FROM ab) SELECT category, count(*) AS links, count(DISTINCT page_id) AS on_pages FROM c GROUP BY category")
def link_counts(spark, d) -> DataFrame:
    """E24."""
    return links(spark, d).groupBy(urls.category(F.col("link"), F.col("txt")).alias("category")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("on_pages"))


@query(f"WITH {_LINKS}, {_ABSOLUTE}, x AS (SELECT page_id, regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]*)', 1) AS prefix FROM ab WHERE {_H.replace('url', 'link')} = {_H}), g AS (SELECT page_id, prefix, count(*) AS n, sum(count(*)) OVER (PARTITION BY page_id) AS total FROM x GROUP BY page_id, prefix), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, prefix) AS r FROM g) SELECT page_id, prefix, n, CAST(total AS BIGINT) AS total, n >= 3 AND n >= 0.3 * total AS dominant FROM r WHERE r = 1")
def dominant_prefix(spark, d) -> DataFrame:
    """The commonest first path segment of a page's own links."""
    x = links(spark, d).filter(urls.host(F.col("link")) == urls.host(F.col("url"))).withColumn("prefix", F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]*)", 1))
    g = x.groupBy("page_id", "prefix").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("page_id")
    r = g.withColumns({"total": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), "prefix"))}).filter("_r = 1")
    return r.select("page_id", "prefix", "n", "total", ((F.col("n") >= 3) & (F.col("n") >= 0.3 * F.col("total"))).alias("dominant"))


_VISIBLE = "html"
for _t in ("script", "style", "nav", "header", "footer"):
    _VISIBLE = rf"regexp_replace({_VISIBLE}, '(?is)<{_t}[\s>].*?</{_t}>', ' ', 'g')"
_VISIBLE = rf"trim(regexp_replace(regexp_replace({_VISIBLE}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH v AS (SELECT page_id, html, {_VISIBLE} AS t FROM pages) SELECT page_id, length(t) AS visible_chars, md5(t) AS digest, contains(html, '<html') AS is_html, length(t) >= 200 AND NOT regexp_matches(lower(t), 'checking your browser|captcha|access denied') AS usable FROM v")
def visible_text(spark, d) -> DataFrame:
    """I26, I31, C8."""
    v = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html", text.visible_text(F.col("html")).alias("_t"))
    usable = (F.length("_t") >= 200) & ~F.lower("_t").rlike("checking your browser|captcha|access denied")
    return v.select("page_id", F.length("_t").alias("visible_chars"), F.md5("_t").alias("digest"), F.col("html").contains("<html").alias("is_html"), usable.alias("usable"))


@query(rf"WITH e AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}})', 1), lambda x: lower(x)))) AS email FROM documents) SELECT doc_id, email FROM e WHERE NOT regexp_matches(string_split(email, '@')[1], '^({'|'.join(dims.GENERIC_MAILBOXES)})($|\.)')")
def document_emails(spark, d) -> DataFrame:
    """Personal addresses of each text."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


@query(f"""WITH c AS (SELECT doc_id, length(text) AS n, s AS start_at, substr(text, s + 1, 15000) AS c FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 15000 THEN [0] ELSE range(0, length(text), 14500) END) AS s FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, start_at, length(c) AS chars, md5(c) AS digest FROM c WHERE n <= 15000 OR length(trim(c, {" || ".join(f"chr({ord(x)})" for x in text.SPACES)})) >= 100""")
def chunks(spark, d) -> DataFrame:
    """Overlapping chunks of 15000 characters, 500 of them shared, tiny ones dropped; a text that fits one is taken whole; contents as a digest."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    c = docs.select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.start_at", F.length("c.chunk").alias("chars"), F.md5("c.chunk").alias("digest"))


_ERR = "CASE " + " ".join(f"WHEN regexp_matches(lower(error_detail), '{p}') THEN '{n}'" for n, p in dims.ERRORS) + " ELSE 'unknown' END"


@query(f"{with_views('job_logs')} SELECT {_ERR} AS error_class, count(*) AS n FROM job_logs WHERE error_detail IS NOT NULL GROUP BY 1")
def error_classes(spark, d) -> DataFrame:
    """I24, in the job log; site_check_errors and verification_errors have the other two."""
    return view(spark, d, "job_logs").filter("error_detail IS NOT NULL").groupBy(text.error_class(F.col("error_detail")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{with_views('members')} SELECT member_id, l AS label, CASE l WHEN 'High' THEN 90 WHEN 'Medium' THEN 60 ELSE 30 END AS confidence FROM (SELECT member_id, CASE WHEN length(linkedin_url) > 0 THEN 'High' WHEN length(email) > 0 THEN 'Medium' ELSE 'Low' END AS l FROM members)")
def member_confidence(spark, d) -> DataFrame:
    """I22."""
    label = text.member_confidence(F.col("linkedin_url"), F.col("email"))
    return view(spark, d, "members").select("member_id", label.alias("label"), text.confidence_number(label).alias("confidence"))


@query(f"{with_views('firms')} SELECT firm_id, substr(regexp_replace(lower(investor_type), '[^a-z0-9_]', '_', 'g'), 1, 40) AS section_key, to_json(string_split(investment_niches, ', ')) AS niches_json, CASE WHEN regexp_matches(investment_niches, '[,\"\n]') THEN '\"' || replace(investment_niches, '\"', '\"\"') || '\"' ELSE investment_niches END AS csv, list_contains(list_transform(string_split(investment_niches, ','), lambda x: trim(x)), 'SaaS') AS has_saas FROM firms")
def field_forms(spark, d) -> DataFrame:
    """Section keys, JSON lists, quoting, array tests."""
    n = F.col("investment_niches")
    return view(spark, d, "firms").select("firm_id", text.section_key(F.col("investor_type")).alias("section_key"), F.to_json(F.split(n, ", ")).alias("niches_json"), text.csv_field(n).alias("csv"), F.array_contains(F.transform(F.split(n, ","), lambda x: F.trim(x)), "SaaS").alias("has_saas"))


@query(f"""{with_views('jobs')}, e AS (SELECT job_id, firm_count AS n, (500+1500+1500+2000+1800+(3000+8000)*1.25::DOUBLE) AS i, (50+100+100+100+90+(800+1500)*1.25::DOUBLE) AS o, greatest(firm_count * 6 / (1000 / 60), ceil(firm_count / 50) * 25) AS s FROM jobs)
    SELECT job_id, CAST(floor(i * n + 0.5) AS BIGINT) AS input_tokens, CAST(floor(o * n + 0.5) AS BIGINT) AS output_tokens, round((i / 1e6 * 0.15 + o / 1e6 * 0.6) * n, 6) AS cost,
    CASE WHEN s >= 3600 THEN CAST(floor(s / 3600) AS INT) || 'h ' || CAST(floor(s % 3600 / 60) AS INT) || 'm' WHEN s >= 60 THEN CAST(floor(s / 60) AS INT) || 'm' ELSE '<1m' END AS duration FROM e""")
def cost_estimate(spark, d) -> DataFrame:
    """Tokens, cost and duration of every job, for descriptions of 250 characters on average."""
    from firmlens.operators.jobs import estimate

    return estimate(view(spark, d, "jobs"), F.lit(250.0)).select("job_id", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"), "duration")


@query("SELECT substr(lang, 1, 2) AS lang, avg(length(text)) AS avg_chars, count(*) AS n FROM documents GROUP BY 1")
def description_length(spark, d) -> DataFrame:
    """E23."""
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(F.substring("lang", 1, 2).alias("lang")).agg(F.avg(F.length("text")).alias("avg_chars"), F.count(F.lit(1)).alias("n"))


#: Plans of up to 19 sections by order, the same text for both engines but for how a struct is made.
_PLANNED = "CASE WHEN i % 9 = 0 THEN '' ELSE concat(o_orderpriority, ' Fünd', CAST(i AS STRING), CASE WHEN i % 4 = 0 THEN ' and a name of the field that is far too long' ELSE '' END) END"
_LABEL = "CASE WHEN i % 7 = 0 THEN '' WHEN i % 5 = 0 THEN NULL ELSE concat('Label ', CAST(i AS STRING)) END"


@query(f"""WITH s AS (SELECT o_orderkey AS job_id, o_orderpriority, unnest(range(1, o_orderkey % 20 + 1)) AS i FROM orders), k AS (SELECT job_id, i, substr(regexp_replace(lower({_PLANNED}), '[^a-z0-9_]', '_', 'g'), 1, 40) AS key, coalesce({_LABEL}, 'Section') AS label FROM s WHERE i <= 15)
    SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY i) AS INTEGER) AS place, key, label FROM k WHERE key <> '' AND label <> ''""")
def agent_sections(spark, d) -> DataFrame:
    """The sections of each job's plan, 15 at most, with clean keys."""
    o = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 20 > 0")
    made = F.expr(f"transform(sequence(1, CAST(o_orderkey % 20 AS INT)), i -> named_struct('key', {_PLANNED}, 'label', {_LABEL}, 'desc', ''))")
    got = o.select(F.col("o_orderkey").alias("job_id"), F.posexplode(text.sections(made)).alias("at", "s"))
    return got.select("job_id", (F.col("at") + 1).alias("place"), "s.key", "s.label")
