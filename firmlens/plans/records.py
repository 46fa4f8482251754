"""Queries of deduplication, merging, matching, ingest, export and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import dims, names, text, urls
from firmlens.operators import dedupe, explore, match, pages
from firmlens.operators.shared import cut
from firmlens.plans.columns import _ABS, _ABSOLUTE, _CAT, _H, _KEY, _LINKS, _O, _P, _PRI, _VISIBLE, links
from firmlens.plans.fixtures import view, with_views
from firmlens.plans.registry import query
from firmlens.sources import export, firm_list

_K = f"k AS (SELECT *, {_KEY} AS pk FROM members)"


@query(f"""{with_views('members')}, {_K} SELECT firm_id, pk AS person_key, min_by(nullif(title, ''), member_id) FILTER (title <> '') AS title, min_by(linkedin_url, member_id) FILTER (linkedin_url <> '') AS linkedin_url, min_by(email, member_id) FILTER (email <> '') AS email, min_by(specialization, member_id) FILTER (specialization <> '') AS specialization, count(*) AS records, min(member_id) AS first_seq FROM k GROUP BY firm_id, pk""")
def merged_people(spark, d) -> DataFrame:
    """K2, K3, H3: one record for each person of a firm, of each field the first value that isn't empty."""
    m = view(spark, d, "members").withColumn("person_key", names.person_key(F.col("name"))).withColumn("_key", F.struct("firm_id", "person_key"))
    return dedupe.merge_records(m, "_key", "member_id", ["title", "linkedin_url", "email", "specialization"]).select("_key.*", "title", "linkedin_url", "email", "specialization", "records", "first_seq")


@query(f"""{with_views('members')}, {_K}, f AS (SELECT *, row_number() OVER (PARTITION BY firm_id, pk ORDER BY member_id) AS r, row_number() OVER (PARTITION BY firm_id, pk ORDER BY member_id DESC) AS l, min(member_id) OVER (PARTITION BY firm_id, pk) AS q FROM k)
    SELECT 'first' AS rule, firm_id, pk AS person_key, member_id, title, q AS first_seq FROM f WHERE r = 1 UNION ALL SELECT 'last', firm_id, pk, member_id, title, q FROM f WHERE l = 1""")
def dedupe_rules(spark, d) -> DataFrame:
    """The first record wins, or the last one at the first one's place."""
    m = view(spark, d, "members").withColumn("person_key", names.person_key(F.col("name"))).withColumn("key", F.struct("firm_id", "person_key")).withColumn("seq", F.col("member_id"))
    a = dedupe.first_wins(m, "key", "seq").select(F.lit("first").alias("rule"), "key.*", "member_id", "title", F.col("seq").alias("first_seq"))
    b = dedupe.last_value_wins(m.select("key", "member_id", "title", "seq"), "key", "seq").select(F.lit("last").alias("rule"), "key.*", "member_id", "title", "first_seq")
    return a.unionByName(b)


@query(f"""{with_views('firms', 'portfolio')}, p AS (SELECT firm_id, list_distinct(list_transform(flatten(list(string_split(investment_niche, ',') ORDER BY company_id)), lambda x: trim(x))) AS l FROM portfolio GROUP BY firm_id)
    SELECT f.firm_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(list_transform(string_split(investment_niches, ','), lambda x: trim(x)), coalesce(l, []))), lambda x: x <> '')), '|') AS niches FROM firms f LEFT JOIN p USING (firm_id)""")
def niche_union(spark, d) -> DataFrame:
    """H1, H2: niches of the firm and of its portfolio as one set."""
    p = view(spark, d, "portfolio").groupBy("firm_id").agg(F.flatten(F.collect_list(F.split("investment_niche", ","))).alias("_l"))
    both = dedupe.union_lists(F.split("investment_niches", ","), F.coalesce("_l", F.array().cast("array<string>")))
    return view(spark, d, "firms").join(p, "firm_id", "left").select("firm_id", F.array_join(F.array_sort(both), "|").alias("niches"))


@query(f"WITH {_LINKS}, {_ABSOLUTE}, l2 AS (SELECT DISTINCT link FROM ab), v AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS link FROM pages) SELECT link FROM l2 WHERE link NOT IN (SELECT link FROM v)")
def unvisited_links(spark, d) -> DataFrame:
    """H4: links that no archived page has."""
    seen = spark.read.parquet(f"{d}/pages.parquet").select(urls.without_query(F.col("url")).alias("link"))
    return links(spark, d).select("link").distinct().join(seen, "link", "left_anti")


@query(f"{with_views('members')}, e AS (SELECT firm_id AS page_id, lower(regexp_replace(name, '\\s+', '.', 'g')) || '@example.com' AS email, member_id AS seq FROM members), m AS (SELECT firm_id AS page_id, member_id, list_filter(regexp_split_to_array(trim(lower(name)), '\\s+'), lambda x: x <> '') AS p FROM members), n AS (SELECT page_id, member_id, p[1] AS f, CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS l FROM m), j AS (SELECT n.*, e.email, e.seq, string_split(e.email, '@')[1] AS lp FROM n JOIN e USING (page_id)) SELECT page_id, member_id, min_by(email, seq) AS email FROM j WHERE (contains(lp, f) AND contains(lp, l)) OR lp = f OR lp = f || '.' || l OR lp = f || l OR lp = substr(f, 1, 1) || l GROUP BY ALL")
def email_matches(spark, d) -> DataFrame:
    """D11."""
    m = view(spark, d, "members")
    e = m.select(F.col("firm_id").alias("page_id"), F.concat(F.lower(F.regexp_replace("name", r"\s+", ".")), F.lit("@example.com")).alias("email"), F.col("member_id").alias("seq"))
    return match.email_of_member(m.select(F.col("firm_id").alias("page_id"), "member_id", "name"), e)


@query(f"""{with_views('members')}, u AS (SELECT firm_id AS page_id, 'https://www.linkedin.com/in/' || regexp_replace(lower(name), '[^a-z]+', '-', 'g') AS url, CASE WHEN member_id % 3 = 0 THEN name || ', ' || title ELSE '' END AS context, member_id AS seq FROM members),
    m AS (SELECT firm_id AS page_id, member_id, list_filter(regexp_split_to_array(trim(lower(trim(name))), '\\s+'), lambda x: x <> '') AS p FROM members), n AS (SELECT page_id, member_id, regexp_replace(p[1], '[^a-z]', '', 'g') AS f, regexp_replace(CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END, '[^a-z]', '', 'g') AS l FROM m),
    j AS (SELECT n.*, url, seq, lower(context) AS c, lower(regexp_extract(url, '/in/([^/?#]+)', 1)) AS s FROM n JOIN u USING (page_id)), k AS (SELECT *, CASE WHEN contains(c, f) AND contains(c, l) THEN 1 WHEN s = f || '-' || l OR s = f || l OR s = substr(f, 1, 1) || '-' || l THEN 2 END AS method FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, member_id ORDER BY method, seq) AS r FROM k WHERE method IS NOT NULL) SELECT page_id, member_id, url, CASE method WHEN 1 THEN 'High' ELSE 'Medium' END AS confidence FROM r WHERE r = 1""")
def profile_matches(spark, d) -> DataFrame:
    """The best profile of each member over all methods."""
    m = view(spark, d, "members")
    u = m.select(F.col("firm_id").alias("page_id"), F.concat(F.lit("https://www.linkedin.com/in/"), F.regexp_replace(F.lower("name"), "[^a-z]+", "-")).alias("url"), F.when(F.col("member_id") % 3 == 0, F.concat("name", F.lit(", "), "title")).otherwise("").alias("context"), F.col("member_id").alias("seq"))
    return match.profile_of_member(m.select(F.col("firm_id").alias("page_id"), "member_id", "name"), u)


#: Letters of the first and last part of a name, by page.
NAMED = r"""nm AS (SELECT firm_id AS page_id, member_id, regexp_replace(p[1], '[^a-z]', '', 'g') AS f, regexp_replace(CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END, '[^a-z]', '', 'g') AS l
    FROM (SELECT *, list_filter(regexp_split_to_array(trim(lower(trim(name))), '\s+'), lambda x: x <> '') AS p FROM members))"""
#: The greedy order itself, member after member: u has page_id, url, near, context, seq.
GREEDY = r"""cand AS MATERIALIZED (SELECT *, CASE WHEN contains(nt, f) AND contains(nt, l) THEN 1 WHEN contains(ct, f) AND contains(ct, l) THEN 2 WHEN contains(slug, f) AND contains(slug, l) THEN 3
      WHEN l <> '' AND regexp_matches(slug, '^[a-z]-') AND contains(slug, l) AND substr(slug, 1, 1) = substr(f, 1, 1) THEN 4 END AS rank FROM (SELECT nm.*, url, seq, lower(near) AS nt, lower(context) AS ct, lower(regexp_extract(url, '/in/([^/?#]+)', 1)) AS slug FROM nm JOIN u USING (page_id) WHERE f <> '')),
    l AS MATERIALIZED (SELECT page_id, member_id, row_number() OVER (PARTITION BY page_id ORDER BY member_id) AS i, urls FROM (SELECT page_id, member_id, list(url ORDER BY rank, seq) AS urls FROM cand WHERE rank IS NOT NULL GROUP BY ALL)),
    r AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS member_id, CAST(NULL AS VARCHAR) AS url FROM l
      UNION ALL SELECT page_id, i, list_append(taken, pick), member_id, pick FROM (SELECT l.page_id, l.i, r.taken, l.member_id, list_filter(l.urls, lambda x: NOT list_contains(r.taken, x))[1] AS pick FROM r JOIN l ON l.page_id = r.page_id AND l.i = r.i + 1))
    SELECT r.page_id, r.member_id, r.url, CASE min(rank) WHEN 1 THEN 'High' WHEN 4 THEN 'Low' ELSE 'Medium' END AS confidence FROM r JOIN cand USING (page_id, member_id, url) GROUP BY ALL"""


@query(f"""{with_views('members').replace('WITH', 'WITH RECURSIVE')}, {NAMED}, u AS (SELECT firm_id AS page_id, 'https://www.linkedin.com/in/' || regexp_replace(lower(name), '[^a-z]+', '-', 'g') || '-' || member_id AS url, name AS near, name || ' ' || title AS context, member_id AS seq FROM members), {GREEDY}""")
def assigned_profiles(spark, d) -> DataFrame:
    """Greedy and one to one within a page."""
    m = view(spark, d, "members")
    u = m.select(F.col("firm_id").alias("page_id"), F.concat(F.lit("https://www.linkedin.com/in/"), F.regexp_replace(F.lower("name"), "[^a-z]+", "-"), F.lit("-"), "member_id").alias("url"), F.col("name").alias("near"), F.concat("name", F.lit(" "), "title").alias("context"), F.col("member_id").alias("seq"))
    return match.assign_profiles(m.select(F.col("firm_id").alias("page_id"), "member_id", "name"), u)


@query(f"""{with_views('members')}, s AS (SELECT firm_id, member_id, name, {_KEY.replace("strip_accents(lower(trim(name)))", "lower(name)")} AS z, regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g')), '\\s+', ' ', 'g') AS x FROM members), q AS (SELECT *, list_filter(string_split(x, ' '), lambda y: y <> '') AS p FROM s), w AS (SELECT *, coalesce(p[1], '') AS f, CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS l FROM q)
    SELECT a.firm_id, a.member_id AS a, b.member_id AS b FROM w a JOIN w b ON a.firm_id = b.firm_id AND a.member_id < b.member_id WHERE a.x = b.x OR (a.f = b.f AND a.l = b.l) OR ((contains(a.x, b.x) OR contains(b.x, a.x)) AND least(length(a.x), length(b.x)) >= 4)""")
def name_variations(spark, d) -> DataFrame:
    """Members of a firm whose names are variations of each other."""
    return match.name_variations(view(spark, d, "members").select("firm_id", "member_id", "name"))


@query(f"{with_views('members')}, e AS (SELECT firm_id, upper(substr(name, 1, 8)) AS employee FROM members) SELECT m.firm_id, m.member_id, e.employee FROM members m JOIN e USING (firm_id) WHERE contains(lower(name), lower(employee)) OR contains(lower(employee), lower(name))")
def employee_matches(spark, d) -> DataFrame:
    """The outside list has the first letters of every member's name."""
    m = view(spark, d, "members")
    return match.external_employees(m, m.select("firm_id", F.upper(F.substring("name", 1, 8)).alias("employee")))


@query(f"""{with_views('members', 'portfolio')}, t AS (SELECT p.firm_id, p.company_id, CASE p.company_id % 4 WHEN 0 THEN 'Round led by ' WHEN 1 THEN 'An Investment of ' WHEN 2 THEN 'At dinner: ' ELSE 'LED BY ' END || string_agg(m.name, ' and ' ORDER BY m.member_id) AS text
      FROM portfolio p JOIN members m ON m.firm_id = p.firm_id AND m.member_id % 10 = p.company_id % 10 GROUP BY p.firm_id, p.company_id)
    SELECT m.firm_id, m.member_id, t.company_id FROM members m JOIN t USING (firm_id) WHERE contains(lower(text), lower(name)) AND (contains(lower(text), 'led') OR contains(lower(text), 'investment'))""")
def led_investments(spark, d) -> DataFrame:
    """A text for each company names some people of the firm, in one of four ways."""
    m, p = view(spark, d, "members"), view(spark, d, "portfolio")
    told = p.join(m, (p["firm_id"] == m["firm_id"]) & (m["member_id"] % 10 == p["company_id"] % 10)).groupBy(p["firm_id"], "company_id").agg(F.array_sort(F.collect_list(F.struct("member_id", "name"))).alias("x"))
    start = F.when(F.col("company_id") % 4 == 0, "Round led by ").when(F.col("company_id") % 4 == 1, "An Investment of ").when(F.col("company_id") % 4 == 2, "At dinner: ").otherwise("LED BY ")
    return match.led_investments(m.select("firm_id", "member_id", "name"), told.select("firm_id", "company_id", F.concat(start, F.array_join("x.name", " and ")).alias("text")))


@query(f"""{with_views('members', 'portfolio')}, l AS (SELECT m.member_id AS person, trim(u.x) AS label, p.company_id % 7 AS confidence, p.company_id * 10 + u.i AS seq FROM members m JOIN portfolio p ON m.firm_id = p.firm_id AND m.member_id % 10 = p.company_id % 10 JOIN (SELECT company_id AS cid, unnest(string_split(investment_niche, ',')) AS x, generate_subscripts(string_split(investment_niche, ','), 1) - 1 AS i FROM portfolio) u ON u.cid = p.company_id WHERE trim(u.x) <> ''),
    c AS (SELECT person, label, count(*) AS n FROM l GROUP BY ALL), many AS (SELECT person, label FROM c WHERE n >= 2), b AS (SELECT *, rank() OVER (PARTITION BY person ORDER BY confidence DESC, seq) AS r FROM l)
    SELECT person, label, 'repeated' AS basis FROM many UNION ALL SELECT person, label, 'single' FROM b WHERE r = 1 AND person NOT IN (SELECT person FROM many)""")
def cross_validated(spark, d) -> DataFrame:
    """E25."""
    m, p = view(spark, d, "members"), view(spark, d, "portfolio")
    j = m.join(p, (m["firm_id"] == p["firm_id"]) & (m["member_id"] % 10 == p["company_id"] % 10)).select(m["member_id"].alias("person"), "company_id", F.posexplode(F.split("investment_niche", ",")).alias("i", "label"))
    rows = j.select("person", F.trim("label").alias("label"), (F.col("company_id") % 7).alias("confidence"), (F.col("company_id") * 10 + F.col("i")).alias("seq")).filter("label <> ''")
    return match.cross_validated(rows)


def _nick_sql() -> str:
    rows, seen = [], set()
    for i, (k, vs) in enumerate(dims.NICKNAMES.items()):
        rows += [(k, v, i, j) for j, v in enumerate(vs)]
    for i, (k, vs) in enumerate(dims.NICKNAMES.items()):
        for v in vs:
            if v not in seen and v not in dims.NICKNAMES:
                seen.add(v)
                rows.append((v, k, i, 0))
    return "nick(name, variant, ord, pos) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {e})" for a, b, c, e in rows) + ")"


_FULL = "CASE c_custkey % 4 WHEN 0 THEN 'Robert Q' WHEN 1 THEN 'Chris' WHEN 2 THEN 'Kate Ann Maria' ELSE 'Ann' END || ' Smith' || CAST(c_custkey % 50 AS STRING)"


@query(f"""WITH {_nick_sql()}, p AS (SELECT c_custkey AS member_id, {_FULL} AS name FROM customer), s AS (SELECT member_id, string_split(lower(name), ' ') AS w FROM p), b AS (SELECT member_id, w[1] AS first, CASE WHEN len(w) > 2 THEN w[2:-2] ELSE [] END AS mid, w[-1] AS last FROM s),
    n AS (SELECT * FROM nick WHERE ord = (SELECT min(ord) FROM nick x WHERE x.name = nick.name)), r AS (SELECT member_id, mid, last, first AS f, 0 AS v FROM b UNION ALL SELECT member_id, mid, last, variant, pos + 1 FROM b JOIN n ON n.name = b.first),
    c AS (SELECT member_id, v, list_concat(list_concat([{{'s': f || '-' || last, 'c': CASE WHEN v > 0 THEN 'Medium' ELSE 'High' END, 'm': 'first-last'}}, {{'s': f || last, 'c': 'Medium', 'm': 'firstlast'}}, {{'s': f || '.' || last, 'c': 'Low', 'm': 'first.last'}}, {{'s': substr(f, 1, 1) || '-' || last, 'c': 'Low', 'm': 'f-last'}}],
      flatten(list_transform(mid, lambda x: [{{'s': f || '-' || x || '-' || last, 'c': 'Medium', 'm': 'first-middle-last'}}, {{'s': f || '-' || substr(x, 1, 1) || '-' || last, 'c': 'Medium', 'm': 'first-m-last'}}]))), [{{'s': f || '-' || last || '-1', 'c': 'Low', 'm': 'first-last-1'}}, {{'s': f || '-' || last || '-2', 'c': 'Low', 'm': 'first-last-2'}}, {{'s': f || '-' || last || '-3', 'c': 'Low', 'm': 'first-last-3'}}]) AS l FROM r),
    e AS (SELECT member_id, v * 100 + generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS x FROM c), k AS (SELECT member_id, seq, x.s AS s, x.c AS c, x.m AS m, row_number() OVER (PARTITION BY member_id, x.s ORDER BY seq) AS r FROM e)
    SELECT member_id, 'https://www.linkedin.com/in/' || s AS url, c AS confidence, m AS method, seq FROM k WHERE r = 1""")
def profile_candidates(spark, d) -> DataFrame:
    """URLs that profiles may have."""
    people = spark.sql(f"SELECT c_custkey AS member_id, {_FULL} AS name FROM {{customer}}", customer=spark.read.parquet(f"{d}/customer.parquet"))
    return match.profile_candidates(people, dims.nicknames(spark))


_SITE = "CASE WHEN website_url LIKE '%@%' THEN website_url WHEN firm_id % 10 = 3 THEN 'info@firm.example' ELSE website_url END"


@query(f"""{with_views('firms')}, r AS (SELECT firm_id AS row_no, CASE WHEN firm_id % 6 = 0 THEN '' ELSE company_name END AS n, {_SITE} AS u FROM firms) SELECT row_no, coalesce(nullif(trim(n), ''), trim(u)) AS company_name, trim(u) AS website_url, '' AS description, CASE WHEN regexp_matches(trim(u), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'e-mail in the URL column' WHEN trim(u) = '' THEN 'no URL' END AS reject_reason FROM r""")
def firm_ingest(spark, d) -> DataFrame:
    """Columns found by name and content, rows validated."""
    raw = view(spark, d, "firms").selectExpr("firm_id AS row_no", "CASE WHEN firm_id % 6 = 0 THEN '' ELSE company_name END AS `Firm Name`", f"{_SITE} AS `Corporate Website`")
    return firm_list.standardise(raw, firm_list.detect(raw))


@query(f"{with_views('firms')}, s AS (SELECT * FROM firms WHERE lower(company_name) LIKE '%0_1%') SELECT firm_id, company_name, (SELECT count(*) FROM s) AS total, CAST(ceil((SELECT count(*) FROM s) / 50.0) AS BIGINT) AS pages FROM s ORDER BY firm_id LIMIT 50")
def firm_search(spark, d) -> DataFrame:
    """A page of a search, with its total; _ is a wildcard in the term."""
    hits = export.search(view(spark, d, "firms"), "company_name", "0_1")
    return export.page(hits, "firm_id", 0).select("firm_id", "company_name").crossJoin(export.page_counts(hits))  # one row


@query(f"{with_views('firms')} SELECT firm_id, c AS \"column\", l AS length FROM (SELECT firm_id, unnest(['website_url', 'investment_niches']) AS c, unnest([length(website_url), length(investment_niches)]) AS l FROM firms) WHERE l > 30")
def long_values(spark, d) -> DataFrame:
    """C9, with a bound of 30."""
    return export.long_values(view(spark, d, "firms"), "firm_id", ["website_url", "investment_niches"], 30)


@query(f"{with_views('firms', 'members')}, {{t}} SELECT 0 AS section, CAST(-2 AS BIGINT) AS seq, '=== FIRMS ===' AS line UNION ALL SELECT 0, -1, 'firm_id,company_name,investment_niches' UNION ALL SELECT 0, firm_id, firm_id || ',' || company_name || ',' || CASE WHEN contains(investment_niches, ',') THEN '\"' || investment_niches || '\"' ELSE investment_niches END FROM firms UNION ALL SELECT 0, 4611686018427387904, '' UNION ALL SELECT 1, -2, '=== MEMBERS ===' UNION ALL SELECT 1, -1, 'member_id,email' UNION ALL SELECT 1, member_id, member_id || ',' || coalesce(email, '') FROM members UNION ALL SELECT 1, 4611686018427387904, ''".replace(", {t}", ""))
def sectioned_csv(spark, d) -> DataFrame:
    """One text with a section for each table."""
    f, m = view(spark, d, "firms").select("firm_id", "company_name", "investment_niches"), view(spark, d, "members").select("member_id", "email")
    return export.sectioned({"FIRMS": (f, "firm_id"), "MEMBERS": (m, "member_id")})


@query(f"{with_views('members')} SELECT coalesce(vc_firm, '') AS \"VC Firm\", name AS \"Name\", title AS \"Title\", coalesce(linkedin_url, '') AS \"LinkedIn URL\", coalesce(email, '') AS \"Email\", specialization AS \"Specialization\" FROM members")
def member_export(spark, d) -> DataFrame:
    """Labelled columns, nulls as empty text; export_sheets and short_exports have the layouts."""
    return export.labelled(export.clean(view(spark, d, "members").drop("member_id", "firm_id")), export.SHORT_MEMBER)


@query(f"{with_views('members')} SELECT name, vc_firm AS site, title AS \"Role\", coalesce(email, '') AS \"Contact\" FROM members")
def wide_result(spark, d) -> DataFrame:
    """One column for each user section of a map."""
    data = F.create_map(F.lit("role"), F.col("title"), F.lit("contact"), F.col("email"))
    return export.wide(view(spark, d, "members").select("name", F.col("vc_firm").alias("site"), data.alias("data")), {"role": "Role", "contact": "Contact"})


@query(f"{with_views('firms', 'processed')} SELECT f.firm_id, f.company_name FROM firms f WHERE f.company_name NOT IN (SELECT company_name FROM processed)")
def insert_absent(spark, d) -> DataFrame:
    """Rows that aren't stored yet, of equal keys the first."""
    return export.new_rows(view(spark, d, "firms").select("firm_id", "company_name"), view(spark, d, "processed"), ["company_name"], "firm_id")


@query(f"{with_views('firms')}, t AS (SELECT company_name, min(firm_id) AS firm_id FROM firms GROUP BY 1) SELECT p.company_id, t.firm_id FROM (SELECT o_orderkey AS company_id, 'Supplier#' || lpad(CAST(o_orderkey % 150 AS VARCHAR), 9, '0') AS company_name FROM orders) p JOIN t USING (company_name)")
def firm_id_lookup(spark, d) -> DataFrame:
    """Rows by name to the first id of that name."""
    ids = view(spark, d, "firms").groupBy("company_name").agg(F.min("firm_id").alias("firm_id"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("company_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("o_orderkey") % 150).cast("string"), 9, "0")).alias("company_name"))
    return o.join(ids, "company_name").select("company_id", "firm_id")


@query(f"WITH {_LINKS}, {_ABSOLUTE}, e AS (SELECT DISTINCT {_H} AS firm, regexp_replace(url, '[?#].*$', '') AS a, link AS b FROM ab WHERE {_H.replace('url', 'link')} = {_H}) SELECT firm, count(*) AS edges, count(DISTINCT b) AS targets FROM e GROUP BY firm")
def site_graph(spark, d) -> DataFrame:
    """The edges that K1 explores, by site."""
    return _edges(spark, d).groupBy("firm").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("to_url").alias("targets"))


def _edges(spark, d) -> DataFrame:
    x = links(spark, d).filter(urls.host(F.col("link")) == urls.host(F.col("url")))
    return x.select(urls.host(F.col("url")).alias("firm"), urls.without_query(F.col("url")).alias("from_url"), F.col("link").alias("to_url"), urls.category_priority(F.col("link"), F.col("txt")).alias("priority"), "seq").groupBy("firm", "from_url", "to_url").agg(F.min("priority").alias("priority"), F.min("seq").alias("seq"))


#: The exploration page after page, with its whole queue: e has firm, a, b, p, q (a page, a link of it, its priority and place); roots firm, url.
EXPLORED = """adj AS MATERIALIZED (SELECT firm, a, list({'p': p, 'q': q, 'u': b}) AS links FROM e GROUP BY ALL),
    r AS (SELECT firm, 0 AS visit, [{'p': 0, 'd': 0, 'b': 0, 'q': 0::BIGINT, 'u': url}] AS queue, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS url, 0 AS depth FROM roots
      UNION ALL SELECT s.firm, visit + 1, list_filter(list_concat(queue, CASE WHEN o.d < 3 THEN coalesce(list_transform(links, lambda x: {'p': x.p, 'd': o.d + 1, 'b': visit + 1, 'q': x.q, 'u': x.u}), []) ELSE [] END), lambda x: x.u <> o.u AND NOT list_contains(seen, x.u)),
        list_append(seen, o.u), o.u, o.d FROM (SELECT *, list_sort(queue)[1] AS o FROM r WHERE len(queue) > 0 AND visit < 20) s LEFT JOIN adj ON adj.firm = s.firm AND adj.a = s.o.u)"""


@query(f"WITH RECURSIVE {_LINKS}, {_ABSOLUTE}, c AS (SELECT {_H} AS firm, regexp_replace(url, '[?#].*$', '') AS a, link AS b, {_CAT} AS cat, seq FROM ab WHERE {_H.replace('url', 'link')} = {_H}), e AS MATERIALIZED (SELECT firm, a, b, min({_PRI})::INTEGER AS p, min(seq)::BIGINT AS q FROM c GROUP BY ALL), roots AS (SELECT firm, min(a) AS url FROM e GROUP BY 1), {EXPLORED} SELECT firm, url, depth, visit FROM r WHERE visit > 0")
def explored_sites(spark, d) -> DataFrame:
    """The archived links of every site, to the depth and number of pages that are usual."""
    e = cut(_edges(spark, d), "edges")  # each round reads them
    return explore.explore(e, e.groupBy("firm").agg(F.min("from_url").alias("url")))


#: Sites of firms: links (firm, a, b, p, q) and what pages say (url, description, aum, headquarters, stages, niches), the same text for both engines.
_SITE_LINKS = """SELECT CAST(firm_id AS STRING) AS firm, concat('https://f', CAST(firm_id AS STRING), x.a) AS a, concat('https://f', CAST(firm_id AS STRING), x.b) AS b, x.p AS p, CAST(x.q AS BIGINT) AS q FROM firms,
      (VALUES ('/', '/team', 1, 1), ('/', '/about', 3, 2), ('/', '/portfolio', 2, 3), ('/', '/team', 4, 4), ('/portfolio', '/', 1, 1), ('/portfolio', '/about', 1, 2)) AS x(a, b, p, q)
    UNION ALL SELECT CAST(firm_id AS STRING), concat('https://f', CAST(firm_id AS STRING), '/team'), concat('https://f', CAST(firm_id AS STRING), '/people/', CAST(member_id AS STRING)), CAST(member_id % 3 + 1 AS INT), CAST(member_id AS BIGINT) FROM members"""
_SITE_FACTS = """SELECT concat('https://f', CAST(firm_id AS STRING), '/') AS url, CASE WHEN firm_id % 3 = 0 THEN concat(company_name, ' home') ELSE '' END AS description, '' AS aum, CAST(NULL AS STRING) AS headquarters, '' AS stages, '' AS niches FROM firms
    UNION ALL SELECT concat('https://f', CAST(firm_id AS STRING), '/about'), concat(company_name, ' about'), concat('$', CAST(firm_id AS STRING), 'M'), '', investment_stages, '' FROM firms
    UNION ALL SELECT concat('https://f', CAST(firm_id AS STRING), '/portfolio'), '', CASE WHEN firm_id % 2 = 0 THEN concat('over ', CAST(firm_id AS STRING)) ELSE '' END, NULL, 'Late', investment_niches FROM firms
    UNION ALL SELECT concat('https://f', CAST(firm_id AS STRING), '/people/', CAST(member_id AS STRING)), name, '', CASE WHEN member_id % 4 = 0 THEN specialization ELSE '' END, '', specialization FROM members"""
_FIRST = lambda c: f"min_by({c}, visit) FILTER ({c} <> '') AS {c}, min(visit) FILTER ({c} <> '') AS {c}_visit"


@query(f"""{with_views('firms', 'members').replace('WITH', 'WITH RECURSIVE')}, e AS MATERIALIZED ({_SITE_LINKS}), facts AS ({_SITE_FACTS}), roots AS (SELECT CAST(firm_id AS STRING) AS firm, concat('https://f', CAST(firm_id AS STRING), '/') AS url FROM firms), {EXPLORED}
    SELECT firm, count(*) AS pages, {', '.join(map(_FIRST, ('description', 'aum', 'headquarters', 'stages', 'niches')))} FROM r LEFT JOIN facts USING (url) WHERE visit > 0 GROUP BY firm""")
def firm_records(spark, d) -> DataFrame:
    """K2 over K1: one record for each firm from the pages of its site in the order in which they are visited."""
    tables = {n: view(spark, d, n) for n in ("firms", "members")}
    edges = cut(spark.sql(_SITE_LINKS.replace("FROM firms", "FROM {firms}").replace("FROM members", "FROM {members}"), **tables).select("firm", F.col("a").alias("from_url"), F.col("b").alias("to_url"), F.col("p").alias("priority"), F.col("q").alias("seq")), "edges")
    facts = spark.sql(_SITE_FACTS.replace("FROM firms", "FROM {firms}").replace("FROM members", "FROM {members}"), **tables)
    listed = lambda c: F.filter(F.split(c, ", "), lambda x: x != "")
    facts = facts.withColumns({"stages": listed("stages"), "niches": listed("niches")})
    roots = tables["firms"].select(F.col("firm_id").cast("string").alias("firm"), F.concat(F.lit("https://f"), F.col("firm_id").cast("string"), F.lit("/")).alias("url"))
    got = explore.firm_records(explore.explore(edges, roots), facts, ["description", "aum", "headquarters"], ["stages", "niches"])
    return got.withColumns({c: F.array_join(c, ", ") for c in ("stages", "niches")})


@query(f"WITH {_LINKS}, {_ABSOLUTE}, x AS (SELECT page_id, url, link, txt, seq FROM ab QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY seq) = 1) SELECT page_id, {_H} AS site, count(*) AS links FROM x WHERE length(txt) > 1 GROUP BY ALL")
def listing_sizes(spark, d) -> DataFrame:
    """Distinct links of each page that have a text."""
    x = links(spark, d)
    first = x.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "link").orderBy("seq"))).filter("_r = 1 AND length(txt) > 1")
    return first.groupBy("page_id", urls.host(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("links"))


@query(rf"WITH {_LINKS}, x AS (SELECT page_id, seq, {_ABS} AS link FROM (SELECT *, {_O} AS o, {_P} AS p FROM l) WHERE (contains(href, 'page') OR contains(href, 'team')) AND (regexp_matches(lower(txt), 'next|more|page') OR regexp_matches(href, 'page=\d+') OR regexp_matches(href, '/\d+$'))) SELECT page_id, link, min(seq) AS seq FROM x GROUP BY ALL")
def pagination_links(spark, d) -> DataFrame:
    """J13, over every page."""
    return pages.pagination_links(links(spark, d))


@query(f"""WITH {_LINKS}, {_ABSOLUTE}, c AS (SELECT *, {_CAT} AS category, {_H} AS site FROM ab), f AS (SELECT site, link AS url, category FROM c WHERE site IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, link ORDER BY page_id, seq) = 1),
    v AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, {_VISIBLE} AS t FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) = 1), u AS (SELECT url, length(t) >= 200 AND NOT regexp_matches(lower(t), 'checking your browser|captcha|access denied') AS ok FROM v)
    SELECT site, category, count(*) AS discovered, count(u.url) AS archived, count(*) FILTER (ok) AS usable, count(*) FILTER (ok IS NOT TRUE) AS failed FROM f LEFT JOIN u USING (url) GROUP BY ALL""")
def crawl_statistics(spark, d) -> DataFrame:
    """What the pages of each site link to, by category, and how much of it is archived and usable."""
    first = F.struct("page_id", "seq")
    found = links(spark, d).withColumn("site", urls.host(F.col("url"))).filter("site IS NOT NULL").withColumn("category", urls.category(F.col("link"), F.col("txt")))
    found = found.groupBy("site", F.col("link").alias("url")).agg(F.min_by("category", first).alias("category"))
    p = spark.read.parquet(f"{d}/pages.parquet").groupBy(urls.without_query(F.col("url")).alias("url")).agg(F.min_by("html", "page_id").alias("html"))
    p = p.select("url", text.visible_text(F.col("html")).alias("content"))
    usable = (F.length("content") >= 200) & ~F.lower("content").rlike("checking your browser|captcha|access denied")
    return explore.crawl_statistics(found, p, usable)


@query(f"{with_views('firms', 'members', 'portfolio', 'processed')} SELECT f.firm_id, f.company_name, p.v AS status, m.v AS title, c.v AS company FROM firms f LEFT JOIN (SELECT company_name, min(status) AS v FROM processed GROUP BY 1) p USING (company_name) LEFT JOIN (SELECT vc_firm AS company_name, min(title) AS v FROM members GROUP BY 1) m USING (company_name) LEFT JOIN (SELECT vc_firm AS company_name, min(portfolio_company) AS v FROM portfolio GROUP BY 1) c USING (company_name)")
def registry_attributes(spark, d) -> DataFrame:
    """Every firm with what three tables have under its name."""
    of = lambda name, key, value: view(spark, d, name).select(F.col(key).alias("company_name"), F.col(value).alias("value"))
    return match.registry_attributes(view(spark, d, "firms"), {"status": of("processed", "company_name", "status"), "title": of("members", "vc_firm", "title"), "company": of("portfolio", "vc_firm", "portfolio_company")})


@query(f"{with_views('firms')}, w(list, place, path) AS (VALUES {', '.join(f'({n!r}, {i}, {p!r})' for n, l in dims.PATH_LISTS.items() for i, p in enumerate(l, 1))}) SELECT firm_id, list, place, regexp_extract(website_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || path AS url FROM firms, w WHERE website_url LIKE 'http%'")
def generated_urls(spark, d) -> DataFrame:
    """The URLs of all five lists of paths, on the origin of each firm's site."""
    f = view(spark, d, "firms").filter("website_url LIKE 'http%'")
    paths = F.explode(F.array(*(F.struct(F.lit(n).alias("list"), F.lit(i).alias("place"), F.lit(p).alias("path")) for n, l in dims.PATH_LISTS.items() for i, p in enumerate(l, 1))))
    return f.select("firm_id", urls.origin(F.col("website_url")).alias("_o"), paths.alias("x")).select("firm_id", "x.list", "x.place", F.concat("_o", "x.path").alias("url"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(html, 'mailto:([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', 1), ''), nullif(regexp_extract(html, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', 1), '')) AS email, nullif(regexp_extract(html, '(https?://(?:[a-z]+\.)?linkedin\.com/in/[A-Za-z0-9_%.-]+)', 1), '') AS linkedin, nullif(regexp_extract(html, '(https?://(?:www\.)?(?:twitter|x)\.com/[A-Za-z0-9_]+)', 1), '') AS twitter FROM pages")
def page_contacts(spark, d) -> DataFrame:
    """J7."""
    return pages.contact_of_page(spark.read.parquet(f"{d}/pages.parquet"))


@query("WITH k(label, word) AS (VALUES ('Venture Capital (VC)', 'venture capital'), ('Venture Capital (VC)', 'vc firm'), ('Seed', 'seed'), ('Growth', 'growth'), ('the', ' the '), ('en', ' en ')) SELECT doc_id, label, count(*) AS hits FROM documents, k WHERE contains(lower(text), word) GROUP BY ALL")
def keyword_tags(spark, d) -> DataFrame:
    """Labels whose keywords a text holds. The dimension is small and fixed; I17 to I21 have queries of their own in taxonomy."""
    words = [("Venture Capital (VC)", "venture capital"), ("Venture Capital (VC)", "vc firm"), ("Seed", "seed"), ("Growth", "growth"), ("the", " the "), ("en", " en ")]
    return tag(spark.read.parquet(f"{d}/documents.parquet"), words)


def tag(docs: DataFrame, words: list[tuple[str, str]], key: str = "doc_id", body: str = "text") -> DataFrame:
    """key, label, hits: one pass, no join; words: (label, keyword)."""
    low = F.lower(body)
    found = F.filter(F.array(*(F.when(low.contains(w), F.lit(label)) for label, w in words)), lambda x: x.isNotNull())
    return docs.select(key, F.explode(found).alias("label")).groupBy(key, "label").agg(F.count(F.lit(1)).alias("hits"))


@query(f"{with_views('members')} SELECT member_id, CASE WHEN a = '' THEN b WHEN b = '' OR contains(lower(a), lower(b)) THEN a WHEN contains(lower(b), lower(a)) THEN b ELSE a || '; ' || b END AS merged FROM (SELECT member_id, trim(title) AS a, trim(specialization) AS b FROM members)")
def merged_fields(spark, d) -> DataFrame:
    """Two values of a field."""
    return view(spark, d, "members").select("member_id", text.merge_text(F.col("title"), F.col("specialization")).alias("merged"))


@query(f"""{with_views('firms')}, c AS (SELECT firm_id, rtrim(website_url, '/') || p AS url, i FROM firms, (VALUES ('/team', 1), ('/people', 2), ('/about', 3), ('/portfolio', 4), ('/companies', 5)) v(p, i) WHERE website_url LIKE 'http%') SELECT firm_id, url, i AS place FROM c""")
def candidate_urls(spark, d) -> DataFrame:
    """I13, in part: URLs made from a site and a short list of paths; generated_urls has all lists."""
    paths = ["/team", "/people", "/about", "/portfolio", "/companies"]
    f = view(spark, d, "firms").filter("website_url LIKE 'http%'")
    return f.select("firm_id", F.regexp_replace("website_url", "/+$", "").alias("_b"), F.posexplode(F.array(*map(F.lit, paths))).alias("_i", "_p")).select("firm_id", F.concat("_b", "_p").alias("url"), (F.col("_i") + 1).alias("place"))


@query("WITH c AS (SELECT page_id % 40 AS site, url, page_id AS place, length(html) AS n FROM pages), u AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place, url) AS r FROM c WHERE n >= 1000) SELECT site, url, place FROM u WHERE r <= 2")
def first_usable_pages(spark, d) -> DataFrame:
    """The first two usable pages of each site in the order of their candidates."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    cand = p.select((F.col("page_id") % 40).alias("site"), "url", F.col("page_id").alias("place"))
    return explore.waterfall(cand, p.groupBy("url").agg(F.min_by("html", "page_id").alias("content")), F.length("content") >= 1000, 2).select("site", "url", "place")


_PAGE_RANK = f"CASE WHEN {_O} IS NOT NULL AND {_P} = '/' THEN 0 ELSE " + "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{'|'.join(u)}') THEN {p}" for _, p, u, _ in dims.PAGE_CATEGORIES) + " ELSE 5 END END"


@query(f"SELECT {_H} AS site, {_PAGE_RANK} AS rank, page_id // 1000 AS block, coalesce(string_agg({_VISIBLE}, chr(10) || chr(10) ORDER BY page_id), '') AS content FROM pages GROUP BY 1, 2, 3")
def assembled_content(spark, d) -> DataFrame:
    """The text of all pages of a site: the home page, then by category, then as they came. A large site's text doesn't
    fit one value, so it comes in blocks of at most 1000 page_ids of a category, whose order is (rank, block)."""
    u = F.col("url")
    rank = F.when(urls.path(u) == "/", 0).otherwise(urls.category_priority(u, F.lit("")))
    p = spark.read.parquet(f"{d}/pages.parquet").select(urls.host(u).alias("site"), rank.alias("rank"), F.expr("page_id div 1000").alias("block"), "page_id", text.visible_text(F.col("html")).alias("body"))
    return export.ordered_content(p, ["site", "rank", "block"], "rank", "page_id", "body")
