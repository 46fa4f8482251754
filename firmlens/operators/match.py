"""Matching of people, e-mails, profiles and companies. Every theta join is keyed by firm or page first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import names, text
from firmlens.operators.contain import contained
from firmlens.operators.shared import cut


def email_of_member(members: DataFrame, emails: DataFrame, page: str = "page_id") -> DataFrame:
    """The first address on the page that fits the member: its local part holds both names, or is first, first.last, firstlast or flast.
    members: page, member_id, name; emails: page, email, seq. The last four are keys; a local part that holds both names is found by the longer of them."""
    p = names.parts(F.lower("name"))
    m = members.select(page, "member_id", p["first"].alias("_f"), p["last"].alias("_l"))
    local = emails.filter("email IS NOT NULL").select(page, F.lower(F.substring_index("email", "@", 1)).alias("_local"), "email", "seq").groupBy(page, "_local").agg(F.min_by("email", "seq").alias("email"), F.min("seq").alias("seq"))
    people = m.select(page, "_f", "_l").distinct()
    forms = F.array("_f", F.concat("_f", F.lit("."), "_l"), F.concat("_f", "_l"), F.concat(F.substring("_f", 1, 1), "_l"))
    made = people.select(page, "_f", "_l", F.explode(F.array_distinct(forms)).alias("_local")).join(local.select(page, "_local"), [page, "_local"])
    longer = people.withColumn("needle", F.when(F.length("_l") >= F.length("_f"), F.col("_l")).otherwise(F.col("_f")))
    hit = contained(longer.select(page, "needle"), local.select(page, F.col("_local").alias("text")), page)
    both = longer.join(hit, [page, "needle"]).filter(F.col("text").contains(F.col("_f")) & F.col("text").contains(F.col("_l"))).select(page, F.col("text").alias("_local"), "_f", "_l")
    fits = made.select(page, "_local", "_f", "_l").unionByName(both).join(local, [page, "_local"])
    best = fits.groupBy(page, "_f", "_l").agg(F.min_by("email", "seq").alias("email"))
    return m.join(best, [page, "_f", "_l"]).select(page, "member_id", "email")


def profile_of_member(members: DataFrame, urls: DataFrame, page: str = "page_id") -> DataFrame:
    """Not exclusive: a URL whose context holds both names (High), else one that a name pattern generates (Medium).
    members: page, member_id, name; urls: page, url, context, seq."""
    p = names.parts(F.lower(F.trim("name")))
    m = members.select(page, "member_id", _letters(p["first"]).alias("_f"), _letters(p["last"]).alias("_l"))
    u = urls.select(page, "url", "seq", F.lower(F.regexp_extract("url", r"/in/([^/?#]+)", 1)).alias("_slug"), F.lower("context").alias("text"))
    people = m.select(page, "_f", "_l").distinct()
    longer = people.withColumn("needle", F.when(F.length("_l") >= F.length("_f"), F.col("_l")).otherwise(F.col("_f")))
    near = longer.join(contained(longer.select(page, "needle"), u.select(page, "text"), page), [page, "needle"]).filter(F.col("text").contains(F.col("_f")) & F.col("text").contains(F.col("_l")))
    high = near.join(u, [page, "text"]).select(page, "_f", "_l", "url", F.struct(F.lit(1).alias("method"), "seq").alias("_o"))
    forms = F.array(F.concat("_f", F.lit("-"), "_l"), F.concat("_f", "_l"), F.concat(F.substring("_f", 1, 1), F.lit("-"), "_l"))
    made = people.select(page, "_f", "_l", F.explode(F.array_distinct(forms)).alias("_slug")).join(u, [page, "_slug"]).select(page, "_f", "_l", "url", F.struct(F.lit(2).alias("method"), "seq").alias("_o"))
    best = high.unionByName(made).groupBy(page, "_f", "_l").agg(F.min_by("url", "_o").alias("url"), F.min("_o").alias("_o"))
    return m.join(best, [page, "_f", "_l"]).select(page, "member_id", "url", F.when(F.col("_o.method") == 1, "High").otherwise("Medium").alias("confidence"))


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z]", "")


def profile_fits(people: DataFrame, urls: DataFrame) -> DataFrame:
    """page_id, _f, _l, url, seq, rank: which profiles fit a name, and how well: the name in the text next to the link (1), in the wider context (2), both
    names in the slug (3), initial and last name in the slug (4). people: page_id, _f, _l, each name once; urls: page_id, url, near, context, seq."""
    slug = F.lower(F.regexp_extract("url", r"/in/([^/?#]+)", 1))
    u = urls.select("page_id", "url", "seq", F.lower(F.coalesce("near", F.lit(""))).alias("_near"), F.lower(F.coalesce("context", F.lit(""))).alias("_context"), F.coalesce(slug, F.lit("")).alias("_slug"))
    # every way holds the last name; names are letters only, so none reaches across the marks between the three texts
    u = u.withColumn("text", F.concat_ws("\n", "_near", "_context", "_slug"))
    p = people.filter("_f <> ''").withColumn("needle", F.when(F.col("_l") == "", F.col("_f")).otherwise(F.col("_l")))
    c = p.join(contained(p.select("page_id", "needle"), u.select("page_id", "text"), "page_id"), ["page_id", "needle"]).join(u, ["page_id", "text"])
    both = lambda x: F.col(x).contains(F.col("_f")) & F.col(x).contains(F.col("_l"))
    pattern = (F.col("_l") != "") & F.col("_slug").rlike("^[a-z]-") & F.col("_slug").contains(F.col("_l")) & (F.substring("_slug", 1, 1) == F.substring("_f", 1, 1))
    rank = F.when(both("_near"), 1).when(both("_context"), 2).when(both("_slug"), 3).when(pattern, 4)
    return c.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("page_id", "_f", "_l", "url").agg(F.min(F.struct("rank", "seq")).alias("_o")).select("page_id", "_f", "_l", "url", "_o.seq", "_o.rank")


def assign_profiles(members: DataFrame, urls: DataFrame) -> DataFrame:
    """One to one and greedy, page by page, in member order; a URL that is taken is out, and a name of one word is looked for alone.
    members: page_id, member_id, name; urls: page_id, url, near, context, seq.

    Members of one name have the same candidates: they are a class. In a round the class's i-th free member is paired with its i-th free URL, as far as no lower
    free member of another class could want one of these URLs: nobody who comes before can then change what they get, so each such pair is final. The lowest free member can always be served, and taken URLs leave with their
    members, so the rounds end in the greedy order; pages, and names within a page, go on side by side."""
    p = names.parts(F.lower(F.trim("name")))
    m = members.select("page_id", "member_id", _letters(p["first"]).alias("_f"), _letters(p["last"]).alias("_l")).filter("_f <> ''")
    name = ["page_id", "_f", "_l"]
    fits = cut(profile_fits(m.select(*name).distinct(), urls), "fits")
    free = cut(m.join(fits.select(*name).distinct(), name, "left_semi"), "free")
    open_, out = fits, None
    while True:
        lowest = free.groupBy(*name).agg(F.min("member_id").alias("low"))
        want = open_.join(lowest, name).select("page_id", "url", F.struct("low", "_f", "_l").alias("who"))
        first = want.groupBy("page_id", "url").agg(F.min("who").alias("first"))
        # the lowest free member of another class that has the URL among its candidates
        second = want.join(first, ["page_id", "url"]).filter(F.col("who") != F.col("first")).groupBy("page_id", "url").agg(F.min("who.low").alias("second"))
        rival = first.join(second, ["page_id", "url"], "left")
        k = Window.partitionBy(*name)
        url = open_.withColumn("i", F.row_number().over(k.orderBy("rank", "seq", "url"))).join(rival, ["page_id", "url"])
        mine = (F.col("first._f") == F.col("_f")) & (F.col("first._l") == F.col("_l"))
        url = url.select(*name, "i", "url", "rank", F.when(mine, F.col("second")).otherwise(F.col("first.low")).alias("before"))
        pairs = free.withColumn("i", F.row_number().over(k.orderBy("member_id"))).join(url, [*name, "i"])
        safe = F.coalesce(F.col("before") > F.col("member_id"), F.lit(True))
        fixed = pairs.withColumn("ok", F.min(safe).over(k.orderBy("i"))).filter("ok").select(*name, "member_id", "url", "rank")
        fixed = cut(fixed, "fixed")
        if fixed.isEmpty():
            break
        out = fixed if out is None else out.unionByName(fixed)
        open_ = cut(open_.join(fixed, ["page_id", "url"], "left_anti"), "open")
        free = cut(free.join(fixed, ["page_id", "member_id"], "left_anti").join(open_.select(*name).distinct(), name, "left_semi"), "free")
        open_ = open_.join(free.select(*name).distinct(), name, "left_semi")
    if out is None:
        out = free.limit(0).select(*name, "member_id", F.lit("").alias("url"), F.lit(1).alias("rank"))
    label = F.when(F.col("rank") == 1, "High").when(F.col("rank") == 4, "Low").otherwise("Medium")
    return out.select("page_id", "member_id", "url", label.alias("confidence"))


def profile_page_of_member(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every member, with the first link whose normalised name is theirs, or null. members: page_id, member_id, name; links: page_id, link, name, seq."""
    first = links.groupBy("page_id", names.person_key(F.col("name")).alias("_k")).agg(F.min_by("link", "seq").alias("link"))
    return members.withColumn("_k", names.person_key(F.col("name"))).join(first, ["page_id", "_k"], "left").select("page_id", "member_id", "link")


def registry_attributes(firms: DataFrame, registries: dict[str, DataFrame]) -> DataFrame:
    """Every firm with the attribute that each registry has under its name, or null. firms: firm_id, company_name;
    registries: company_name, value. Of several values of a name the least counts."""
    out = firms.select("firm_id", "company_name")
    for name, r in registries.items():
        out = out.join(r.groupBy("company_name").agg(F.min("value").alias(name)), "company_name", "left")
    return out.select("firm_id", "company_name", *registries)


def external_employees(members: DataFrame, employees: DataFrame) -> DataFrame:
    """Employees from an outside list whose name holds a member's or the other way, within a firm. Different names are matched once, by
    what the texts hold, and then stand for all who have them."""
    m = members.select("firm_id", "member_id", F.lower("name").alias("_m"))
    e = employees.select("firm_id", "employee", F.lower("employee").alias("_e"))
    as_ = lambda df, c, name: df.select("firm_id", F.col(c).alias(name))
    within = contained(as_(e, "_e", "needle"), as_(m, "_m", "text"), "firm_id").select("firm_id", F.col("text").alias("_m"), F.col("needle").alias("_e"))
    around = contained(as_(m, "_m", "needle"), as_(e, "_e", "text"), "firm_id").select("firm_id", F.col("needle").alias("_m"), F.col("text").alias("_e"))
    return m.join(within.union(around).distinct(), ["firm_id", "_m"]).join(e, ["firm_id", "_e"]).select("firm_id", "member_id", "employee")


def name_variations(members: DataFrame) -> DataFrame:
    """firm_id, a, b: members of a firm (a below b) whose names are variations of each other: equal, equal in first and last name, or one holds the other, which
    has at least four characters. members: firm_id, member_id, name. Different names are matched once: by keys, and by what they hold."""
    m = members.select("firm_id", "member_id", names.spaced_key(F.col("name")).alias("x"))
    p = names.parts(F.col("x"))
    n = m.select("firm_id", "x").filter("x IS NOT NULL").distinct().withColumns({"f": p["first"], "l": p["last"]})
    other = n.select("firm_id", F.col("x").alias("y"), "f", "l")
    ends = n.join(other, ["firm_id", "f", "l"]).select("firm_id", "x", "y")  # holds the equal ones
    held = contained(n.filter("length(x) >= 4").select("firm_id", F.col("x").alias("needle")), n.select("firm_id", F.col("x").alias("text")), "firm_id")
    one = held.select("firm_id", F.col("needle").alias("x"), F.col("text").alias("y"))
    pairs = ends.unionByName(one).union(one.select("firm_id", "y", "x")).distinct()
    a, b = m.withColumnRenamed("member_id", "a"), m.select("firm_id", F.col("member_id").alias("b"), F.col("x").alias("y"))
    return a.join(pairs, ["firm_id", "x"]).join(b, ["firm_id", "y"]).filter("a < b").select("firm_id", "a", "b")


def led_investments(members: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Portfolio texts of the firm that name the person and say "led" or "investment"."""
    t = F.lower("text")
    told = portfolio.filter(t.contains("led") | t.contains("investment")).select("firm_id", "company_id", t.alias("text"))
    m = members.select("firm_id", "member_id", F.lower("name").alias("needle"))
    hit = contained(m.select("firm_id", "needle"), told.select("firm_id", "text"), "firm_id")
    return m.join(hit, ["firm_id", "needle"]).join(told, ["firm_id", "text"]).select("firm_id", "member_id", "company_id")


def cross_validated(labels: DataFrame) -> DataFrame:
    """Labels of a person that are mentioned at least twice; without any, the labels of the most confident mention.
    labels: person, label, confidence, seq."""
    c = labels.groupBy("person", "label").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    best = labels.withColumn("_r", F.rank().over(Window.partitionBy("person").orderBy(F.desc("confidence"), "seq"))).filter("_r = 1").select("person", "label", F.lit("single").alias("basis"))
    many = c.filter("n >= 2").select("person", "label", F.lit("repeated").alias("basis"))
    return many.unionByName(best.join(many, "person", "left_anti"))


def profile_candidates(people: DataFrame, nicknames: DataFrame, key: str = "member_id", name: str = "name") -> DataFrame:
    """URLs that a person's profile may have, first spelling of each slug, with confidence and method, in order.

    All spellings of a name are made in its own row, and the first of each slug is taken there: only names are shuffled, by key, and rows go out as they are made.
    Only where several rows have a key are their slugs compared between rows."""
    p = names.parts(F.lower(F.trim("_name")))
    told = people.select(key, F.col(name).alias("_name")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    base = told.select(key, "_n", p["first"].alias("first"), p["middle"].alias("middle"), F.when(p["last"] == "", p["first"]).otherwise(p["last"]).alias("last")).filter("first <> ''")
    least = nicknames.groupBy("name").agg(F.min("ord").alias("ord"))
    # a fixed list, and a row for each of its names
    nick = F.broadcast(nicknames.join(least, ["name", "ord"]).groupBy("name").agg(F.collect_list(F.struct(F.col("variant").alias("f"), (F.col("at") + 1).alias("v"))).alias("_v")))
    own = F.array(F.struct(F.col("first").alias("f"), F.lit(0).cast(nicknames.schema["at"].dataType).alias("v")))
    rows = base.join(nick, base["first"] == nick["name"], "left").select(key, "_n", "middle", "last", F.concat(own, F.coalesce("_v", F.array().cast(nick.schema["_v"].dataType))).alias("_f"))
    last, lit, join = F.col("last"), F.lit, F.concat
    one = lambda slug, c, m: F.struct(slug.alias("slug"), c.alias("confidence"), F.lit(m).alias("method"))

    def spellings(first: Column, v: Column) -> Column:
        conf = F.when(v > 0, "Medium").otherwise("High")
        fixed = F.array(one(join(first, lit("-"), last), conf, "first-last"), one(join(first, last), lit("Medium"), "firstlast"), one(join(first, lit("."), last), lit("Low"), "first.last"), one(join(F.substring(first, 1, 1), lit("-"), last), lit("Low"), "f-last"))
        mids = F.filter(F.split("middle", " "), lambda x: x != "")
        middle = F.flatten(F.transform(mids, lambda x: F.array(one(join(first, lit("-"), x, lit("-"), last), lit("Medium"), "first-middle-last"), one(join(first, lit("-"), F.substring(x, 1, 1), lit("-"), last), lit("Medium"), "first-m-last"))))
        numbered = F.array(*(one(join(first, lit("-"), last, lit(f"-{i}")), lit("Low"), f"first-last-{i}") for i in (1, 2, 3)))
        return F.transform(F.concat(fixed, middle, numbered), lambda c, at: F.struct(c["slug"].alias("slug"), (v * 100 + at).alias("seq"), c["confidence"].alias("confidence"), c["method"].alias("method")))

    every = rows.select(key, "_n", F.array_sort(F.flatten(F.transform("_f", lambda x: spellings(x["f"], x["v"])))).alias("_c"))
    firsts = F.filter("_c", lambda c, i: (i == 0) | (F.get("_c", i - 1)["slug"] != c["slug"]))
    out = every.select(key, "_n", F.explode(firsts).alias("c")).select(key, "_n", "c.*")
    several = out.filter("_n > 1").withColumn("_r", F.row_number().over(Window.partitionBy(key, "slug").orderBy("seq"))).filter("_r = 1").drop("_r")
    out = out.filter("_n = 1").unionByName(several)
    return out.select(key, F.concat(F.lit("https://www.linkedin.com/in/"), "slug").alias("url"), "confidence", "method", "seq")


def simple_profile_candidates(people: DataFrame, key: str = "member_id", name: str = "name") -> DataFrame:
    """Five patterns and five numbered ones of a name's letters, in order: key, place, url. Names of one word have none."""
    p = names.parts(F.trim(name))
    letters = {k: F.regexp_replace(F.lower(c), "[^a-z]", "") for k, c in p.items()}
    base = people.select(key, letters["first"].alias("f"), letters["middle"].alias("m"), letters["last"].alias("l")).filter("f <> '' AND l <> ''")
    first, middle, last, dash = F.col("f"), F.col("m"), F.col("l"), F.lit("-")
    made = [F.concat(first, dash, last), F.concat(first, last), F.when(middle != "", F.concat(first, dash, middle, dash, last)), F.concat(F.substring(first, 1, 1), dash, last), F.concat(first, dash, F.substring(last, 1, 1))]
    made += [F.concat(first, dash, last, F.lit(f"-{i}")) for i in range(1, 6)]
    rows = base.select(key, F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("at", "slug"))
    return rows.select(key, (F.col("at") + 1).alias("place"), F.concat(F.lit("https://www.linkedin.com/in/"), "slug").alias("url"))


def prefer_profile(members: DataFrame, details: DataFrame) -> DataFrame:
    """Every member with what their own page says before what the team page says: title, profile, philosophy (as specialisation) and e-mail. A
    profile from the own page makes the record certain. members: page_id, member_id, name, title, linkedin_url, specialization, email,
    confidence; details: page_id, seq, name, title, linkedin_url, philosophy, email; of several pages of a name the first counts."""
    found = details.groupBy("page_id", names.person_key(F.col("name")).alias("_k")).agg(F.min_by(F.struct("title", "linkedin_url", "philosophy", "email"), "seq").alias("_d"))
    j = members.withColumn("_k", names.person_key(F.col("name"))).join(found, ["page_id", "_k"], "left")
    own = lambda detail, main: text.first_filled(F.col(f"_d.{detail}"), F.col(main))
    title = F.when(F.trim("_d.title") != "", F.col("_d.title")).otherwise(F.col("title"))
    sure = F.coalesce(F.col("_d.linkedin_url") != "", F.lit(False))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return j.select("page_id", "member_id", title.alias("title"), empty(own("linkedin_url", "linkedin_url")).alias("linkedin_url"), empty(own("philosophy", "specialization")).alias("specialization"), empty(own("email", "email")).alias("email"), F.when(sure, "High").otherwise(F.col("confidence")).alias("confidence"))
