"""Bounded exploration of archived link graphs, one round for all sites at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.operators.pages import entry_key, listing_entries
from firmlens.operators.shared import cut


#: The order of the frontier: priority, depth, then as pages came in (the visit that found them, and their place on that page).
ORDER = ("priority", "depth", "found_by", "seq", "url")


#: Tables of more rows than this are joined by shuffles. Spark goes by the size of files, which these rows outgrow many times once they are broadcast.
BROADCAST_ROWS = 200_000


def _joined_by(df: DataFrame, rows: int) -> DataFrame:
    return df if rows <= BROADCAST_ROWS else df.hint("shuffle_hash")


def explore(edges: DataFrame, roots: DataFrame, max_depth: int = 3, max_pages: int = 20) -> DataFrame:
    """firm, url, depth, visit: in each round every firm visits the page of its frontier with the best (priority, depth, arrival). edges: firm, from_url, to_url,
    priority, seq; roots: firm, url. A link may be found again with a better order: the best one counts.

    The frontier is never sorted: the next page of a firm is a minimum, which every task takes of its own part first, so that a firm with most of all links isn't bound
    to one task. A round appends what it found to the frontier, and only what was visited since is taken out."""
    order = F.struct(*ORDER)
    parts = [cut(roots.select("firm", "url", F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit(0).alias("found_by"), F.lit(0).cast("long").alias("seq")), "frontier")]
    visited, seen = None, 0
    for visit in range(1, max_pages + 1):
        rest = reduce(DataFrame.unionByName, parts)
        if visited is not None:
            rest = rest.join(_joined_by(visited.select("firm", "url"), seen), ["firm", "url"], "left_anti")
        now = cut(rest.groupBy("firm").agg(F.min(order).alias("o")).select("firm", "o.url", "o.depth", F.lit(visit).alias("visit")), "visit")
        found = now.count()
        if not found:
            break
        visited, seen = now if visited is None else visited.unionByName(now), seen + found
        new = _joined_by(now.filter(F.col("depth") < max_depth), found).join(edges, (edges["firm"] == now["firm"]) & (edges["from_url"] == now["url"]))
        new = new.select(now["firm"], F.col("to_url").alias("url"), (F.col("depth") + 1).alias("depth"), edges["priority"], F.lit(visit).alias("found_by"), F.col("seq").cast("long").alias("seq"))
        parts.append(cut(new, "frontier"))
    return visited


def firm_records(visited: DataFrame, facts: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """A record for each firm from the pages that were visited: of each field the first value that isn't empty, of each list the first that has any, in
    the order of visits, with the number of pages and the visit that each came from. visited: firm, url, visit; facts: url, scalars and lists, a row for each page with any."""
    rows = visited.join(facts, "url", "left")

    def first(c: str, filled: Column) -> list[Column]:
        at = F.when(filled, F.col("visit"))
        return [F.min_by(F.when(filled, F.col(c)), at).alias(c), F.min(at).cast("int").alias(f"{c}_visit")]

    cols = [x for c in scalars for x in first(c, F.length(c) > 0)] + [x for c in lists for x in first(c, F.size(c) > 0)]
    return rows.groupBy("firm").agg(F.count(F.lit(1)).alias("pages"), *cols)


def follow(pages: DataFrame, starts: DataFrame, cap: int = 50) -> DataFrame:
    """start, url, place: listings followed from page to page until the end, a repeat or the cap. pages: url, next_url; starts: start."""
    now = starts.select("start", F.col("start").alias("url"), F.lit(1).alias("place"))
    out = now
    step = pages.select(F.col("url").alias("_u"), "next_url").filter("next_url IS NOT NULL")
    for place in range(2, cap + 1):
        nxt = now.join(step, now["url"] == step["_u"]).select("start", F.col("next_url").alias("url"), F.lit(place).alias("place"))
        now = cut(nxt.join(out.select("start", "url"), ["start", "url"], "left_anti").select("start", "url", "place"), "listing")
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def listing(links: DataFrame, pages: DataFrame, starts: DataFrame, cap: int = 500) -> DataFrame:
    """start, place, name, url: the entries of listings that are followed from page to page. The prefix that is found on a page is carried to the next one and goes before any
    detection there. A listing ends with a page of fewer than three entries (which still count), without a next page, at a repeat or at the cap. Of equal entries the first counts.
    links: url, link, txt, seq; pages: url, next_url; starts: start."""
    now = starts.select("start", F.col("start").alias("url"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("known"))
    visited, found = now.select("start", "url"), []
    for place in range(1, cap + 1):
        entries = cut(listing_entries(links.join(now, "url").select("start", "url", "link", "txt", "seq", "known"), "start"), "entries")
        found.append(entries.withColumn("place", F.lit(place)))
        more = entries.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("pattern").alias("pattern")).filter("n >= 3")
        same = entry_key(F.col("next_url")) == entry_key(F.col("url"))
        step = now.join(more, "start").join(pages, "url").filter(F.col("next_url").isNotNull() & ~same)
        step = step.select("start", F.col("next_url").alias("url"), F.lit(place + 1).alias("place"), F.coalesce("pattern", "known").alias("known"))
        now = cut(step.join(visited, ["start", "url"], "left_anti").select("start", "url", "place", "known"), "listing")
        if now.isEmpty():
            break
        visited = visited.unionByName(now.select("start", "url"))
    every = reduce(DataFrame.unionByName, found)
    first = every.groupBy("start", entry_key(F.col("url")).alias("_k")).agg(F.min_by(F.struct("place", "name", "url"), F.struct("place", "seq")).alias("_e"))
    return first.select("start", "_e.*")


def expand(firms: DataFrame, entries: DataFrame) -> DataFrame:
    """Directory entries that aren't in the list yet, added to it; of several names of a URL the least."""
    new = entries.groupBy(F.col("url").alias("website_url")).agg(F.min("name").alias("company_name"))
    return firms.unionByName(new.join(firms.select("website_url"), "website_url", "left_anti").select(*firms.columns))


def waterfall(candidates: DataFrame, pages: DataFrame, usable, k: int = 1) -> DataFrame:
    """The first k usable pages of each site in the order of their candidates. candidates: site, url, place; pages: url, content."""
    got = candidates.join(pages, "url").filter(usable)
    return got.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))).filter(F.col("_r") <= k).drop("_r")


#: What stands between the texts of several pages (a fixed value).
BETWEEN = "\n\n---\n\n"


def combined(candidates: DataFrame, pages: DataFrame, usable, k: int = 3) -> DataFrame:
    """site, combined, sources, attempted: the texts of a site's first k usable pages as one, their URLs, and how many candidates were tried until then."""
    got = waterfall(candidates, pages, usable, k)
    # at most k pages of a site
    items = F.array_sort(F.collect_list(F.struct("place", "url", "content")))
    of = got.groupBy("site").agg(items.alias("_p"), F.count(F.lit(1)).alias("_n"), F.max("place").alias("_last"))
    tried = candidates.join(of.select("site", "_n", "_last"), "site", "left").filter((F.col("place") <= F.col("_last")) | F.col("_n").isNull() | (F.col("_n") < k)).groupBy("site").agg(F.count(F.lit(1)).alias("attempted"))
    text_of = F.array_join(F.transform("_p", lambda x: x["content"]), BETWEEN)
    return tried.join(of, "site", "left").select("site", F.coalesce(text_of, F.lit("")).alias("combined"), F.coalesce(F.transform("_p", lambda x: x["url"]), F.array().cast("array<string>")).alias("sources"), "attempted")


def with_fallback(found: DataFrame, standard: DataFrame) -> DataFrame:
    """Candidates that were found, and the standard ones of sites without any. Both: site, url, place."""
    return found.unionByName(standard.join(found.select("site").distinct(), "site", "left_anti").select(*found.columns))


def crawl_statistics(candidates: DataFrame, pages: DataFrame, usable) -> DataFrame:
    """Discovered, archived, usable and failed pages of each site and category."""
    df = candidates.join(pages.withColumn("_have", F.lit(True)), "url", "left")
    ok = F.coalesce(usable, F.lit(False)) & F.col("_have").isNotNull()
    return df.groupBy("site", "category").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("_have").isNotNull()).alias("archived"), F.count_if(ok).alias("usable"), F.count_if(~ok).alias("failed"))
