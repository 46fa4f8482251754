"""URLs: the four normal forms, absolute links, variants, and the rules that class them. A bad URL is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlens.functions import dims

ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, ORIGIN, 1), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, ORIGIN[:-1] + r")([^?#]*)", 2)
    return F.when(origin(url).isNull(), None).otherwise(F.when(p == "", "/").otherwise(p))


def with_scheme(url: Column) -> Column:
    """Trimmed, https added where no scheme is, one trailing slash cut."""
    u = F.trim(url)
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(url == "", url).otherwise(F.regexp_replace(u, "/$", ""))


def origin_path_lower(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat(origin(url), path(url)), "/$", ""))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def same_host(url: Column, base: Column) -> Column:
    """Origin and path if the host is the base's, else null."""
    return F.when(host(url) == host(base), F.concat(origin(url), path(url)))


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands on the page `base`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.concat(origin(base), path(base)), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin(base), link))
        .otherwise(F.concat(folder, link))
    )


def host_variants(url: Column) -> Column:
    """The URL, with and without www., and over https."""
    bare = F.regexp_replace(url, r"^(https?://)www\.", "$1")
    www = F.regexp_replace(bare, r"^(https?://)", "$1www.")
    https = F.regexp_replace(url, "^http://", "https://")
    return F.array_distinct(F.array(url, bare, www, https))


def registered_domain(url: Column) -> Column:
    return F.substring_index(host(url), ".", -2)


def skip(url: Column) -> Column:
    h, p = host(url), path(url)
    platform = F.lit(False)
    for d in dims.SKIP_DOMAINS:
        platform = platform | (h == d) | h.endswith("." + d)
    return F.when(h.isNull(), True).otherwise((F.length(url) > 500) | h.rlike(r"^(img|cdn|static|assets|media|images|s3|files|r|go|redirect|track|click|out)\.") | p.startswith("/redirect") | p.startswith("/go/") | p.startswith("/out/") | platform)


def _category(url: Column, text: Column, value) -> Column:
    u, t = F.lower(url), F.lower(text)
    out = F.when(F.lit(False), F.lit(value("", 0)))
    for name, priority, in_url, in_text in dims.PAGE_CATEGORIES:
        out = out.when(u.rlike("|".join(in_url)) | t.rlike("|".join(in_text)), F.lit(value(name, priority)))
    return out.otherwise(F.lit(value("other", 5)))


def category(url: Column, text: Column) -> Column:
    return _category(url, text, lambda n, p: n)


def category_priority(url: Column, text: Column) -> Column:
    return _category(url, text, lambda n, p: p)
