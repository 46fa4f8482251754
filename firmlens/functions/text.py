"""Text: mailboxes, visible text, chunks, labels, classes of errors, merging of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlens.functions import dims

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def generic_mailbox(email: Column) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    return local.rlike("^(" + "|".join(dims.GENERIC_MAILBOXES) + r")($|\.)")


def valid_email(email: Column) -> Column:
    return email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def emails(content: Column) -> Column:
    """Personal addresses in the text, distinct, in lower case."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(f"({EMAIL})"), F.lit(1)), lambda x: F.lower(x)))
    return F.filter(found, lambda x: ~generic_mailbox(x))


def visible_text(html: Column) -> Column:
    """Without scripts, styles, navigation, headers, footers and tags; space squeezed."""
    s = html
    for tag in ("script", "style", "nav", "header", "footer"):
        s = F.regexp_replace(s, rf"(?is)<{tag}[\s>].*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))


def is_html(content: Column) -> Column:
    return content.contains("<html") | content.contains("<a ") | content.contains("<!DOCTYPE")


def title(content: Column) -> Column:
    """The first "# " line of a markdown text."""
    return F.nullif(F.trim(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


#: What counts as space at the ends of a text (a fixed value).
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def chunks(content: Column, size: int = 15000, overlap: int = 500, least: int = 100) -> Column:
    """(start_at, chunk) of overlapping chunks; those with fewer than `least` characters between their spaces are left out. A text that fits one chunk is taken whole, however short."""
    n = F.length(content)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)))
    parts = F.transform(starts, lambda s: F.struct(s.cast("long").alias("start_at"), F.substr(content, s + 1, F.lit(size)).alias("chunk")))
    return F.filter(parts, lambda p: (n <= size) | (F.length(F.btrim(p["chunk"], F.lit(SPACES))) >= least))


def sections(given: Column, most: int = 15) -> Column:
    """The first 15 sections of a plan (structs of key, label, desc) with clean keys; a missing label is "Section", and those without key or label go."""
    clean = F.transform(F.slice(given, 1, most), lambda s: F.struct(section_key(F.coalesce(s["key"], F.lit(""))).alias("key"), F.coalesce(s["label"], F.lit("Section")).alias("label"), F.coalesce(s["desc"], F.lit("")).alias("desc")))
    return F.filter(clean, lambda s: (s["key"] != "") & (s["label"] != ""))


def classed(message: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The first class whose pattern the message fits."""
    m = F.lower(message)
    out = F.when(F.lit(False), F.lit(""))
    for name, p in rules:
        out = out.when(m.rlike(p), F.lit(name))
    return out.otherwise(otherwise)


def error_class(message: Column) -> Column:
    return classed(message, dims.ERRORS, F.lit("unknown"))


def site_error(message: Column) -> Column:
    """What a failed check of a site says."""
    return classed(message, dims.SITE_ERRORS, F.concat(F.lit("Failed to fetch: "), F.substring(message, 1, 100)))


def verification_error(message: Column) -> Column:
    """What a failed verification says."""
    return classed(message, dims.VERIFICATION_ERRORS, F.lit("Verification unavailable"))


def least_chars(url: Column) -> Column:
    """The visible characters that a page needs: pages of people more than others."""
    return F.when(url.contains("/team") | url.contains("/people") | url.contains("/about"), 1000).otherwise(100)


def of_portfolio(html: Column) -> Column:
    """Whether a page speaks of a portfolio."""
    return F.lower(html).rlike("|".join(dims.PORTFOLIO_WORDS))


def log_status(filled: Column, total: Column) -> Column:
    return F.when(filled == 0, "failed").when(filled < total, "partial").otherwise("success")


def confidence_number(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in dims.CONFIDENCE.items():
        out = out.when(label == k, F.lit(v))
    return out.otherwise(F.lit(dims.OTHER_CONFIDENCE))


def member_confidence(linkedin: Column, email: Column) -> Column:
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(has(linkedin), "High").when(has(email), "Medium").otherwise("Low")


def section_key(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(label), "[^a-z0-9_]", "_"), 1, 40)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def merge_text(a: Column, b: Column) -> Column:
    """Two values of a field: an empty one gives way, one that holds the other stays, else new segments are appended."""
    old, new = F.coalesce(F.trim(a), F.lit("")), F.coalesce(F.trim(b), F.lit(""))
    cut = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    more = F.array_except(cut(new), cut(old))
    return F.when(old == "", new).when((new == "") | F.lower(old).contains(F.lower(new)), old).when(F.lower(new).contains(F.lower(old)), new).otherwise(F.array_join(F.concat(F.array(old), more), "; "))


def exported(c: Column) -> Column:
    """Null, NaN and "nan" become empty."""
    s = c.cast("string")
    return F.when(s.isNull() | (F.lower(s) == "nan"), "").otherwise(s)


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
