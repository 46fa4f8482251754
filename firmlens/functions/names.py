"""Names of people: three keys that fold differently on purpose, parts, and profile slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, and these letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0].isascii() and unicodedata.normalize("NFD", c) != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
MARKS = "[̀-ͯ]"


def fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), MARKS, "")


def person_key(name: Column) -> Column:
    """Lower case, accents folded, hyphens and apostrophes kept, single spaces."""
    s = F.regexp_replace(fold(F.lower(F.trim(name))), r"\s+", " ")
    return F.coalesce(F.trim(F.regexp_replace(s, r"[^a-z0-9\s\-']", "")), F.lit(""))


def hyphen_key(name: Column) -> Column:
    """Lower case, anything but ASCII letters, digits and space deleted, spaces as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+", "-")


def spaced_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", "")), r"\s+", " ")


def same_person_key(name: Column) -> Column:
    """Equal for equal person keys and for two-part names in either order."""
    parts = F.split(person_key(name), " ")
    return F.when(F.size(parts) == 2, F.array_join(F.array_sort(parts), " ")).otherwise(person_key(name))


def parts(name: Column) -> dict[str, Column]:
    p = F.filter(F.split(F.trim(name), r"\s+"), lambda x: x != "")
    n = F.size(p)
    return {
        "first": F.when(n > 0, F.get(p, F.lit(0))).otherwise(""),
        "middle": F.when(n > 2, F.array_join(F.slice(p, 2, n - 2), " ")).otherwise(""),
        "last": F.when(n > 1, F.get(p, n - 1)).otherwise(""),
    }


def company_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def linkedin_slug(name: Column) -> Column:
    """Anything but letters, digits, space and hyphens deleted, spaces as hyphens, single hyphens."""
    s = F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-"))


def names_match(a: Column, b: Column) -> Column:
    """Spaced keys are equal, first and last parts are equal, or one holds the other (4 characters at least)."""
    x, y = spaced_key(a), spaced_key(b)
    p, q = parts(x), parts(y)
    return (x == y) | ((p["first"] == q["first"]) & (p["last"] == q["last"])) | ((x.contains(y) | y.contains(x)) & (F.least(F.length(x), F.length(y)) >= 4))
