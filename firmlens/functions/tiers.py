"""Decision-maker tiers of job titles as one ordered conditional expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The titles of each tier, departments and keywords, in their own order.
DEPARTMENTS = ["investing", "investment team", "investments", "deal team", "seed/early", "seed", "early stage", "growth", "growth stage"]
EXCLUDED_PARTNERS = ["operating partner", "venture partner", "limited partner", "strategic partner", "executive partner"]
TIER1 = ["chief executive officer", "ceo", "chief investment officer", "cio", "managing partner", "general partner", "founding partner", "senior partner", "equity partner", "investment partner", "managing director", "md", "partner"]
TIER2 = ["principal", "venture principal", "investment principal", "vice president", "vp", "vice-president", "vp of investments", "vice president of investments", "senior associate", "sr associate", "sr. associate", "senior investment manager", "investment manager", "investor relations", "ir partner", "head of investor relations"]
TIER3 = ["associate", "investment associate", "venture associate", "analyst", "investment analyst", "venture analyst"]
EXCLUDED = ["limited partner", "lp", " lp ", "investor", "angel investor", "operating partner", "venture partner", "strategic partner", "executive partner", "entrepreneur in residence", "eir", "portfolio manager", "portfolio director", "portfolio operations", "portfolio manger", "investment operations", "investment data analyst", "data analyst", "data strategist", "data engineer", "operations analyst", "program manager", "program associate", "accelerator manager", "community manager", "general manager", "capital formation", "fund accountant", "fund controller", "financial analyst", "chief financial officer", "cfo", "chief operating officer", "coo", "chief technology officer", "cto", "chief marketing officer", "cmo", "chief people officer", "chief commercial officer", "head of", "director of", "legal", "counsel", "attorney", "compliance", "finance", "accounting", "accountant", "controller", "treasurer", "operations", "admin", "assistant", "coordinator", "marketing", "communications", "public relations", "pr", "human resources", "hr", "recruiter", "talent", "learning", "education", "designer", "experience", "advisor", "consultant", "board member", "board observer", "fellow", "scholar"]
INVESTMENT_WORDS = ["invest", "venture", "vc", "capital", "fund", "portfolio", "deal", "partner", "principal", "associate", "analyst"]

PRIORITY = {"Tier 1": 1, "Tier 2": 2, "Tier 3": 3, "Exclude": 999}
#: (tier, description, test): "words" are whole words, "part" is anywhere in the title.
RULES = [
    ("Tier 1", "Investment team member (department-based classification)", "part", DEPARTMENTS),
    ("Exclude", "Non-deal sourcing partner role", "words", EXCLUDED_PARTNERS),
    ("Tier 1", "Senior Partner - Makes final investment decisions", "words", TIER1),
    ("Tier 2", "Senior Deal Team - Leads due diligence and deal execution", "words", TIER2),
    ("Tier 3", "Junior Deal Team - Sources deals and conducts initial evaluations", "words", TIER3),
    ("Exclude", "Non-deal sourcing role", "words", EXCLUDED),
    ("Tier 3", "Unknown investment role - Defaulting to junior deal team", "part", INVESTMENT_WORDS),
]
EMPTY = ("Tier 3", "Unknown role (empty title) - Defaulting to junior deal team")
OTHER = ("Exclude", "Non-investment role")


def pattern(kind: str, items: list[str]) -> str:
    """One regular expression in the syntax that Java and RE2 share; words end at ASCII boundaries."""
    any_of = "|".join(re.escape(x) for x in items if x == x.strip())
    return f"({any_of})" if kind == "part" else f"(^|[^a-z0-9_])({any_of})($|[^a-z0-9_])"


def _pick(title: Column, value) -> Column:
    t = F.lower(F.trim(title))
    out = F.when(title.isNull() | (F.trim(title) == ""), F.lit(value(*EMPTY)))
    for tier, text, kind, items in RULES:
        out = out.when(t.rlike(pattern(kind, items)), F.lit(value(tier, text)))
    return out.otherwise(F.lit(value(*OTHER)))


def tier(title: Column) -> Column:
    return _pick(title, lambda t, _: t)


def tier_priority(title: Column) -> Column:
    return _pick(title, lambda t, _: PRIORITY[t])


def tier_description(title: Column) -> Column:
    return _pick(title, lambda _, d: d)


def sql(title: str, what: str = "tier") -> str:
    """The same as a text for the other engine."""
    value = {"tier": lambda t, d: f"'{t}'", "priority": lambda t, d: str(PRIORITY[t]), "description": lambda t, d: f"'{d}'"}[what]
    whens = " ".join(f"WHEN regexp_matches(lower(trim({title})), '{pattern(k, i)}') THEN {value(t, d)}" for t, d, k, i in RULES)
    return f"CASE WHEN {title} IS NULL OR trim({title}) = '' THEN {value(*EMPTY)} {whens} ELSE {value(*OTHER)} END"
