"""Pair inspection, tiers and target choice as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import RISK_TERMS, TIER_1, TIER_2, TIER_3
from .text import is_short_upper, strip

BYPASSED = "Verified biomedical acronym equivalence safely bypassed interception."
PASSED = "Clinical safety check passed."
SLIPPED = "Concept slippage detected: conflicting high-risk modifiers ("


def risk_tokens(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters, digits and hyphens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-zA-Z0-9\-]+"), F.lit(0)))


def inspect_pair(x: Column, y: Column, acronym: Column | bool = False, custom: list[str] | None = None) -> Column:
    """struct<is_blocked, risk_level, conflicts, reason> of merging x and y."""
    terms = [*RISK_TERMS, *(t.lower() for t in custom or [])]
    lexicon = F.array(*map(F.lit, sorted(set(terms))))
    phrases = sorted({t for t in terms if " " in t})
    a, b = risk_tokens(x), risk_tokens(y)
    delta = F.array_union(F.array_except(a, b), F.array_except(b, a))
    px, py = F.lower(strip(x)), F.lower(strip(y))
    sided = F.filter(F.array(*map(F.lit, phrases)).cast("array<string>"), lambda p: F.contains(px, p) != F.contains(py, p))
    conflicts = F.array_sort(F.array_union(F.array_intersect(delta, lexicon), sided))
    acr = F.lit(acronym) if isinstance(acronym, bool) else acronym
    conflicts = F.when(acr, F.array().cast("array<string>")).otherwise(conflicts)
    blocked = F.size(conflicts) > 0
    reason = F.when(acr, BYPASSED).when(blocked, F.concat(F.lit(SLIPPED), F.array_join(conflicts, ", "), F.lit(")"))).otherwise(PASSED)
    return F.struct(blocked.alias("is_blocked"), F.when(blocked, "HIGH_RISK").otherwise("SAFE").alias("risk_level"), conflicts.alias("conflicts"), reason.alias("reason"))


def grade(blocked: Column, reason: Column, rule_source: Column, safe_words: str) -> tuple[Column, Column, Column]:
    """(tier, clinical_safety_check, selected_for_export); safe_words: alternatives that make a rule Tier 1."""
    tier = F.when(blocked, TIER_3).when(rule_source.rlike(safe_words), TIER_1).otherwise(TIER_2)
    return tier, F.when(blocked, F.concat(F.lit("Blocked: "), reason)).otherwise("Passed"), ~blocked


#: E17, for single terms; E18, for clusters.
SAFE_BY_TERM = "Lemmatization|Hyphen|Punctuation|Syntax"
SAFE_BY_CLUSTER = "Lemmatization|Hyphen|Syntax|Concept"


def arbitrate(a: Column, b: Column, freq_a: Column, freq_b: Column, canonical: Column) -> Column:
    """The term that stands for both; freq_a and freq_b are 0 where unknown, canonical may be null."""
    short_a, short_b = is_short_upper(a), is_short_upper(b)
    return (
        F.when(short_a & ~short_b, b)
        .when(short_b & ~short_a, a)
        .when(freq_a > freq_b, a)
        .when(freq_b > freq_a, b)
        .when(F.lower(a) == F.lower(canonical), a)
        .when(F.lower(b) == F.lower(canonical), b)
        .when(F.length(a) <= F.length(b), a)
        .otherwise(b)
    )
