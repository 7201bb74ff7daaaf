"""String rules for keyword terms as column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import ACRONYM_STOP_WORDS, PROTECTED_ENDINGS, PROTECTED_WORDS, ROOTS

#: All characters of Unicode's property White_Space.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(c, F.lit(SPACE))


def fold(c: Column) -> Column:
    return F.lower(strip(c))


def split_clean(c: Column, pattern: str) -> Column:
    """Parts between matches of pattern, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def clean_syntax(c: Column) -> Column:
    """Stripped, quotes off both ends, one space for each run of white space."""
    bare = F.regexp_replace(strip(c), r"""^['"`]+|['"`]+$""", "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def clean_heading(c: Column) -> Column:
    """A subject heading without major-topic stars and subheadings."""
    return strip(F.regexp_replace(strip(F.replace(c, F.lit("*"), F.lit(""))), r"/[^,;]+", ""))


def split_mixed(c: Column) -> Column:
    """Keywords between ASCII or full-width semicolons and line ends."""
    return split_clean(F.translate(c, "；\n\r", ";;;"), ";")


def is_short_upper(c: Column) -> Column:
    """P5: at most five characters, all its cased ones upper, at least one cased."""
    t = strip(c)
    return (F.length(t) <= 5) & (t == F.upper(t)) & (t != F.lower(t))


def is_short_word(c: Column) -> Column:
    """One to six letters or digits."""
    return strip(c).rlike(r"^[\p{L}\p{N}]{1,6}$")


def _initials(words: Column) -> Column:
    return F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def acronym_key(c: Column) -> Column:
    """The letters and digits of an acronym; null where it has none or more than eight."""
    bare = F.regexp_replace(c, "[^A-Za-z0-9]", "")
    return F.when(F.length(bare).between(1, 8), bare)


def phrase_keys(c: Column) -> Column:
    """array<struct<key, lower_first>>: the initial strings that an acronym of this phrase may have.

    lower_first keys only serve acronyms of two or more characters that start in lower case.
    """
    words = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    content = F.filter(words, lambda w: ~F.lower(w).isin(ACRONYM_STOP_WORDS))
    first = F.lower(F.substring(F.get(words, F.lit(0)), 1, 1))
    mixed = F.when(F.size(content) > 1, F.concat(first, _initials(F.slice(content, 2, F.greatest(F.size(content), F.lit(1))))))
    make = lambda key, low: F.struct(key.alias("key"), F.lit(low).alias("lower_first"))
    keys = F.array(make(_initials(words), False), make(_initials(content), False), make(mixed, True))
    return F.array_distinct(F.filter(keys, lambda k: F.coalesce(k["key"] != "", F.lit(False))))


def starts_lower(bare: Column) -> Column:
    return (F.length(bare) >= 2) & bare.rlike("^[a-z]")


def aligned(acronym: Column, phrase: Column) -> Column:
    """Whether the acronym's letters are initials of the phrase."""
    bare = acronym_key(acronym)
    low = F.lower(bare)
    ok = F.exists(phrase_keys(phrase), lambda k: (k["key"] == low) & (~k["lower_first"] | starts_lower(bare)))
    return F.coalesce(ok, F.lit(False))


_PAREN = r"^(.*?)\s*[(（](.*?)[)）]$"


def decouple(c: Column) -> Column:
    """E5: struct<full_phrase, acronym, valid> of a term such as `full phrase (fp)` or `FP (full phrase)`."""
    t = strip(c)
    outer, inner = strip(F.regexp_extract(t, _PAREN, 1)), strip(F.regexp_extract(t, _PAREN, 2))
    make = lambda f, a, v: F.struct(f.alias("full_phrase"), a.alias("acronym"), F.lit(v).alias("valid"))
    both = t.rlike(_PAREN)
    return F.when(both & aligned(inner, outer), make(outer, inner, True)).when(both & aligned(outer, inner), make(inner, outer, True)).otherwise(make(t, F.lit(None).cast("string"), False))


def hyphen_forms(c: Column) -> tuple[Column, Column]:
    """The spaced and the closed form."""
    return strip(F.replace(c, F.lit("-"), F.lit(" "))), strip(F.replace(c, F.lit("-"), F.lit("")))


def is_protected(word: Column, words: list[str] | None = None) -> Column:
    """Listed, or with a protected ending."""
    low = F.lower(word)
    return low.isin(words or PROTECTED_WORDS) | low.rlike(f"({'|'.join(PROTECTED_ENDINGS)})$")


def lemma_word(word: Column, words: list[str] | None = None) -> Column:
    """The singular by the rule cascade; a changed word is in lower case."""
    low = F.lower(word)
    cut = lambda n: F.substring(low, F.lit(1), F.length(low) - n)
    greek = F.concat(cut(3), F.lit("sis"))
    return (
        F.when(is_protected(word, words), word)
        .when(low.endswith("ses") & ~low.endswith("sses") & (greek.isin(words or PROTECTED_WORDS) | (F.length(low) > 5)), greek)
        .when(low.endswith("ies") & (F.length(low) > 4), F.concat(cut(3), F.lit("y")))
        .when(low.endswith("es") & (F.length(low) > 4), F.when(low.rlike("(ches|shes|xes|zes|sses)$"), cut(2)).otherwise(cut(1)))
        .when(low.endswith("s") & ~low.rlike("(ss|us|is)$"), cut(1))
        .otherwise(word)
    )


def lemma_phrase(c: Column, words: list[str] | None = None) -> Column:
    """The phrase with its last word in the singular and single spaces; blank gives an empty string."""
    parts = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    last = F.element_at(parts, -1)
    rest = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(parts) == 0, "").otherwise(F.array_join(F.concat(rest, F.array(lemma_word(last, words))), " "))


def roots_of(c: Column, roots: list[str] | None = None) -> Column:
    """Sorted roots of four letters or more within the a-z runs of the term."""
    listed = F.array(*(F.lit(r) for r in sorted(roots if roots is not None else ROOTS) if len(r) >= 4))
    low = F.lower(c)
    return F.filter(listed, lambda r: F.contains(low, r))


def shared_roots(a: Column, b: Column, roots: list[str] | None = None) -> Column:
    """E11."""
    return F.array_intersect(roots_of(a, roots), roots_of(b, roots))
