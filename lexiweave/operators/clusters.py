"""Term links, their closure, target clusters and root-based absorption, all as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import SAFE_BY_CLUSTER, grade, inspect_pair
from ..functions.lexicons import TIER_3
from ..functions.text import acronym_key, decouple, fold, hyphen_forms, is_short_upper, is_short_word, lemma_phrase, phrase_keys, roots_of, starts_lower
from ..lineage import settled
from .keywords import lookup, resolve_hyphens
from .roots import roots_in

RULE_COLUMNS = ["raw_term", "target_term", "tier", "rule_source", "clinical_safety_check", "raw_frequency", "selected_for_export"]


def term_properties(freqs: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """Freqs with base_term, is_acronym, hyphen_resolved, lemmatized, descriptor_id, concept_id, canonical_name."""
    d = decouple(F.col("term"))
    df = freqs.select("term", "freq", d.alias("d")).select(
        "term", "freq", F.col("d.full_phrase").alias("base_term"), (F.col("d.valid") | is_short_upper(F.col("term")) | is_short_word(F.col("term"))).alias("is_acronym")
    )
    if vocabulary is not None:
        vocabulary = settled(_asked(df, vocabulary))
    df = resolve_hyphens(df, "base_term", freqs, vocabulary).withColumn("lemmatized", lemma_phrase(F.col("hyphen_resolved")))
    if vocabulary is None:
        none = F.lit(None).cast("string")
        return df.withColumns({"descriptor_id": none, "concept_id": none, "canonical_name": none})
    df = lookup(lookup(df, "lemmatized", vocabulary, "l_"), "base_term", vocabulary, "b_")
    pick = lambda c: F.when(F.col("l_matched"), F.col("l_" + c)).otherwise(F.col("b_" + c)).alias(c)
    return df.select(*freqs.select("term", "freq").columns, "base_term", "is_acronym", "hyphen_resolved", "lemmatized", *map(pick, ("descriptor_id", "concept_id", "canonical_name")))


def _asked(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The entries of the vocabulary under any form of a base_term that is looked up: a large one is gone through once, and what is left is no larger than the forms."""
    base = F.col("base_term")
    space, closed = hyphen_forms(base)
    hyphened = F.array(F.lower(space), F.lower(closed), fold(lemma_phrase(space)), fold(lemma_phrase(closed)))
    forms = F.concat(F.array(fold(base), fold(lemma_phrase(base))), F.when(F.contains(base, F.lit("-")), hyphened).otherwise(F.array().cast("array<string>")))
    asked = df.select(F.explode(F.array_distinct(forms)).alias("term")).distinct()
    return vocabulary.join(asked, "term", "left_semi")


def hyphen_and_plural_links(props: DataFrame, freqs: DataFrame) -> DataFrame:
    """(src, dst, rule_source, is_acr) of full terms whose resolved or singular form is a term."""
    full = props.where(~F.col("is_acronym")).select("term", F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("hyphen_resolved").alias("dst")), F.struct(F.lit(2).alias("o"), F.col("lemmatized").alias("dst")))).alias("x"))
    real = full.select("term", "x.o", "x.dst").where(F.col("dst") != F.col("term")).join(freqs.select(F.col("term").alias("dst")), "dst", "left_semi")
    best = real.groupBy("term").agg(F.min(F.struct("o", "dst")).alias("x"))
    return best.select(F.col("term").alias("src"), F.col("x.dst").alias("dst"), F.when(F.col("x.o") == 1, "Hyphen Resolution").otherwise("Lemmatization").alias("rule_source"), F.lit(False).alias("is_acr"))


def acronym_links(props: DataFrame) -> DataFrame:
    """Each acronym to its most frequent full term. An equi-join on initials, at most three for a term."""
    keys = props.where(~F.col("is_acronym")).select(F.col("term").alias("dst"), "freq", F.explode(phrase_keys(F.col("term"))).alias("x"))
    keys = keys.select("dst", "freq", F.col("x.key").alias("key"), "x.lower_first")
    # Of the phrases under one key only the best can win, so skewed keys shrink before the join.
    best = keys.groupBy("key", "lower_first").agg(F.min_by(F.struct("freq", "dst"), F.struct(-F.col("freq"), "dst")).alias("b"))
    acronyms = props.where("is_acronym").select(F.col("term").alias("src"), acronym_key(F.col("term")).alias("bare"))
    met = acronyms.join(best, F.lower("bare") == F.col("key")).where(~F.col("lower_first") | starts_lower(F.col("bare")))
    won = met.groupBy("src").agg(F.min_by("b.dst", F.struct(-F.col("b.freq"), F.col("b.dst"))).alias("dst"))
    return won.select("src", "dst", F.lit("Acronym Decoupling").alias("rule_source"), F.lit(True).alias("is_acr"))


def descriptor_links(props: DataFrame) -> DataFrame:
    """Full terms of a descriptor to its most frequent one (ties: the first by name)."""
    full = props.where(~F.col("is_acronym") & F.col("descriptor_id").isNotNull()).select("term", "freq", "descriptor_id", "concept_id")
    lead = full.groupBy("descriptor_id").agg(F.min_by(F.struct("term", "concept_id"), F.struct(-F.col("freq"), "term")).alias("d"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = full.join(lead, "descriptor_id").where(F.col("term") != F.col("d.term"))
    same = F.coalesce((F.col("concept_id") == F.col("d.concept_id")) & (F.col("concept_id") != ""), F.lit(False))
    label = F.when(same, F.concat(F.lit("MeSH Concept ("), "concept_id", F.lit(")"))).otherwise(F.concat(F.lit("MeSH Descriptor ("), "descriptor_id", F.lit(")")))
    return met.select(F.col("term").alias("src"), F.col("d.term").alias("dst"), label.alias("rule_source"), is_short_upper(F.col("term")).alias("is_acr"))


def term_links(props: DataFrame, freqs: DataFrame, vocabulary: bool = True) -> DataFrame:
    """G1: one (src, dst, rule_source, is_acr) at most for each term; descriptor links only fill gaps."""
    first = hyphen_and_plural_links(props, freqs).unionByName(acronym_links(props))
    if not vocabulary:
        return first
    ranked = first.withColumn("o", F.lit(1)).unionByName(descriptor_links(props).withColumn("o", F.lit(2)))
    best = ranked.groupBy("src").agg(F.min_by(F.struct("dst", "rule_source", "is_acr"), "o").alias("x"))
    return best.select("src", "x.dst", "x.rule_source", "x.is_acr")


def _to_ends(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """((src, end) of links whose chain has an end, (src, end) of those that run into a cycle, end being on it; None if there are none).

    Pointer doubling. A round moves only the pointers whose end still has a link; those at a sink leave the working set. Every chain
    has nodes at each distance from its sink, so a round in which no pointer arrives shows that all that are left
    run in circles; they go on alone until their ends are on the cycles. About log2 of the longest chain rounds.
    """
    going = pointers = links.select("src", F.col("dst").alias("end"))
    arrived: list[DataFrame] = []
    steps, left = 1, n
    while True:
        on = pointers.select(F.col("src").alias("__e"), F.col("end").alias("__n"))
        moved = settled(going.join(on, F.col("end") == F.col("__e"), "left").select("src", F.coalesce("__n", "end").alias("end"), F.col("__n").isNotNull().alias("on")))
        arrived.append(moved.where("NOT on").select("src", "end"))
        going, steps = moved.where("on").select("src", "end"), steps * 2
        now = going.count()
        pointers = reduce(DataFrame.unionByName, [*arrived, going])
        if not now:
            return pointers, None
        if now == left and steps >= now:
            return reduce(DataFrame.unionByName, arrived), going
        left = now


def close_links(links: DataFrame) -> DataFrame:
    """Each link carried on to the end of its chain, with the label of its first step.

    Links on a cycle are dropped, so that each of its terms is its own target; a chain into a cycle ends
    where it enters.
    """
    links = settled(links)
    n = links.count()
    if not n:
        return links
    ends, turning = _to_ends(links, n)
    if turning is not None:
        on_cycles = settled(turning.select(F.col("end").alias("src")).distinct())
        into = settled(links.join(turning.select("src"), "src", "left_semi").join(on_cycles, "src", "left_anti"))
        if m := into.count():
            ends = ends.unionByName(_to_ends(into, m)[0])
    return links.join(ends, "src").select("src", F.col("end").alias("dst"), "rule_source", "is_acr")


def link_rules(closed: DataFrame, freqs: DataFrame, interceptor: bool = True, custom_risk_terms: list[str] | None = None) -> DataFrame:
    """Graded rules of the closed links, without merges of a term with itself."""
    seen = inspect_pair(F.col("src"), F.col("dst"), F.col("is_acr"), custom_risk_terms)
    df = closed.where(fold(F.col("src")) != fold(F.col("dst"))).join(freqs.select(F.col("term").alias("src"), "freq"), "src", "left").withColumn("seen", seen)
    blocked = F.col("seen.is_blocked") if interceptor else F.lit(False)
    tier, safety, selected = grade(blocked, F.col("seen.reason"), F.col("rule_source"), SAFE_BY_CLUSTER)
    return df.select(F.col("src").alias("raw_term"), F.col("dst").alias("target_term"), tier.alias("tier"), "rule_source", safety.alias("clinical_safety_check"), F.coalesce("freq", F.lit(1)).alias("raw_frequency"), selected.alias("selected_for_export"))


def targets_of(freqs: DataFrame, closed: DataFrame) -> DataFrame:
    """(target_term, target_raw_freq): terms that were not carried elsewhere, and the ends of links."""
    alone = freqs.join(closed.select(F.col("src").alias("term")), "term", "left_anti").select(F.col("term").alias("target_term"))
    ends = closed.select(F.col("dst").alias("target_term"))
    return alone.unionByName(ends).distinct().join(freqs.select(F.col("term").alias("target_term"), F.col("freq").alias("target_raw_freq")), "target_term", "left").withColumn("target_raw_freq", F.coalesce("target_raw_freq", F.lit(0)))


def summarize(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """A4: targets with variant_count, selected_variant_count, combined_freq, total_potential_freq, has_blocked_variants."""
    chosen = F.when(F.col("selected_for_export"), F.col("raw_frequency")).otherwise(0)
    own = rules.groupBy("target_term").agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.count_if("selected_for_export").alias("selected_variant_count"),
        F.sum(chosen).alias("__c"),
        F.sum("raw_frequency").alias("__t"),
        F.bool_or(F.col("tier") == TIER_3).alias("has_blocked_variants"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return targets.join(own, "target_term", "left").select(
        "target_term", "target_raw_freq", zero("variant_count").alias("variant_count"), zero("selected_variant_count").alias("selected_variant_count"),
        (F.col("target_raw_freq") + zero("__c")).alias("combined_freq"), (F.col("target_raw_freq") + zero("__t")).alias("total_potential_freq"), F.coalesce("has_blocked_variants", F.lit(False)).alias("has_blocked_variants"),
    )


def _with_roots(df: DataFrame, column: str, roots: list[str] | DataFrame | None) -> DataFrame:
    """df with a row for each root of column; a table of roots is met by its index, a list by looking for each."""
    if isinstance(roots, DataFrame):
        return df.join(roots_in(df, roots, column), column)
    return df.withColumn("root", F.explode(roots_of(F.col(column), roots)))


def absorb_by_roots(freqs: DataFrame, closed: DataFrame, clusters: DataFrame, interceptor: bool = True, roots: list[str] | DataFrame | None = None, keep_orphans: bool = False, custom_risk_terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, absorbed terms) of the greedy pass that attaches lone terms to a target with a common root.

    The pass in order of (combined_freq, target_raw_freq) descending, then name, has a closed form. A lone
    term goes to the first active target with a root of its own that comes before it; a lone term without one,
    which has itself absorbed nothing, goes to the first after it. The first such term is the smallest key
    under any of its roots and the second the next key, so two minima for each root replace all pairs. Rules
    of a term that was itself absorbed are dropped with it, unless keep_orphans. roots is a list, or a table (root) of any size.
    """
    key = F.struct(-F.col("combined_freq"), -F.col("target_raw_freq"), F.col("target_term").alias("name"))
    active = clusters.where((F.col("variant_count") > 0) | (F.col("target_raw_freq") >= 2)).select("target_term", key.alias("key"))
    active = _with_roots(active, "target_term", roots).select("target_term", "key", "root")
    first = active.groupBy("root").agg(F.min("key").alias("first"))
    later = active.join(first, "root").where(F.col("key") > F.col("first")).groupBy("root").agg(F.min("key").alias("second"))
    edges = first.join(later, "root", "left")
    own = clusters.where("variant_count = 0").select(F.col("target_term").alias("term"), F.when(F.col("target_raw_freq") >= 2, key).alias("key"))
    lone = freqs.join(closed.select(F.col("src").alias("term")), "term", "left_anti").join(own, "term").select("term", "freq", "key")
    lone = _with_roots(lone, "term", roots)
    met = lone.join(edges, "root").groupBy("term", "freq", "key").agg(F.min("first").alias("first"), F.min("second").alias("second"))
    met = settled(met)
    before = F.col("key").isNull() | (F.col("first") < F.col("key"))
    one = met.where(before).select("term", "freq", F.col("first.name").alias("target"))
    busy = one.select(F.col("target").alias("term")).distinct()
    two = met.where(~before & F.col("second").isNotNull()).join(busy, "term", "left_anti").select("term", "freq", F.col("second.name").alias("target"))
    took = settled(one.unionByName(two))
    absorbed = took.select("term")
    shown = took if keep_orphans else took.join(absorbed.withColumnRenamed("term", "target"), "target", "left_anti")
    if isinstance(roots, DataFrame):
        theirs = _with_roots(shown.select("target").distinct(), "target", roots)
        shown = _with_roots(shown, "term", roots).join(theirs, ["target", "root"]).groupBy("term", "freq", "target").agg(F.min("root").alias("root"))
    else:
        shown = shown.withColumn("root", F.array_min(F.array_intersect(roots_of(F.col("term"), roots), roots_of(F.col("target"), roots))))
    seen = inspect_pair(F.col("term"), F.col("target"), False, custom_risk_terms)
    shown = shown.withColumn("seen", seen)
    blocked = F.col("seen.is_blocked") if interceptor else F.lit(False)
    safety = F.when(blocked, F.concat(F.lit("Blocked: "), F.col("seen.reason"))).otherwise(F.concat(F.lit("Peripheral Morpheme: shared root '"), "root", F.lit("' (Manual confirmation required)")))
    rules = shown.select(
        F.col("term").alias("raw_term"), F.col("target").alias("target_term"), F.lit(TIER_3).alias("tier"), F.concat(F.lit("Medical Morpheme ("), "root", F.lit(")")).alias("rule_source"),
        safety.alias("clinical_safety_check"), F.col("freq").alias("raw_frequency"), F.lit(False).alias("selected_for_export"),
    )
    return rules, absorbed


def build_clusters(freqs: DataFrame, vocabulary: DataFrame | None, interceptor: bool = True, morphemes: bool = True, roots: list[str] | DataFrame | None = None, keep_orphans: bool = False, custom_risk_terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, rules). A vocabulary of None switches its links and lookups off."""
    freqs = settled(freqs)
    props = settled(term_properties(freqs, vocabulary))
    closed = settled(close_links(term_links(props, freqs, vocabulary is not None)))
    rules = link_rules(closed, freqs, interceptor, custom_risk_terms)
    targets = targets_of(freqs, closed)
    if morphemes:
        more, absorbed = absorb_by_roots(freqs, closed, settled(summarize(targets, rules)), interceptor, roots, keep_orphans, custom_risk_terms)
        gone = absorbed.withColumnRenamed("term", "target_term")
        if keep_orphans:  # an absorbed term that absorbed others stays as their root
            gone = gone.join(more.select("target_term"), "target_term", "left_anti")
        rules = rules.unionByName(more)
        targets = targets.join(gone, "target_term", "left_anti")
    return summarize(targets, rules), rules


def ordered(clusters: DataFrame, mode: str = "combined", limit: int | None = None) -> DataFrame:
    """By combined frequency, number of variants or own frequency, descending, then by name."""
    first = {"combined": ("combined_freq", "variant_count"), "variants": ("variant_count", "combined_freq"), "frequency": ("target_raw_freq", "variant_count")}[mode]
    out = clusters.orderBy(*(F.desc(c) for c in first), "target_term")
    return out.limit(limit) if limit else out


def nested(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """O3: clusters with variants, an array of rules by frequency descending, then by name."""
    each = rules.groupBy("target_term").agg(F.array_sort(F.collect_list(F.struct((-F.col("raw_frequency")).alias("o"), *RULE_COLUMNS))).alias("v"))
    rows = clusters.join(each, "target_term", "left")
    return rows.withColumn("variants", F.transform(F.coalesce("v", F.array()), lambda x: F.struct(*(x[c].alias(c) for c in RULE_COLUMNS)))).drop("v")
