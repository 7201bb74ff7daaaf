"""From frequencies to rules, term by term; the way by clusters is operators.clusters.build_clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import SAFE_BY_TERM, arbitrate, grade, inspect_pair
from ..functions.text import decouple, lemma_phrase
from ..lineage import settled
from ..operators.clusters import RULE_COLUMNS
from ..operators.keywords import at_least, frequency_of, lookup, resolve_hyphens


def rules_by_term(freqs: DataFrame, vocabulary: DataFrame, least: int = 2, custom_risk_terms: list[str] | None = None) -> DataFrame:
    """One rule for each term of at least `least` records, identity rules included."""
    kept = settled(at_least(freqs, least))  # it is met four times
    df = kept.withColumn("base", decouple(F.col("term"))["full_phrase"])
    df = resolve_hyphens(df, "base", kept, vocabulary).withColumn("lemma", lemma_phrase(F.col("hyphen_resolved")))
    df = frequency_of(lookup(df, "lemma", vocabulary), F.lower("lemma"), kept, "lemma_freq")
    target = arbitrate(F.col("term"), F.col("lemma"), F.col("freq"), F.col("lemma_freq"), F.col("canonical_name"))
    source = F.when(F.col("matched"), F.concat(F.lit("MeSH ("), "descriptor_id", F.lit(")"))).when(F.col("lemma") != F.col("term"), "Lemmatization").otherwise("Direct")
    df = df.select(F.col("term").alias("raw_term"), target.alias("target_term"), source.alias("rule_source"), F.col("freq").alias("raw_frequency"))
    df = df.withColumn("seen", inspect_pair(F.col("raw_term"), F.col("target_term"), False, custom_risk_terms))
    tier, safety, selected = grade(F.col("seen.is_blocked"), F.col("seen.reason"), F.col("rule_source"), SAFE_BY_TERM)
    return df.withColumns({"tier": tier, "clinical_safety_check": safety, "selected_for_export": selected}).select(*RULE_COLUMNS)
