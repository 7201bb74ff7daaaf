"""Review of proposed rules: batch actions, overrides, search and the summary panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import TIER_3



def _is_t3():
    return F.col("tier") == TIER_3


def approve_safe(rules: DataFrame) -> DataFrame:
    """Selected is whether the tier is not 3."""
    return rules.withColumn("selected_for_export", ~_is_t3())


def exclude_tier_3(rules: DataFrame) -> DataFrame:
    """R2."""
    return rules.withColumn("selected_for_export", F.col("selected_for_export") & ~_is_t3())


def set_cluster(rules: DataFrame, target: str, choice: str) -> DataFrame:
    """`all`, `safe` or `none` of one target's rules."""
    value = {"all": F.lit(True), "safe": ~_is_t3(), "none": F.lit(False)}[choice]
    return rules.withColumn("selected_for_export", F.when(F.col("target_term") == target, value).otherwise(F.col("selected_for_export")))


def toggle(overrides: DataFrame, raw_term: str, selected: bool) -> DataFrame:
    """Overrides (raw_term, selected, target) with this choice for one term."""
    old = overrides.where(F.col("raw_term") == raw_term).agg(F.max("target").alias("target"))
    row = old.select(F.lit(raw_term).alias("raw_term"), F.lit(selected).alias("selected"), "target")
    return overrides.where(F.col("raw_term") != raw_term).unionByName(row)


def overrides_of(rules: DataFrame) -> DataFrame:
    """The overrides that keep the present choices (what a batch action writes to the draft)."""
    return rules.select("raw_term", F.col("selected_for_export").alias("selected"), F.lit(None).cast("string").alias("target"))


def apply_overrides(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules with an override's choice and target where it has them. R3 is leaving it out."""
    o = overrides.select("raw_term", F.col("selected").alias("__s"), F.col("target").alias("__t"))
    return rules.join(o, "raw_term", "left").select(
        "raw_term", F.coalesce("__t", "target_term").alias("target_term"), "tier", "rule_source", "clinical_safety_check", "raw_frequency", F.coalesce("__s", "selected_for_export").alias("selected_for_export")
    )


def search(clusters: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Clusters whose target or a variant holds the text, in any case."""
    low = text.lower()
    hit = rules.where(F.contains(F.lower("raw_term"), F.lit(low))).select("target_term").distinct().withColumn("__h", F.lit(True))
    return clusters.join(hit, "target_term", "left").where(F.contains(F.lower("target_term"), F.lit(low)) | F.coalesce("__h", F.lit(False))).drop("__h")


def scope(clusters: DataFrame, which: str = "all") -> DataFrame:
    """`variants`, `blocked` or `all`."""
    return {"variants": clusters.where("variant_count > 0"), "blocked": clusters.where("has_blocked_variants"), "all": clusters}[which]


def panel(freqs: DataFrame, clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of terms, clusters with variants, variants, selected and Tier 3 rules."""
    a = freqs.agg(F.count(F.lit(1)).alias("terms"))
    b = clusters.agg(F.count_if(F.col("variant_count") > 0).alias("clusters"))
    c = rules.agg(F.count(F.lit(1)).alias("variants"), F.count_if("selected_for_export").alias("selected"), F.count_if(_is_t3()).alias("tier_3"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))
