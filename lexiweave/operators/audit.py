"""Dual metrics and the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..lineage import settled

#: Rows of a mapping that is sent to all executors; a larger one is met in an exchange.
SENT = 200_000


def mapping_of(rules: DataFrame) -> DataFrame:
    """(raw, canonical) of the selected rules, folded; of several targets for one raw the last by name serves."""
    chosen = rules.where("selected_for_export").select(fold(F.col("raw_term")).alias("raw"), fold(F.col("target_term")).alias("canonical"))
    return chosen.groupBy("raw").agg(F.max("canonical").alias("canonical"))


def dual_metrics(doc_kw: DataFrame, mapping: DataFrame) -> DataFrame:
    """(canonical, raw_sum, doc_count, reduction) over distinct keywords of records.

    A keyword maps by its folded form, else by itself, else to itself.
    """
    mapping = settled(mapping)
    sent = F.broadcast if mapping.count() <= SENT else lambda m: m
    # One exchange, by record: what is counted per record needs no other while the mapping is sent.
    once = doc_kw.select("rec_seq", "kw_raw").repartition("rec_seq").distinct().withColumn("__f", fold(F.col("kw_raw")))
    by_fold = sent(mapping.select(F.col("raw").alias("__f"), F.col("canonical").alias("__a")))
    by_self = sent(mapping.select(F.col("raw").alias("kw_raw"), F.col("canonical").alias("__b")))
    met = once.join(by_fold, "__f", "left").join(by_self, "kw_raw", "left")
    named = met.select("rec_seq", fold(F.coalesce("__a", "__b", "kw_raw")).alias("canonical")).where(F.col("canonical") != "")
    # Records are counted by a first pass on (canonical, record), so a hot keyword is summed in parts.
    parts = named.groupBy("canonical", "rec_seq").agg(F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("canonical").agg(F.sum("n").alias("raw_sum"), F.count(F.lit(1)).alias("doc_count"))
    return sums.withColumn("reduction", F.col("raw_sum") - F.col("doc_count"))


def audit_rows(rules: DataFrame, doc_kw: DataFrame | None) -> DataFrame:
    """Rules with raw_sum, doc_count, reduction, export_status; without records, a rule's own frequency."""
    key = fold(F.col("target_term"))
    if doc_kw is None:
        met = rules.withColumns({c: F.lit(None).cast("long") for c in ("raw_sum", "doc_count", "reduction")})
    else:
        rules = settled(rules)
        met = rules.join(dual_metrics(doc_kw, mapping_of(rules)), key == F.col("canonical"), "left")
    return met.select(
        "raw_term", "target_term", "tier", "rule_source", "clinical_safety_check",
        F.coalesce("raw_sum", "raw_frequency").alias("raw_sum"), F.coalesce("doc_count", "raw_frequency").alias("doc_count"), F.coalesce("reduction", F.lit(0)).alias("reduction"),
        F.when(F.col("selected_for_export"), "Included").otherwise("Excluded/Review Needed").alias("export_status"),
    )


def exportable(rules: DataFrame, include_unselected: bool = False) -> DataFrame:
    """Selected rules that are no merges with themselves."""
    kept = fold(F.col("raw_term")) != fold(F.col("target_term"))
    return rules.where(kept if include_unselected else kept & F.col("selected_for_export"))


def pair_lines(rules: DataFrame, include_unselected: bool = False, separator: str = "\t") -> DataFrame:
    """K1, K2: (line) of raw and target for each exportable rule."""
    return exportable(rules, include_unselected).select(F.concat_ws(separator, "raw_term", "target_term").alias("line"))
