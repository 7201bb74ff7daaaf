"""Keyword tables: frequencies, filters, vocabulary lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import SEED_VOCABULARY
from ..functions.text import fold, hyphen_forms

VOCABULARY_SCHEMA = "term string, descriptor_id string, concept_id string, canonical_name string"


def edges_of(records: DataFrame, column: str = "keywords") -> DataFrame:
    """The (rec_seq, kw_raw) table of a record table."""
    return records.select("rec_seq", F.explode(column).alias("kw_raw"))


def effective_edges(records: DataFrame) -> DataFrame:
    """(rec_seq, kw_raw) of effective keywords where there are any, else of keywords."""
    some = F.coalesce(F.size("effective_keywords") > 0, F.lit(False))
    return records.select("rec_seq", F.explode(F.when(some, F.col("effective_keywords")).otherwise(F.col("keywords"))).alias("kw_raw"))


def document_frequency(doc_kw: DataFrame, ignore_case: bool = False) -> DataFrame:
    """A1: (term, freq). Each distinct raw keyword of a record adds 1 to its folded form; blanks are dropped.

    Spellings of one keyword in one record count each, unless ignore_case.
    """
    term = fold(F.col("kw_raw")).alias("term")
    if ignore_case:
        counted = doc_kw.select("rec_seq", term).distinct().select("term", F.lit(1).alias("n"))
    else:  # folded once for each spelling, not for each record that has it
        counted = doc_kw.select("rec_seq", "kw_raw").distinct().groupBy("kw_raw").agg(F.count(F.lit(1)).alias("n")).select(term, "n")
    # Blanks count nothing and go by their sum: a condition on the term would be pushed below the distinct and fold every row.
    counts = F.when(F.col("term") != "", F.col("n")).otherwise(0)
    return counted.groupBy("term").agg(F.sum(counts).alias("freq")).where("freq > 0")


def at_least(freqs: DataFrame, least: int = 2) -> DataFrame:
    """P1."""
    return freqs.where(F.col("freq") >= least)


def run_counters(records: DataFrame, freqs: DataFrame, least: int = 2) -> DataFrame:
    """One row of documents, unique_keywords, candidate_terms."""
    counted = freqs.agg(F.count(F.lit(1)).alias("unique_keywords"), F.count_if(F.col("freq") >= least).alias("candidate_terms"))
    return records.agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(counted))


def seed_vocabulary(spark: SparkSession) -> DataFrame:
    """S13."""
    return spark.createDataFrame(SEED_VOCABULARY, VOCABULARY_SCHEMA)


def lookup(df: DataFrame, column: str, vocabulary: DataFrame, prefix: str = "") -> DataFrame:
    """Df with matched, descriptor_id, concept_id, canonical_name of column's folded value.

    A left equi-join; Spark broadcasts the vocabulary while it is below its threshold.
    """
    v = vocabulary.select(F.col("term").alias("__v"), *(F.col(c).alias(prefix + c) for c in ("descriptor_id", "concept_id", "canonical_name")))
    return df.join(v, fold(F.col(column)) == F.col("__v"), "left").withColumn(prefix + "matched", F.col("__v").isNotNull()).drop("__v")


def synonym_relation(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs (term1, term2) with is_synonym, tier, concept_id, descriptor_id, reason."""
    met = lookup(lookup(pairs, "term1", vocabulary, "a_"), "term2", vocabulary, "b_")
    both = F.col("a_matched") & F.col("b_matched")
    concept = both & (F.col("a_concept_id") == F.col("b_concept_id"))
    descriptor = both & (F.col("a_descriptor_id") == F.col("b_descriptor_id"))
    concept, descriptor = F.coalesce(concept, F.lit(False)), F.coalesce(descriptor, F.lit(False))
    return met.select(
        *pairs.columns,
        concept.alias("is_synonym"),
        F.when(concept, "Tier 1").when(descriptor, "Tier 2").otherwise("Tier 3").alias("tier"),
        F.when(concept, F.col("a_concept_id")).alias("concept_id"),
        F.when(concept | descriptor, F.col("a_descriptor_id")).alias("descriptor_id"),
        F.when(~both, "One or both terms not found in MeSH index")
        .when(concept, F.concat(F.lit("True synonyms under MeSH Concept "), "a_concept_id"))
        .when(descriptor, F.concat(F.lit("Related concepts under MeSH Descriptor "), "a_descriptor_id", F.lit(" (Broad/Narrow relation)")))
        .otherwise("Distinct MeSH descriptors")
        .alias("reason"),
    )


def frequency_of(df: DataFrame, key, freqs: DataFrame, name: str) -> DataFrame:
    """df with `name`: the frequency of the key expression, 0 where unknown. Null keys meet nothing."""
    f = freqs.select(F.col("term").alias("__t"), F.col("freq").alias("__f"))
    return df.withColumn("__k", key).join(f, F.col("__k") == F.col("__t"), "left").withColumn(name, F.coalesce("__f", F.lit(0))).drop("__k", "__t", "__f")


def resolve_hyphens(df: DataFrame, column: str, freqs: DataFrame, vocabulary: DataFrame | None, out: str = "hyphen_resolved") -> DataFrame:
    """Df with `out`. Only values with a hyphen look anything up: vocabulary first, then frequency, then the spaced form."""
    c = F.col(column)
    has = F.contains(c, F.lit("-"))
    space, closed = hyphen_forms(c)
    df = frequency_of(df, F.when(has, F.lower(space)), freqs, "__fs")
    df = frequency_of(df, F.when(has, F.lower(closed)), freqs, "__fc")
    in_s = in_c = F.lit(False)
    if vocabulary is not None:
        for name, form in (("__vs", space), ("__vc", closed)):
            v = vocabulary.select(F.col("term").alias(name)).distinct()
            df = df.join(v, F.when(has, F.lower(form)) == F.col(name), "left")
        in_s, in_c = F.col("__vs").isNotNull(), F.col("__vc").isNotNull()
    known = (F.col("__fs") > 0) | (F.col("__fc") > 0)
    best = (
        F.when(~has, c).when(in_s, space).when(in_c, closed)
        .when(known & (F.col("__fs") < F.col("__fc")), closed)
        .otherwise(space)
    )
    return df.withColumn(out, best).drop("__fs", "__fc", "__vs", "__vc")
