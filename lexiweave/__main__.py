"""From export files to thesaurus files and audit table in one call: `python -m lexiweave PATH... --out FOLDER`."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import settled
from .operators import clusters, keywords
from .plans.pipelines import rules_by_term
from .sources import sinks, tables


def harmonise(
    spark: SparkSession, paths: str | list[str], out: str | Path, least: int = 2, by_cluster: bool = False, vocabulary: DataFrame | None = None, custom_risk_terms: list[str] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """(rules, counters) of the records in paths; out gets the thesaurus files and the audit table.

    By term, terms of fewer records than `least` are left out; by cluster all terms take part and the rules without identity merges are
    exported. Counters are documents, unique_keywords and candidate_terms. Term files, which hold counts and no records, count by their own numbers
    where paths hold nothing else. Files without records give files without rules.
    """
    records = settled(tables.read_records(spark, paths))
    edges = keywords.effective_edges(records)
    others = records.where(F.col("source_database") != "VOSviewer")
    freqs = keywords.document_frequency(edges)
    if others.isEmpty() and not records.isEmpty():
        freqs = tables.vos_frequencies(tables.read_lines(spark, paths)).where("term <> ''")
    freqs = settled(freqs)
    vocabulary = keywords.seed_vocabulary(spark) if vocabulary is None else vocabulary
    if by_cluster:
        rules = clusters.build_clusters(freqs, vocabulary, custom_risk_terms=custom_risk_terms)[1]
    else:
        rules = rules_by_term(freqs, vocabulary, least, custom_risk_terms)
    rules = settled(rules)
    base = str(out).rstrip("/")
    if "://" not in base:
        Path(base).mkdir(parents=True, exist_ok=True)
    sinks.write_vosviewer(rules, f"{base}/thesaurus_vosviewer.txt")
    sinks.write_citespace(rules, f"{base}/thesaurus_citespace.txt")
    sinks.write_bibliometrix(rules, f"{base}/thesaurus_bibliometrix.csv")
    sinks.write_audit(rules, f"{base}/audit_table.csv", edges if not others.isEmpty() else None)
    return rules, keywords.run_counters(records, freqs, least).first().asDict()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexiweave", description="Harmonise the keywords of literature-database exports.")
    parser.add_argument("paths", nargs="+", help="files or folders of any mix of formats")
    parser.add_argument("--out", default="output", help="folder for the results, shared with the executors")
    parser.add_argument("--least", type=int, default=2, help="records that a term needs (not by cluster)")
    parser.add_argument("--clusters", action="store_true", help="link terms into clusters instead of term by term")
    parser.add_argument("--risk-term", action="append", help="a further term that blocks merges; may be repeated")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("lexiweave").getOrCreate()
    _, counters = harmonise(spark, given.paths, given.out, given.least, given.clusters, custom_risk_terms=given.risk_term)
    print(*(f"{name}: {n}" for name, n in counters.items()), f"written to {given.out}", sep="\n")


if __name__ == "__main__":
    main()
