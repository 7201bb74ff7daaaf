"""Frequencies: a spelling is folded once, and tasks grow with the line items."""

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import keywords
from lexiweave.plans import corpus

ROWS = [(1, "Tumor"), (1, "tumor"), (1, "tumor"), (2, " tumor "), (2, "　"), (3, ""), (3, None), (None, "TUMOR"), (None, "TUMOR"), (4, "exercise"), (4, "-")]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_blanks_and_spellings(spark, ignore_case):
    got = keywords.document_frequency(spark.createDataFrame(ROWS, "rec_seq long, kw_raw string"), ignore_case)
    fold = lambda k: k.strip().lower() if k is not None else ""
    pairs = {(r, fold(k) if ignore_case else k) for r, k in ROWS}
    want = {}
    for _, k in pairs:
        if fold(k):
            want[fold(k)] = want.get(fold(k), 0) + 1
    assert dict(got.collect()) == want and got.schema["freq"].dataType.simpleString() == "bigint"


def test_spellings_are_folded_after_they_are_counted(spark):
    e = spark.range(1000).select((F.col("id") % 300).alias("rec_seq"), F.concat(F.lit("Term "), F.col("id") % 7).alias("kw_raw"))
    plan = keywords.document_frequency(e)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [rec_seq"):]
    assert plan.count("regexp_replace") >= 1 and "regexp_replace" not in below


def test_folding_case_first_folds_a_row_once(spark):
    e = spark.range(1000).select((F.col("id") % 300).alias("rec_seq"), F.concat(F.lit("Term "), F.col("id") % 7).alias("kw_raw"))
    assert keywords.document_frequency(e, ignore_case=True)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_tasks_grow_with_the_line_items(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(corpus, "PAIRS_PER_TASK", 500)
    dealt = corpus.dealt_edges(spark, data)
    assert dealt.rdd.getNumPartitions() == -(-n // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(dealt.collect()) == sorted(corpus.keyword_edges(spark, data).collect())
    parts = dealt.select("rec_seq", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == parts.select("rec_seq").distinct().count()
    plan = keywords.document_frequency(dealt)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(rec_seq") == 1
