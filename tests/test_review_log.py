"""A review log against recomputing everything."""

import random

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import audit, review, review_log
from lexiweave.operators.clusters import RULE_COLUMNS

TERMS = [f"t{i}" for i in range(12)]


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(5)
    rules = [(t if i % 4 else t.upper(), TERMS[rng.randrange(12)], f"Tier {1 + i % 3}", "x", "Passed", 1, i % 3 != 0) for i, t in enumerate(TERMS + TERMS[:4])]
    kws = [(r, rng.choice(TERMS + [t.upper() for t in TERMS] + [" ", "free"])) for r in range(300) for _ in range(4)] + [(1, None), (None, "t1")]
    kws += [(r, "t0") for r in range(300)]  # a keyword of every record
    return spark.createDataFrame(rules, ", ".join(f"{c} {t}" for c, t in zip(RULE_COLUMNS, "string string string string string long boolean".split()))), spark.createDataFrame(kws, "rec_seq long, kw_raw string")


def by_hand(actions):
    state = {}
    for _, term, selected, target, reset in sorted(actions, key=lambda a: a[0]):
        if term is None:
            continue
        s, t = (None, None) if reset else state.get(term, (None, None))
        state[term] = (s if selected is None else selected, t if target is None else target)
    return {k: v for k, v in state.items() if v != (None, None)}


def agrees(spark, folder, inputs, actions):
    rules, kws = inputs
    wanted = by_hand(actions)
    got = {r.raw_term: (r.selected, r.target) for r in review_log.overrides(spark, folder).collect()}
    assert got == wanted
    over = spark.createDataFrame([(k, *v) for k, v in wanted.items()], "raw_term string, selected boolean, target string")
    whole = audit.dual_metrics(kws, audit.mapping_of(review.apply_overrides(rules, over)))
    cols = ["canonical", "raw_sum", "doc_count", "reduction"]
    assert sorted(review_log.metrics(spark, folder).select(cols).collect()) == sorted(whole.select(cols).collect())


def test_log_equals_recomputation(spark, tmp_path, inputs):
    rng, folder, done = random.Random(9), str(tmp_path / "review"), []
    review_log.start(folder, *inputs)
    agrees(spark, folder, inputs, done)
    for size in (7, 0, 40):
        batch = [
            (len(done) + i, rng.choice([*TERMS, "T0", "T4", "nobody", None]), rng.choice([True, False, None]), rng.choice([None, None, "New One", "t3", ""]), rng.random() < 0.2) for i in range(size)
        ]
        done += batch
        review_log.record(folder, spark.createDataFrame(batch, review_log.ACTION))
        agrees(spark, folder, inputs, done)
    small = str(tmp_path / "small")
    review_log.compact(spark, folder, small)
    agrees(spark, small, inputs, done)
    # Clearing every term gives the rules as proposed.
    clear = review_log.overrides(spark, small).select(F.lit(99).alias("seq"), "raw_term", F.lit(None).cast("boolean").alias("selected"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("reset"))
    review_log.record(small, clear)
    agrees(spark, small, inputs, [])


def test_unfinished_version_does_not_count(spark, tmp_path, inputs, monkeypatch):
    folder = str(tmp_path / "review")
    review_log.start(folder, *inputs)
    batch = [(1, "t1", True, "Elsewhere", False)]

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(review_log, "_finish", lost)
        with pytest.raises(RuntimeError):
            review_log.record(folder, spark.createDataFrame(batch, review_log.ACTION))
    agrees(spark, folder, inputs, [])
    review_log.record(folder, spark.createDataFrame(batch, review_log.ACTION))
    agrees(spark, folder, inputs, batch)
    with pytest.raises(ValueError):
        review_log.start(folder, *inputs)


def test_without_rows(spark, tmp_path, inputs):
    folder = str(tmp_path / "review")
    review_log.start(folder, inputs[0].limit(0), inputs[1].limit(0))
    review_log.record(folder, spark.createDataFrame([(1, "t1", True, "x", False)], review_log.ACTION))
    assert review_log.metrics(spark, folder).count() == 0 and review_log.reviewed_rules(spark, folder).count() == 0
