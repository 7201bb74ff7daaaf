import pytest
from pyspark.sql import functions as F

from lexiweave.functions import checks, text
from lexiweave.functions.lexicons import ROOTS
from lexiweave.operators import keywords


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "term, phrase, acronym, valid",
    [
        ("renal replacement therapy (rrt)", "renal replacement therapy", "rrt", True),
        ("HRV (heart rate variability)", "heart rate variability", "HRV", True),
        ("non-steroidal anti-inflammatory drug (NSAID)", "non-steroidal anti-inflammatory drug", "NSAID", True),
        ("sense of coherence (SC)", "sense of coherence", "SC", True),
        ("fracture (open)", "fracture (open)", None, False),
        ("stroke (left side)", "stroke (left side)", None, False),
        ("heart rate variability（HRV）", "heart rate variability", "HRV", True),
    ],
)
def test_parentheses(spark, term, phrase, acronym, valid):
    d = one(spark, term, text.decouple)
    assert (d.full_phrase, d.acronym, d.valid) == (phrase, acronym, valid)


def test_lemmas(spark):
    cases = {
        "kidney stones": "kidney stone", "two neuroses": "two neurosis", "sleep patterns": "sleep pattern", "muscle weakness": "muscle weakness",
        "plant proteomics": "plant proteomics", "viral hepatitis": "viral hepatitis", "surgeries": "surgery", "biopsies": "biopsy", "diseases": "diseasis", "boxes": "boxe", "churches": "church", "": "", "  two   words ": "two word",
        "virus": "virus", "class": "class",
    }
    rows = spark.createDataFrame(list(cases.items()), "x string, want string").select("x", "want", text.lemma_phrase(F.col("x")).alias("got")).collect()
    assert {r.x: r.got for r in rows} == cases | {"boxes": "box"}


def test_hyphens(spark):
    freqs = spark.createDataFrame([("pre-treatment", 5), ("pretreatment", 20), ("pre treatment", 2), ("prostatecancer", 90), ("re test", 7)], "term string, freq long")
    df = spark.createDataFrame([("long-term-care",), ("pre-treatment",), ("plain",), ("prostate-cancer",), ("re-test",)], "x string")
    got = {r.x: r.y for r in keywords.resolve_hyphens(df, "x", freqs, keywords.seed_vocabulary(spark), "y").collect()}
    assert got == {"long-term-care": "long term care", "pre-treatment": "pretreatment", "plain": "plain", "prostate-cancer": "prostate cancer", "re-test": "re test"}


@pytest.mark.parametrize(
    "x, y, acr, blocked",
    [
        ("recurrent glioma", "glioma", False, True), ("glioma", "refractory glioma", False, True), ("insomnia", "sleep", False, True), ("fatigues", "fatigue", False, True),
        ("asthma", "bronchial asthma", False, False), ("MDD", "major depressive disorder", True, False), ("early-stage myeloma", "stage myeloma", False, True),
    ],
)
def test_pairs(spark, x, y, acr, blocked):
    df = spark.createDataFrame([(x, y, acr)], "x string, y string, a boolean")
    assert df.select(checks.inspect_pair(F.col("x"), F.col("y"), F.col("a")).alias("s")).first().s.is_blocked == blocked


def test_custom_risk_terms(spark):
    df = spark.createDataFrame([("rare thing", "thing")], "x string, y string")
    s = df.select(checks.inspect_pair(F.col("x"), F.col("y"), False, ["RARE"]).alias("s")).first().s
    assert s.is_blocked and s.reason.endswith("(rare)")


def test_roots(spark):
    got = lambda t: set(one(spark, t, text.roots_of))
    assert all(any(r in got(w) for r in ROOTS) for w in [f"pre{ROOTS[0]}al", f"{ROOTS[5]}oid state", f"x {ROOTS[-1].upper()}IC"])
    assert not got("press release") and not got("protocol design") and not got("") and got(f"{ROOTS[0]}al {ROOTS[5]}oid") >= {ROOTS[0], ROOTS[5]}


def test_lookup_and_relations(spark):
    v = keywords.seed_vocabulary(spark)
    df = spark.createDataFrame([("Prostate Cancer ",), ("androgen antagonists",), ("nothing",), (None,)], "x string")
    got = {r.x: (r.descriptor_id, r.canonical_name, r.matched) for r in keywords.lookup(df, "x", v).collect()}
    assert got["Prostate Cancer "] == ("D011471", "Prostatic Neoplasms", True) and got["androgen antagonists"][0] == "D000726" and got["nothing"] == (None, None, False)
    pairs = spark.createDataFrame([("exercise", "aerobic exercise"), ("prostate cancer", "cancer of the prostate"), ("exercise", "x"), ("exercise", "anxiety")], "term1 string, term2 string")
    rel = {(r.term1, r.term2): r for r in keywords.synonym_relation(pairs, v).collect()}
    assert rel["exercise", "aerobic exercise"].tier == "Tier 2" and not rel["exercise", "aerobic exercise"].is_synonym
    assert rel["prostate cancer", "cancer of the prostate"].is_synonym and rel["prostate cancer", "cancer of the prostate"].concept_id == "M0017849"
    assert rel["exercise", "anxiety"].reason == "Distinct MeSH descriptors" and rel["exercise", "x"].tier == "Tier 3"


def test_arbitration(spark):
    rows = [("HRV", "heart rate variability", 9, 1, None, "heart rate variability"), ("renal calculus", "kidney stone", 3, 70, None, "kidney stone"), ("cc dd", "cc", 2, 2, "CC DD", "cc dd"), ("cc dd", "cc", 2, 2, None, "cc")]
    df = spark.createDataFrame(rows, "a string, b string, fa int, fb int, c string, want string")
    got = df.select("want", checks.arbitrate(*(F.col(c) for c in ("a", "b", "fa", "fb", "c"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_headings_and_splits(spark):
    assert one(spark, "*Sea Level/trends & change, Tides/history", text.clean_heading) == "Sea Level, Tides"
    assert one(spark, "潮汐; 盐沼；；泥滩; 海草", text.split_mixed) == ["潮汐", "盐沼", "泥滩", "海草"]
    assert one(spark, "  'a   b' ", text.clean_syntax) == "a b"
