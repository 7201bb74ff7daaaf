import random

import pytest

from lexiweave.functions.lexicons import TIER_1, TIER_2, TIER_3
from lexiweave.operators import audit, clusters, keywords, review
from lexiweave.plans.pipelines import rules_by_term

TWELVE = {
    "exercise": 210, "exercises": 33, "aerobic exercise": 47, "renal biopsy": 90, "renal-biopsy": 8, "renal biopsies": 12, "anxiety": 61, "anxieties": 5,
    "quality of life": 77, "life quality": 30, "intensity modulated beam therapy": 40, "imbt": 9,
}


def build(spark, freqs, **options):
    df = spark.createDataFrame(list(freqs.items()), "term string, freq long")
    c, r = clusters.build_clusters(df, keywords.seed_vocabulary(spark) if options.pop("vocabulary", True) else None, **options)
    return {x.target_term: x for x in c.collect()}, {x.raw_term: x for x in r.collect()}, c, r


def test_twelve_terms(spark):
    c, r, _, _ = build(spark, TWELVE)
    assert {t: x.combined_freq for t, x in c.items()} == {"exercise": 290, "renal biopsy": 110, "anxiety": 61, "quality of life": 107, "intensity modulated beam therapy": 49}
    want = {
        "exercises": (TIER_1, "MeSH Concept (M0007873)"), "aerobic exercise": (TIER_2, "MeSH Descriptor (D015444)"), "renal-biopsy": (TIER_1, "Hyphen Resolution"), "renal biopsies": (TIER_1, "Lemmatization"),
        "anxieties": (TIER_3, "Lemmatization"), "life quality": (TIER_1, "MeSH Concept (M0018318)"), "imbt": (TIER_2, "Acronym Decoupling"),
    }
    assert {t: (x.tier, x.rule_source) for t, x in r.items()} == want
    assert not r["anxieties"].selected_for_export and c["anxiety"].has_blocked_variants and not c["exercise"].has_blocked_variants


def test_roots_attach_lone_terms(spark):
    freqs = {"hepatic lesion": 200, "hepatic-lesion": 21, "hepatitis panel": 17, "hepatology": 14, "immune marker": 120, "immunotherapy": 19, "immune markers": 11, "device": 44}
    c, r, cdf, rdf = build(spark, freqs)
    assert r["hepatology"].rule_source == "Medical Morpheme (hepat)" and not r["hepatology"].selected_for_export and r["immunotherapy"].target_term == "immune marker"
    assert c["hepatic lesion"].combined_freq == 221 and c["immune marker"].combined_freq == 131 and set(c) == {"hepatic lesion", "immune marker", "device"}
    assert [v.raw_term for v in clusters.nested(cdf, rdf).where("target_term = 'hepatic lesion'").first().variants] == ["hepatic-lesion", "hepatitis panel", "hepatology"]
    c2, r2, _, _ = build(spark, freqs, morphemes=False)
    assert "hepatology" in c2 and len(r2) == 2


def test_odd_cases(spark):
    c, r, _, _ = build(spark, {"prostate cancers": 500, "prostate cancer": 100})
    assert r["prostate cancer"].tier == TIER_3 and r["prostate cancer"].target_term == "prostate cancers"
    c, r, _, _ = build(spark, {"cancers": 5, "cancer": 9, "tumors": 5, "tumor": 9}, vocabulary=False, morphemes=False)
    assert set(r) == {"cancers"}
    c, r, _, _ = build(spark, {"anxieties": 3, "anxiety": 9})
    assert r["anxieties"].clinical_safety_check == "Blocked: Concept slippage detected: conflicting high-risk modifiers (anxiety)"
    c, r, _, _ = build(spark, {"anxieties": 3, "anxiety": 9}, interceptor=False)
    assert r["anxieties"].tier == TIER_1
    c, r, _, _ = build(spark, {"quality of life (qol)": 4, "quality of life": 9}, morphemes=False)
    assert len(c) == 2 and not r
    chain = {"aaaa xx": 300, "aaaa bbbb": 20, "bbbb yy": 10}
    c, r, _, _ = build(spark, chain, vocabulary=False, roots=["aaaa", "bbbb"])
    assert set(c) == {"aaaa xx"} and set(r) == {"aaaa bbbb"}
    c, r, _, _ = build(spark, chain, vocabulary=False, roots=["aaaa", "bbbb"], keep_orphans=True)
    assert set(c) == {"aaaa xx", "aaaa bbbb"} and set(r) == {"aaaa bbbb", "bbbb yy"}


def follow(links):
    out = {}
    for raw in links:
        at, seen = links[raw], {raw}
        while at in links and at not in seen:
            seen.add(at)
            at = links[at]
        if at != raw:
            out[raw] = at
    return out


@pytest.mark.parametrize("seed", range(4))
def test_closure_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = {}
    for g in range(30):  # many small graphs side by side
        n = rng.randint(2, 11)
        links |= {f"{g}.{i}": f"{g}.{j}" for i in range(n) if rng.random() < 0.8 and (j := rng.randrange(n)) != i}
    df = spark.createDataFrame([(a, b, "x", False) for a, b in links.items()], "src string, dst string, rule_source string, is_acr boolean")
    assert {r.src: r.dst for r in clusters.close_links(df).collect()} == follow(links)
    assert clusters.close_links(df.limit(0)).count() == 0


def absorb(freqs, shares, rank):
    """The pass in order: each active target takes lone terms that share a root and have no variants yet."""
    absorber, has = {}, set()
    for t in sorted((x for x in freqs if x in rank), key=rank.get):
        for x in sorted(freqs):
            if x != t and x not in absorber and x not in has and (t, x) in shares:
                absorber[x] = t
                has.add(t)
    return absorber


@pytest.mark.parametrize("seed", range(3))
def test_absorption_on_random_roots(spark, seed):
    rng = random.Random(seed)
    names = ["".join(c * 4 for c in s) for s in "abcdefghij"]
    freqs, roots = {}, [n for n in names]
    while len(freqs) < 25:
        freqs[" ".join(rng.sample(names, rng.randint(1, 3))) + f" {len(freqs)}z"] = rng.randint(1, 9)
    of = {t: {r for r in roots if any(r in w for w in t.split())} for t in freqs}
    shares = {(a, b) for a in freqs for b in freqs if of[a] & of[b]}
    rank = {t: (-f, -f, t) for t, f in freqs.items() if f >= 2}
    want = absorb(freqs, shares, rank)
    _, r, _, _ = build(spark, freqs, vocabulary=False, roots=roots)
    assert {t: x.target_term for t, x in r.items()} == {x: t for x, t in want.items() if t not in want}


def test_by_term_rules_and_metrics(spark):
    freqs = {"gastric ulcer": 320, "gastric-ulcer": 41, "gastric ulcers": 27, "lung nodule": 150, "lung nodules": 22, "rate of change": 75, "rate-of-change": 13, "rare": 1, "mri": 66}
    r = rules_by_term(spark.createDataFrame(list(freqs.items()), "term string, freq long"), keywords.seed_vocabulary(spark))
    assert r.count() == 8
    want = {("gastric-ulcer", "gastric ulcer"), ("gastric ulcers", "gastric ulcer"), ("lung nodules", "lung nodule"), ("rate-of-change", "rate of change")}
    assert {tuple(x) for x in audit.exportable(r).select("raw_term", "target_term").collect()} == want
    docs = spark.createDataFrame([(1, "lung nodules"), (1, "lung nodule"), (2, "Lung Nodule"), (2, "lung nodules"), (3, "Lung Nodule")], "rec_seq long, kw_raw string")
    m = audit.dual_metrics(docs, spark.createDataFrame([("lung nodules", "lung nodule")], "raw string, canonical string")).first()
    assert (m.raw_sum, m.doc_count, m.reduction) == (5, 3, 2)


def test_counts_and_review(spark):
    e = spark.createDataFrame([(1, "ADT"), (1, "adt"), (1, "adt"), (2, " "), (2, None)], "rec_seq long, kw_raw string")
    assert keywords.document_frequency(e).collect()[0].freq == 2 and keywords.document_frequency(e, ignore_case=True).collect()[0].freq == 1
    _, _, c, r = build(spark, TWELVE)
    assert {x.raw_term for x in review.approve_safe(r).where("not selected_for_export").collect()} == {"anxieties"}
    none = spark.createDataFrame([], "raw_term string, selected boolean, target string")
    done = {x.raw_term: x for x in review.apply_overrides(r, review.toggle(none, "imbt", False)).collect()}
    assert not done["imbt"].selected_for_export and done["exercises"].selected_for_export
    assert [x.target_term for x in review.search(c, r, "IMB").collect()] == ["intensity modulated beam therapy"]
    p = review.panel(r.select("raw_term"), c, r).first()
    assert (p.clusters, p.variants, p.selected, p.tier_3) == (5, 7, 6, 1)
    targets, raws = {x.target_term for x in r.collect()}, {x.raw_term for x in r.collect()}
    assert not targets & raws and all(x.raw_term != x.target_term for x in r.collect())
