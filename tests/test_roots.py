import random

from pyspark.sql import functions as F

from lexiweave.functions.lexicons import ROOTS
from lexiweave.operators import clusters
from lexiweave.operators.roots import root_index, roots_in


def test_five_thousand_roots_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("abcdeo") for _ in range(rng.randint(lo, hi)))
    roots = [word(4, 9) for _ in range(5200)] + ["abc", "ab-cd", "Abcde", "abcde", None, "", "ab cd"]
    terms = [f"{word(2, 14)} {word(1, 12).upper()}-{word(3, 12)}2{word(1, 9)}" for _ in range(600)] + [None, "", "éabcdé", "abcde", "abcde", "ABCDEF abcdef"]
    listed = {r.lower() for r in roots if r and r.isascii() and r.isalpha() and len(r) >= 4}
    assert len(listed) > 4000
    runs = lambda t: "".join(c if "a" <= c <= "z" else " " for c in t.lower()).split()
    want = {(t, r) for t in terms if t for run in runs(t) for r in listed if r in run}
    r, t = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for n, xs in (("root", roots), ("term", terms)))
    got = [tuple(x) for x in roots_in(t, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    index = root_index(r)
    assert index.count() == len(listed)
    # Each root stands under one gram, and the fullest of these holds few of them.
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] < len(listed) / 50
    assert roots_in(t, r.limit(0)).count() == 0 == roots_in(t.limit(0), r).count()


def test_clusters_by_a_table_of_roots(spark):
    freqs = spark.createDataFrame([("nephritic syndrome", 300), ("nephritis", 80), ("nephropathy", 25), ("cardiology", 70), ("cardiac arrest", 90), ("electrocardiogram", 4), ("plain", 50)], "term string, freq long")
    table = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    a = clusters.build_clusters(freqs, None)
    b = clusters.build_clusters(freqs, None, roots=table)
    for x, y in zip(a, b):
        assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.select(x.columns).collect()), key=str)
    assert a[1].count() > 1
