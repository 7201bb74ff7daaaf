import hashlib
import struct

import xxhash
from pyspark.sql import functions as F

from lexiweave.llm import sketches


def brute(rows):
    rows = sorted({(i if i is not None else -(1 << 63), t or "") for i, t in rows}, key=lambda r: -r[0])
    out = {}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        h = len(t) // 2
        out[i] = (len(t), t[: len(t) - h] + after[:h])
    return out


def test_edits_follow_descending_ids(spark):
    rows = [(i * 7 % 101, " ".join(f"é{i}w{j}" for j in range(i % 13))) for i in range(101)] + [(None, "last one 😀 here"), (500, None), (400, "short")]
    rows.append(rows[5])
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    got = sketches.edited_fingerprints(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited) == want[r.doc_id if r.doc_id is not None else -(1 << 63)]
    assert sketches.edited_fingerprints(df.limit(0)).count() == 0
    assert sketches.edited_fingerprints(df.where("doc_id = 400")).first().edited == "sho" + "sh"


def test_small_sets_are_exact_and_estimates_close(spark):
    a = [f"w{i}" for i in range(3000)]
    rows = [("x y z",), ("x y z",), ("",), (None,), (" ".join(a),), (" ".join(a[600:] + [f"q{i}" for i in range(600)]),)]
    s = sketches.with_sketch(spark.createDataFrame(rows, "text string"), "text", "s").collect()
    assert len(s[0].s) == 1 and s[0].s == s[1].s and s[2].s == s[3].s == [] and len(s[4].s) == sketches.K
    one = spark.createDataFrame([(s[4].s, s[5].s, s[2].s)], "a array<long>, b array<long>, e array<long>")
    c = one.select(
        sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c"),
        sketches.distinct_count(F.col("a")).alias("n"), sketches.resemblance(F.col("a"), F.col("e")).alias("z"), sketches.resemblance(F.col("e"), F.col("e")).alias("ee"),
    ).first()
    assert abs(c.r - 2396 / 3596) < 0.15 and abs(c.c - 0.8) < 0.15 and abs(c.n / 2996 - 1) < 0.3 and c.z == 0 and c.ee == 1


def test_merge_of_parts_is_the_whole(spark):
    rows = [("g", " ".join(f"w{i}" for i in range(n, n + 300))) for n in (0, 296, 592)]
    df = sketches.with_sketch(spark.createDataFrame(rows, "g string, text string"), "text", "s", k=50)
    merged = sketches.merge_all(df, ["g"], "s", k=50).first().s
    whole = sketches.with_sketch(spark.createDataFrame([(" ".join(f"w{i}" for i in range(892)),)], "text string"), "text", "s", k=50).first().s
    assert merged == whole


def test_digest_of_edit(spark):
    from lexiweave.llm.queries import op10_bottom_k_fingerprints

    import duckdb
    import tempfile

    d = tempfile.mkdtemp()
    duckdb.sql(f"copy (select range as doc_id, 'text number ' || range || ' öä and more words' as text from range(30)) to '{d}/documents.parquet'")
    got = {r.doc_id: r for r in op10_bottom_k_fingerprints(spark, d).collect()}
    want = brute([(i, f"text number {i} öä and more words") for i in range(30)])
    assert all(hashlib.sha256(want[i][1].encode()).hexdigest() == got[i].edited_sha256 for i in range(30))


def slow_sketch(text, k=sketches.K, width=sketches.WIDTH):
    """Sketch by the definition: k smallest of the distinct chained hashes of five words, as signed longs."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.lower().split()]
    grams = [hashes] if 0 < len(hashes) <= width else [hashes[i : i + width] for i in range(len(hashes) - width + 1)]
    out = set()
    for gram in grams:
        seed = 42
        for h in gram:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        out.add(signed(seed))
    return sorted(out)[:k]


def slow_likeness(a, b, k=sketches.K):
    union = sorted({*a, *b})[:k]
    return 1.0 if a == b else 0.0 if not a or not b else len({*union} & {*a} & {*b}) / len(union)


def test_fingerprints_and_likeness_against_brute_force(spark):
    rows = [(i, " ".join(f"W{j * (1 + i % 3)}é" for j in range(i, i + 45 * i))) for i in range(12)] + [(50, "one"), (51, ""), (52, None), (60, "long " * 30_000 + " ".join(map(str, range(3000))))]
    got = {r.doc_id: r for r in sketches.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edits, order = brute(rows), sorted(dict(rows), reverse=True)
    texts = {i: t or "" for i, t in rows}
    for n, i in enumerate(order):
        own, edited = slow_sketch(texts[i]), slow_sketch(edits[i][1])
        after = slow_sketch(texts[order[(n + 1) % len(order)]])
        assert got[i].sketch == own and got[i].edited_sketch == edited
        assert abs(got[i].near_edited - slow_likeness(own, edited)) < 1e-12 and abs(got[i].near_next - slow_likeness(own, after)) < 1e-12
