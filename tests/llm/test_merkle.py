import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexiweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root of a list of nodes and, for each, the (left, right) siblings level by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, wider = [], []
        for at in range(0, len(nodes), 16):
            part = nodes[at : at + 16]
            for k in range(len(part)):
                for x in under[at + k]:
                    paths[x].append((part[:k], part[k + 1 :]))
            above.append(H(*part))
            wider.append([x for u in under[at : at + 16] for x in u])
        nodes, under = above, wider
    return nodes[0], paths


def plain(rows):
    if not rows:
        return []
    key = lambda x: (x is not None, x if x is not None else 0)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own, subroots = {}, []
    for s in names:
        by[s].sort(key=lambda r: (key(r[0]), leaf(*r)))
        own[s] = climb([leaf(*r) for r in by[s]])
        subroots.append(own[s][0])
    root, upper = climb(subroots)
    out = []
    for s, up in zip(names, upper):
        for r, path in zip(by[s], own[s][1]):
            now = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                now = leaf(r[0], text, *r[2:])
            proof = "".join(x for left, right in path + up for x in left + right)
            for left, right in path + up:
                now = H(*left, now, *right)
            out.append((r[0], leaf(*r), own[s][0], root, H(proof), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", leaf string, t int").repartition(parts)
    made = merkle.folded(merkle.manifest(df, merkle.tampered_text()), F.coalesce("tampered_leaf", "leaf"))
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", F.col("folded_root") == F.col("root")).collect()), key=str)


def test_levels():
    assert [merkle.levels_above(n) for n in (0, 1, 2, 16, 17, 256, 257, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 1, "b": 1}, {None: 3, "": 16, "é": 17, "z": 1}, {"hot": 5000, "b": 257, "c": 256, None: 255, "d": 4097}, {f"s{i}": 1 + i % 2 for i in range(300)}])
def test_against_level_by_level(spark, sizes):
    rows, n = [], 0
    for s, m in sizes.items():
        for _ in range(m):
            rows.append((n * 7 % 100_003, f"Text {n} ÄB" if n % 11 else None, "en" if n % 3 else None, s, n if n % 4 else None))
            n += 1
    got = run(spark, rows)
    assert got == plain(rows)
    if n > 100:
        assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (1, "Same", "en", "a", 4), (1, "Same", "en", "a", 4), (1, "Other", "en", "a", 5), (2, "X" * 300_000, "en", "a", 9), *[(10, "COPY", "en", "h", 4)] * 400]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == len(rows)


def test_proofs_stand_alone(spark):
    """A proof folds to the root from its own leaf and from no other."""
    df = spark.createDataFrame([(i, f"t{i}", "en", "ab"[i % 2], i) for i in range(700)], SCHEMA)
    rows = merkle.manifest(df).collect()
    assert len({r.root for r in rows}) == 1 and all(r.tampered_leaf is None for r in rows)
    for r in rows[::50]:
        assert merkle.fold(r.leaf, r.siblings, r.places) == r.root != merkle.fold(rows[3].leaf if r is not rows[3] else rows[4].leaf, r.siblings, r.places)
    assert merkle.manifest(df.drop("lang", "n_chars")).count() == 700
