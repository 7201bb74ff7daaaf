import heapq

import numpy as np

from lexiweave.llm import multi_index


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.float32(v).astype(np.float64)
    return {q: sorted(((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k] for q in ok if q % every == 0}


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=7)
    got = multi_index.traverse(a, b, np.ones(63, dtype=np.int64), 63)
    sums = (a[:, None] + b[None, :]).ravel()
    assert sorted(got.tolist()) == list(range(63)) and np.all(np.diff(sums[got]) <= 1e-12)
    assert len(multi_index.traverse(a, b, np.ones(63, dtype=np.int64), 5)) == 5
    assert heapq.nlargest(5, sums.tolist()) == sums[got[:5]].tolist()


def test_blocks_split_and_share():
    start, parts = multi_index.blocks_of(np.array([10, 10, 5000, 3, 4090, 10]), 4096)
    assert parts.tolist() == [1, 1, 2, 1, 1, 1] and start.tolist() == [0, 0, 1, 3, 3, 4]


def test_recall_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, x[0].tolist()) for i in range(300)]
    rows += [(9000, None), (9020, [0.0] * 8), (9040, [float("nan")] * 8), (9060, [1.0] * 3), (9080, []), (9100, [None] * 8), (None, x[1].tolist()), (20, x[20].tolist()), (9120, [float("inf")] * 8)]
    rows += [(10000, [1.0, 2.0, 3.0]), (10001, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    want = brute(rows, 20, 20)
    got = {}
    for r in multi_index.search(df, every=20, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, min(20, len(want[q])) + 1))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found) and q not in [f[1] for f in found]
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.9
    full = multi_index.search(df, every=20, k=20, share=1.0).collect()
    assert {(r.query_id, r.vec_id) for r in full} == {(q, i) for q, f in want.items() for _, i in f}
    assert multi_index.search(df.limit(0), every=20).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.search(two, every=20).collect()] == [(0, 1, 1, 1.0)]
