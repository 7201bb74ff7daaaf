import hashlib
import math

import numpy as np
import pytest

from lexiweave.llm import ball_trees

RESULT = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=16, rounds=3, dim=64, scale=64, start="1:"):
    """Every vector with every centroid, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    first = sorted((hashlib.sha256(f"{start}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for m, (_, v) in zip(mine, kept) if m == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    if not centroids:
        return []
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, m in found if m == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, id int")
    return sorted(map(tuple, ball_trees.clustered(df.repartition(3), **more)[0].select(*RESULT).collect()), key=str)


def test_filtering_agrees_with_all_distances():
    """Clustered, spread and equal vectors: each ball given away as a whole has that nearest centroid in every vector."""
    rng = np.random.default_rng(4)
    for points in (
        np.concatenate([rng.normal(size=(700, 64)) * 3 + rng.normal(size=64) * 200 for _ in range(6)]),
        rng.normal(size=(3000, 64)) * 60,
        np.concatenate([np.tile(rng.normal(size=(1, 64)) * 50, (2000, 1)), rng.normal(size=(500, 64)) * 50]),
        rng.normal(size=(400, 64)) * 2**25,
    ):
        x = np.floor(points).astype(np.int32)
        centroids = x[rng.permutation(len(x))[:16]].astype(np.int64)
        centroids[5] = centroids[4]  # ties go to the smaller number
        tree = ball_trees.build(np.arange(len(x)), np.zeros(len(x), dtype=bool), x)
        cluster, distance = ball_trees.assigned(tree, centroids)
        d = np.array([[sum((a - b) ** 2 for a, b in zip(p.tolist(), c.tolist())) for c in centroids] for p in tree.points[:300]], dtype=object)
        assert distance[:300].tolist() == d.min(axis=1).tolist() and cluster[:300].tolist() == d.argmin(axis=1).tolist()
        n, total, inertia = ball_trees.summed(tree, centroids)
        for j in range(16):
            assert n[j] == (cluster == j).sum() and total[j].tolist() == tree.points[cluster == j].astype(np.int64).sum(axis=0).tolist()
            assert inertia[j] == sum(distance[cluster == j].tolist())


def test_whole_balls_are_given_away():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 64)) * 300
    x = np.floor(np.concatenate([rng.normal(size=(1000, 64)) * 3 + c for c in centres])).astype(np.int32)
    tree = ball_trees.build(np.arange(len(x)), np.zeros(len(x), dtype=bool), x)
    whole, leaves = ball_trees.filtered(tree, np.floor(centres).astype(np.int64))
    assert sum(len(rows) for rows, _ in leaves) < 0.05 * len(x) and len(whole) < 200


@pytest.mark.parametrize("size", [0, 1, 7, 900])
def test_against_the_plain_method(spark, size, monkeypatch):
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(x) for x in rng.normal(size=64) * 0.3 + (i % 5)]) for i in range(size)]
    if size == 900:
        monkeypatch.setattr(ball_trees, "BLOCK", 100)
        same = rows[3][1]
        rows += [(i, same) for i in range(5000, 5400)] + [rows[7]] * 3  # many copies, a repeated row
        rows += [(None, rows[9][1]), (20001, None), (20002, []), (20003, [1.0] * 63), (20004, [*[1.0] * 63, None]), (20005, [*[1.0] * 63, float("nan")]), (20006, [*[1.0] * 63, float("-inf")])]
    assert run(spark, rows) == plain(rows)


def test_empty_clusters_stay_and_no_ids(spark):
    rows = [(i, [float(i // 3)] * 64) for i in range(12)]  # four distinct vectors for six centroids
    assert run(spark, rows, k=6) == plain(rows, k=6)
    assert run(spark, [(None, [1.0] * 64)]) == []
    assert run(spark, [(1, [1.0] * 64), (2, [float(1 << 28)] * 64)]) == plain([(1, [1.0] * 64)])
