"""Centroid clustering of integer vectors over forests of ball trees.

Every partition packs its vectors into trees of at most BLOCK vectors. A ball stores the centre and radius of its vectors,
their count, integer sum and sum of squares. A round sends the centroids through each tree from the root: where the
triangle inequality shows that one centroid is nearer than all others to every vector of a ball, the whole ball is added to it by
its stored sums; else only the centroids that may still be nearest go on to its halves, and a leaf compares its
vectors exactly. Bounds are floating point with a margin, all sums and compared distances are integers, so the
result is that of the plain method. Trees are built once, kept in the shared checkpoint folder and read by each round.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stable

#: Vectors of one tree, and of a leaf at most (a ball of equal vectors is not split).
BLOCK = 16_384
LEAF = 48
#: Scaled components beyond this have no exact squared distance in 64 bits; see `clustered`.
BOUND = 1 << 27
#: Up to this size all terms of a squared distance in 64 components are exact in double precision.
_EXACT = 1 << 22


@dataclass
class Tree:
    """Vectors in the order of their balls; ball b has rows lo[b] to hi[b] and the halves left[b] and left[b] + 1, 0 for a leaf."""

    ids: np.ndarray
    no_id: np.ndarray
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    squares: np.ndarray


def build(ids: np.ndarray, no_id: np.ndarray, points: np.ndarray) -> Tree:
    """A tree over at least one integer vector: balls are halved at the median along the line between two far vectors."""
    order = np.arange(len(points))
    real = points.astype(np.float64)
    lo, hi, left, centre, radius = [0], [len(points)], [0], [], []
    b = 0
    while b < len(lo):
        rows = order[lo[b] : hi[b]]
        x = real[rows]
        c = x.mean(axis=0)
        away = ((x - c) ** 2).sum(axis=1)
        centre.append(c)
        far = int(away.argmax())
        radius.append(np.sqrt(away[far]))
        if len(rows) > LEAF and (x != x[0]).any():
            other = int(((x - x[far]) ** 2).sum(axis=1).argmax())
            along = x @ (x[other] - x[far])
            half = len(rows) // 2
            order[lo[b] : hi[b]] = rows[np.argpartition(along, half)]
            left[b] = len(lo)
            lo += [lo[b], lo[b] + half]
            hi += [lo[b] + half, hi[b]]
            left += [0, 0]
        b += 1
    points = points[order]
    wide = points.astype(np.int64)
    first, last = np.array(lo), np.array(hi)
    sums = np.concatenate([np.zeros((1, wide.shape[1]), dtype=np.int64), np.cumsum(wide, axis=0)])
    # Squares may pass 64 bits in sum, so they are Python integers where they are large.
    norms = (wide * wide).sum(axis=1)
    running = np.concatenate([[0], np.cumsum(norms if norms.max() < (1 << 62) // len(norms) else norms.astype(object))])
    return Tree(ids[order], no_id[order], points, first, last, np.array(left), np.array(centre), np.array(radius), sums[last] - sums[first], running[last] - running[first])


def exact_squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """int64 squared distance of each vector to each centroid, for components within BOUND."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if most < _EXACT and points.shape[1] <= 64 else np.int64
    x, c = points.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Balls whose vectors all have one nearest centroid, as (ball, centroid), and leaves with the centroids left, as (rows, numbers).

    A centroid is left out only where it is farther than another one from every vector of the ball, so that ties stay.
    """
    real = centroids.astype(np.float64)
    whole, leaves = [], []
    balls, open_to = np.array([0]), np.ones((1, len(real)), dtype=bool)
    while len(balls):
        c = tree.centre[balls]
        away = np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] - 2 * (c @ real.T) + (real * real).sum(axis=1)[None, :], 0.0))
        # The error of a squared distance is below 1e-12 of its terms, that of its root below 1e-6 of their root.
        margin = 1e-6 * (1.0 + np.sqrt((c * c).sum(axis=1).max() + (real * real).sum(axis=1).max()))
        reach = tree.radius[balls][:, None] + margin
        least = np.where(open_to, away, np.inf).min(axis=1)[:, None]
        open_to &= away - reach <= least + reach
        one = open_to.sum(axis=1) == 1
        whole += zip(balls[one].tolist(), open_to[one].argmax(axis=1).tolist(), strict=True)
        end = ~one & (tree.left[balls] == 0)
        leaves += [(np.arange(tree.lo[b], tree.hi[b]), np.flatnonzero(m)) for b, m in zip(balls[end], open_to[end], strict=True)]
        go = ~one & ~end
        halves = tree.left[balls[go]]
        balls, open_to = np.concatenate([halves, halves + 1]), np.concatenate([open_to[go], open_to[go]])
    return whole, leaves


def _nearest(tree: Tree, leaves: list, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, centroid, squared distance) of the vectors of leaves: leaves with the same centroids left are compared together."""
    alike: dict[bytes, list] = {}
    for rows, among in leaves:
        alike.setdefault(among.tobytes(), [among]).append(rows)
    for among, *rows in alike.values():
        at = np.concatenate(rows)
        d = exact_squares(tree.points[at], centroids[among])
        best = d.argmin(axis=1)  # the first of equal ones: the smaller number
        yield at, among[best], d[np.arange(len(at)), best]


def summed(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Vectors, componentwise sum and sum of squared distances (Python integers) of each centroid's vectors in the tree."""
    n, total, inertia = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids), [0] * len(centroids)
    whole, leaves = filtered(tree, centroids)
    for b, j in whole:
        count = int(tree.hi[b] - tree.lo[b])
        n[j] += count
        total[j] += tree.total[b]
        c, s = centroids[j].tolist(), tree.total[b].tolist()
        inertia[j] += int(tree.squares[b]) - 2 * sum(x * y for x, y in zip(c, s, strict=True)) + count * sum(x * x for x in c)
    for rows, nearest, d in _nearest(tree, leaves, centroids):
        x = tree.points[rows].astype(np.int64)
        for j in np.unique(nearest).tolist():
            mine = nearest == j
            n[j] += int(mine.sum())
            total[j] += x[mine].sum(axis=0)
            inertia[j] += sum(d[mine].tolist())
    return n, total, inertia


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector, in the tree's order."""
    cluster, distance = np.zeros(len(tree.points), dtype=np.int32), np.zeros(len(tree.points), dtype=np.int64)
    whole, leaves = filtered(tree, centroids)
    for b, j in whole:
        rows = slice(tree.lo[b], tree.hi[b])
        cluster[rows], distance[rows] = j, exact_squares(tree.points[rows], centroids[[j]])[:, 0]
    for rows, nearest, d in _nearest(tree, leaves, centroids):
        cluster[rows], distance[rows] = nearest, d
    return cluster, distance


def scaled(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors with exactly `dim` components, each of them floor(scale * x) within BOUND; see `clustered`."""
    e = F.col(vector_col).cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= BOUND) & (F.abs(F.floor(x * scale)) <= BOUND))
    return vectors.where((F.size(vector_col) == dim) & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(e, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _forest(rows: DataFrame, dim: int) -> DataFrame:
    """(tree): the pickled trees of every partition's vectors."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tree() -> pa.RecordBatch:
            ids, v = pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            small = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
            made = build(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), x.astype(small))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["tree"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == BLOCK:
                    yield tree()
                    held, size = [], 0
        if size:
            yield tree()

    return rows.mapInArrow(grow, "tree binary")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for b in batches:
        for raw in b.column(0):
            yield pickle.loads(raw.as_buffer())


def _sums(forest: DataFrame, centroids: np.ndarray) -> list:
    """A row for each centroid with vectors: its number, n, sums and inertia. Each task sends at most one row a centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, inertia = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64), [0] * k
        for tree in _trees(batches):
            more = summed(tree, centroids)
            n, total, inertia = n + more[0], total + more[1], [a + b for a, b in zip(inertia, more[2], strict=True)]
        some = np.flatnonzero(n)
        arrays = [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array([str(inertia[j]) for j in some], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "n", "sums", "inertia"])

    parts = forest.mapInArrow(run, "cluster int, n long, sums array<long>, inertia string")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *sums).collect()  # a row a centroid


def clustered(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, start: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, and the final centroids.

    A vector is kept if it has exactly `dim` components, none null or non-finite; a component that is beyond
    2^27 after scaling counts as not finite, for a squared distance of such would not fit its column. Components become floor(scale * x).
    Centroids start as the k kept vectors with the smallest sha256 of `start` and the id, ties by vector. A null id
    has no such hash: its vectors are clustered but start no centroid. Rows that repeat an id or a vector count each by
    itself. With fewer than k rows that have an id there are as many centroids; without any, and for an
    empty table, the result is empty. An inertia beyond 64 bits is null. Other columns are ignored, whatever their names.
    k rows of sums a round reach the driver.
    """
    rows = scaled(vectors, dim, scale, id_col, vector_col)
    hashed = F.sha2(F.concat(F.lit(start), F.col("id").cast("string")), 256)
    first = rows.where(F.col("id").isNotNull()).select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], result), np.zeros((0, dim), dtype=np.int64)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    forest = stable(_forest(rows, dim))
    for _ in range(rounds):
        for r in _sums(forest, centroids):
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    inertia = {r["cluster"]: int(r["inertia"]) for r in _sums(forest, centroids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches):
            cluster, distance = assigned(tree, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=tree.no_id), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = forest.mapInArrow(run, "vec_id long, cluster int, distance long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda x: F.lit(x if abs(x) < 1 << 63 else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))  # noqa: E731  # k literals
    every: Column = fits(sum(inertia.values()))
    made = found.select("*", of([fits(inertia.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"), every.alias("inertia"), of([F.lit(d) for d in digests]).alias("centroid_sha256"))
    return made, centroids


def oracle_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, start: str = "1:") -> str:
    """The plain method in DuckDB, every vector with every centroid."""
    ctes = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{start}' || vec_id), v) - 1 AS num, v AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('{start}' || vec_id), v LIMIT {k})",
    ]
    for n in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        ctes.append(f"a{n} AS (SELECT r, vec_id, v, arg_min(num, (d, num)) AS num, min(d) AS d FROM (SELECT r, vec_id, v, num, {away} AS d FROM kept, c{n}) GROUP BY r, vec_id, v)")
        if n < rounds:
            ctes.append(
                f"""c{n + 1} AS (SELECT num, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM
 (SELECT num, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT num, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n}) GROUP BY num, j) GROUP BY num) USING (num))"""
            )
    return f"""WITH {", ".join(ctes)} SELECT vec_id, CAST(num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (num)"""
