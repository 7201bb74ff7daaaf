"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised against its own centroids, so a pair of
centroids names a cell. A query walks the pairs in order of summed nearness with a heap over the two
sorted centroid lists until the visited cells hold `share` of all entries; the entries of those cells
are then reranked by their exact inner product. Centroids are fitted on a bounded sample and grow in number
with the rows, every valid row is indexed, and entries meet queries in blocks of bounded size: each entry
moves once, a query goes to the blocks that it visits and is streamed past their entries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stable

#: Centroids of a half: these, or so many times the fourth root of the rows, so that cells grow with the root of the rows.
LEAST_CENTROIDS = 64
CENTROIDS = 4.0
SHARE = 0.5
SAMPLE = 20_000
ENTRIES = 16384


def valid(e: Column) -> Column:
    """Not null, not empty, every component a finite number, and not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(e) > 0) & ~F.exists(e, odd) & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; an empty one moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ c.T - 0.5 * (c**2).sum(axis=1)
        at = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        far = np.argsort(near[np.arange(len(x)), at] - 0.5 * (x**2).sum(axis=1))
        for j, i in zip(np.flatnonzero(n == 0), far, strict=False):
            c[j] = x[i]
    return c


def quantise(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Visited cells, flat and in order: largest first[i] + second[j] first, until they hold `most` entries."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    s, t = first[a].tolist(), second[b].tolist()
    heap = [(-(s[0] + t[0]), 0, 0)]
    rows = [0] * len(a)  # how far each row of the grid has been pushed
    rows[0] = 1
    got, held, out = counts.tolist(), 0, []
    while heap and held < most:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        out.append(cell)
        held += got[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(s[i] + t[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a) and not rows[i + 1]:
            rows[i + 1] = 1
            heapq.heappush(heap, (-(s[i + 1] + t[0]), i + 1, 0))
    return np.array(out, dtype=np.int64)


def blocks_of(counts: np.ndarray, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks for each first-half centroid: small ones share, large ones are split."""
    start, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    block, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > entries:
            block, held = block + 1, 0
        start[i] = block
        if n > entries:
            parts[i] = -(-n // entries)
            block, held = block + int(parts[i]), 0
        else:
            held += n
    return start, parts


def search(vectors: DataFrame, every: int, k: int = 20, centroids: float = CENTROIDS, share: float = SHARE, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found for every row whose id is divisible by `every`, by largest inner product.

    Returns query_id, rank (from 1, int), vec_id, score (double); ties go to the smaller vec_id. Rows
    with a null id, and vectors that are null, empty, zero or hold null or non-finite components take
    no part. Vectors meet those of their own length: each length has an index of its own. Rows that
    repeat an id and vector count once; candidates with the query's own id are left out. Of equal
    vectors only the k + 1 smallest ids can be among the k nearest, so only they are reranked. An empty table gives
    an empty result. `sample` vectors, the counts of the cells and the lengths reach the driver.
    """
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = stable(rows.distinct())
    sizes = {r["d"]: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = [_search(rows.where(F.size("v") == d), d, n, every, k, centroids, share, sample) for d, n in sorted(sizes.items())]
    return reduce(DataFrame.unionByName, each)


def _search(rows: DataFrame, dim: int, n_rows: int, every: int, k: int, centroids: float, share: float, sample: int) -> DataFrame:
    """search() among `n_rows` distinct rows (id, v) of one length."""
    half = max(1, dim // 2)
    taken = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).toArrow()
    x = _matrix(taken["v"], dim)
    most_centroids = max(1, min(max(LEAST_CENTROIDS, round(centroids * n_rows**0.25)), len(x) // 4))
    c1 = kmeans(x[:, :half], most_centroids)
    c2 = kmeans(x[:, half:], most_centroids) if dim > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dim)
            i, j = quantise(m[:, :half], c1), quantise(m[:, half:], c2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in m], pa.binary()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=["id", "v", "i", "j"])

    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).select("id", "v")
    index = stable(entries.mapInArrow(assign, "id long, v binary, i int, j int"))
    counts = np.zeros(len(c1) * len(c2), dtype=np.int64)
    for r in index.groupBy("i", "j").count().collect():  # a row a cell
        counts[r["i"] * len(c2) + r["j"]] = r["count"]
    start, parts = blocks_of(counts.reshape(len(c1), len(c2)).sum(axis=1))
    most = max(int(np.ceil(share * counts.sum())), min(int(counts.sum()), 4 * k))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(2), dim)
            first, second = m[:, :half] @ c1.T, m[:, half:] @ c2.T
            for q in range(len(m)):
                cell = traverse(first[q], second[q], counts, most)
                # All visited cells are at least as near as the last one.
                least = float(first[q, cell[-1] // len(c2)] + second[q, cell[-1] % len(c2)])
                at = np.unique(cell[counts[cell] > 0] // len(c2))
                block = np.unique(np.concatenate([np.arange(start[i], start[i] + parts[i]) for i in at]))
                n = len(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), *(pa.array([b.column(c)[q].as_py()] * n, pa.int64()) for c in (0, 1)), pa.array([m[q].tobytes()] * n, pa.binary()), pa.array([least] * n, pa.float64())],
                    names=["block", "id", "qh", "v", "least"],
                )

    asked = rows.where(F.col("id") % every == 0).select("id", F.xxhash64("v").alias("qh"), "v").mapInArrow(probe, "block long, id long, qh long, v binary, least double")
    first_block = F.array(*(F.lit(int(s)) for s in start))
    in_parts = F.array(*(F.lit(int(p)) for p in parts))
    block = (F.get(first_block, F.col("i")) + F.pmod(F.xxhash64("id"), F.get(in_parts, F.col("i")))).cast("long")
    none = lambda t: F.lit(None).cast(t)
    placed = index.select(block.alias("block"), F.lit(0).alias("asks"), "id", none("long").alias("qh"), "v", "i", "j", none("double").alias("least"))
    placed = placed.unionByName(asked.select("block", F.lit(1).alias("asks"), "id", "qh", "v", none("int").alias("i"), none("int").alias("j"), "least"))
    placed = placed.repartition("block").sortWithinPartitions("block", "asks")

    def rows_of(b: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=np.float64).reshape(-1, dim)

    def nearest(held: tuple, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, m, i, j = held
        qids, qhs, least, q = b.column("id").to_numpy(), b.column("qh").to_numpy(), b.column("least").to_numpy(), rows_of(b)
        out: list[list] = [[], [], [], []]
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            near, first, second = part @ m.T, part[:, :half] @ c1.T, part[:, half:] @ c2.T
            for n in range(len(part)):
                bound = least[at + n] - 1e-9 * (1 + abs(least[at + n]))
                found = np.flatnonzero((first[n, i] + second[n, j] >= bound) & (ids != qids[at + n]))
                if found.size > k:
                    s = near[n, found]
                    last = np.partition(s, s.size - k)[s.size - k]
                    found = found[s >= last - 1e-9 * (1 + abs(last))]
                exact = (m[found] * part[n]).sum(axis=1)  # row by row, so equal vectors score equally everywhere
                best = np.lexsort((ids[found], -exact))[:k]
                for column, x in zip(out, (np.full(best.size, qids[at + n]), np.full(best.size, qhs[at + n]), ids[found][best], exact[best]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "qh", "vec_id", "score"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a block come before its queries; only the entries, of bounded number, are held."""
        here, held, gathered = None, None, []
        for b in batches:
            blocks, asks = b.column("block").to_numpy(), b.column("asks").to_numpy()
            ends = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *ends], [*ends, len(blocks)], strict=True):
                if hi == lo:
                    continue
                if blocks[lo] != here:
                    here, held, gathered = blocks[lo], None, []
                part = b.slice(lo, hi - lo)
                if not asks[lo]:
                    gathered.append(part)
                elif gathered:
                    if held is None:
                        column = lambda c: np.concatenate([g.column(c).to_numpy(zero_copy_only=False) for g in gathered])
                        held = column("id").astype(np.int64), np.concatenate([rows_of(g) for g in gathered]), column("i").astype(np.int64), column("j").astype(np.int64)
                    yield from nearest(held, part)

    found = placed.mapInArrow(rerank, "query_id long, qh long, vec_id long, score double")
    best = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
