"""SimHash near-duplicate detection by tiled exact comparison.

A fingerprint has 64 bits. Two fingerprints within `radius` bits agree on at least
`blocks - radius` of `blocks` bit blocks, so each choice of that many blocks gives one bucket key and every
linked pair meets in some bucket. Within a bucket the fingerprints are compared exactly, tile by
tile, with numpy exclusive-or and bit counts; tiles whose population counts differ beyond the
radius are skipped. A bucket above `tile` fingerprints is cut into tiles by population count and
hash, and only tile pairs within the radius are dealt out, so no task gets an unbounded bucket.
Each comparison emits a spanning forest of its links, not all pairs.

For sets of shingles of a given similarity a fingerprint of 64 bits is too short: `first_of_groups` takes one of 512, meets in the
same kind of buckets, compares by the same exclusive-or and bit counts, and checks the found links on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_key, stable

RADIUS = 3
TILE = 2048
_SMALL = 16
#: Shingles of a tile of an exact comparison (8 bytes each), and of one step of it.
CELL = 4_000_000
CHUNK = 1_000_000


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles of the text with A-Z lowered; repeats kept; under `width` words: the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(text: str | None, width: int) -> int:
    """Bit i is set when over half of the shingles' XXH64 (seed 42) have it; 0 for a text without words."""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles(text, width)), dtype="<u8")
    if not hashes.size:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > hashes.size).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted XXH64 hashes of the distinct shingles."""
    return np.unique(np.fromiter({xxhash.xxh64_intdigest(s, 42) for s in shingles(text, width)}, dtype="<u8"))


#: Bytes of a wide fingerprint, and of each of its groups: two equal bytes of one group are a bucket key.
SIGNATURE = 64
GROUP = 8
_SALTS = np.random.default_rng(11).integers(0, 1 << 63, SIGNATURE // 8, dtype=np.uint64)
_FIRST, _SECOND = (np.array(x) for x in zip(*(p for g in range(0, SIGNATURE, GROUP) for p in combinations(range(g, g + GROUP), 2)), strict=True))
#: Differing bits of 128, and of all 512, that sets of similarity 0.8 stay within: 0.152 of the bits differ (0.19 for the smallest sets), with four deviations.
NEAR, NEAR_SMALL, NEAR_ALL = 36, 41, 131
_SMALL_SET = 32
#: Nodes of the links that a task of the wide net holds together before it gives them away.
FOREST = 100_000


def signature(text: str | None, width: int) -> tuple[int, bytes]:
    """Number of distinct shingles, and their SimHash of 512 bits."""
    return _signature(shingle_set(text, width))


def _signature(hashes: np.ndarray) -> tuple[int, bytes]:
    """Bit i of word w is set when over half of the hashes, mixed with the salt of w, have it."""
    ones = np.zeros(SIGNATURE * 8, dtype=np.int64)
    for at in range(0, hashes.size, 8192):
        x = hashes[at : at + 8192, None] ^ _SALTS[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return hashes.size, np.packbits(2 * ones > hashes.size, bitorder="little").tobytes()


def with_fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus `fp` long (the fingerprint's bits as a signed long). Null text counts as empty."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(fps.view(np.int64), pa.int64())],
                names=[*keep, "fp"],
            )

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def block_keys(radius: int, blocks: int) -> list[int]:
    """Bit masks, one for each choice of blocks - radius whole blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _spanning(fps: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[list, list]:
    """Spanning forest of the links among fps (side None) or between side 0 and side 1."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps = fps[order]
    side = None if side is None else side[order]
    pops = np.bitwise_count(fps).astype(np.int16)
    left = np.ones(fps.size, dtype=bool)
    src, dst = [], []
    for start in range(fps.size):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            lo, hi = np.searchsorted(pops, [pops[at] - radius, pops[at] + radius + 1])
            near = left[lo:hi] & (np.bitwise_count(fps[lo:hi] ^ fps[at]) <= radius)
            if side is not None:
                near &= side[lo:hi] != side[at]
            found = np.flatnonzero(near) + lo
            if found.size:
                left[found] = False
                src += [fps[at]] * found.size
                dst += fps[found].tolist()
                queue += found.tolist()
    return src, dst


def _compare(radius: int):
    """Over rows sorted by (k, a, b): the links of each group."""

    def links(k, a, b, side, fps):
        new = np.ones(k.size, dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, k.size))
        group = np.repeat(np.arange(starts.size), sizes)
        small = np.repeat((sizes <= _SMALL) & (a[starts] == b[starts]), sizes)
        src, dst = [], []
        g, f = group[small], fps[small]
        for step in range(1, _SMALL):
            if f.size <= step:
                break
            same = g[step:] == g[:-step]
            if not same.any():
                break
            hit = same & (np.bitwise_count(f[step:] ^ f[:-step]) <= radius)
            src.append(f[:-step][hit])
            dst.append(f[step:][hit])
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n > 1 and not small[s]:
                x, y = _spanning(fps[s : s + n], side[s : s + n] if a[s] != b[s] else None, radius)
                src.append(np.array(x, dtype=np.uint64))
                dst.append(np.array(y, dtype=np.uint64))
        return (np.concatenate(src), np.concatenate(dst)) if src else (fps[:0], fps[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
            cut = int(last[-1]) + 1 if last.size else 0
            held = [x[cut:] for x in now]
            if cut:
                yield out(links(*(x[:cut] for x in now[:4]), now[4][:cut].view(np.uint64)))
        if held is not None:
            yield out(links(*held[:4], held[4].view(np.uint64)))

    def out(pair) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64()) for x in pair], names=["src", "dst"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(src, dst) links that connect all distinct `fp` values within `radius` bits of one another.

    Not every pair: each comparison gives a spanning forest, so the components are those of all pairs.
    """
    masks = block_keys(radius, blocks or radius + 2)
    distinct = fps.select("fp").distinct()
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)))).alias("k"),
    )
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = stable(keyed.join(sizes, "k").select("k", "fp", "n"))
    none = F.lit(0)
    plain = kept.where(F.col("n") <= tile).select("k", none.alias("a"), none.alias("b"), none.alias("side"), "fp")
    hot = kept.where(F.col("n") > tile).select("k", "fp", F.bit_count("fp").alias("pop"))
    cells = hot.groupBy("k", "pop").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    near = (
        cells.select("k", F.col("tiles").alias("t2"), F.col("pop").alias("p2"))
        .select("k", "t2", "p2", F.explode(F.sequence(F.col("p2") - radius, F.col("p2") + radius)).alias("pop"))
        .groupBy("k", "pop")
        .agg(F.collect_list(F.struct("p2", "t2")).alias("partners"))  # at most 2 radius + 1 entries
        .join(cells, ["k", "pop"])
    )
    mine = F.col("pop") * F.lit(1 << 24) + F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    theirs = F.flatten(F.transform("partners", lambda p: F.transform(F.sequence(F.lit(0), p["t2"] - 1), lambda j: p["p2"] * F.lit(1 << 24) + j)))
    dealt = (
        hot.join(near, ["k", "pop"])
        .select("k", "fp", mine.alias("mine"), F.explode(theirs).alias("other"))
        .select("k", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp")
    )
    rows = plain.unionByName(dealt).repartition("k", "a", "b").sortWithinPartitions("k", "a", "b")
    return rows.mapInArrow(_compare(radius), "src long, dst long").distinct()


def _grouped(links):
    """`links` of each group of rows that are equal in their first three columns; rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            ends = np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1 if len(g) else []
            at = 0
            for end in [*ends, len(g)]:
                if held and end > at and any(held[0].column(i)[0].as_py() != int(g[at, i]) for i in range(3)):
                    yield links(pa.Table.from_batches(held))
                    held = []
                if end > at:
                    held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of `others` have a Jaccard similarity of at least `similarity` with `one`, all sorted and without repeats."""
    found, at = [], 0
    while at < len(others):
        end, room = at, CHUNK
        while end < len(others) and (end == at or others[end].size <= room):
            room -= others[end].size
            end += 1
        sizes = np.array([o.size for o in others[at:end]])
        joined = np.concatenate(others[at:end])
        hit = one[np.minimum(np.searchsorted(one, joined), one.size - 1)] == joined
        shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        found.append(shared >= similarity * (one.size + sizes - shared) - 1e-9)
        at = end
    return np.concatenate(found)


def _similar(similarity: float):
    """Links among the texts of one tile (left), or between two tiles: fingerprints are within the radius, and sets
    that much alike."""

    def links(t: pa.Table) -> pa.RecordBatch:
        sizes = t["size"].to_numpy()
        order = np.argsort(sizes, kind="stable")
        sizes, node, side = sizes[order], t["node"].to_numpy()[order], t["side"].to_numpy()[order]
        crossed = t["a"][0] != t["b"][0]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint8).reshape(len(node), SIGNATURE)[order].view("<u8")
        raw = t["set"].to_pylist()
        sets = [np.frombuffer(raw[i], dtype="<u8") for i in order.tolist()]
        src, dst = [], []
        left = np.arange(len(node))
        while left.size:
            queue, left = [left[0]], left[1:]
            while queue and left.size:
                at = queue.pop()
                lo, hi = np.searchsorted(sizes[left], [sizes[at] * similarity - 1e-6, sizes[at] / similarity + 1e-6])
                near = np.arange(lo, hi)
                if near.size and crossed:
                    near = near[side[left[near]] != side[at]]
                if near.size:
                    near = near[np.bitwise_count(sig[left[near]] ^ sig[at]).sum(axis=1, dtype=np.int64) <= NEAR_ALL]
                if near.size:
                    near = near[_alike(sets[at], [sets[i] for i in left[near].tolist()], similarity)]
                if near.size:
                    found = left[near]
                    src += [node[at]] * found.size
                    dst += node[found].tolist()
                    queue += found.tolist()
                    left = np.delete(left, near)
        make = lambda x: pa.array(np.array(x, dtype=np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([make(src), make(dst)], names=["src", "dst"])

    return _grouped(links)


def _dealt(rows: DataFrame, group: str, kept: tuple[str, ...]) -> DataFrame:
    """(group, a, b, side, kept) of rows with a number of `tiles` for their group: each pair of tiles meets once."""
    mine = F.pmod(F.xxhash64("node"), F.col("tiles"))
    each = rows.select(group, *kept, mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    pairs = each.select(group, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *kept)
    return pairs.repartition(group, "a", "b").sortWithinPartitions(group, "a", "b")


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of 128 bits for each bucket of a wide fingerprint."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            node, size, sig = batch.slice(at, 256).columns
            raw = np.frombuffer(b"".join(sig.to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE)
            k = (np.arange(_FIRST.size, dtype=np.int32) << 16) | (raw[:, _FIRST].astype(np.int32) << 8) | raw[:, _SECOND]
            each = lambda x: pa.array(np.repeat(np.ascontiguousarray(x), _FIRST.size))
            words = raw.view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), each(node.to_numpy()), each(size.to_numpy()), each(words[:, 0]), each(words[:, 1])], names=["k", "node", "size", "a", "b"])


def _near(similarity: float):
    """Over rows sorted by k and node: links that connect the buckets, by exclusive-or and bit counts, where sizes allow the similarity.

    A task joins the links of its buckets and gives each node the smallest one it is joined with, so links grow with the nodes, not with the buckets of a group of near copies.
    """

    def close(n, m, x, y, z, w):
        most = np.maximum(n, m)
        bits = np.bitwise_count(x ^ y) + np.bitwise_count(z ^ w)
        return (bits <= np.where(most >= _SMALL_SET, NEAR, NEAR_SMALL)) & (np.minimum(n, m) >= similarity * most - 1e-6)

    def links(k, node, size, a, b):
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        counts = np.diff(np.append(starts, k.size))
        small = np.repeat((counts > 1) & (counts <= _SMALL), counts)
        src, dst = [node[:0]], [node[:0]]
        g, v, n, x, z = (c[small] for c in (k, node, size, a, b))
        for step in range(1, _SMALL):
            at = np.flatnonzero(g[step:] == g[:-step])
            if not at.size:
                break
            at = at[close(n[at], n[at + step], x[at], x[at + step], z[at], z[at + step])]
            src.append(v[at])
            dst.append(v[at + step])
        for s, c in zip(starts[counts > _SMALL].tolist(), counts[counts > _SMALL].tolist(), strict=True):
            left = np.arange(s, s + c)
            while left.size:
                queue, left = [left[0]], left[1:]
                while queue and left.size:
                    i = queue.pop()
                    hit = close(size[i], size[left], a[i], a[left], b[i], b[left])
                    if hit.any():
                        src.append(np.full(int(hit.sum()), node[i]))
                        dst.append(node[left[hit]])
                        queue += left[hit].tolist()
                        left = left[~hit]
        return np.concatenate(src).tolist(), np.concatenate(dst).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, root = None, {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        def join(src, dst):
            for x, y in zip(src, dst, strict=True):
                u, v = find(x), find(y)
                if u != v:
                    root[max(u, v)] = min(u, v)

        def stars() -> pa.RecordBatch:
            """A link of each node to the smallest one that the task's buckets join it with: other tasks give mostly the same ones for a group."""
            linked = [(x, r) for x in list(root) if (r := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in linked], pa.int64()) for i in (0, 1)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            now[3:] = [c.view(np.uint64) for c in now[3:]]  # bits are counted of unsigned words
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[cut:] for x in now]
            if cut:
                join(*links(*(x[:cut] for x in now)))
            if len(root) > FOREST:
                yield stars()
        if held is not None:
            join(*links(*held))
        yield stars()

    return run


def candidate_links(prints: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(src, dst) links of a wide net: their components hold all pairs of texts that are `similarity` alike, and more.

    prints: (node, size, sig), a row for each node, sig being a SimHash of 512 bits in 64 blocks of a byte. Texts meet where two blocks of
    one of 8 groups are whole (0.8-alike sets miss with a chance of about 1 in 10,000), and link within the radius of 128 of the bits.
    Tasks give a node 224 links at most, one for each of its buckets; each then goes to the smallest end of its links, as do the other ends.
    """
    keyed = prints.select("node", "size", "sig").mapInArrow(_bucket_rows, "k int, node long, size long, a long, b long")
    stars = keyed.repartition("k").sortWithinPartitions("k", "node").mapInArrow(_near(similarity), "src long, dst long")
    ends = stars.groupBy("src").agg(F.collect_set("dst").alias("ends"), F.min("dst").alias("dst"))
    return ends.select(F.explode(F.concat(F.array("src"), "ends")).alias("src"), "dst").where("src <> dst").distinct()


def similar_links(texts: DataFrame, prints: DataFrame, width: int = 5, similarity: float = 0.8, cell: int = CELL) -> DataFrame:
    """(src, dst) links that connect the nodes whose shingle sets have a Jaccard similarity of `similarity` or more.

    prints: (node, k, th, size, sig), a row for each node; texts: (k, th, text), one text for each (k, th). The components
    of candidate_links get their sets and are compared exactly; one with more than `cell` shingles is cut into tiles.
    """
    near = stable(prints.join(connected_components(candidate_links(prints, similarity)), "node").select("root", "node", "k", "th", "size", "sig"))
    tiles = near.groupBy("root").agg(F.ceil(F.sum("size") / cell).cast("long").alias("tiles"))
    asked = near.join(tiles, "root").select("k", "th", "root", "node", "size", "sig", F.greatest("tiles", F.lit(1)).alias("tiles"))
    schema = "root long, node long, size long, sig binary, tiles long, set binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(t, width).tobytes() for t in part.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(sets, pa.binary())], names=["root", "node", "size", "sig", "tiles", "set"])

    held = texts.join(asked, ["k", "th"]).select("root", "node", "size", "sig", "tiles", "text").mapInArrow(run, schema)
    return _dealt(held, "root", ("node", "size", "sig", "set")).mapInArrow(_similar(similarity), "src long, dst long").distinct()


def first_of_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group of texts linked by similar_links or equal, the row with the smallest doc_id.

    Same columns. Texts with one set of shingles, by its digest, are one text here; null and empty texts are, so one of
    them stays. Of repeated rows one stays; a null doc_id counts as the smallest. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, signed = [], []
            for t in b.column(2).to_pylist():
                hashes = shingle_set(t, width)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                signed.append(_signature(hashes))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64), pa.int64()), pa.array([n for n, _ in signed], pa.int64()), pa.array([s for _, s in signed], pa.binary())], names=["k", "th", "node", "size", "sig"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = {"__lw_k": id_key(), "__lw_th": F.xxhash64(text)}
    texts = docs.select(id_key().alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = stable(texts.mapInArrow(run, "k long, th long, node long, size long, sig binary"))
    repeated = not prints.groupBy("k", "th").count().where("count > 1").isEmpty()
    firsts = stable(prints.groupBy("node").agg(F.min(F.struct("k", "th", "size", "sig")).alias("x")).select("node", "x.*"))
    links = similar_links(texts.dropDuplicates(["k", "th"]) if repeated else texts, firsts, width, similarity)
    roots = connected_components(links).withColumnRenamed("node", "of")
    rooted = firsts.join(roots, F.col("node") == F.col("of"), "left").select(F.struct("k", "th").alias("first"), F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias("__lw_k"), F.col("first.th").alias("__lw_th"))
    found = docs.withColumns(key).join(kept, ["__lw_k", "__lw_th"], "left_semi")
    if repeated:
        found = found.dropDuplicates(["__lw_k", "__lw_th"])
    return found.select(*docs.columns)


def near_duplicate_groups(docs: DataFrame, width: int = 3, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Rows with equal fingerprints, and chains of fingerprints at `radius` or fewer differing bits,
    share a component; component_id is its smallest doc_id (null only if all its ids are null).
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come out
    repeatedly. An empty table gives an empty result; further columns of docs are ignored.
    """
    prints = stable(with_fingerprints(docs, width, text_col))
    roots = connected_components(fingerprint_links(prints, radius))
    named = (
        prints.groupBy("fp")
        .agg(F.min("doc_id").alias("first"))
        .join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
