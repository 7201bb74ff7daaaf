"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks. With weight w, block i of a source is released at slot floor(i / w)
and due by slot ceil((i + 1) / w); at each slot the released block with the earliest deadline goes.
At every slot each source is then within one block of its weight's share, the weights being exact
fractions. When a source ends, a new phase with the remaining sources begins; every row is placed
once. The schedule is made on the driver, over at most BLOCKS blocks and one a source: a corpus too large for
blocks of the given size has larger ones, so the plan's size does not grow with the rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 32
BLOCKS = 1 << 20
BUCKET = 1024
_GROUP = 1024
_NULL = "\u0000null"


def _phase(left: Mapping[str, int], weight: Mapping[str, int]) -> tuple[dict[str, list[int]], int]:
    """Slots from 0 of each source's next blocks, earliest deadline first, until the first source ends; and their number.

    weight: whole numbers in the proportions of the weights.
    """
    total = sum(weight[s] for s in left)
    taken: dict[str, list[int]] = {s: [] for s in left}
    waiting: list[tuple[int, int, str, int]] = []
    ready = [(-(-total // weight[s]), s, 0) for s in left]
    heapq.heapify(ready)
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        due, s, i = heapq.heappop(ready)
        assert due > t, "weights that sum to 1 meet their deadlines"
        taken[s].append(t)
        t += 1
        if i + 1 == left[s]:
            return taken, t
        job = (i + 1) * total // weight[s], -(-(i + 2) * total // weight[s]), s, i + 1
        if job[0] <= t:
            heapq.heappush(ready, job[1:])
        else:
            heapq.heappush(waiting, job)


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, list[int]]:
    """The slot of each block of each source. A phase costs as many steps as it has slots and sources."""
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    weight = {s: int(w * scale) for s, w in exact.items()}
    left = {s: n for s, n in blocks.items() if n}
    out: dict[str, list[int]] = {s: [] for s in left}
    base = 0
    while left:
        if len(left) == 1:
            [(s, n)] = left.items()
            out[s] += range(base, base + n)
            break
        taken, length = _phase(left, weight)
        for s, slots in taken.items():
            out[s] += [base + t for t in slots]
            left[s] -= len(slots)
            if not left[s]:
                del left[s]
        base += length
    return out


def tempered(counts: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights between the natural shares (1) and equal ones (0)."""
    return {s: float(n) ** power for s, n in counts.items() if n}


def _before(sizes: DataFrame) -> DataFrame:
    """(s, b, before): rows of the source in the buckets before b; two steps, so that no window holds all buckets of a source."""
    grouped = sizes.withColumn("g", F.floor(F.col("__lw_b") / _GROUP))
    inside = F.sum("n").over(Window.partitionBy("__lw_s", "g").orderBy("__lw_b")) - F.col("n")
    tops = grouped.groupBy("__lw_s", "g").agg(F.sum("n").alias("n"))
    tops = tops.select("__lw_s", "g", (F.sum("n").over(Window.partitionBy("__lw_s").orderBy("g")) - F.col("n")).alias("top"))
    return grouped.withColumn("inside", inside).join(tops, ["__lw_s", "g"]).select("__lw_s", "__lw_b", (F.col("inside") + F.col("top")).alias("__lw_before"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, source_col: str = "source", id_col: str = "doc_id", most_blocks: int = BLOCKS) -> DataFrame:
    """docs with columns mix_block, mix_slot, mix_position (longs): each row's block in its source, that
    block's slot, and the row's place in the mixed order (increasing; gaps only after partial blocks).

    weights: positive target weight of each source (None key for null source), taken exactly; by default the
    square root of its rows. A source without a weight is an error. Blocks have `block` rows, more where the rows would
    make over `most_blocks` blocks. Rows of a source are dealt into blocks by the hash of their id, those of null id by that of
    their other columns; equal ids take any of their places, and rows that are equal in all columns are one key. The per-source counts are the only thing that reaches the driver: as many numbers
    as there are sources; the schedule of blocks goes back as an array a source. Columns of docs with these names
    are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    named = docs.withColumn("__lw_s", F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)))
    counts = {r["__lw_s"]: r["n"] for r in named.groupBy("__lw_s").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return docs.withColumns({c: F.lit(None).cast("long") for c in ("mix_block", "mix_slot", "mix_position")})
    if weights is not None:
        wanted = {_NULL if s is None else s: w for s, w in weights.items()}
        if missing := sorted(set(counts) - set(wanted)):
            raise ValueError(f"no weight for sources {missing[:5]}")
        if any(not 0 < w < math.inf for w in wanted.values()):
            raise ValueError("weights are positive")
    else:
        wanted = tempered(counts)
    rows = sum(counts.values())
    block = max(block, -(-rows // most_blocks))
    slots = schedule({s: -(-n // block) for s, n in counts.items()}, wanted)
    plan = pa.table({"__lw_s": pa.array(list(slots), pa.string()), "__lw_where": pa.array(list(slots.values()), pa.list_(pa.int64()))})
    table = F.broadcast(docs.sparkSession.createDataFrame(plan))  # eight bytes a block, of most_blocks blocks and one a source
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != id_col and "map<" not in kind and "variant" not in kind]
    h = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(F.lit("null"), *rest))
    dealt = named.withColumn("__lw_h", h).withColumn("__lw_b", F.pmod(F.col("__lw_h"), F.lit(max(1, rows // BUCKET)).cast("long")))
    before = _before(dealt.groupBy("__lw_s", "__lw_b").agg(F.count(F.lit(1)).alias("n")))
    ranked = dealt.withColumn("__lw_r", F.row_number().over(Window.partitionBy("__lw_s", "__lw_b").orderBy("__lw_h", id_col)) - 1)
    placed = ranked.join(before, ["__lw_s", "__lw_b"]).withColumn("__lw_rank", F.col("__lw_before") + F.col("__lw_r"))
    placed = placed.withColumn("mix_block", F.floor(F.col("__lw_rank") / block).cast("long")).join(table, "__lw_s")
    placed = placed.withColumn("mix_slot", F.get("__lw_where", F.col("mix_block").cast("int")))
    return placed.select(*docs.columns, "mix_block", "mix_slot", (F.col("mix_slot") * block + F.col("__lw_rank") % block).alias("mix_position"))


def in_mixed_order(docs: DataFrame, partitions: int, **options) -> DataFrame:
    """docs, same columns, laid out in the mixed order: partitions are ranges of it, each sorted."""
    return mix(docs, **options).repartitionByRange(partitions, "mix_position").sortWithinPartitions("mix_position").select(*docs.columns)
