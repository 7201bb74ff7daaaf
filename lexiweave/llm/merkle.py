"""Merkle manifest of a table of documents: one root, and a proof for every row.

A row's leaf is a digest over its fields. The leaves of a source, in order of id, are hashed in runs of FANOUT, level by level, to
the source's subroot, and the subroots in order of source likewise to the root. Levels are not computed one by
one: nodes are bucketed by their index divided by FANOUT^LEVELS, and one applyInPandas collapses LEVELS levels of a
bucket (a superblock). Bucket roots are nodes of the next, 256 times smaller table, until one node is left.
Proofs are made on the way down: the siblings of a node inside its bucket, then those of its bucket's root. Buckets have at most
FANOUT^LEVELS nodes whatever the size of a source. Indices come from a range partitioning and prefix sums over
partitions, so no task ever holds a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stable

FANOUT = 16
#: Levels of a superblock.
LEVELS = 2
BUCKET = FANOUT**LEVELS


def digest(text: str) -> str:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return hashlib.sha256(text.encode()).hexdigest()


def levels_above(n: int) -> int:
    """Levels between n nodes and their one root: none for a single node."""
    found = 0
    while n > 1:
        n, found = -(-n // FANOUT), found + 1
    return found


def collapse(nodes: list[str], levels: int) -> tuple[str, list[str], list[list[int]]]:
    """Root of a bucket of consecutive nodes after `levels` levels, and each node's siblings (their digests joined) and places.

    Places are, for each level, the siblings to the left and to the right of the node's ancestor in its run.
    """
    siblings, places = [""] * len(nodes), [[] for _ in nodes]
    now, width = nodes, 1
    for _ in range(levels):
        above = []
        for at in range(0, len(now), FANOUT):
            run = now[at : at + FANOUT]
            for i in range(len(run)):
                others = "".join(run[:i]) + "".join(run[i + 1 :])
                for x in range((at + i) * width, min((at + i + 1) * width, len(nodes))):
                    siblings[x] += others
                    places[x] += [i, len(run) - 1 - i]
            above.append(digest("".join(run)))
        now, width = above, width * FANOUT
    return now[0], siblings, places


def fold(node: str, siblings: str, places: list[int]) -> str:
    """The root that a node and its proof give."""
    at = 0
    for left, right in zip(places[::2], places[1::2], strict=True):
        middle, end = at + 64 * left, at + 64 * (left + right)
        node = digest(siblings[at:middle] + node + siblings[middle:end])
        at = end
    return node


def _levels(n: int) -> int:
    return min(LEVELS, levels_above(n))


def _ordered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows in order of keys, with their partition `pid` and place `pos` in it, settled.

    Fully tied rows may stand in any order, so the place of a row in the input comes last: a key
    that a third of all rows have is dealt over many partitions.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = F.monotonically_increasing_id()
    order = [*(k.asc_nulls_first() for k in keys), F.col("__tie").asc()]
    dealt = rows.withColumn("__tie", tie).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
    return stable(dealt.withColumn("pid", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _indexed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves with t, the number of their source, i, their index in it, and n, its leaves; and (t, n), a row for each source.

    Counts are one row for each partition and source in it; windows go over the sources of one partition, over the partitions
    of one source, and over all partitions.
    """
    ordered = _ordered(leaves, [F.col("source"), F.col("doc_id"), F.col("leaf")])
    counts = ordered.groupBy("pid", "source").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("low"))
    of_source = Window.partitionBy("source")
    earlier_rows = of_source.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("*", F.coalesce(F.sum("m").over(earlier_rows), F.lit(0)).alias("before"), F.sum("m").over(of_source).alias("n"))
    counts = counts.withColumn("new", F.when(F.col("before") == 0, 1).otherwise(0))
    begun = counts.groupBy(F.col("pid").alias("p")).agg(F.sum("new").alias("sources")).select("p", F.coalesce(F.sum("sources").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.sum("new").over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A source that began in an earlier partition is the last one counted there.
    counts = counts.withColumn("inside", inside).join(begun, F.col("pid") == F.col("p"))
    counts = stable(counts.select("p", F.col("source").alias("s"), (F.col("earlier") + F.col("inside") - 1).alias("t"), (F.col("before") - F.col("low")).alias("shift"), "n", "new"))
    joined = ordered.join(counts, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("i", F.col("pos") + F.col("shift"))
    return joined.drop("p", "s", "pid", "pos", "shift", "new"), counts.where("new = 1").select("t", "n")


_NODE = "t long, i long, n long, node string"


def _bucket() -> Column:
    return F.expr(f"i div {BUCKET}").alias("bucket")


def _above(nodes: DataFrame) -> DataFrame:
    """The next table of nodes: a row for each bucket, numbered as buckets are."""

    def shrink(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        n = int(group["n"].iloc[0])
        levels = _levels(n)
        root = collapse(group["node"].tolist(), levels)[0]
        return pd.DataFrame({"t": [key[0]], "i": [key[1]], "n": [-(-n // FANOUT**levels)], "node": [root]})

    return nodes.select("t", "i", "n", "node").groupBy("t", _bucket()).applyInPandas(shrink, _NODE)


def _reduced(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of nodes from the given one up to that of one node a tree, each settled but the first; most: nodes of the largest tree."""
    tables = [nodes]
    while most > 1:
        tables.append(stable(_above(tables[-1])))
        most = -(-most // BUCKET)
    return tables


def _below(nodes: DataFrame, upper: DataFrame, keep: list[str]) -> DataFrame:
    """keep, subroot, siblings and places of nodes: the lower proof inside a node's bucket and then the bucket root's own.

    upper: (t, i, subroot, siblings, places) of the table above.
    """
    fields = {f.name: f for f in nodes.schema.fields}
    schema = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in keep) + ", subroot string, siblings string, places array<int>"

    def join(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        _, siblings, places = collapse(group["node"].tolist(), _levels(int(group["n"].iloc[0])))
        subroot, more, further = above["subroot"].iloc[0], above["siblings"].iloc[0], list(above["places"].iloc[0])
        return group[keep].assign(subroot=subroot, siblings=[s + more for s in siblings], places=[p + further for p in places])

    left = nodes.withColumn("bucket", _bucket()).groupBy("t", "bucket")
    right = upper.withColumn("bucket", F.col("i")).groupBy("t", "bucket")
    return left.cogroup(right).applyInPandas(join, schema)


def _proofs(tables: list[DataFrame], top: DataFrame, keep: list[str]) -> DataFrame:
    """Proofs of the first table's nodes; top: (t, i, subroot, siblings, places) of the last table."""
    for n in range(len(tables) - 2, -1, -1):
        top = _below(tables[n], top, keep if n == 0 else ["t", "i"])
    return top


def field(value: Column, size: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    return F.coalesce(F.concat(size.cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """The leaf of a row: the digest of its fields, one after the other."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(field(t, F.octet_length(t)) for t in texts)), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, tampered_leaf, subroot, root, siblings, places) of every row.

    siblings and places are the proof that `fold` takes from the leaf to the root. tampered gives another text in place of a row's
    own, null where the row stays; its leaf is tampered_leaf, null likewise. Nulls are values of their own: a null source is
    a source and comes first, as a null id does in its source. Rows of equal id are ordered by their leaf, repeated rows
    are leaves of their own. A source of one row has its leaf as subroot, a table of one source its subroot as root.
    An empty table gives an empty result. Columns beyond FIELDS are ignored, those of FIELDS that docs lacks count as null.
    """
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in FIELDS}
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered.isNotNull(), leaf_of([have[c] if c != "text" else tampered for c in FIELDS]))
    # The texts are read once, for their digests.
    leaves = stable(docs.select(have["source"].alias("source"), have["doc_id"].cast("long").alias("doc_id"), leaf_of(list(have.values())).alias("leaf"), other.alias("tampered_leaf")))
    nodes, sources = _indexed(leaves)
    size = sources.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    nodes = nodes.withColumn("node", F.col("leaf"))
    tables = _reduced(nodes, size["most"] or 0)
    upper = tables[-1].select(F.lit(0).cast("long").alias("t"), F.col("t").alias("i"), F.lit(size["sources"]).cast("long").alias("n"), "node")
    further = _reduced(upper, size["sources"])
    root = further[-1].select("node").first()
    nothing = (F.lit("").alias("siblings"), F.array().cast("array<int>").alias("places"))
    top = further[-1].select("t", "i", "node", F.lit("").alias("subroot"), *nothing)
    of_sources = _proofs(further, top, ["t", "i", "node"])
    keep = ["source", "doc_id", "leaf", "tampered_leaf"]
    top = of_sources.select(F.col("i").alias("t"), F.lit(0).cast("long").alias("i"), F.col("node").alias("subroot"), "siblings", "places")
    if len(tables) == 1:  # every source has one row, which is its subroot
        found = nodes.drop("i").join(top.drop("i"), "t")
    else:
        found = _proofs(tables, top, keep)
    return found.select("source", "doc_id", "leaf", "tampered_leaf", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "siblings", "places")


def folded(rows: DataFrame, leaf: Column, into: str = "folded_root") -> DataFrame:
    """rows of `manifest` with a column `into`: the root that their proof gives from `leaf`. A null leaf or proof gives null."""
    rows = rows.drop(into).withColumn("__leaf", leaf)
    names = rows.columns[:-1]
    schema = rows.drop("__leaf").schema.add(into, "string")
    at = [rows.columns.index(c) for c in ("__leaf", "siblings", "places")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(*(b.column(i).to_pylist() for i in at), strict=True)
            roots = [None if None in (x, s, p) else fold(x, s, p) for x, s, p in each]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(roots, pa.string())], names=[*names, into])

    return rows.mapInArrow(run, schema)


def tampered_text(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text with A-Z in lower case where 5 divides the crc32 of the id in decimal, else null; null texts stay null."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(F.col(text), letters, letters.lower()))


def _climb_sql(tree: str, path: str, levels: int) -> str:
    """CTEs from {tree}0 (t, i, node, n) and {path}0 (id, t, i, fold, siblings) up by `levels` levels; a tree of one node stays."""
    parts, side = [], f"p.i % {FANOUT} + 1"
    left, right = f"array_to_string(run[1:{side} - 1], '')", f"array_to_string(run[{side} + 1:], '')"
    for k in range(levels):
        parts += [
            f"{tree}{k}r AS (SELECT t, i // {FANOUT} AS b, list(node ORDER BY i) AS run, any_value(n) AS n FROM {tree}{k} GROUP BY 1, 2)",
            f"{tree}{k + 1} AS (SELECT t, b AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {tree}{k}r)",
            f"""{path}{k + 1} AS (SELECT id, p.t, b AS i, CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold,
 CASE WHEN n > 1 THEN siblings || {left} || {right} ELSE siblings END AS siblings FROM {path}{k} p JOIN {tree}{k}r r ON r.t = p.t AND r.b = p.i // {FANOUT})""",
        ]
    return ", ".join(parts)


def oracle_sql(levels: int = 5) -> str:
    """The manifest in DuckDB, level by level, for sources of up to FANOUT^levels rows and as many sources; crc32 bit by bit."""
    shifted = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {shifted}), 4294967295)"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({' || '.join(value(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    other = leaf(f"translate(text, '{letters}', '{letters.lower()}')")
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {other} ELSE {leaf("text")} END AS fold FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM documents)),
placed AS (SELECT id, fold, leaf AS node, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d JOIN src ON src.source IS NOT DISTINCT FROM d.source),
a0 AS (SELECT t, i, node, n FROM placed), p0 AS (SELECT id, t, i, fold, '' AS siblings FROM placed), {_climb_sql("a", "p", levels)},
b0 AS (SELECT 0 AS t, t AS i, node, count(*) OVER () AS n FROM a{levels}), q0 AS (SELECT id, 0 AS t, t AS i, fold, siblings FROM p{levels}), {_climb_sql("b", "q", levels)}
SELECT doc_id, leaf, a{levels}.node AS subroot, b{levels}.node AS root, sha256(siblings) AS proof_sha256, q.fold AS folded_root, q.fold = b{levels}.node AS verified
FROM d JOIN q{levels} q USING (id) JOIN placed USING (id) JOIN a{levels} ON a{levels}.t = placed.t JOIN b{levels} ON true"""
