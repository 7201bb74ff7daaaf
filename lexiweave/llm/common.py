"""Shared helpers: lineage cuts in the shared folder, and one connected-components routine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NO_ID = -(1 << 63)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir as the session gives it; a temporary folder serves only where none is set and all runs on
    one machine. On a cluster without the setting this is an error. Files of checkpoints that nothing refers to are removed."""
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lexiweave-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder of this name only inside the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def stable(df: DataFrame) -> DataFrame:
    """A copy of df in the shared checkpoint folder: computed once, and safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(col: str = "doc_id"):
    """A join key for a nullable id: all nulls meet on the smallest long."""
    return F.coalesce(F.col(col).cast("long"), F.lit(_NO_ID))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as (src, dst) rows, by alternating large and small stars.

    Returns (node, root), root being the smallest node of the component; nodes without an edge to
    another node are absent. Every step is a map-side combined minimum, or a join in which a hub node's edges
    meet its one minimum, where adaptive execution splits them. Each round ends in a checkpoint; rounds grow
    about as the logarithm of the longest chain.
    """
    pairs = edges.where(F.col("src") != F.col("dst"))
    e = stable(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = stable(small)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
