"""A review kept as an append-only log of actions, with the audit's counts brought up to date for what an action touches.

A review is a folder that executors share:

* `rules`, `postings` (key, rec_seq, n: the spellings of a folded keyword in a record): written once, postings in buckets by key;
* `log`, `mapping` (raw, canonical or null), `counts` (canonical, rec_seq, n, added up over versions), `metrics` (canonical, raw_sum,
  doc_count): one folder a version; what a version says of a key or canonical stands over earlier ones;
* `done/version=N`, written last. A version without it does not count and is written again, so a lost job leaves the review as it was.

One writer at a time. An action (seq, raw_term, selected, target, reset) sets what is not null; reset first clears the term's earlier
choices. Actions stand in the order of version and seq; of two with one seq the greater value stands. Null terms are nobody's, terms
without a rule are kept and do nothing; a null rec_seq (a long) is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from .audit import mapping_of
from .review import apply_overrides

ACTION = "seq long, raw_term string, selected boolean, target string, reset boolean"
#: Columns of the tables that have versions. They are named, so that a version without rows reads like others.
SCHEMAS = {
    "log": f"{ACTION}, version int",
    "mapping": "raw string, canonical string, old string, version int",
    "counts": "canonical string, rec_seq long, n long, version int, bucket int",
    "metrics": "canonical string, raw_sum long, doc_count long, version int",
}
#: Folders that postings and counts of a version are spread over; an update reads those of the keys that it touches.
BUCKETS = 64


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, folder: str) -> int:
    """How many versions are whole; they are numbered from 0."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(1 for f in fs.listStatus(path) if f.getPath().getName().startswith("version=")) if fs.exists(path) else 0


def _finish(spark: SparkSession, folder: str, version: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/done/version={version}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _by_bucket(df: DataFrame, key: str) -> DataFrame:
    """df with the bucket of key, a file a bucket; adaptive execution splits a bucket above its advisory size, as one of a hot key."""
    return df.withColumn("bucket", _bucket(F.col(key))).hint("rebalance", "bucket")


def _write(df: DataFrame, folder: str, table: str, version: int, by: str | None = None) -> None:
    if by is None:
        df.write.mode("overwrite").parquet(f"{folder}/{table}/version={version}")
        return
    _by_bucket(df, by).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{table}/version={version}")


def _read(spark: SparkSession, folder: str, table: str, versions: int) -> DataFrame:
    paths = [f"{folder}/{table}/version={v}" for v in range(versions)]
    return spark.read.option("basePath", f"{folder}/{table}").schema(SCHEMAS[table]).parquet(*paths)


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("rec_seq long, key string, n long, bucket int").parquet(f"{folder}/postings")


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of a key those of its last version (there is one)."""
    values = F.struct(*(c for c in rows.columns if c not in (key, "version")))
    return rows.groupBy(key).agg(F.max_by(values, "version").alias("v")).select(key, "v.*")


def _in_buckets_of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of `rows` in the folders of the keys; at most BUCKETS numbers reach the driver."""
    wanted = [r[0] for r in keys.select(_bucket(F.col(key))).distinct().collect()]
    return rows.where(F.col("bucket").isin(wanted)).drop("bucket")


def start(folder: str, rules: DataFrame, doc_kw: DataFrame) -> None:
    """A new review of rules over (rec_seq, kw_raw), version 0."""
    spark = rules.sparkSession
    if _versions(spark, folder):
        raise ValueError(f"{folder} holds a review")
    rules.write.mode("overwrite").parquet(f"{folder}/rules")
    rules = spark.read.parquet(f"{folder}/rules")
    postings = doc_kw.groupBy("rec_seq", fold(F.col("kw_raw")).alias("key")).agg(F.count_distinct("kw_raw").alias("n")).where("key <> ''")
    _by_bucket(postings, "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    _write(spark.createDataFrame([], ACTION), folder, "log", 0)
    _write(mapping_of(rules), folder, "mapping", 0)
    mapping, postings = _read(spark, folder, "mapping", 1).select("raw", "canonical"), _postings(spark, folder).drop("bucket")
    named = postings.join(mapping, F.col("key") == F.col("raw"), "left").select(F.coalesce("canonical", "key").alias("canonical"), "rec_seq", "n").where("canonical <> ''")
    _write(named.groupBy("canonical", "rec_seq").agg(F.sum("n").alias("n")), folder, "counts", 0, "canonical")
    kept = _read(spark, folder, "counts", 1)
    _write(kept.groupBy("canonical").agg(F.sum("n").alias("raw_sum"), F.count(F.lit(1)).alias("doc_count")), folder, "metrics", 0)
    _finish(spark, folder, 0)


def _compacted_log(log: DataFrame) -> DataFrame:
    """(raw_term, selected, target) that stand after all actions, the last writer of each; terms with neither are left out."""
    at = F.struct("version", "seq")
    of = log.where("raw_term IS NOT NULL").groupBy("raw_term").agg(
        F.max(F.when(F.col("reset"), at)).alias("r"),
        F.max(F.when(F.col("selected").isNotNull(), F.struct(at.alias("at"), "selected"))).alias("s"),
        F.max(F.when(F.col("target").isNotNull(), F.struct(at.alias("at"), "target"))).alias("t"),
    )
    # What the resetting action itself sets stands.
    stands = lambda c: F.when(F.col("r").isNull() | (F.col(f"{c}.at") >= F.col("r")), F.col(c))
    return of.select("raw_term", stands("s")["selected"].alias("selected"), stands("t")["target"].alias("target")).where("selected IS NOT NULL OR target IS NOT NULL")


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_term, selected, target) of the review, what `apply_overrides` and the draft take."""
    return _compacted_log(_read(spark, folder, "log", _versions(spark, folder)))


def reviewed_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules with all choices of the review."""
    return apply_overrides(spark.read.parquet(f"{folder}/rules"), overrides(spark, folder))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(canonical, raw_sum, doc_count, reduction) as `dual_metrics` has them for the reviewed rules, read from what is kept."""
    kept = _latest(_read(spark, folder, "metrics", _versions(spark, folder)), "canonical").where("raw_sum > 0")
    return kept.withColumn("reduction", F.col("raw_sum") - F.col("doc_count"))


def record(folder: str, actions: DataFrame) -> None:
    """Adds actions as a version. Counts change only for keywords whose canonical the actions change, and for those two canonicals.

    Per keyword and record one row leaves the old canonical and one joins the new: a keyword that stands in a third of all records
    is dealt by (canonical, record), and its sums are made in parts.
    """
    spark = actions.sparkSession
    n = _versions(spark, folder)
    if not n:
        raise ValueError(f"{folder} holds no review")
    flag = F.coalesce("reset", F.lit(False)) if "reset" in actions.columns else F.lit(False)
    _write(actions.select(F.col("seq").cast("long").alias("seq"), "raw_term", "selected", "target", flag.alias("reset")), folder, "log", n)
    touched = _read(spark, folder, "log", n + 1).where(F.col("version") == n).select(fold(F.col("raw_term")).alias("raw")).where("raw IS NOT NULL").distinct()
    # Rules and choices of the touched keys alone; one key may have several rules.
    rules = spark.read.parquet(f"{folder}/rules").join(touched, fold(F.col("raw_term")) == F.col("raw"), "left_semi")
    log = _read(spark, folder, "log", n + 1).join(touched, fold(F.col("raw_term")) == F.col("raw"), "left_semi")
    now = mapping_of(apply_overrides(rules, _compacted_log(log)))
    was = _latest(_read(spark, folder, "mapping", n).drop("old"), "raw").select("raw", F.col("canonical").alias("old"))
    _write(touched.join(now, "raw", "left").join(was, "raw", "left").where(~F.col("canonical").eqNullSafe(F.col("old"))), folder, "mapping", n)
    changed = _read(spark, folder, "mapping", n + 1).where(F.col("version") == n).select(F.col("raw").alias("key"), "old", "canonical")
    moved = _in_buckets_of(_postings(spark, folder), changed, "key").join(changed, "key")
    moves = moved.select("rec_seq", F.explode(F.array(
        F.struct(F.coalesce("old", "key").alias("canonical"), (-F.col("n")).alias("n")), F.struct(F.coalesce("canonical", "key").alias("canonical"), F.col("n").alias("n")),
    )).alias("m")).select("m.canonical", "rec_seq", "m.n").where("canonical <> ''")
    _write(moves.groupBy("canonical", "rec_seq").agg(F.sum("n").alias("n")).where("n <> 0"), folder, "counts", n, "canonical")
    delta = _read(spark, folder, "counts", n + 1).where(F.col("version") == n).select("canonical", "rec_seq", F.col("n").alias("d"))
    before = _in_buckets_of(_read(spark, folder, "counts", n), delta, "canonical").groupBy("canonical", "rec_seq").agg(F.sum("n").alias("n"))
    before = before.select(F.col("canonical").alias("__c"), F.col("rec_seq").alias("__r"), "n")
    met = delta.join(before, (F.col("canonical") == F.col("__c")) & F.col("rec_seq").eqNullSafe(F.col("__r")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gained = (F.col("n") + F.col("d") > 0).cast("long") - (F.col("n") > 0).cast("long")
    change = met.groupBy("canonical").agg(F.sum("d").alias("ds"), F.sum(gained).alias("dd"))
    old = _latest(_read(spark, folder, "metrics", n), "canonical")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    new = change.join(old, "canonical", "left").select("canonical", (zero("raw_sum") + F.col("ds")).alias("raw_sum"), (zero("doc_count") + F.col("dd")).alias("doc_count"))
    _write(new, folder, "metrics", n)
    _finish(spark, folder, n)


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The review of `folder` as version 0 of a new folder: one action a term, one row a key and canonical."""
    n = _versions(spark, folder)
    if not n or _versions(spark, into):
        raise ValueError(f"{folder} must hold a review and {into} none")
    spark.read.parquet(f"{folder}/rules").write.mode("overwrite").parquet(f"{into}/rules")
    _by_bucket(_postings(spark, folder).drop("bucket"), "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/postings")
    _write(overrides(spark, folder).select(F.lit(0).cast("long").alias("seq"), "raw_term", "selected", "target", F.lit(False).alias("reset")), into, "log", 0)
    _write(_latest(_read(spark, folder, "mapping", n).drop("old"), "raw").where("canonical IS NOT NULL"), into, "mapping", 0)
    counts = _read(spark, folder, "counts", n).groupBy("canonical", "rec_seq").agg(F.sum("n").alias("n")).where("n > 0")
    _write(counts, into, "counts", 0, "canonical")
    _write(metrics(spark, folder).drop("reduction"), into, "metrics", 0)
    _finish(spark, into, 0)
