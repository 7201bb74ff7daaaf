"""Document frequencies over arriving records: a record that is exported again counts once, a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keywords import document_frequency
from ..sources.sinks import _file_system

KEYS = ("doc_id", "kw_raw")


def _seen(spark: SparkSession, folder: str) -> DataFrame | None:
    """(doc_id, kw_raw, batch) of all batches so far."""
    found = _file_system(spark, folder).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    return spark.read.schema("doc_id string, kw_raw string, batch long").parquet(folder) if found else None


def take_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Keeps the (doc_id, kw_raw) pairs of a batch that no earlier one had, as the batch's own part of the folder.

    The part is written anew when the batch comes again, so it counts once. Rows with a null id or keyword are left out.
    Pairs are compared by an anti-join on both columns, so a record or a keyword with a third of all rows is no single key.
    """
    new = batch.select(*(F.col(c).cast("string").alias(c) for c in KEYS)).where(F.col("doc_id").isNotNull() & F.col("kw_raw").isNotNull()).distinct()
    seen = _seen(batch.sparkSession, folder)
    if seen is not None:
        new = new.join(seen.where(F.col("batch") < number).select(*KEYS), list(KEYS), "left_anti")
    new.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def follow(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts to keep the pairs of a stream of (doc_id, kw_raw) in a folder that all executors share; it ends when all that is there is taken."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, folder))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_frequency(spark: SparkSession, folder: str, ignore_case: bool = False) -> DataFrame:
    """A1 over all records that arrived: (term, freq), as `document_frequency` has it over their table at once."""
    seen = _seen(spark, folder)
    if seen is None:
        seen = spark.createDataFrame([], "doc_id string, kw_raw string")
    return document_frequency(seen.select(F.col("doc_id").alias("rec_seq"), "kw_raw"), ignore_case)
