"""Text in other charsets, decoded and encoded in generated code.

Spark's own decode knows GBK and GB18030 only under settings that it takes from the session when an expression is resolved. They are
on while a frame is made here and as before afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Charsets that are tried after UTF-8, in this order; the last one decodes anything.
CHARSETS = ["GBK", "GB18030", "ISO-8859-1"]
_SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


@contextmanager
def all_charsets(spark: SparkSession) -> Iterator[None]:
    """Frames made inside decode and encode by any charset of the JVM; what a charset lacks is replaced, not an error."""
    before = [spark.conf.get(s, None) for s in _SETTINGS]
    for s in _SETTINGS:
        spark.conf.set(s, "true")
    try:
        yield
    finally:
        for s, value in zip(_SETTINGS, before):
            spark.conf.unset(s) if value is None else spark.conf.set(s, value)


def encoded(df: DataFrame, column: str, charsets: list[str], kind: str = "kind") -> DataFrame:
    """df with the bytes of column in the place of its UTF-8, as Spark's text writer puts them out, where `kind` names one of the charsets."""
    with all_charsets(df.sparkSession):
        value = F.col(column)
        for c in charsets:
            value = F.when(F.col(kind) == c, F.encode(column, c).cast("string")).otherwise(value)
        return df.withColumn(column, value)


def file_charsets(raw: DataFrame) -> DataFrame:
    """(path, charset) of (path, value) lines of raw bytes: the first of UTF-8 and CHARSETS that decodes each line of a file.

    A line is decoded if nothing in it had to be replaced, or if encoding it again gives its bytes. All bytes of a line end are line ends in each of these charsets.
    """
    b = F.col("value").cast("binary")
    with all_charsets(raw.sparkSession):
        fits = lambda c: ~F.contains(F.decode(b, c), F.lit("�")) | (F.encode(F.decode(b, c), c) == b)
        marks = raw.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), *(F.bool_and(fits(c)).alias(c) for c in CHARSETS[:-1]))
    first = F.when(F.col("utf8"), "UTF-8")
    for c in CHARSETS[:-1]:
        first = first.when(F.col(c), c)
    return marks.select("path", first.otherwise(CHARSETS[-1]).alias("charset"))


def decoded(raw: DataFrame) -> DataFrame:
    """Lines of raw bytes (path, value, ...) with value decoded by the charset of its file.

    The bytes are read twice, once for the charsets, a row a file, as the driver's own list of files has.
    """
    kinds = file_charsets(raw).select(F.col("path").alias("__path"), "charset")
    met = raw.join(F.broadcast(kinds), F.col("path") == F.col("__path"))
    b = F.col("value").cast("binary")
    with all_charsets(raw.sparkSession):
        text = F.when(F.col("charset") == "UTF-8", F.col("value"))
        for c in CHARSETS:
            text = text.when(F.col("charset") == c, F.decode(b, c))
        return met.withColumn("value", text).drop("__path", "charset")
