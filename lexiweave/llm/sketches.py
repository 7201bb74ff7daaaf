"""Bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word
shingles, as longs. Sketches of parts merge to the sketch of the whole set; from two sketches come
estimates of resemblance and containment, and from one the number of distinct shingles. A set of
fewer than k shingles is held whole, so its figures are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_key, stable

K = 128
WIDTH = 5
_SPACE = " \t\n\u000b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for null or blank text."""
    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds `out`: the sketch of text_col. Fewer than `width` words make one shingle; none make none."""
    hashed = df.withColumn("__h", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
    h = F.col("__h")
    whole = F.xxhash64(h)
    each = F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, width))))
    shingled = F.when(F.size(h) == 0, h).when(F.size(h) <= width, F.array(whole)).otherwise(each)
    return hashed.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingled)), 1, k)).drop("__h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One merged sketch for each key: its k smallest hashes, by map-side combined steps.

    Hashes are first made distinct and cut to k for each of 64 salts, so a hot key's parts are
    reduced before they meet; at most 64 k hashes of a key then meet in one task.
    """
    one = df.select(*keys, F.explode(sketch).alias("__x")).distinct().withColumn("__s", F.pmod(F.xxhash64("__x"), F.lit(64)))
    part = one.groupBy(*keys, "__s").agg(F.slice(F.sort_array(F.collect_set("__x")), 1, k).alias("__p"))
    return part.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("__p"))), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sets resemble fully, one empty set not at all."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(u, a), b))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's share of the range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that is in b's: resemblance times the union's size over a's size."""
    inside = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(inside, F.lit(1.0)))


def as_string(a: Column) -> Column:
    """The sketch as hex digits, 16 a hash; empty for a text without words."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def next_rows(keys: DataFrame, parts: int) -> DataFrame:
    """For each (id, th, half) row, in descending id, then th: the next row's nid, nth; after the last: the first.

    Rows are range-partitioned once; each partition is numbered and walked by a window, and the
    first row of each partition (one for each of `parts` partitions) closes the gap before it.
    """
    order = [F.col("id").desc(), F.col("th").asc()]
    dealt = keys.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id())
    dealt = stable(dealt)
    firsts = dealt.groupBy("pid").agg(F.min_by(F.struct("id", "th"), F.struct(-F.col("id").cast("decimal(20,0)"), "th")).alias("first"))
    ring = Window.orderBy("pid")  # one row for each partition
    closing = firsts.select("pid", F.lead("first").over(ring).alias("after"), F.first("first").over(ring).alias("very_first"))
    closing = closing.select("pid", F.coalesce("after", "very_first").alias("after"))
    inner = dealt.withColumn("nx", F.lead(F.struct("id", "th")).over(Window.partitionBy("pid").orderBy(*order)))
    return inner.join(F.broadcast(closing), "pid").select("id", "th", "half", F.coalesce("nx", "after").alias("nx")).select("id", "th", "half", F.col("nx.id").alias("nid"), F.col("nx.th").alias("nth"))


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """Each document's sketch, its edited text's sketch, and their likeness.

    The edited text is the document with its last floor(n/2) code points replaced by the first as
    many (or all) of the next document in descending doc_id; after the last comes the first. Null
    text counts as empty, a null doc_id as the smallest id. Rows that share a doc_id follow by the
    hash of their texts; exact repeats of a row count as one document in that order and come out
    once each. A single document is its own next. Returns doc_id, next_doc_id, n_chars, edited, sketch,
    edited_sketch, near_edited, near_next; further columns of docs are ignored.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", id_key().alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    lengths = base.select("id", "th", F.floor(F.char_length("text") / 2).alias("half"))
    distinct = lengths.groupBy("id", "th").agg(F.max("half").alias("half"), F.count(F.lit(1)).alias("copies"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nexts = stable(next_rows(stable(distinct.drop("copies")), parts))
    # Every document goes once to its own key; its first half goes on to the document before it.
    before = nexts.select(F.col("nid").alias("id"), F.col("nth").alias("th"), F.col("id").alias("pid"), F.col("th").alias("pth"), F.col("half").alias("phalf"))
    here = with_sketch(base.join(before, ["id", "th"]), "text", "sketch", k, width)
    sent = here.select(F.col("pid").alias("id"), F.col("pth").alias("th"), F.substring("text", F.lit(1), F.col("phalf").cast("int")).alias("head"), F.col("sketch").alias("next_sketch"), F.col("doc_id").alias("next_doc_id"))
    if not distinct.where("copies > 1").isEmpty():
        sent = sent.dropDuplicates(["id", "th"])
    # The same columns of base as above, so that its exchange is reused and each text is shuffled once.
    met = with_sketch(base.join(sent, ["id", "th"]), "text", "sketch", k, width)
    n = F.char_length("text")
    made = met.select("doc_id", "next_doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "head").alias("edited"))
    made = with_sketch(made, "edited", "edited_sketch", k, width)
    return made.select("doc_id", "next_doc_id", "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
