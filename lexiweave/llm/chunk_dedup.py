"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes marks candidates for cuts wherever it falls under a threshold;
a chunk ends at the first candidate LEAST to MOST bytes from its start, else at MOST bytes. LEAST is the
hash's span, so once two texts are cut at the same place of a shared passage they are cut alike up to its end,
and an insertion moves only the cuts near it. From each chunk on, the shortest run of whole chunks with at
least `min_words` words is compared over the whole corpus by the 64-bit digest of its bytes: a run that stands
in two documents is repeated as a whole, so each repeated passage has one partner for `min_words` words in a row at
every place. A word is a stretch between blanks; in scripts that are written without blanks (Han, kana, Thai, Lao, Burmese,
Khmer) each code point counts as one. A text of fewer words is compared as a whole; blanks alone are no passage.
Overlapping runs join to passages. The document with the smallest id keeps its copy of a
run; later copies can be cut. Repeats inside one document are left alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_key

_SPAN = 16
LEAST = _SPAN
AVERAGE = 32
MOST = 512
MIN_WORDS = 24
#: Bytes hashed at a time.
STEP = 1 << 20


def gear_table(seed: int = 20) -> np.ndarray:
    """256 random 32-bit words, by seed."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash h = 2 h + gear[byte] over the last 16 bytes; its top 16 bits see them all."""
    h = _GEAR[data]
    step = 1
    while step < _SPAN:  # sums over 2, 4, ... 16 bytes
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h = wider
        step *= 2
    return h


def candidates(raw: bytes, average: int = AVERAGE) -> list[int]:
    """Ends of the bytes whose gear hash is under the threshold: one in average - LEAST."""
    data = np.frombuffer(raw, dtype=np.uint8)
    under = np.uint32((1 << 32) // max(1, average - LEAST) - 1)
    found = []
    for at in range(0, data.size, STEP):
        lead = min(at, _SPAN - 1)
        found.append(np.flatnonzero(gear_hashes(data[at - lead : at + STEP])[lead:] <= under) + at + 1)
    return np.concatenate(found).tolist() if found else []


def cut_points(raw: bytes, average: int = AVERAGE, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of raw, the last being its length."""
    ends, at, i, n = [], 0, 0, len(raw)
    cuts = candidates(raw, average)
    while at < n:
        i = bisect_left(cuts, at + LEAST, i)
        at = min(cuts[i] if i < len(cuts) else n, at + most, n)
        ends.append(at)
    return np.array(ends, dtype=np.int64)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(data: np.ndarray) -> np.ndarray:
    """Where words start in UTF-8 bytes, code points of scripts without blanks among them."""
    space = _IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    if data.size and data.max() >= 0xE0:
        after = np.append(data[1:], np.uint8(0))
        inside = lambda x, lo, hi: (x >= lo) & (x <= hi)
        begins |= inside(data, 0xE4, 0xE9) | ((data == 0xE3) & (after >= 0x81)) | ((data == 0xF0) & (after >= 0xA0))  # kana and Han
        begins |= (data == 0xE0) & inside(after, 0xB8, 0xBB)  # Thai and Lao
        begins |= (data == 0xE1) & (inside(after, 0x80, 0x82) | inside(after, 0x9E, 0x9F))  # Burmese and Khmer
    return np.flatnonzero(begins)


def runs_of(raw: bytes, average: int = AVERAGE, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the shortest run of chunks with min_words words from each chunk on; the whole text if it has fewer words, but some."""
    words = word_places(np.frombuffer(raw, dtype=np.uint8))
    if words.size < min_words:
        some = np.arange(1 if words.size else 0, dtype=np.int64)
        return some, some + len(raw)
    ends = cut_points(raw, average)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: ends.size]
    before = np.searchsorted(words, starts)
    last = np.searchsorted(np.searchsorted(words, ends), before + min_words)  # first chunk by whose end there are enough
    whole = last < ends.size
    starts, ends = starts[whole], ends[last[whole]]
    if ends[-1] < len(raw):  # the last run goes on to the end of the text, too, so that equal ends are found whole
        starts, ends = np.append(starts, starts[-1]), np.append(ends, len(raw))
    return starts, ends


def runs(docs: DataFrame, average: int = AVERAGE, min_words: int = MIN_WORDS, text_col: str = "text", places: bool = True) -> DataFrame:
    """(digest, k) of every run, and with places (th, start, end): text hash and place in bytes.

    k is the id, nulls on the smallest long. A text of fewer than min_words words is one run; null, empty and blank ones have none.
    """
    names = ["digest", "k", *(("th", "start", "end") if places else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            at = 0
            while at < b.num_rows:
                digests, found, rows, size = [], [], [], 0
                while at < b.num_rows and len(rows) < 256 and size < STEP:
                    raw = b.column(2)[at].as_py().encode("utf-8", "surrogatepass")
                    starts, ends = runs_of(raw, average, min_words)
                    digests += [digest(raw[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                    found.append((starts, ends))
                    rows.append(at)
                    size += len(raw)
                    at += 1
                row = pa.array(np.repeat(rows, [s.size for s, _ in found]))
                arrays = [pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), b.column(0).take(row)]
                if places:
                    arrays += [b.column(1).take(row), *(pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    text = F.col(text_col).cast("string")
    schema = "digest long, k long" + (", th long, start long, end long" if places else "")
    return docs.where(F.length(text) > 0).select(id_key().alias("k"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, average: int = AVERAGE, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """(k, th, start, bytes, removable_bytes, first_k) of each passage: repeated runs that overlap or touch.

    A run is repeated when its digest stands under two or more ids. removable_bytes are those of runs of which another
    id is the first, first_k is the smallest id with one of its runs.
    """
    ids = runs(docs, average, min_words, text_col, places=False).groupBy("digest").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"))
    repeated = ids.where("first_k < last_k").select("digest", "first_k")
    found = runs(docs, average, min_words, text_col).join(repeated, "digest").select("k", "th", "start", "end", "first_k")
    # One exchange by document; a repeated row adds nothing to what its first copy covers.
    before = Window.partitionBy("k", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    later = F.col("first_k") < F.col("k")
    found = found.withColumns({"so_far": F.max("end").over(before), "cut": F.max(F.when(later, F.col("end"))).over(before)})
    added = lambda c: F.greatest(F.col("end") - F.greatest("start", F.coalesce(c, F.lit(0))), F.lit(0))
    new = F.when(F.col("so_far").isNull() | (F.col("start") > F.col("so_far")), 1).otherwise(0)
    numbered = found.withColumns({"new": new, "bytes": added("so_far"), "less": F.when(later, added("cut")).otherwise(0)})
    numbered = numbered.withColumn("passage", F.sum("new").over(Window.partitionBy("k", "th").orderBy("start", "end")))
    return numbered.groupBy("k", "th", "passage").agg(
        F.min("start").alias("start"), F.sum("bytes").alias("bytes"), F.sum("less").alias("removable_bytes"), F.min("first_k").alias("first_k")
    ).drop("passage")


def documents_with_repeats(docs: DataFrame, average: int = AVERAGE, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """One row for each document that holds a repeated passage: doc_id, n_passages, repeated_bytes,
    removable_bytes (of copies whose first document is another), spans (array of start, bytes in UTF-8) and
    first_doc_id (the smallest id that shares one of its runs).

    Documents without a repeated passage have no row; null, empty and blank texts have none. A text of fewer than min_words words
    counts as repeated only where another text is equal to it; passages of fewer words inside longer texts are not found,
    nor are long stretches without blanks in scripts that have them (they are one word). Repeats of a
    row are one document and give one row; rows of one id with unlike texts give one each; a null
    doc_id is an id of its own and is reported as null. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    found = repeated_passages(docs, average, min_words, text_col)
    back = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    rows = found.groupBy("k", "th").agg(
        F.count(F.lit(1)).alias("n_passages"),
        F.sum("bytes").alias("repeated_bytes"),
        F.sum("removable_bytes").alias("removable_bytes"),
        F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("spans"),
        F.min("first_k").alias("first_k"),
    )
    return rows.select(back("k").alias("doc_id"), "n_passages", "repeated_bytes", "removable_bytes", "spans", back("first_k").alias("first_doc_id"))
