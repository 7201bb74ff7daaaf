"""Tagged-text literature exports as record tables.

Parsers take (path, line_no, line) rows and return rec_seq, doc_id, keyword arrays, source_database. Lines of `read_lines` have a
`block` besides: the byte at which Spark split the file. One file is then read by many tasks: a record is
the number of separators before its lines, counted inside each block and, over the few blocks of a file, by a prefix sum. Tags carry
forward inside a record, which an exchange by (file, record) brings together wherever a split cut it. Places of records in their
file, for ids of records without one, are counted in the same two steps. Without `block` a file is one value and one window.

Lines of files of at most WHOLE bytes have `whole` besides: an exchange brings each such file to one task once, and all windows and groups
of its parser then work where the lines are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_heading, split_clean, split_mixed, strip


#: Records whose places are counted together.
RANGE = 4096
#: Bytes of a file that one task may take whole, and files for each task.
WHOLE = 16 << 20
FILES = 16


def lines_of(texts: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, text) rows, without line ends and a byte-order mark."""
    bare = F.regexp_replace("text", "^\ufeff", "")
    return texts.select("path", F.posexplode(F.split(bare, r"\r\n|\n|\r")).alias("line_no", "line"))


def read_lines(spark: SparkSession, path: str | list[str], decode: Callable[[DataFrame], DataFrame] | None = None, whole: bool | None = None, which: Column | None = None) -> DataFrame:
    """(path, block, line_no, line) of files, those of inner folders too, which Spark splits by its maxPartitionBytes; line_no is ordered inside a block.

    `decode` makes text of (path, block, line_no, value) lines of raw bytes; without it, bytes beyond UTF-8 are replaced. A byte-order mark goes. Unlike in `lines_of`, a line end at the end of a file opens no further, empty line.
    `whole` takes only files of at most WHOLE bytes (true) or only larger ones (false); `which` only those whose `_metadata` are so.
    """
    start = F.col("_metadata.file_block_start")
    files = spark.read.option("recursiveFileLookup", "true").text(path)
    if whole is not None:
        size = F.col("_metadata.file_size")  # Spark leaves the other files out when it lists them
        files = files.where(size <= WHOLE if whole else size > WHOLE)
    if which is not None:
        files = files.where(which)
    raw = files.select(F.col("_metadata.file_path").alias("path"), start.alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")
    raw = raw.withColumn("value", F.make_valid_utf8("value")) if decode is None else decode(raw)
    raw = raw.withColumnRenamed("value", "line")
    if whole:
        raw = raw.withColumn("whole", F.lit(True))
    return raw.withColumn("line", F.when(F.col("block") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))


def parsed(spark: SparkSession, path: str | list[str], parse: Callable[[DataFrame], DataFrame], decode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What `parse` makes of the lines of files: small files each in one task, larger ones by their splits."""
    small = parse(read_lines(spark, path, decode, True))
    if read_lines(spark, path, whole=False).select("path").isEmpty():
        return small
    return small.unionByName(parse(read_lines(spark, path, decode, False)))


def placed(lines: DataFrame) -> DataFrame:
    """lines of whole files with all of a file in one task, and their files as the only unit; other lines as they are. Tasks grow in number with the files."""
    if "whole" not in lines.columns:
        return lines
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(lines.inputFiles()) // FILES))
    return lines.drop("whole", "block").repartition(n, "path")


def order_of(lines: DataFrame) -> Column:
    """What orders the lines of one file."""
    return F.struct("block", "line_no") if "block" in lines.columns else F.col("line_no")


def with_counts(lines: DataFrame, **marks: Column) -> DataFrame:
    """lines with, for each mark (a number), its sum over the lines of the file up to and including this one.

    The sum before a block is one over the blocks before it: rows of block sums are as many as splits.
    """
    if "block" not in lines.columns:
        so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return lines.withColumns({n: F.sum(m).over(so_far) for n, m in marks.items()})
    sums = lines.groupBy("path", "block").agg(*(F.sum(m).alias(n) for n, m in marks.items()))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("path").alias("__path"), F.col("block").alias("__block"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in marks))
    inside = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lines.withColumns({n: F.sum(m).over(inside) for n, m in marks.items()})
    joined = counted.join(before, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in marks}).drop("__path", "__block", *(f"__{n}" for n in marks))


def head_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first `most` lines of each file, with their number from 0 in line_no and is_last for the last line of a file."""
    if "block" not in lines.columns:
        last = F.lead("line_no").over(Window.partitionBy("path").orderBy("line_no")).isNull()
        return lines.withColumn("is_last", last).where(F.col("line_no") < most)
    # No line of a file is the last one here: each has a line end after it.
    first = Window.partitionBy("path", "block").orderBy("line_no")
    near = lines.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)  # the first lines of each block
    number = F.row_number().over(Window.partitionBy("path").orderBy("block", "line_no")) - 1
    # Blocks of fewer lines than that hold all of their own, so the first `most` of what is kept are those of the file.
    return near.withColumn("line_no", number).where(F.col("line_no") < most).select("path", "line_no", "line", F.lit(False).alias("is_last"))


def _numbered(records: DataFrame, default: str, split: bool, **more: Column) -> DataFrame:
    """Records (path, rec, doc_id, ...) with ids filled in by their place in the file, and rec_seq unique over files.

    For split files places are counted inside ranges of record numbers, and over the ranges of a file by a prefix sum.
    """
    if not split:
        return _named(records.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("rec"))), default, **more)
    of = F.expr(f"rec div {RANGE}")
    sums = records.groupBy("path", of.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("path").alias("__path"), F.col("range").alias("__range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("path", "range").orderBy("rec"))
    filled = records.withColumn("range", of).withColumn("place", place).join(before, (F.col("path") == F.col("__path")) & (F.col("range") == F.col("__range")))
    return _named(filled.withColumn("place", F.col("place") + F.col("__before")), default, **more)


def _named(records: DataFrame, default: str, **more: Column) -> DataFrame:
    """Records with their place, 1 for a file's first, as ids."""
    doc_id = F.coalesce(F.when(F.col("doc_id") != "", F.col("doc_id")), F.concat(F.lit(default), F.col("place").cast("string")))
    return records.withColumn("doc_id", doc_id).withColumn("rec_seq", F.xxhash64("path", "place")).withColumns(more)


_NONE = "array<string>"


def _in_record(lines: DataFrame) -> Window:
    """The lines of a record up to this one."""
    return Window.partitionBy("path", "rec").orderBy(order_of(lines)).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def parse_wos(lines: DataFrame) -> DataFrame:
    """`UT`, `DE`, `ID` up to each `ER`; a record without ER is lost, DE falls back to ID."""
    line, lines = F.col("line"), placed(lines)
    goes_on = line.startswith("   ")
    own = F.when(~goes_on & (strip(F.substring(line, 1, 2)) != ""), strip(F.substring(line, 1, 2)))
    df = lines.where(line != "").withColumn("own", own).withColumn("val", F.when(goes_on, strip(line)).otherwise(strip(F.substring(line, 4, 1 << 30))))
    df = with_counts(df, rec=F.when(F.col("own") == "ER", 1).otherwise(0))
    # ER is its record's last line, so what continues it belongs to no tag of the next.
    df = df.withColumn("rec", F.col("rec") - F.when(F.col("own") == "ER", 1).otherwise(0))
    df = df.withColumn("tag", F.last("own", ignorenulls=True).over(_in_record(lines)))
    words = split_clean(F.col("val"), ";")
    none = F.array().cast(_NONE)
    per = df.groupBy("path", "rec").agg(
        F.bool_or(F.coalesce(F.col("own") == "ER", F.lit(False))).alias("closed"),
        F.max_by("val", F.when(F.col("tag") == "UT", order_of(lines))).alias("doc_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("tag") == "DE", words).otherwise(none))))).alias("de"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("tag") == "ID", words).otherwise(none))))).alias("id"),
    ).where("closed").drop("closed")
    effective = F.when(F.size("de") > 0, F.col("de")).otherwise(F.col("id"))
    # Each ER closes one record, so a record's place is its number.
    return _named(per.withColumn("place", F.col("rec") + 1), "wos_doc_").select(
        "rec_seq", "doc_id", effective.alias("keywords"), F.col("de").alias("author_keywords_de"), F.col("id").alias("keywords_plus_id"), effective.alias("effective_keywords"),
        ((F.size("de") == 0) & (F.size("id") > 0)).alias("is_de_fallback"), F.array_sort(F.array_union("de", "id")).alias("combined_keywords"), F.lit("Web of Science").alias("source_database"),
    )


def parse_pubmed(lines: DataFrame) -> DataFrame:
    """`PMID`, `OT`, `MH`; a blank line closes a record that has an id or keywords, as the file's end does."""
    line, lines = F.col("line"), placed(lines)
    tagged = (F.length(line) >= 6) & (F.substring(line, 5, 2) == "- ")
    goes_on = ~tagged & line.startswith("      ")
    blank = ~tagged & ~goes_on & (strip(line) == "")
    df = lines.withColumn("own", F.when(tagged, strip(F.substring(line, 1, 4)))).where(tagged | goes_on | blank)
    df = with_counts(df, rec=F.when(blank, 1).otherwise(0)).where(tagged | goes_on)
    # A blank line with nothing before it closes no record; such groups are empty and drop out below.
    df = df.withColumn("tag", F.last("own", ignorenulls=True).over(_in_record(lines))).withColumn("val", F.when(F.col("own").isNotNull(), strip(F.substring(line, 7, 1 << 30))).otherwise(strip(line)))
    word = F.when(F.col("tag") == "OT", F.col("val")).when(F.col("tag") == "MH", clean_heading(F.col("val")))
    per = df.groupBy("path", "rec").agg(F.max_by("val", F.when(F.col("tag") == "PMID", order_of(lines))).alias("pmid"), F.array_sort(F.collect_set(F.when(word != "", word))).alias("keywords"))
    per = per.where((F.coalesce("pmid", F.lit("")) != "") | (F.size("keywords") > 0)).withColumn("doc_id", F.when(F.col("pmid") != "", F.concat(F.lit("PMID:"), "pmid"))).drop("pmid")
    return _plain(_numbered(per, "pm_doc_", "block" in lines.columns), "PubMed")


def _plain(df: DataFrame, database: str) -> DataFrame:
    none = F.array().cast(_NONE)
    return df.select(
        "rec_seq", "doc_id", "keywords", none.alias("author_keywords_de"), none.alias("keywords_plus_id"), none.alias("effective_keywords"), F.lit(False).alias("is_de_fallback"), none.alias("combined_keywords"), F.lit(database).alias("source_database")
    )


def parse_cnki_text(lines: DataFrame) -> DataFrame:
    """A title line starts a record, keyword lines add to it."""
    line, lines = strip(F.col("line")), placed(lines)
    title, words = "【来源篇名】", "【关键词】"
    df = with_counts(lines.withColumn("s", line).where(line.startswith(title) | line.startswith(words)), rec=F.when(F.col("s").startswith(title), 1).otherwise(0))
    value = lambda t: strip(F.replace("s", F.lit(t), F.lit("")))
    per = df.groupBy("path", "rec").agg(
        F.max_by(value(title), F.when(F.col("s").startswith(title), order_of(lines))).alias("doc_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("s").startswith(words), split_mixed(value(words))))))).alias("keywords"),
    )
    return _plain(_numbered(per.where((F.coalesce("doc_id", F.lit("")) != "") | (F.size("keywords") > 0)), "cnki_", "block" in lines.columns), "CNKI")


def parse_cnki_refworks(lines: DataFrame) -> DataFrame:
    """`RT ` starts a record once the one before has an id or keywords; `T1` is the id, `K1` keywords."""
    line, lines = strip(F.col("line")), placed(lines)
    df = with_counts(lines.withColumn("s", line).where(F.col("s").rlike("^(?:RT |T1|K1)")), rec=F.when(F.col("s").startswith("RT "), 1).otherwise(0))
    tag, val = strip(F.substring("s", 1, 2)), strip(F.substring("s", 4, 1 << 30))
    per = df.groupBy("path", "rec").agg(
        F.max_by(val, F.when(tag == "T1", order_of(lines))).alias("doc_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(tag == "K1", split_mixed(val)))))).alias("keywords"),
    )
    return _plain(_numbered(per.where((F.coalesce("doc_id", F.lit("")) != "") | (F.size("keywords") > 0)), "cnki_", "block" in lines.columns), "CNKI")


def parse_cnki(lines: DataFrame) -> DataFrame:
    """S5 for files with one of its marks in the first 30 lines, S6 for the others."""
    marked = F.contains("line", F.lit("【来源篇名】")) | F.contains("line", F.lit("【关键词】"))
    custom = F.broadcast(head_lines(lines, 30).where(marked).select("path").distinct())  # a row a file
    return parse_cnki_text(lines.join(custom, "path", "left_semi")).unionByName(parse_cnki_refworks(lines.join(custom, "path", "left_anti")))


def format_of(has: Callable[[str], Column], starts: Callable[[str], Column], closes: Column, on_first: Callable[[Column], Column], first: Column) -> Column:
    """The format of a file by its first lines: whether they have a text, whether one starts with it, whether one ends in ER; `on_first` says whether its first line is such."""
    low, parts = F.lower(first), F.size(F.split(first, "\t"))
    titles = F.contains(first, F.lit("Author Keywords")) | F.contains(first, F.lit("Index Keywords")) | F.contains(first, F.lit("EID"))
    return (
        F.when(starts("PMID-") | (has("MH  -") & has("TI  -")), "pubmed_medline")
        .when(starts("PT ") | (closes & (has("DE ") | has("ID "))), "wos_plaintext")
        .when(has("【来源篇名】") | has("【关键词】"), "cnki_text")
        .when(has("RT Journal") | has("RT Book") | (has("K1 ") & has("A1 ")), "cnki_refworks")
        .when(on_first(titles), "scopus_csv")
        .when(on_first(parts.isin(2, 3) & (F.contains(low, F.lit("occurrences")) | F.contains(low, F.lit("label")))), "vos_tsv")
        .otherwise("unknown")
    )


def detect_formats(lines: DataFrame) -> DataFrame:
    """(path, format) from the first 60 lines of each file; files without text are unknown."""
    line = F.col("line")
    has = lambda t: F.bool_or(F.contains(line, F.lit(t)))
    starts = lambda t: F.bool_or(line.startswith(t))
    kind = format_of(has, starts, F.bool_or(line.endswith("ER") & ~F.col("is_last")), lambda c: F.bool_or((F.col("line_no") == 0) & c), line)
    return head_lines(lines, 60).groupBy("path").agg(kind.alias("format"))
