"""Delimited and structured sources: Scopus CSV, VOSviewer terms, vocabulary XML, JSON and word lists."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_clean, strip
from . import whole
from .charsets import decoded
from .tagged import _plain, detect_formats, head_lines, parse_cnki, parse_pubmed, parse_wos, parsed, placed, read_lines, with_counts

#: Schema of a descriptor record; inference would make single children structs.
DESCRIPTOR = (
    "DescriptorUI string, DescriptorName struct<String: string>, ConceptList struct<Concept: array<struct<ConceptUI: string, ConceptName: struct<String: string>,"
    " TermList: struct<Term: array<struct<String: string>>>>>>"
)


def read_decoded(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, line_no, line) of files, each in the first charset that decodes it whole; files are split."""
    return read_lines(spark, path, decoded)


def csv_rows(lines: DataFrame) -> DataFrame:
    """(path, rec, row): the rows of quoted CSV text, also ones with line ends in their cells, numbered from 1 in their file; empty lines are none.

    A line opens a row where the quotes before it in the file are even in number. Each block of a split file counts, for both
    parities that its start may have, the rows that would open in it; two prefix sums over the blocks of a file, of quotes and then of
    rows, say which holds. A lone quote inside a cell without quotes upsets what follows in its file.
    """
    lines = placed(lines)
    line, quotes = F.col("line"), F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    split = [c for c in ("block",) if c in lines.columns]
    inside = Window.partitionBy("path", *split).orderBy("line_no")
    earlier_lines, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = lines.withColumn("quotes", quotes).withColumn("odd", F.coalesce(F.sum("quotes").over(earlier_lines), F.lit(0)) % 2)
    if not split:
        df = df.withColumn("rec", F.sum(F.when((F.col("odd") == 0) & (line != ""), 1).otherwise(0)).over(so_far)).where((line != "") | (F.col("odd") == 1))
        return _rows(df, F.struct("line_no", "line"))
    sums = df.groupBy("path", "block").agg(F.sum("quotes").alias("q"), F.count_if((line != "") & (F.col("odd") == 0)).alias("if_even"), F.count_if((line != "") & (F.col("odd") == 1)).alias("if_odd"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("carry", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2).withColumn("opened", F.when(F.col("carry") == 0, F.col("if_even")).otherwise(F.col("if_odd")))
    sums = sums.select(F.col("path").alias("__path"), F.col("block").alias("__block"), "carry", F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("before"))
    df = df.join(sums, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    outside = F.col("odd") == F.col("carry")
    df = df.withColumn("rec", F.col("before") + F.sum(F.when(outside & (line != ""), 1).otherwise(0)).over(so_far)).where((line != "") | ~outside)
    return _rows(df, F.struct("block", "line_no", "line"))


def _rows(df: DataFrame, place) -> DataFrame:
    """(path, rec, row) of lines with the number of their row, in the order of their place."""
    return df.groupBy("path", "rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["line"]), "\n").alias("row"))


def csv_cells(lines: DataFrame, names: list[str]) -> DataFrame:
    """(path, n, names...): cells of the named columns by each file's own header, '' where a file or row lacks one; n counts a file's rows from 1."""
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    heads = head_lines(lines, 1)
    width = (heads.agg(F.max(commas).alias("n")).first()["n"] or 0) + 1
    fields = [f"c{i}" for i in range(width)]
    cells = lambda c: F.from_csv(c, ", ".join(f"{f} string" for f in fields), {"quote": '"', "escape": '"'})
    many = lambda c: F.array(*(c[f] for f in fields))
    titles = many(cells(F.col("line")))
    # A row a file, as the driver's own list of files has.
    places = F.broadcast(heads.select(F.col("path").alias("__path"), *(F.array_position(titles, c).cast("int").alias(f"p{i}") for i, c in enumerate(names))))
    rows = csv_rows(lines).where("rec > 1").join(places, F.col("path") == F.col("__path")).withColumn("cells", many(cells(F.col("row"))))
    at = lambda i: F.coalesce(F.get("cells", F.col(f"p{i}") - 1), F.lit(""))
    return rows.select("path", (F.col("rec") - 1).alias("n"), *(strip(at(i)).alias(c) for i, c in enumerate(names)))


def read_scopus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The id is EID, else DOI, else a number; keywords are those of authors and index. Files are split; each has its own header."""
    names = {"EID": "eid", "DOI": "doi", "Author Keywords": "a", "Index Keywords": "i"}
    return parsed(spark, path, lambda lines: scopus_records(csv_cells(lines, list(names)).withColumnsRenamed(names)))


def read_cnki(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files in any of the charsets."""
    return parsed(spark, path, parse_cnki, decoded)


def scopus_records(rows: DataFrame) -> DataFrame:
    """S8 of (path, n, eid, doi, a, i) rows, n being their number in the file; rows with rec, their order, get it. Empty or null cells fall through."""
    n = F.col("n") if "n" in rows.columns else F.row_number().over(Window.partitionBy("path").orderBy("rec"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    words = F.array_sort(F.array_distinct(F.array_union(*(split_clean(F.coalesce(c, F.lit("")), ";") for c in ("a", "i")))))
    found = rows.withColumn("n", n).select(
        F.xxhash64("path", "n").alias("rec_seq"), F.coalesce(some("eid"), some("doi"), F.concat(F.lit("scopus_"), F.col("n").cast("string"))).alias("doc_id"), words.alias("keywords")
    )
    return _plain(found, "Scopus")


def vos_terms(lines: DataFrame) -> DataFrame:
    """(path, line_no, term, occurrences, total_link_strength) and block, if lines have it; a third column that is no number is an error."""
    cells = F.split("line", "\t")
    if "block" in lines.columns:
        # The first line of a file has the smallest number of its first block.
        first = head_lines(lines, 1).where(F.lower(F.get(cells, F.lit(0))).rlike("term|label")).select(F.col("path").alias("__path"), F.col("line").alias("__line"))
        lines = placed(lines)
        numbered = with_counts(lines, n=F.lit(1)).join(F.broadcast(first), (F.col("path") == F.col("__path")) & (F.col("n") == 1), "left")  # a row a file
        rows = numbered.where((strip(F.col("line")) != "") & F.col("__path").isNull())
    else:
        rows = lines.where((strip(F.col("line")) != "") & ~((F.col("line_no") == 0) & F.lower(F.get(cells, F.lit(0))).rlike("term|label")))
    cell = lambda i: strip(F.get(cells, F.lit(i)))
    of = [c for c in ("path", "block", "line_no") if c in lines.columns]
    return rows.select(
        *of, cell(0).alias("term"),
        F.when(cell(1).rlike(r"^\d+$"), cell(1)).otherwise("1").cast("long").alias("occurrences"),
        F.coalesce(F.when(F.size(cells) > 2, cell(2)).cast("double"), F.lit(0.0)).alias("total_link_strength"),
    )


def vos_records(lines: DataFrame) -> DataFrame:
    """A record of one keyword for each term."""
    rows = with_counts(vos_terms(lines), n=F.lit(1))
    return _plain(rows.select(F.xxhash64("path", "n").alias("rec_seq"), F.concat(F.lit("vos_term_"), F.col("n").cast("string")).alias("doc_id"), F.array("term").alias("keywords")), "VOSviewer")


def vos_frequencies(lines: DataFrame) -> DataFrame:
    """(term, freq), the last line of a term standing for it."""
    return vos_terms(lines).groupBy(F.lower("term").alias("term")).agg(F.max_by("occurrences", F.struct(*(c for c in ("path", "block", "line_no") if c in lines.columns))).alias("freq"))


def read_vocabulary_xml(spark: SparkSession, path: str) -> DataFrame:
    """(term, descriptor_id, concept_id, canonical_name, concept_name) of descriptor records.

    Of entries for one term the last of the file stands; a descriptor's own name is an entry only where
    no other gives it. Files ending in .gz are read as such but not split.
    """
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())  # the order of records, however files are split
    return vocabulary_entries(raw.withColumn("rec", place))


def vocabulary_entries(raw: DataFrame) -> DataFrame:
    """S12 of parsed descriptor records (DESCRIPTOR's columns) with rec, their order."""
    df = raw.select("rec", F.col("DescriptorUI").alias("d"), F.col("DescriptorName.String").alias("name"), F.posexplode_outer("ConceptList.Concept").alias("c", "concept"))
    df = df.where(F.col("d").isNotNull() & F.col("name").isNotNull())
    terms = df.select("rec", "d", "name", "c", "concept", F.posexplode("concept.TermList.Term").alias("t", "term")).where(F.col("term.String").isNotNull())
    last = F.struct("rec", "c", "t")
    value = F.struct(F.col("d").alias("descriptor_id"), F.coalesce("concept.ConceptUI", "d").alias("concept_id"), F.col("name").alias("canonical_name"), F.coalesce("concept.ConceptName.String", "name").alias("concept_name"))
    entries = terms.groupBy(F.lower(strip(F.col("term.String"))).alias("term")).agg(F.max_by(value, last).alias("v")).select("term", "v.*")
    own = df.groupBy(F.lower(strip(F.col("name"))).alias("term")).agg(F.min_by(F.struct("d", "name"), "rec").alias("v"))
    own = own.join(entries, "term", "left_anti").select("term", F.col("v.d").alias("descriptor_id"), F.col("v.d").alias("concept_id"), F.col("v.name").alias("canonical_name"), F.lit(None).cast("string").alias("concept_name"))
    return entries.unionByName(own)


def read_vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """A {term: {descriptor_id, concept_id, canonical_name}} file as rows."""
    text = spark.read.text(path, wholetext=True)
    entry = "struct<descriptor_id: string, concept_id: string, canonical_name: string, concept_name: string>"
    return text.select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("term", "v")).select("term", "v.*")


def read_roots_json(spark: SparkSession, path: str) -> DataFrame:
    """(root, category, meaning, examples)."""
    text = spark.read.text(path, wholetext=True)
    entry = "struct<category: string, meaning: string, examples: array<string>>"
    return text.select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("root", "v")).select("root", "v.*")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word), folded, without blank lines and # comments."""
    word = F.lower(strip(F.col("value")))
    return spark.read.text(path).select(word.alias("word")).where((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of files of any formats, each file by what it holds; what is unknown is read as Web of Science.

    Small files are values of one scan, which exchanges nothing. Larger files are split; these, and small ones of CNKI in other charsets than
    UTF-8, are read by format: a row a file with format and path reaches the driver, which lists the files anyway. Empty files have no records.
    """
    files = whole.small_files(spark, path)
    width = F.max(F.when(F.col("format") == "scopus_csv", F.regexp_count(F.substring_index("text", "\n", 1), F.lit(",")) + 1))
    small = files.agg(F.count(F.lit(1)).alias("n"), width.alias("width"), F.collect_list(F.when(whole.is_other(), F.col("path"))).alias("others")).first()
    kinds = {"cnki_text": [unquote(p) for p in small["others"]]} if small["others"] else {}
    for r in detect_formats(read_lines(spark, path, which=~whole.is_small())).collect():
        kinds.setdefault({"cnki_refworks": "cnki_text"}.get(r["format"], r["format"]), []).append(unquote(r["path"]))  # Spark names files by encoded paths
    found = [whole.records_of(files, small["width"] or 1)] if small["n"] else []
    for kind, paths in sorted(kinds.items()):
        if kind == "scopus_csv":
            found.append(read_scopus(spark, paths))
        elif kind == "cnki_text":
            found.append(read_cnki(spark, paths))
        else:
            parse = {"pubmed_medline": parse_pubmed, "vos_tsv": vos_records}.get(kind, parse_wos)
            found.append(parsed(spark, paths, parse))
    return reduce(DataFrame.unionByName, found) if found else parse_wos(read_lines(spark, path))
