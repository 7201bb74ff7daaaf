"""Small exports, each read as one value: a file's format, its records and their numbers are found where the file is read.

Nothing is exchanged and every file is read once for its format and once for its records. A file is cut into records by a pattern,
and a record's lines are found by patterns again; the rules are those of the parsers of lines in `tagged` and `tables`, which
read what is larger. Parts of a pattern that repeat are possessive, so that long records take no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from . import tagged
from .tagged import format_of

#: Names of files that Spark unpacks; their text is larger than they are, PACKED times at a guess.
PACKED_NAMES = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
PACKED = 16
#: White space but line feeds, as `strip` takes it, and what is neither.
_SPACES = r"\t\x0B-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_W, _N = f"[{_SPACES}]", rf"[^\n{_SPACES}]"
#: What parts keywords as split_mixed has it.
_MIXED = r";；\n\r"
_REST = 1 << 30
_NONE = "array<string>"


def is_small() -> Column:
    """Of a scan's files: those that a task may hold as one value."""
    packed = F.col("_metadata.file_name").rlike(PACKED_NAMES)
    return F.col("_metadata.file_size") <= F.when(packed, tagged.WHOLE // PACKED).otherwise(tagged.WHOLE)


def small_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, utf8, text, format) of small files, those of inner folders too. Line ends are line feeds, and a byte-order mark goes."""
    value = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).where(is_small())
    files = value.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("utf8"), F.make_valid_utf8("value").alias("text"))
    bare = F.when(F.startswith("text", F.lit("\ufeff")), F.substring("text", 2, _REST)).otherwise(F.col("text"))
    files = files.withColumn("text", bare)
    ends = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    files = files.withColumn("text", F.when(F.contains("text", F.lit("\r")), ends).otherwise(F.col("text")))
    files = files.withColumn("head", F.substring_index("text", "\n", 60))
    return files.select("path", "utf8", "text", _format(F.col("head")).alias("format"))


def _format(head: Column) -> Column:
    """S1 of the first 60 lines of a file; like lines that are read from files, none of them counts as its last."""
    return format_of(
        lambda t: F.contains(head, F.lit(t)), lambda t: head.startswith(t) | F.contains(head, F.lit("\n" + t)), F.contains(head, F.lit("ER\n")) | head.endswith("ER"), lambda c: c, F.substring_index(head, "\n", 1)
    )


def _entry(doc_id: Column, first: Column, second: Column | None = None) -> Column:
    return F.struct(doc_id.cast("string").alias("doc_id"), first.alias("first"), (F.array().cast(_NONE) if second is None else second).alias("second"))


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _words(c: Column, ends: str) -> Column:
    """What stands between `ends`, stripped, without empty ones: as split_clean has it, in one pass."""
    edge = rf"[^\n{ends}{_SPACES}]"
    return _found(c, f"{edge}(?:[^{ends}]*{edge})?")


def _last(c: Column) -> Column:
    return F.get(c, F.size(c) - 1)


def _after(c: Column, n: int) -> Column:
    """The last line of a text from its n-th character on."""
    return strip(F.substring(F.substring_index(c, "\n", -1), n, _REST))


def _with_some(entries: Column) -> Column:
    return F.filter(entries, lambda e: (F.coalesce(e["doc_id"], F.lit("")) != "") | (F.size(e["first"]) > 0))


def _sorted(words: Column) -> Column:
    return F.sort_array(F.array_distinct(words))


def _wos(text: Column) -> Column:
    """Each ER closes a record; a tag holds for the lines after it that begin with two blanks."""
    parts = F.split(text, r"(?dm)^ER.*\n?")
    block = lambda t: rf"(?dm)^{t}.*(?:\n++(?:{_W}{_W}.*|{_W}$))*+"
    words = lambda r, t: _sorted(_words(F.regexp_replace(F.array_join(_found(r, block(t)), "\n"), r"(?d)(?:^|\n+).{0,3}", ";"), ";"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda r: _entry(_after(_last(_found(r, block("UT"))), 4), words(r, "DE"), words(r, "ID")))


def _pubmed(text: Column) -> Column:
    """Blank lines part records; a tag holds for the lines after it that begin with six blanks, up to the next."""
    parts = F.split(F.concat(F.lit("\n"), text), rf"(?:\n(?! {{6}}){_W}*+(?=\n|\z))++")
    block = lambda t: rf"(?d)\n(?:{t})- .*(?:\n(?!.{{4}}- ).*)*+"
    two = lambda t: f"{t}{_W}{_W}|{_W}{t}{_W}|{_W}{_W}{t}"
    lines = lambda r, t: F.regexp_replace(F.array_join(_found(r, block(two(t))), ""), r"(?d)\n(?:.{4}- | {6})(.*)|\n.*", "\n$1")

    def entry(r: Column) -> Column:
        number = F.regexp_replace(_last(_found(r, block("PMID"))), r"(?d)\n(?!.{4}- | {6}).*", "")
        pmid = _after(number, 7)
        # As clean_heading has it: a slash that only blanks follow stays.
        headings = F.regexp_replace(F.replace(lines(r, "MH"), F.lit("*"), F.lit("")), rf"/(?!{_W}*+(?:\n|\z))[^,;\n]+", "")
        return _entry(F.when(pmid != "", F.concat(F.lit("PMID:"), pmid)), _sorted(F.concat(_words(lines(r, "OT"), r"\n"), _words(headings, r"\n"))))

    return _with_some(F.transform(parts, entry))


def _cnki_text(text: Column) -> Column:
    """A title line opens a record."""
    title, words = "【来源篇名】", "【关键词】"
    bare = lambda c, t: F.replace(c, F.lit(t), F.lit(""))
    lines = lambda r: F.array_join(_found(r, rf"(?dm)^{_W}*+({words}.*)$", 1), "\n")
    return _with_some(F.transform(F.split(text, rf"\n(?={_W}*+{title})"), lambda r: _entry(strip(bare(F.regexp_extract(r, rf"(?d)^{_W}*+({title}.*)", 1), title)), _sorted(_words(bare(lines(r), words), _MIXED)))))


def _cnki_refworks(text: Column) -> Column:
    """A line of RT and a word opens a record."""
    lines = lambda r, t: _found(r, rf"(?dm)^{_W}*+{t}.?(.*)$", 1)
    parts = F.split(text, rf"\n(?={_W}*+RT {_W}*+{_N})")
    return _with_some(F.transform(parts, lambda r: _entry(strip(_last(lines(r, "T1"))), _sorted(_words(F.array_join(lines(r, "K1"), "\n"), _MIXED)))))


def _cnki(text: Column) -> Column:
    head = F.substring_index(text, "\n", 30)
    return F.when(F.contains(head, F.lit("【来源篇名】")) | F.contains(head, F.lit("【关键词】")), _cnki_text(text)).otherwise(_cnki_refworks(text))


def _scopus(text: Column, width: int) -> Column:
    """A row goes on while its quotes are odd in number; its cells are those of from_csv, under its file's own titles."""
    fields = [f"c{i}" for i in range(width)]
    cells = lambda c: F.transform(F.array(F.from_csv(c, ", ".join(f"{f} string" for f in fields), {"quote": '"', "escape": '"'})), lambda x: F.array(*(x[f] for f in fields)))
    rows = _found(text, r'(?:[^"\n]++|"[^"]*+(?:"|\z))++')
    names = ("EID", "DOI", "Author Keywords", "Index Keywords")
    places = F.transform(cells(F.substring_index(text, "\n", 1)), lambda titles: F.array(*(F.array_position(titles, name).cast("int") for name in names)))

    def entry(found: Column, places: Column) -> Column:
        at = lambda i: F.coalesce(F.get(found, F.get(places, F.lit(i)) - 1), F.lit(""))
        some = lambda c: F.when(c != "", c)
        return _entry(F.coalesce(some(strip(at(0))), some(strip(at(1)))), _sorted(F.concat(_words(at(2), ";"), _words(at(3), ";"))))

    made = lambda p: F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.get(F.transform(cells(r), lambda found: entry(found, p)), F.lit(0)))
    return F.get(F.transform(places, made), F.lit(0))


def _vos(text: Column) -> Column:
    first = lambda x: F.substring_index(x, "\t", 1)
    rows = F.filter(F.split(text, "\n"), lambda x, i: (strip(x) != "") & ~((i == 0) & F.lower(first(x)).rlike("term|label")))
    return F.transform(rows, lambda x: _entry(F.lit(None), F.array(strip(first(x)))))


def is_other() -> Column:
    """Of small files: those of CNKI in other charsets than UTF-8."""
    return F.col("format").isin("cnki_text", "cnki_refworks") & ~F.col("utf8")


def records_of(files: DataFrame, width: int) -> DataFrame:
    """S2 to S10 of small_files: the records of all that is_other does not name; width is the most cells of a first line of a CSV file."""
    kind = F.when(F.col("format").isin("cnki_text", "cnki_refworks"), "CNKI").when(F.col("format") == "pubmed_medline", "PubMed").when(F.col("format") == "scopus_csv", "Scopus").when(F.col("format") == "vos_tsv", "VOSviewer").otherwise("Web of Science")
    text, of = F.col("text"), F.col("source_database")
    entries = F.when(of == "CNKI", _cnki(text)).when(of == "PubMed", _pubmed(text)).when(of == "Scopus", _scopus(text, width)).when(of == "VOSviewer", _vos(text)).otherwise(_wos(text))
    # Not a filter, which Spark would move below the columns that it uses and so have them made twice.
    entries = F.when(is_other(), F.array().cast("array<struct<doc_id: string, first: array<string>, second: array<string>>>")).otherwise(entries)
    found = files.withColumn("source_database", kind).select("path", "source_database", F.posexplode(entries).alias("n", "e"))
    found = found.select("path", "source_database", (F.col("n") + 1).cast("long").alias("place"), "e.*")
    default = F.when(of == "CNKI", "cnki_").when(of == "PubMed", "pm_doc_").when(of == "Scopus", "scopus_").when(of == "VOSviewer", "vos_term_").otherwise("wos_doc_")
    none, wos = F.array().cast(_NONE), of == "Web of Science"
    words = F.when(wos & (F.size("first") == 0), F.col("second")).otherwise(F.col("first"))
    only = lambda c: F.when(wos, c).otherwise(none)
    return found.select(
        F.xxhash64("path", "place").alias("rec_seq"), F.coalesce(F.when(F.col("doc_id") != "", F.col("doc_id")), F.concat(default, F.col("place").cast("string"))).alias("doc_id"), words.alias("keywords"),
        only(F.col("first")).alias("author_keywords_de"), only(F.col("second")).alias("keywords_plus_id"), only(words).alias("effective_keywords"), (wos & (F.size("first") == 0) & (F.size("second") > 0)).alias("is_de_fallback"),
        only(F.sort_array(F.array_union("first", "second"))).alias("combined_keywords"), of,
    )
