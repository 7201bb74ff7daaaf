"""Thesaurus, audit, vocabulary and draft files.

Rows are sorted and formatted by Spark and written as parts by its tasks, whose output counts only once a task has
committed. The parts are joined in order by calls to the file system, under another name, and the whole file gets its own
name in one step: a failed task leaves no file, and an older one stays. No rows reach the driver but for the workbook form. On a cluster
the path is one that all executors share.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import AUDIT_COLUMNS
from ..operators.audit import audit_rows, exportable

BOM = "\ufeff"


def _file_system(spark: SparkSession, path: str):
    """The file system of a path; the local one without its checksum files."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return found.getRawFileSystem() if found.getClass().getSimpleName() == "LocalFileSystem" else found


def write_joined(lines: DataFrame, path: str | Path, head: str = "", tail: str = "", line_end: str = "\n") -> Path | str:
    """One file of head, the rows of `lines` (one column of text, in order) each with line_end, and tail."""
    spark, name = lines.sparkSession, str(path)
    jvm = spark.sparkContext._jvm
    at, parts, whole = jvm.org.apache.hadoop.fs.Path, f"{name}.{uuid.uuid4().hex}.parts", f"{name}.{uuid.uuid4().hex}.part"
    fs = _file_system(spark, name)
    try:
        lines.write.option("lineSep", line_end).text(parts)
        files = [f.getPath() for f in fs.listStatus(at(parts)) if f.getPath().getName().startswith("part-")]
        out = fs.create(at(whole), True)
        try:
            out.write(bytearray(head.encode()))
            for f in sorted(files, key=lambda f: int(re.match(r"part-(\d+)", f.getName())[1])):
                source = fs.open(f)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
        fs.delete(at(name), False)
        if not fs.rename(at(whole), at(name)):
            raise OSError(f"could not name {whole} {name}")
    finally:
        fs.delete(at(parts), True)
        fs.delete(at(whole), False)
    return path if "://" in name else Path(path)


def csv_line(cells: Iterable[Column], separator: str) -> Column:
    """Cells between separators, quoted where they hold one, a quote or a line end; null is empty."""
    cell = lambda c: F.coalesce(F.when(c.rlike(f'[{separator}"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))
    return F.concat_ws(separator, *(cell(c.cast("string")) for c in cells))


def _pairs(rules: DataFrame, include_unselected: bool) -> DataFrame:
    return exportable(rules, include_unselected).select("raw_term", "target_term").orderBy("target_term", "raw_term")


def write_vosviewer(rules: DataFrame, path: str | Path, include_unselected: bool = False) -> Path | str:
    """K1."""
    return write_joined(_pairs(rules, include_unselected).select(F.concat_ws("\t", "raw_term", "target_term")), path, "label\treplace by\n")


def write_citespace(rules: DataFrame, path: str | Path, include_unselected: bool = False) -> Path | str:
    """K2."""
    return write_joined(_pairs(rules, include_unselected).select(F.concat_ws("\t", "raw_term", "target_term")), path)


def write_bibliometrix(rules: DataFrame, path: str | Path, include_unselected: bool = False) -> Path | str:
    """K3."""
    pairs = _pairs(rules, include_unselected)
    return write_joined(pairs.select(csv_line(map(F.col, pairs.columns), ";")), path, BOM + "old_term;new_term\r\n", line_end="\r\n")


def write_audit(rules: DataFrame, path: str | Path, doc_kw: DataFrame | None = None) -> Path | str:
    """K4, K5: the audit table as CSV with a byte-order mark, or as a workbook where path ends in .xlsx and one can be written."""
    table = audit_rows(rules, doc_kw).orderBy("target_term", "raw_term")
    if str(path).endswith(".xlsx"):
        try:
            return _write_workbook(map(tuple, table.toLocalIterator()), Path(path))
        except Exception as problem:  # whatever keeps the workbook from being written, the table is not lost
            warnings.warn(f"no workbook ({problem}); the audit table is written as CSV", stacklevel=2)
            path = str(path).removesuffix(".xlsx") + ".csv"
    return write_joined(table.select(csv_line(map(F.col, table.columns), ",")), path, BOM + ",".join(AUDIT_COLUMNS) + "\r\n", line_end="\r\n")


def _write_workbook(rows: Iterable[tuple], path: Path) -> Path:
    import openpyxl
    from openpyxl.styles import Font

    book = openpyxl.Workbook(write_only=True)
    sheet = book.create_sheet("Table S1 Harmonization Audit")
    for n, title in enumerate(AUDIT_COLUMNS):
        sheet.column_dimensions[openpyxl.utils.get_column_letter(n + 1)].width = max(14, len(title) + 2)
    sheet.freeze_panes = "A2"
    heads = [openpyxl.cell.WriteOnlyCell(sheet, value=title) for title in AUDIT_COLUMNS]
    for head in heads:
        head.font = Font(bold=True)
    sheet.append(heads)
    for row in rows:
        sheet.append(row)
    note = book.create_sheet("Methodological Statement")
    note.append(["Raw Occurrence Sum counts every mention of a keyword; Independent Document Count counts each record once."])
    book.save(path)
    return path


def _write_map(rows: DataFrame, key: str, path: str | Path) -> Path | str:
    """A JSON object of objects, indented by two, in order of key, which is unique; fields that are null are left out."""
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    fields = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'    "{c}": '), text(F.col(c)))) for c in rows.columns if c != key)))
    value = F.when(F.size(fields) > 0, F.concat(F.lit("{\n"), F.array_join(fields, ",\n"), F.lit("\n  }"))).otherwise("{}")
    last = rows.agg(F.max(key).alias("__last"))  # one row
    entries = rows.join(F.broadcast(last)).orderBy(key).select(F.concat(F.lit("  "), text(F.col(key)), F.lit(": "), value, F.when(F.col(key) == F.col("__last"), "").otherwise(",")))
    some = not rows.isEmpty()
    return write_joined(entries, path, "{\n" if some else "{", "}")


def write_vocabulary(vocabulary: DataFrame, path: str | Path) -> Path | str:
    """K6: pretty JSON by term."""
    return _write_map(vocabulary, "term", path)


def write_draft(overrides: DataFrame, path: str | Path) -> Path | str:
    """K7: the overrides as JSON by term, replaced in one step."""
    return _write_map(overrides.select("raw_term", "selected", "target"), "raw_term", path)


def read_draft(spark: SparkSession, path: str | Path) -> DataFrame:
    """The overrides of a draft file; none where it does not exist."""
    found = _file_system(spark, str(path)).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path)))
    if not found:
        return spark.createDataFrame([], "raw_term string, selected boolean, target string")
    entries = F.from_json("value", "map<string, struct<selected: boolean, target: string>>")
    return spark.read.text(str(path), wholetext=True).select(F.explode(entries).alias("raw_term", "v")).select("raw_term", "v.selected", "v.target")
