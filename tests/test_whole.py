"""Small files are read as values: the same records as by lines, and no exchange."""

import random

import pytest
from pyspark.sql import functions as F

from lexiweave.functions.text import strip
from lexiweave.sources import tables, tagged

#: Pieces of exports, odd ones among them.
PIECES = {
    "wos": ["PT J\n", "DE a; b ;;a\n", "   c/d; \n", "  x\n", "　　 y;z\n", "\n", " \n", "ID e;f\n", "DE\n", "UT W{}\n", "UT  \n", "ER\n", "ERx\n", "ER", "TI t\r\n", "D q\n", "\t\n"],
    "pubmed": ["PMID- {}\n", "PMID- \n", "OT  - o{}\n", " OT - p \n", "MH  - *M/x, y/z\n", "MH  - a/ \n", "MH  - *\n", "      goes on / \n", "       \n", "dropped\n", "\n", "  \n", "\r\n", "    - none\n", "OT  -\n", "OT- - u\n", "TI  - t\n", "OT  - q"],
    "cnki": ["【来源篇名】题{}\n", "  【来源篇名】\n", "【关键词】一；；二;三\n", "　【关键词】【关键词】 四 ；\n", "其他\n", "\n", "x【关键词】no\n", "【来源篇名】a【来源篇名】b\n"],
    "refworks": ["RT Journal\n", "RT \n", "RT\n", "  RT x\n", "T1 t{}\n", "T1\n", "T1x y\n", "K1 a; b；c\n", " K1\tz;\n", "K1\n", "A1 n\n", "\n", " K1 ；e \r\n"],
    "scopus": ['"t ""q"",\n\n{}",', "E{},", ",", "10.1/{},", '"a; b;;a ; "', '"x\ny; z"', "k", "\n", "\n", "\n", '"'],
    "vos": ["t{}\t3\t1\n", " u \t\n", "\n", " \t \n", "label\t2\n", "v\r\n", "\tw\n"],
}
HEADS = {"wos": "PT J\n", "pubmed": "PMID- 1\n", "cnki": "【关键词】零\n", "refworks": "RT Journal\n", "scopus": "Title,EID,DOI,Author Keywords,Index Keywords\n", "vos": "label\toccurrences\n"}


@pytest.mark.parametrize("kind", PIECES)
def test_odd_files_are_read_as_by_lines(spark, tmp_path, monkeypatch, kind):
    rng = random.Random(kind)
    for i in range(12):
        text = HEADS[kind] + "".join(rng.choice(PIECES[kind]).format(rng.randrange(99)) for _ in range(150))
        (tmp_path / f"{kind} {i}.txt").write_bytes((("﻿" if i == 1 else "") + text).encode() + (b"\xff\xe3\x80\n" if i == 2 and kind not in ("cnki", "refworks") else b""))
    cols = ["rec_seq", "source_database", "doc_id", "keywords", "author_keywords_de", "keywords_plus_id", "effective_keywords", "is_de_fallback", "combined_keywords"]
    read = lambda: sorted(map(tuple, tables.read_records(spark, str(tmp_path)).select(*cols).collect()), key=str)
    small = read()
    monkeypatch.setattr(tagged, "WHOLE", 0)
    assert len(small) > 50 and small == read()


def test_small_files_need_no_exchange(spark, tmp_path):
    for kind, pieces in PIECES.items():
        (tmp_path / f"{kind}.txt").write_text(HEADS[kind] + pieces[0].format(1))
    plan = tables.read_records(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan text") == 1 and "Repartition" not in plan and "Window" not in plan and "Join" not in plan


def test_a_long_record_takes_no_stack(spark, tmp_path):
    n = 30000
    (tmp_path / "w.txt").write_text("PT J\nDE a\n" + "".join(f"   k{i};\n" for i in range(n)) + "ER\n")
    (tmp_path / "p.txt").write_text("PMID- 1\nOT  - a\n" + "".join(f"      k{i}\n" for i in range(n)))
    (tmp_path / "s.csv").write_text("Title,EID,Author Keywords\n" + '"x' + ' ""y""\n' * n + f'",E1,"{"; ".join(f"k{i}" for i in range(n))}; a"\n')
    got = {r.source_database: len(r.keywords) for r in tables.read_records(spark, str(tmp_path)).collect()}
    assert got == {"Web of Science": n + 1, "PubMed": n + 1, "Scopus": n + 1}


def test_strip_takes_all_white_space(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    padded = chars.select("c", F.concat("c", F.lit("x y"), "c").alias("t"))
    assert padded.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
