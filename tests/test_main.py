"""From files to files."""

from lexiweave.__main__ import harmonise, main
from lexiweave.operators import audit, keywords
from lexiweave.sources import tables

WOS = "PT J\nDE renal tumor; renal tumors\nUT W:1\nER\n\nPT J\nDE renal tumor\nUT W:2\nER\n\n"


def test_records_to_files(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.txt").write_text(WOS)
    (tmp_path / "in" / "p.txt").write_text("PMID- 1\nOT  - renal tumors\nOT  - rare word\n")
    rules, counters = harmonise(spark, str(tmp_path / "in"), tmp_path / "out")
    assert counters == {"documents": 3, "unique_keywords": 3, "candidate_terms": 2}
    assert {r.raw_term: r.target_term for r in rules.collect()} == {"renal tumor": "renal tumor", "renal tumors": "renal tumor"}
    assert (tmp_path / "out" / "thesaurus_vosviewer.txt").read_text() == "label\treplace by\nrenal tumors\trenal tumor\n"
    assert (tmp_path / "out" / "thesaurus_citespace.txt").read_text() == "renal tumors\trenal tumor\n"
    table = (tmp_path / "out" / "audit_table.csv").read_text(encoding="utf-8-sig").splitlines()
    edges = keywords.effective_edges(tables.read_records(spark, str(tmp_path / "in")))
    assert len(table) == 3 and {(r.raw_sum, r.doc_count) for r in audit.audit_rows(rules, edges).collect()} == {(4, 3)} and all(",4,3,1," in x for x in table[1:])
    main([str(tmp_path / "in"), "--out", str(tmp_path / "c"), "--clusters"])
    assert "documents: 3" in capsys.readouterr().out and "renal tumors\trenal tumor" in (tmp_path / "c" / "thesaurus_vosviewer.txt").read_text()


def test_term_file_keeps_its_counts(spark, tmp_path):
    (tmp_path / "v.txt").write_text("label\toccurrences\nrenal tumor\t9\nrenal tumors\t4\nlone\t1\n")
    rules, _ = harmonise(spark, str(tmp_path / "v.txt"), tmp_path / "out")
    assert {r.raw_term: r.raw_frequency for r in rules.collect()} == {"renal tumor": 9, "renal tumors": 4}


def test_no_records(spark, tmp_path):
    (tmp_path / "e.txt").write_text("")
    rules, counters = harmonise(spark, str(tmp_path / "e.txt"), tmp_path / "out")
    assert rules.count() == 0 and counters["documents"] == 0 and (tmp_path / "out" / "thesaurus_vosviewer.txt").read_text() == "label\treplace by\n"
