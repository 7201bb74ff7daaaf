"""What one task holds does not grow with the input."""

from lexiweave.operators import audit, clusters
from lexiweave.plans import corpus
from lexiweave.sources import tables, tagged

DATA = "/root/testdata/sf0.001"
REC = "PT J\nDE a{0}; b\n   c\nUT WOS:{0}\nER\n\n"


def test_tasks_grow_with_the_line_items(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PER_TASK", 300)
    assert corpus.record_bodies(spark, DATA, "pubmed").rdd.getNumPartitions() >= 20


def test_small_files_need_one_exchange(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("".join(REC.format(i) for i in range(5 * n, 5 * n + 5)))
    found = tagged.parsed(spark, str(tmp_path), tagged.parse_wos)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert sorted((r.doc_id, tuple(r.keywords)) for r in found.collect()) == sorted((f"WOS:{i}", tuple(sorted([f"a{i}", "b", "c"]))) for i in range(15))


def test_large_and_small_files_are_read_alike(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("".join(REC.format(i) for i in range(40)))
    (tmp_path / "b.txt").write_text("".join(REC.format(i) for i in range(40, 42)))
    (tmp_path / "c.csv").write_text("Title,EID,Author Keywords\n" + "".join(f'"t ""x"",\n{i}",E{i},"k{i}; z"\n' for i in range(30)))
    (tmp_path / "d.csv").write_text('Title,EID,Author Keywords\n"t\n\nu",,y\n')
    rows = lambda: sorted((r.doc_id, tuple(r.keywords)) for r in tables.read_records(spark, str(tmp_path)).collect())
    whole = rows()
    assert len(whole) == 73 and ("scopus_1", ("y",)) in whole
    monkeypatch.setattr(tagged, "WHOLE", 200)
    assert rows() == whole
    monkeypatch.setattr(tagged, "WHOLE", 0)
    assert rows() == whole


def test_a_small_mapping_is_sent(spark):
    edges = spark.createDataFrame([(1, "A"), (1, "a"), (2, "b"), (None, "b"), (None, "b"), (2, " ")], "rec_seq long, kw_raw string")
    mapping = spark.createDataFrame([("a", "x"), ("b", "x")], "raw string, canonical string")
    found = audit.dual_metrics(edges, mapping)
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 0
    assert [tuple(r) for r in found.collect()] == [("x", 4, 3, 1)]


def test_a_large_vocabulary_is_cut_to_what_is_asked(spark):
    freqs = spark.createDataFrame([("renal-tumors", 3), ("renal tumor", 2), ("other", 1)], "term string, freq long")
    vocabulary = spark.createDataFrame([(f"entry {i}", "d", "c", "n") for i in range(50)] + [("renal tumor", "d1", "c1", "Renal Tumor"), ("renaltumors", "d2", "c2", "x")], "term string, descriptor_id string, concept_id string, canonical_name string")
    assert {r.term for r in clusters._asked(freqs.withColumnRenamed("term", "base_term"), vocabulary).collect()} == {"renal tumor", "renaltumors"}
    got = {r.term: (r.hyphen_resolved, r.descriptor_id) for r in clusters.term_properties(freqs, vocabulary).collect()}
    assert got == {"renal-tumors": ("renaltumors", None), "renal tumor": ("renal tumor", "d1"), "other": ("other", None)}
