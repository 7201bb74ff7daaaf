import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from lexiweave.operators import keywords
from lexiweave.sources import sinks, tables, tagged


def lines(spark, **files):
    return tagged.lines_of(spark.createDataFrame(list(files.items()), "path string, text string"))


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_web_of_science(spark):
    a = "PT J\nTI A note on tides\nDE tidal range; salt marsh; tidal range\nID estuaries; erosion\nUT WOS:A77\nER\n"
    b = "PT J\nDE one;\n   two; ;three\nER\n\nPT J\nID mud flats; eel grass\nUT W2\nER\n\nPT J\nDE lost\n"
    got = rows(tagged.parse_wos(lines(spark, a=a, b=b)))
    assert set(got) == {"WOS:A77", "wos_doc_1", "W2"}
    assert got["WOS:A77"].keywords == ["salt marsh", "tidal range"] and not got["WOS:A77"].is_de_fallback
    assert got["wos_doc_1"].keywords == ["one", "three", "two"]
    assert got["W2"].is_de_fallback and got["W2"].effective_keywords == ["eel grass", "mud flats"]
    assert len({r.rec_seq for r in got.values()}) == 3
    f = keywords.document_frequency(keywords.effective_edges(tagged.parse_wos(lines(spark, a=a))))
    assert {r.term: r.freq for r in f.collect()} == {"tidal range": 1, "salt marsh": 1}


def test_pubmed(spark):
    a = "PMID- 314\nTI  - Waves\nOT  - NAO\nMH  - *Sea Level/trends\nMH  - Storm Surges/statistics & numerical data\n\n\nPMID- 2\nOT  - first\n      second\nignored\nOT  - "
    got = rows(tagged.parse_pubmed(lines(spark, a=a)))
    assert set(got) == {"PMID:314", "PMID:2"} and set(got["PMID:314"].keywords) == {"NAO", "Sea Level", "Storm Surges"}
    assert got["PMID:2"].keywords == ["first", "second"]


def test_cnki(spark):
    r = "RT Journal\nT1 海岸侵蚀的观测\nK1 潮汐; 盐沼；；泥滩; 海草\n\n"
    c = "【来源篇名】甲\n【关键词】一;;二\n【来源篇名】乙\n【关键词】三；四\n"
    got = rows(tagged.parse_cnki(lines(spark, r=r, c=c)))
    assert len(got["海岸侵蚀的观测"].keywords) == 4 and got["甲"].keywords == ["一", "二"] and got["乙"].keywords == ["三", "四"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def export(kind, n, rng):
    """An export of n records with odd ones among them."""
    out = []
    for i in range(n):
        words = [f"k{rng.randrange(40)} w{j}" for j in range(rng.randrange(5))]
        odd = rng.random()
        if kind == "wos":
            out += ["PT J", f"TI title {i}", "   goes on", *([f"DE {words[0]};", *(f"   {w};" for w in words[1:])] if words and odd < 0.7 else []), f"ID {'; '.join(words)}", *([f"UT WOS:{i}"] if odd < 0.8 else []), "ER", *([""] if odd < 0.9 else ["ER"])]
        elif kind == "pubmed":
            out += [*([f"PMID- {i}"] if odd < 0.8 else []), "AB  - text", "      more text", *(f"OT  - {w}" if j % 2 else f"MH  - *{w}/x" for j, w in enumerate(words)), *(["      continued"] if words else []), *[""] * rng.randrange(1, 4)]
        elif kind == "cnki":
            out += [f"【来源篇名】{f'题 {i}' if odd < 0.8 else ''}", "其他", f"【关键词】{';；'.join(words)}"]
        else:
            out += ["RT Journal", *([f"T1 title {i}"] if odd < 0.8 else []), "A1 someone", f"K1 {'；'.join(words)}", ""]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize(("kind", "parse"), [("wos", tagged.parse_wos), ("pubmed", tagged.parse_pubmed), ("cnki", tagged.parse_cnki), ("refworks", tagged.parse_cnki)])
def test_split_files_have_the_same_records(spark, tmp_path, small_splits, kind, parse):
    """One file in one piece, in a hundred and in pieces below a line: the same records, ids and numbers."""
    rng = random.Random(kind)
    texts = {f"{kind}{i} x.txt": export(kind, n, rng) for i, n in enumerate((700, 3, 1))}
    for name, text in texts.items():
        (tmp_path / name).write_text(("\ufeff" if name.startswith(f"{kind}1") else "") + (text.replace("\n", "\r\n") if name.startswith(f"{kind}2") else text), encoding="utf-8", newline="")
    cols = ["doc_id", "keywords", "combined_keywords", "is_de_fallback"]
    want = sorted(map(tuple, parse(lines(spark, **texts)).select(*cols).collect()), key=str)
    assert len(want) > 500
    for size in ("1g", "1000", "97"):
        small_splits(size)
        read = tagged.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > {"1g": 0, "1000": 8, "97": 99}[size]
        got = parse(read)
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == want
        assert got.select("rec_seq").distinct().count() == len(want)
        assert [(r.format) for r in tagged.detect_formats(read).collect()] == [{"wos": "wos_plaintext", "pubmed": "pubmed_medline", "cnki": "cnki_text", "refworks": "cnki_refworks"}[kind]] * 3


def test_split_csv(spark, tmp_path, small_splits):
    """Cells with line ends, quotes and separators in one file of many splits, against the csv module."""
    rng = random.Random(9)
    cell = lambda: "".join(rng.choice(["a", "b ", ";", ",", '"', "\n", "\n\n", "é", "“x”"]) for _ in range(rng.randrange(12)))
    heads = [["Title", "EID", "DOI", "Author Keywords", "Index Keywords"], ["Index Keywords", "Author Keywords", "Year", "DOI", "EID", "Abstract"], ["Title", "Author Keywords"]]
    want = []
    for i, head in enumerate(heads):
        with open(tmp_path / f"s{i}.csv", "w", encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(head)
            for _ in range((400, 60, 5)[i]):
                out.writerow([cell() for _ in head])
                if rng.random() < 0.1:
                    f.write("\n")  # an empty line is no row
        with open(tmp_path / f"s{i}.csv", encoding="utf-8-sig", newline="") as f:
            for n, r in enumerate(csv.DictReader(f), 1):
                words = {w.strip() for c in ("Author Keywords", "Index Keywords") for w in (r.get(c) or "").split(";")} - {""}
                want.append(((r.get("EID") or "").strip() or (r.get("DOI") or "").strip() or f"scopus_{n}", sorted(words)))
    for size in ("1g", "777", "61"):
        small_splits(size)
        got = tables.read_scopus(spark, str(tmp_path)).select("doc_id", "keywords").collect()
        assert sorted((r.doc_id, sorted(r.keywords)) for r in got) == sorted(want)


def test_a_folder_of_all_formats(spark, tmp_path, small_splits):
    files = {
        "a.txt": "PT J\nDE a1; a2\nUT W1\nER\n", "b.txt": "PMID- 5\nOT  - b1\n\n", "c d.txt": "RT Journal\nT1 C\nK1 c1；c2\n", "e.txt": "【来源篇名】E\n【关键词】e1\n",
        "f.csv": 'Title,EID,Author Keywords\n"x\ny",E9,f1; f2\n', "g.tsv": "label\toccurrences\nG1\t3\nG2\t4\n", "h.txt": "nothing known\n", "i.txt": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "k.txt").write_bytes("RT Journal\nT1 标题\nK1 关键；词\n".encode("gbk"))
    want = {("Web of Science", "W1"): {"a1", "a2"}, ("PubMed", "PMID:5"): {"b1"}, ("CNKI", "C"): {"c1", "c2"}, ("CNKI", "E"): {"e1"}, ("Scopus", "E9"): {"f1", "f2"}, ("VOSviewer", "vos_term_1"): {"G1"}, ("VOSviewer", "vos_term_2"): {"G2"}, ("CNKI", "标题"): {"关键", "词"}}
    for size in ("1g", "13"):
        small_splits(size)
        got = {(r.source_database, r.doc_id): set(r.keywords) for r in tables.read_records(spark, str(tmp_path)).collect()}
        assert got == want
        terms = tables.vos_frequencies(tagged.read_lines(spark, str(tmp_path / "g.tsv"))).collect()
        assert {r.term: r.freq for r in terms} == {"g1": 3, "g2": 4}


def test_detection(spark, tmp_path):
    files = {
        "wos": "PT J\nDE a\nER\n", "pub": "PMID- 1\n", "ref": "RT Journal\nT1 x\n", "cn": "x\n【关键词】a\n", "sco": "Title,Author Keywords,EID\n", "vos": "label\toccurrences\nx\t3\n", "no": "hello\n",
        "er": "XX\nDE a\nER\n", "late": "x\n" * 60 + "PMID- 1\n",
    }
    got = {r.path: r.format for r in tagged.detect_formats(lines(spark, **files)).collect()}
    assert got == {"wos": "wos_plaintext", "pub": "pubmed_medline", "ref": "cnki_refworks", "cn": "cnki_text", "sco": "scopus_csv", "vos": "vos_tsv", "no": "unknown", "er": "wos_plaintext", "late": "unknown"}
    (tmp_path / "p.txt").write_text("PMID- 7\nOT  - k\n")
    assert tables.read_records(spark, str(tmp_path / "p.txt")).first().doc_id == "PMID:7"


def test_charsets(spark, tmp_path):
    body = "【来源篇名】标题 {}\n【关键词】关键；词 {}\n"
    odd = {"gbk": "í", "gb18030": "ß𠀀", "utf-8": "é", "utf-8-sig": "é"}
    for charset, more in odd.items():
        (tmp_path / f"{charset}.txt").write_bytes(body.format(charset, more).encode(charset))
    (tmp_path / "rest.txt").write_bytes(b"RT Journal\nT1 rest\nK1 caf\xe9\xff;x\n")
    (tmp_path / "none.txt").write_bytes(b"")
    got = rows(tagged.parse_cnki(tables.read_decoded(spark, str(tmp_path))))
    assert {k: v.keywords for k, v in got.items()} == {f"标题 {c}": sorted(["关键", f"词 {m}"]) for c, m in odd.items()} | {"rest": ["café\xff", "x"]}


def test_big_file_in_gbk_is_split(spark, tmp_path):
    text = "".join(f"【来源篇名】题{i}\n【关键词】词{i};共\n" for i in range(20000))
    (tmp_path / "g.txt").write_bytes(text.encode("gbk"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65536)
    try:
        lines_ = tables.read_decoded(spark, str(tmp_path / "g.txt"))
        assert lines_.select("block").distinct().count() > 4
        got = tagged.parse_cnki(lines_)
        assert got.count() == 20000 and got.where("doc_id = concat('题', substr(array_min(keywords), 2)) OR doc_id = concat('题', substr(array_max(keywords), 2))").count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scopus(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Title,DOI,EID,Author Keywords,Index Keywords\n"a, b",10.1/x,E1,one; two,two; three\nc,10.2/y,,"x ""q""; ",\nd,,,,\n', encoding="utf-8-sig")
    got = rows(tables.read_scopus(spark, str(tmp_path / "s.csv")))
    assert got["E1"].keywords == ["one", "three", "two"] and got["10.2/y"].keywords == ['x "q"'] and got["scopus_3"].keywords == []
    assert tables.read_records(spark, str(tmp_path / "s.csv")).count() == 3


def test_vos(spark):
    df = lines(spark, v="label\toccurrences\ttotal link strength\nAlpha\t7\t1.5\n\nbeta\tx\nalpha\t3\n")
    assert [(r.term, r.occurrences, r.total_link_strength) for r in tables.vos_terms(df).orderBy("line_no").collect()] == [("Alpha", 7, 1.5), ("beta", 1, 0.0), ("alpha", 3, 0.0)]
    assert {r.term: r.freq for r in tables.vos_frequencies(df).collect()} == {"alpha": 3, "beta": 1}
    assert [r.doc_id for r in tables.vos_records(df).collect()] == ["vos_term_1", "vos_term_2", "vos_term_3"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.vos_terms(lines(spark, v="a\t1\tmany\n")).collect()


XML = """<DescriptorRecordSet>
<DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Alpha Thing</String></DescriptorName><ConceptList>
<Concept><ConceptUI>M1</ConceptUI><ConceptName><String>Alpha</String></ConceptName><TermList><Term><String>Alpha</String></Term><Term><String>Alphas</String></Term></TermList></Concept>
<Concept><ConceptUI>M2</ConceptUI><ConceptName><String>Beta</String></ConceptName><TermList><Term><String>Beta</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
<DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Gamma</String></DescriptorName><ConceptList>
<Concept><ConceptUI>M3</ConceptUI><ConceptName><String>Gamma</String></ConceptName><TermList><Term><String>Gamma</String></Term><Term><String>ALPHAS</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
</DescriptorRecordSet>"""


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.xml").write_text(XML)
    df = tables.read_vocabulary_xml(spark, str(tmp_path / "v.xml"))
    got = {r.term: (r.descriptor_id, r.concept_id, r.canonical_name, r.concept_name) for r in df.collect()}
    assert got == {"alpha": ("D1", "M1", "Alpha Thing", "Alpha"), "alphas": ("D2", "M3", "Gamma", "Gamma"), "beta": ("D1", "M2", "Alpha Thing", "Beta"), "gamma": ("D2", "M3", "Gamma", "Gamma"), "alpha thing": ("D1", "D1", "Alpha Thing", None)}
    sinks.write_vocabulary(df, tmp_path / "v.json")
    back = {r.term: (r.descriptor_id, r.concept_id, r.canonical_name, r.concept_name) for r in tables.read_vocabulary_json(spark, str(tmp_path / "v.json")).collect()}
    assert back == got
    (tmp_path / "r.json").write_text(json.dumps({"abcd": {"category": "c", "meaning": "m", "examples": ["x"]}}))
    assert tables.read_roots_json(spark, str(tmp_path / "r.json")).first().examples == ["x"]
    (tmp_path / "w.txt").write_text("# note\nDistress\n\n distress \nsepsis\n")
    assert {r.word for r in tables.read_word_list(spark, str(tmp_path / "w.txt")).collect()} == {"distress", "sepsis"}


def test_sinks(spark, tmp_path):
    cols = "raw_term string, target_term string, tier string, rule_source string, clinical_safety_check string, raw_frequency long, selected_for_export boolean"
    r = spark.createDataFrame([("a b", "a", "t", "s", "Passed", 3, True), ("A ", "a", "t", "s", "Passed", 1, True), ("c", "a", "t", "s", "Blocked", 2, False)], cols)
    assert sinks.write_vosviewer(r, tmp_path / "v.txt").read_text() == "label\treplace by\na b\ta\n"
    assert sinks.write_citespace(r, tmp_path / "c.txt", include_unselected=True).read_text() == "a b\ta\nc\ta\n"
    assert sinks.write_bibliometrix(r, tmp_path / "b.csv").read_bytes() == b"\xef\xbb\xbfold_term;new_term\r\na b;a\r\n"
    out = sinks.write_audit(r, tmp_path / "t.xlsx")
    assert out.suffix in (".csv", ".xlsx")
    if out.suffix == ".csv":
        assert out.read_text("utf-8-sig").splitlines()[0].startswith("Original Keyword (Raw),") and len(out.read_text().splitlines()) == 4
    o = spark.createDataFrame([("a b", False, None), ("c", None, "d")], "raw_term string, selected boolean, target string")
    sinks.write_draft(o, tmp_path / "d.json")
    assert (tmp_path / "d.json").read_text() == json.dumps({"a b": {"selected": False}, "c": {"target": "d"}}, indent=2)
    assert sinks.write_draft(o.limit(0), tmp_path / "e.json").read_text() == "{}"
    odd = spark.createDataFrame([('q"\\', None, None), ("é\n语", True, "\t/"), ("zz", None, "x")], o.schema)
    assert sinks.write_draft(odd, tmp_path / "d.json").read_text("utf-8") == json.dumps({'q"\\': {}, "zz": {"target": "x"}, "é\n语": {"selected": True, "target": "\t/"}}, ensure_ascii=False, indent=2)
    sinks.write_draft(o, tmp_path / "d.json")
    many = spark.createDataFrame([(f"r{i:05d}", f"t;{i % 7}", "t", 's "x"', "Passed", i, True) for i in range(3000)], cols).repartition(7)
    want = [b"\xef\xbb\xbfold_term;new_term\r\n", *(f'r{i:05d};"t;{i % 7}"\r\n'.encode() for i in sorted(range(3000), key=lambda i: (i % 7, i)))]
    assert sinks.write_bibliometrix(many, tmp_path / "m.csv").read_bytes() == b"".join(want)
    with open(sinks.write_audit(many, tmp_path / "a.csv"), encoding="utf-8-sig", newline="") as f:
        found = list(csv.reader(f))
    assert len(found) == 3001 and found[1][:4] == ["r00000", "t;0", "t", 's "x"']
    assert sorted(map(tuple, sinks.read_draft(spark, tmp_path / "d.json").collect())) == [("a b", False, None), ("c", None, "d")]
    assert sinks.read_draft(spark, tmp_path / "none.json").count() == 0


def test_a_failed_sink_leaves_no_file(spark, tmp_path):
    """A task that fails leaves neither a new file nor parts, and an older file stays as it was."""
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.lit("x")).otherwise(F.raise_error(F.lit("no"))).alias("line"))
    (tmp_path / "old.txt").write_text("old")
    for name in ("old.txt", "new.txt"):
        with pytest.raises(Exception, match="no"):
            sinks.write_joined(bad, tmp_path / name)
    assert [p.name for p in tmp_path.iterdir()] == ["old.txt"] and (tmp_path / "old.txt").read_text() == "old"
    assert sinks.write_joined(bad.where("false"), tmp_path / "old.txt", "head\n").read_text() == "head\n"
