"""Singulars by a table."""

from lexiweave.operators import suffixes


def test_words(spark):
    wanted = {
        "diseases": "disease", "Responses": "response", "metastases": "metastasis", "women": "woman", "mice": "mouse", "viruses": "virus", "hypotheses": "hypothesis", "nurses": "nurse", "analyses": "analysis",
        "tumors": "tumor", "therapies": "therapy", "matrices": "matrix", "series": "series", "roses": "rose", "fibroses": "fibrosis", "": "", "x": "x",
    }
    df = spark.createDataFrame([(w, 1) for w in [*wanted, "mice"]] + [(None, 2)], "w string, put int")
    got = suffixes.lemmas(df, "w", suffixes.english(spark)).collect()
    assert len(got) == len(wanted) + 2 and {r.w: r.lemma for r in got} == wanted | {None: None}


def test_own_table_and_phrases(spark):
    rules = spark.createDataFrame([("oxen", "ox", 4, True), ("en", "e", 3, False), ("xen", "x", 9, False)], suffixes.RULES)
    df = spark.createDataFrame([("red  oxen",), ("big boxen",), ("  ",), (None,), ("lazy dogs",)], "p string")
    got = {r.p: r.lemma for r in suffixes.phrase_lemmas(df, "p", rules).collect()}
    assert got == {"red  oxen": "red ox", "big boxen": "big boxe", "  ": "", None: None, "lazy dogs": "lazy dog"}
    none = suffixes.lemmas(df, "p", rules.limit(0)).where("p = 'lazy dogs'").first()
    assert none.lemma == "lazy dog"
