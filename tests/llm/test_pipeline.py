import shutil
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lexiweave.llm import mixing, pii, quality, simhash
from lexiweave.llm.tokens import load

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.toPandas()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs.toPandas())
    yield out
    shutil.rmtree(folder)


def test_columns_and_order_of_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "surrogates", "mixing", "packing"]
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[:5])


def test_quality_keeps_what_the_model_accepts(spark, stages):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels)
    want = {r.doc_id for r in stages[0].itertuples() if model.score(quality.encode(quality.passages(r.text)), np.array([0]))[0] >= 0.3}
    assert set(stages[1].doc_id) == want and len(want) < len(stages[0])


def test_dedup_against_brute_force(stages):
    """Of each chain of sets with a Jaccard similarity of 0.8 the smallest id stays, and no other row goes."""
    rows = sorted(stages[1].itertuples(), key=lambda r: r.doc_id)
    sets = [set(simhash.shingles(r.text, 5)) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert set(stages[2].doc_id) == {rows[i].doc_id for i in range(len(rows)) if find(i) == i} and len(stages[2]) < len(rows)


def test_packing_follows_the_mixed_order(spark, stages):
    placed = mixing.mix(spark.createDataFrame(stages[3][["doc_id", "source"]])).select("doc_id", "mix_position").toPandas()
    want = placed.sort_values("mix_position").doc_id.tolist()
    pieces = stages[5].drop_duplicates("doc_id").sort_values(["mix_part", "mix_row"])
    assert pieces.doc_id.tolist() == want


def test_surrogates_and_mix(spark, stages):
    assert sorted(stages[2].doc_id) == sorted(stages[3].doc_id) == sorted(stages[4].doc_id)
    before = dict(zip(stages[2].doc_id, stages[2].text))
    changed = [r for r in stages[3].itertuples() if r.text != before[r.doc_id]]
    assert changed and all(r.n_chars == len(r.text) for r in changed)
    old = spark.createDataFrame(stages[2][["doc_id", "text"]])
    hit = {r.doc_id for r in old.where(old.text.rlike(pii.ENTITY)).collect()}
    assert {r.doc_id for r in changed} == hit


def test_packing_holds_every_token(stages):
    t = load(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4].itertuples()}
    got = defaultdict(int)
    for r in stages[5].itertuples():
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == len(stages[5])


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, DATA).write.parquet(f"{tmp_path}/{n}")
        empty = spark.read.parquet(f"{tmp_path}/{n}")
        assert empty.count() == 0


def test_near_copies_go(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join(words[:300] + ["new"] + words[300:]), " ".join(words[:-3]), None, "", "short text", "short text", " ".join(f"v{i}" for i in range(600))]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in simhash.first_of_groups(df).collect())
    assert got == [-1, 3, 5, 7]


def pair(n, shared, own):
    """Two texts whose sets of five-word shingles have `shared` in common and `own` each to themselves."""
    common = " ".join(f"c{n}x{i}" for i in range(shared + 4))
    return [f"{common} {' '.join(f'{side}{n}x{i}' for i in range(own))}" for side in "ab"]


@pytest.mark.parametrize(("shared", "own"), [(400, 50), (8, 1)])
def test_pairs_at_true_similarity(spark, shared, own):
    low = {400: 53, 8: 2}[shared]
    texts = [t for n in range(300) for t in pair(n, shared, own)] + [t for n in range(300, 600) for t in pair(n, shared, low)]
    sets = [set(simhash.shingles(t, 5)) for t in (*texts[:2], *texts[600:602])]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert jaccard(*sets[:2]) == 0.8 and jaccard(*sets[2:]) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.first_of_groups(df).select("doc_id").collect()}
    assert {i for i in range(600) if i % 2 == 0} | set(range(600, 1200)) <= kept
    assert sum(i in kept for i in range(1, 600, 2)) <= 1


def test_repeated_lines(spark):
    line = " ".join(f"l{i}" for i in range(11))
    own = lambda n: " ".join(f"o{n}x{i}" for i in range(100))
    apart = [f"{(line + ' ') * 60}{own(n)}" for n in range(2)]
    base = " ".join(f"b{i}" for i in range(143)) + f" {line} {line}"
    texts = [*apart, base, base + f" {line}" * 40]
    assert simhash.fingerprint(apart[0], 5) == simhash.fingerprint(apart[1], 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_groups(df).select("doc_id").collect()) == [0, 1, 2]


NAMES = ["score", "predicted", "n_entities", "entity_kinds", "mix_part", "mix_row", "lw_score", "lw_predicted", "lw_entities", "fp", "k", "th"]


def test_columns_of_the_user_stay(spark, tmp_path):
    """Stages return a user's columns as they were, whatever their names, and rows that are null, empty or repeated."""
    rows = [(1, "Mr Smith wrote a long and quite ordinary line of text here.", "a", 59), (2, None, "a", 0), (3, "", None, 0), (None, "plain words", "b", 11), (4, "word " * 30_000, "b", 150_000), (5, "twice the same", "a", 14), (5, "twice the same", "a", 14)]
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in NAMES]) for i, r in enumerate(rows)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs.select("doc_id", *NAMES).collect()
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = docs.select("doc_id", *NAMES).collect()
        assert set(after) <= set(before) and len(after) >= {"near_dedup": len(before) - 2}.get(name, 0 if name == "quality" else len(before)), name
        if name == "quality" and not after:
            docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in NAMES]) for i, r in enumerate(rows)], docs.schema)
    pieces = corpus_pipeline.pack_sequences(spark, docs, DATA)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert dict(pieces.dtypes)["mix_part"] == "int" and pieces.where("mix_part IS NULL").count() == 0
    lone = corpus_pipeline.pack_sequences(spark, spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, mix_part string, mix_row string"), DATA).first()
    assert lone.mix_part is None and lone.mix_row is None and lone.doc_tokens == 2
