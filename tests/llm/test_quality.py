import math
import zlib

import numpy as np

from lexiweave.llm import quality

DATA = "/root/testdata/sf0.01"


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, 5)).astype(np.float32) for n in (1, 4, 2, 7)]
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 3])
    m = quality.fit(bags, y, hidden=4, gate=3, rounds=1)
    x, starts = np.concatenate(bags).astype(float), np.array([0, 1, 5, 7])

    def loss():
        s = m.forward(x, starts)["s"]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    grad = quality._gradient(m, m.forward(x, starts), y, w, starts)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        down = loss()
        v[at] += 1e-6
        assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-6, k


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(600):
        bag = rng.normal(size=(8, 6))
        if i % 2:
            bag[rng.integers(8), 0] += 6
        bags.append(bag.astype(np.float32))
        y.append(float(i % 2))
    m = quality.fit(bags[:400], np.array(y[:400]))
    s = [m.score(b, np.array([0]))[0] for b in bags[400:]]
    assert np.mean((np.array(s) > 0.5) == np.array(y[400:])) > 0.93
    f = m.forward(bags[401].astype(float), np.array([0]))
    assert f["a"].argmax() == bags[401][:, 0].argmax()


def test_held_out_accuracy_and_contract(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "word " * 50000, None), (2, "x", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(df, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(df, some).collect()) == 4
    scored = quality.score(df, quality.train(df, some))
    assert scored.columns == ["doc_id", "text", "score", "predicted"] and scored.count() == 4
    assert quality.classify(df.limit(0), some).count() == 0


def slow_score(model, text):
    """The score by the formulas, passage by passage, in plain Python."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    p, hidden, weights = model.p, [], []
    for row in quality.encode(quality.passages(text)):
        x = [(float(v) - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(a * b for a, b in zip(x, column)) + c) for column, c in zip(p["B"].T, p["b"])]
        gate = [math.tanh(sum(a * b for a, b in zip(h, v))) * sig(sum(a * b for a, b in zip(h, u))) for v, u in zip(p["V"].T, p["U"].T)]
        hidden.append(h)
        weights.append(math.exp(sum(a * b for a, b in zip(gate, p["w"]))))
    z = [sum(w * h[i] for w, h in zip(weights, hidden)) / sum(weights) for i in range(len(p["c"]))]
    return sig(sum(a * b for a, b in zip(z, p["c"])) + float(p["d"][0]))


def test_scores_against_plain_formulas(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).select("text", "score").collect()
    assert all(abs(r.score - slow_score(model, r.text)) < 1e-6 for r in got[::7])


def test_words_and_trigrams_are_counted():
    bag = quality.encode(quality.passages("The cat THE\nzzz"))
    words = bag[:, -quality.WORD_BINS - quality.GRAM_BINS : -quality.GRAM_BINS] ** 2
    the, cat = (zlib.crc32(w) % quality.WORD_BINS for w in (b"the", b"cat"))
    assert the != cat and abs(words[0, the] - 2 / 3) < 1e-6 and abs(words[0, cat] - 1 / 3) < 1e-6 and abs(words[1].sum() - 1) < 1e-6
    grams = bag[:, -quality.GRAM_BINS :] ** 2
    assert abs(grams[0].sum() - 9 / 11) < 1e-6 and abs(grams[1].sum() - 1 / 3) < 1e-6


def test_sample_takes_whole_rows_within_the_bounds(spark, monkeypatch):
    """Rows come with all their passages until the bound; a row over a sixteenth of it is left out."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append((bags, y)))
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(1 + i % 9))) for i in range(200)] + [(500, "x\n" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    quality.train(docs, labels, most=320)
    bags, y = seen.pop()
    whole = {quality.encode(quality.passages(t)).astype(np.float16).tobytes() for _, t in rows[:-1]}
    assert 300 < sum(map(len, bags)) <= 320 and len(bags) == len(y) and all(b.tobytes() in whole for b in bags)
    quality.train(docs, labels, rows=50)
    assert len(seen.pop()[0]) == 50
