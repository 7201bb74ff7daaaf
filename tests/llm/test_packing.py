import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from lexiweave.llm import packing
from lexiweave.llm.packing import Packer, Piece, pack_documents, pack_examples
from lexiweave.llm.tokens import load

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = np.array(load(PATH).encode(texts[d] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == ids.size and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == ids.size
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and len(ps) <= 256
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_documents_round_trip(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta's", "gamma,", "ééé", "12345", "½", "don't", "日本語"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 50, 700, 9000]))) for i in range(300)} | {1000: None, 1001: "", 1002: "<|endoftext|> x"}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, offset int")
    assert check_pieces(pack_documents(df, PATH).collect(), texts) == 0
    assert pack_documents(df.limit(0), PATH).count() == 0
    tiny = {i: None for i in range(3000)}
    assert check_pieces(pack_documents(spark.createDataFrame([(i, None) for i in tiny], "doc_id long, text string"), PATH).collect(), tiny) == 0
    twice = pack_documents(spark.createDataFrame([(1, "a b c")] * 2 + [(None, "d")], "doc_id long, text string"), PATH).collect()
    assert sum(r.length for r in twice) == 10


def test_limits_hold_at_once():
    rng = random.Random(4)
    items = [Piece(i, 0, t := rng.randint(1, 900), rng.randint(0, t)) for i in range(3000)]
    p = Packer(tokens=1000, segments=8, loss=600, window=128, cut=False)
    closed = [s for x in items for s in p.add(x)] + list(p.finish())
    fits = [s for s in closed if not (len(s) == 1 and s[0].loss > 600)]
    assert sorted(x.owner for s in closed for x in s) == list(range(3000))
    assert all(sum(x.tokens for x in s) <= 1000 and len(s) <= 8 and sum(x.loss for x in s) <= 600 for s in fits)
    used = max(sum(x.tokens for s in fits for x in s) / 1000, sum(x.loss for s in fits for x in s) / 600)
    assert len(fits) < 1.12 * used


def test_examples(spark):
    rows = [(i, 100 + i % 50, i % 90, "x") for i in range(500)] + [(None, None, None, "x"), (900, 5000, 10, "x"), (901, 10, 3000, "x")]
    got = pack_examples(spark.createDataFrame(rows, "doc_id long, n int, l int, id string"), "doc_id", "n", "l").collect()
    assert len(got) == len(rows) and sum(r.over_limit for r in got) == 2
    total, loss = defaultdict(int), defaultdict(int)
    for r in got:
        if not r.over_limit:
            total[r.sequence_id] += r.tokens
            loss[r.sequence_id] += r.loss
    assert max(total.values()) <= 2048 and max(loss.values()) <= 2048


def test_loss_limit_binds_on_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    t = load(path)
    want = defaultdict(lambda: [0, 0])
    for r in df.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n * (r.role == "assistant")
    limits = {"tokens": 1024, "segments": 20, "loss": 300}
    got = packing.pack_conversations(df, path, **limits).collect()
    assert {r.id: [r.tokens, r.loss] for r in got} == dict(want) and len(got) == len(want)
    free = packing.pack_conversations(df, path, **limits | {"loss": 10**9}).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert len(rows) == 1 and rows[0].over_limit or sum(r.tokens for r in rows) <= 1024 and sum(r.loss for r in rows) <= 300 and len(rows) <= 20
        assert [r.offset for r in rows] == [sum(x.tokens for x in rows[:i]) for i in range(len(rows))]
    assert len(by) > len({r.sequence_id for r in free})
    assert packing.pack_conversations(df.limit(0), path).count() == 0
