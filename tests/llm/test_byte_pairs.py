import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexiweave.llm import byte_pairs, queries
from lexiweave.llm.byte_pairs import BytePairs, RankQueue, decode_ids, encode_texts, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", " ", "a   b \n\n c", "don't we'll 'RE 's", "  lead", "tail  ", "12 345½Ⅻ!!", "日本語 text", "a\x85b\x1c\x1dc　 d", "<|endoftext|>", "😀👍🏽 é é", "'ſ ß İ", "x\x00y", "  ​"]


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(PATH, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("wide", [False, True])
def test_queue_takes_by_rank_then_by_place(wide):
    rng = random.Random(5)
    queue, held = RankQueue(5000, wide), []
    for _ in range(4000):
        if held and rng.random() < 0.3:
            rank, places = queue.take()
            assert rank == min(held)[0] and list(places) == sorted(p for r, p in held if r == rank)
            held = [x for x in held if x[0] != rank]
        else:
            held.append((rng.randrange(5000), rng.randrange(100)))
            queue.put(*held[-1])
    while held:
        rank, _ = queue.take()
        assert rank == min(held)[0]
        held = [x for x in held if x[0] != rank]
    assert queue.take() == (-1, [])


def plain_merge(ranks, raw):
    """Looks for the lowest, leftmost pair anew before each merge."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_where_lower_ranks_come_up_later(pairs):
    """Ranks in any order, not those of a trained vocabulary: a merge may open a pair of lower rank than its own."""
    rng = random.Random(8)
    for trial in range(40):
        tokens = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
        rng.shuffle(tokens)
        own = BytePairs(PATH, PATTERN)
        own.ranks = {t: i for i, t in enumerate([*tokens, b"a", b"b", b"c"])}
        own.spelled = {i: t for t, i in own.ranks.items()}
        own.first = [own.ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) for _ in range(20)]
        assert own.merge(pieces) == [[own.ranks[p]] if p in own.ranks else plain_merge(own.ranks, p) for p in pieces]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(pairs, library, text):
    assert pairs.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert pairs.decode(pairs.encode([text])[0].tolist()) == text.encode()


def test_every_code_point(pairs, library):
    for lo in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000]
        for form in ("a{}b ", "  {} ", "1{0}{0}"):
            text = "".join(form.format(c) for c in chars)
            assert pairs.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_random_and_very_long_pieces(pairs, library):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["th", "e ", "in", "Ñ", "ó", "'", "s ", "  ", "\n", "7", "!!", "re", " ", "zq", "語", "\t"]) for _ in range(rng.randint(1, 60)))
        assert pairs.encode([text])[0].tolist() == library.encode_ordinary(text)
    for text in ("a" * 200_000, " " * 100_000 + "x", "".join(rng.choice("abcdefgh") for _ in range(200_000))):
        assert pairs.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE", 50)
    monkeypatch.setattr(byte_pairs, "WIDE", 1000)
    own, rng = BytePairs(PATH, PATTERN), random.Random(2)
    for size in (0, 1, 5, 200):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 90))) for _ in range(9)) for _ in range(size)]
        assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert all(len(p) <= byte_pairs.LONG for p in own.cache)


def test_rows(spark, library):
    rows = [(1, "one two", 5), (1, "one two", 5), (None, None, 5), (3, "", 5), (4, "word " * 40_000, 5), (5, "a<|endoftext|>b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = decode_ids(encode_texts(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert [(r.doc_id, r.ids, bytes(r.decoded)) for r in got] == [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert encode_texts(df.limit(0), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="ids"):
        encode_texts(df, PATH, PATTERN, keep=("doc_id", "ids"))
    again = decode_ids(encode_texts(df, PATH, PATTERN).withColumn("decoded", F.lit(1)).withColumn("ids", F.when(F.col("doc_id") > 1, F.col("ids"))), PATH, PATTERN)
    assert [bytes(r.decoded) for r in again.collect()] == [(t or "").encode() if (i or 0) > 1 else b"" for i, t, _ in rows]


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op13_byte_pairs(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rows_are_decoded_without_a_look_at_each_id(pairs, monkeypatch):
    texts = ["one two", "", "日本語 é", "x"]
    ids = [pairs.encode([t])[0] for t in texts]
    monkeypatch.setattr(BytePairs, "decode", None)
    ends = np.cumsum([len(i) for i in ids])
    assert [b.decode() for b in pairs.decode_rows(np.concatenate(ids), ends).to_pylist()] == texts
    assert pairs.decode_rows(ids[1], np.array([0, 0])).to_pylist() == [b"", b""]
    assert pairs.decode_rows(ids[1], np.array([], dtype=np.int64)).to_pylist() == []
    for odd in (-1, len(pairs.ranks) + 5):
        with pytest.raises(KeyError):
            pairs.decode_rows(np.array([odd]), np.array([1]))


def test_a_byte_without_a_token_is_an_error():
    own = BytePairs(PATH, PATTERN)
    own.ranks = {t: i for t, i in own.ranks.items() if t != b"x"}
    assert own.merge([b"", b"a", b""]) == [[], [own.ranks[b"a"]], []] and own.merge([]) == []
    with pytest.raises((ValueError, TypeError)):
        own.encode(["xq"])
