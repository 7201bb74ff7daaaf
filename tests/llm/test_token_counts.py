import random

import numpy as np
import public_tokenizers
import pytest

from lexiweave.llm.token_counts import count_tokens
from lexiweave.llm.tokens import PrefixCounts, WordTokens, load, prefix_counts, truncation_point

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "a   b \n\n c", "don't we'll they've 'rent 's", "  lead", "tail  ", " ' 's", "a\tb\n", "é è", "'re", "I'll\n\n  go", "x y 12 345!! ñandú", "日本語 text ½", "a\x85b"]


def library(text):
    return len(load(BYTES).encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounts(BYTES)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_is_exact(counter, text):
    assert prefix_counts(counter.store(text)).tolist() == [library(text[:i]) for i in range(len(text) + 1)]


def test_random_texts(counter):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["th", "e ", "in", "g ", "Ñ", "ó", "'", "s ", "  ", "\n", "7", "!!", "re", " ", "zq"]) for _ in range(rng.randint(1, 40)))
        counts = prefix_counts(counter.store(text))
        assert counts.tolist() == [library(text[:i]) for i in range(len(text) + 1)]
        assert truncation_point(counter.store(text), 5) == max(i for i in range(len(text) + 1) if library(text[:i]) <= 5)


def test_word_ids_match_the_library():
    w = WordTokens(WORDS)
    for text in [*TEXTS, "É\x85a", "<|endoftext|>", "İstanbul ß SS ﬁ", "a\x1cb", "1234 a1b2's", "w" * 3000]:
        assert w.ids(text).tolist() == load(WORDS).encode(text, add_special_tokens=False).ids


def test_counts_on_odd_rows(spark):
    rows = [(1, "one two", 5), (1, "one two", 5), (None, None, 5), (3, "", 5), (4, "word " * 40000, 5), (5, "a<|endoftext|>b", 5)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), BYTES, with_store=True).collect()
    assert [(r.n_bytes, r.n_tokens) for r in got] == [(len((t or "").encode()), library(t or "")) for _, t, _ in rows]
    assert prefix_counts(np.frombuffer(got[4].store, np.int8))[-1] == got[4].n_tokens and got[4].fits == 512 * 5 - 1
    assert count_tokens(spark.createDataFrame(rows, "doc_id long, text string, k int").limit(0), BYTES).count() == 0


@pytest.mark.parametrize(
    "text",
    ["it’s a\n\nb", "“x”  y — z\n\n\t'll go", "a <| b |> c", "if x <|> y:  z", "日本\u3000\u3000語  é\x1c\x1cb\xa0 c", "a<|endoftext|>b", "  <|endoftext|>  <|endoftext|><|endoftext|> it’s  <|end", "’ \n<|endoftext|>\n\n<|x"],
)
def test_every_prefix_of_special_and_unusual_texts(counter, text):
    store = counter.store(text)
    assert store.dtype == np.int8
    assert prefix_counts(store).tolist() == [library(text[:i]) for i in range(len(text) + 1)]
