import random

import numpy as np
import pytest
import xxhash

from lexiweave.llm import simhash
from lexiweave.llm.common import connected_components


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_plain_count():
    for text in (None, "", "One", "one two", "A b\tc\x0bD e", "é É ß x y z " * 30, "a b c a b c a b c", "w " * 70000):
        assert simhash.fingerprint(text, 3) == brute_print(text)


@pytest.mark.parametrize("tile", [2048, 8])
def test_links_connect_like_brute_force(spark, tile):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps += [0, 1, (1 << 64) - 1, fps[0], fps[0]]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, 3, tile=tile)).collect()}
    want = brute_groups(fps, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    mine = [found.get(f, f) for f in signed]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_chain_and_hub_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_groups_on_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(3, text, 1), (9, text.upper().replace("W", "w"), 1), (4, text + " tail", 2), (None, None, 3), (8, "", 4), (8, "", 4), (5, "quite another text here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicate_groups(df).collect())
    assert got == [(-1, 8), (3, 3), (4, 3), (5, 5), (8, 8), (8, 8), (9, 3)]
    assert simhash.near_duplicate_groups(df.limit(0)).count() == 0


def test_masks_cover_every_pattern():
    masks = simhash.block_keys(3, 5)
    for _ in range(200):
        flips = sum(1 << b for b in np.random.default_rng(_).choice(64, 3, replace=False).tolist())
        assert any(not flips & m for m in masks)
