"""The net of first_of_groups is a SimHash that finds pairs of similarity 0.8."""

import numpy as np
import pytest

from lexiweave.llm import simhash


def test_bits_are_those_of_over_half_of_the_shingles():
    hashes = np.array([5], dtype=np.uint64)
    one = np.frombuffer(simhash._signature(hashes)[1], dtype=np.uint8)
    two = np.frombuffer(simhash._signature(np.array([5, 6], dtype=np.uint64))[1], dtype=np.uint8)
    assert not (two & ~one).any() and 200 < np.bitwise_count(one).sum() < 312  # of two both must have a bit
    assert simhash._signature(hashes[:0]) == (0, bytes(64))


@pytest.mark.parametrize("copies", [3, 40])
def test_links_of_pairs_and_of_large_buckets(spark, copies):
    rng, rows, want = np.random.default_rng(7), [], set()
    for g in range(30):
        base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        for c in range(copies):
            own = np.concatenate([base[:190], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])
            size, sig = simhash._signature(own)
            rows.append((g * 1000 + c, size, bytearray(sig)))
    rows.append((99999, 0, bytearray(64)))
    links = simhash.candidate_links(spark.createDataFrame(rows, "node long, size long, sig binary"))
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    assert roots == {g * 1000 + c: g * 1000 for g in range(30) for c in range(copies)}


def test_buckets_of_one_group_give_the_same_links(spark):
    rng, rows = np.random.default_rng(9), []
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for c in rng.permutation(400).tolist():
        size, sig = simhash._signature(np.concatenate([base[:192], rng.integers(0, 1 << 63, 8, dtype=np.uint64)]))
        rows.append((c, size, bytearray(sig)))
    n = simhash.candidate_links(spark.createDataFrame(rows, "node long, size long, sig binary")).count()
    print("links", n)
    assert n < 12 * 400


def test_links_of_a_group_grow_with_its_nodes_not_with_the_tasks(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for c in rng.permutation(400).tolist():
        size, sig = simhash._signature(np.concatenate([base[:192], rng.integers(0, 1 << 63, 8, dtype=np.uint64)]))
        rows.append((c, size, bytearray(sig)))
    prints = spark.createDataFrame(rows, "node long, size long, sig binary")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = {(r.src, r.dst) for r in simhash.candidate_links(prints).collect()}
        assert len(links) < 3 * 400
        monkeypatch.setattr(simhash, "FOREST", 10)  # links that are given away early still hold the group together
        early = {(r.src, r.dst) for r in simhash.candidate_links(prints).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for found in (links, early):
        assert {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(list(found), "src long, dst long")).collect()} == dict.fromkeys(range(400), 0)
