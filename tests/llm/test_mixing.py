from fractions import Fraction

import pytest

from lexiweave.llm import mixing


def worst_deviation(slots, weights):
    """The largest distance of a source from its exact share, over all prefixes until the first source ends."""
    total = sum(map(Fraction, weights.values()))
    end = min(max(ts) for ts in slots.values()) + 1
    worst = Fraction(0)
    for s, ts in slots.items():
        w = Fraction(weights[s]) / total
        a, b = w.numerator, w.denominator
        # Extremes stand just before and just after each of the source's own slots, and at the end.
        high = max(((i + 1) * b - a * (t + 1) for i, t in enumerate(ts) if t < end), default=0)
        low = max((a * t - i * b for i, t in enumerate(ts) if t < end), default=0)
        last = a * end - b * sum(t < end for t in ts)
        worst = max(worst, Fraction(max(high, low, abs(last)), b))
    return worst


@pytest.mark.parametrize(
    "weights,blocks",
    [
        ({"a": 1, "b": 1, "c": 1}, {"a": 333_000, "b": 334_000, "c": 334_000}),
        ({"a": 1e6, "b": 10}, {"a": 500_000, "b": 50}),
        ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 20_000, "b": 9_000, "c": 9_000}),
        ({f"s{i}": (i + 1) ** -0.5 for i in range(37)}, {f"s{i}": 900 for i in range(37)}),
    ],
)
def test_within_one_block_of_the_weights(weights, blocks):
    slots = mixing.schedule(blocks, weights)
    assert sorted(t for ts in slots.values() for t in ts) == list(range(sum(blocks.values())))
    assert worst_deviation(slots, weights) < 1


def test_against_slot_by_slot_search():
    """Earliest deadline first by looking at all sources at every slot."""
    weights = {"a": Fraction(1, 2), "b": Fraction(1, 3), "c": Fraction(1, 7), "d": Fraction(1, 42)}
    done, order = dict.fromkeys(weights, 0), []
    for t in range(84):
        open_ = [(-(-(done[s] + 1) // w), s) for s, w in weights.items() if done[s] // w <= t]
        s = min(open_)[1]
        order.append((s, done[s]))
        done[s] += 1
    got = mixing.schedule({"a": 84, "b": 56, "c": 24, "d": 4}, weights)  # no source ends before slot 84
    assert sorted((t, (s, i)) for s, ts in got.items() for i, t in enumerate(ts) if t < 84) == list(enumerate(order))


def test_phases_place_every_block_once():
    blocks = {"a": 5000, "b": 90, "c": 1, "d": 0, "e": 2500}
    got = mixing.schedule(blocks, {s: 1 + i for i, s in enumerate(blocks)})
    assert sorted(t for ts in got.values() for t in ts) == list(range(sum(blocks.values())))
    assert all(len(ts) == blocks[s] and ts == sorted(ts) for s, ts in got.items())


def test_mix_of_rows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "t", i) for i in range(3000)] + [(None, None, None, 0), (5, "s1", "t", 0), (5, "s1", "t", 0)]
    rows += [(None, "hot", None, i) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows) == len({r.mix_position for r in got})
    slots = mixing.schedule({s: -(-n // 16) for s, n in _counts(rows).items()}, mixing.tempered(_counts(rows)))
    blocks, counts = {}, {}
    for r in got:
        name = r.source or mixing._NULL
        assert r.mix_slot == slots[name][r.mix_block]
        blocks.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
        counts[r.source, r.mix_block] = counts.get((r.source, r.mix_block), 0) + 1
    assert all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    assert max(counts.values()) == 16 and all(n == 16 for (s, b), n in counts.items() if b + 1 < len(slots[s or mixing._NULL]))
    some = df.drop("mix_slot").where("doc_id is not null").dropDuplicates(["doc_id"])
    laid = mixing.in_mixed_order(some, 3, block=16)
    assert laid.columns == some.columns and [r.doc_id for r in laid.collect()] == [r.doc_id for r in sorted(mixing.mix(some, block=16).collect(), key=lambda r: r.mix_position)]
    assert mixing.mix(df.limit(0)).count() == 0
    assert max(r.mix_block for r in mixing.mix(df, most_blocks=10).collect()) < 10
    with pytest.raises(ValueError):
        mixing.mix(df, {"hot": 1.0})


def _counts(rows):
    out = {}
    for _, s, *_ in rows:
        out[s or mixing._NULL] = out.get(s or mixing._NULL, 0) + 1
    return out


def test_null_ids_are_dealt_over_buckets(spark, monkeypatch):
    """Rows without an id are no single key: they stand in many buckets, and every place is taken once."""
    monkeypatch.setattr(mixing, "BUCKET", 50)
    df = spark.createDataFrame([(None, "a", f"t{i}", {"k": i}) for i in range(3000)] + [(i, "b", "x", {}) for i in range(1000)], "doc_id long, source string, text string, m map<string,int>")
    got = mixing.mix(df).select("text", "source", "mix_block", "mix_position").toPandas()
    assert len(got) == 4000 and got.mix_position.is_unique and set(got[got.source == "a"].text) == {f"t{i}" for i in range(3000)}
    sizes = got.groupby(["source", "mix_block"]).size()
    assert sizes.max() == mixing.BLOCK and len(sizes) == -(-3000 // mixing.BLOCK) + -(-1000 // mixing.BLOCK)
