import random

import numpy as np

from lexiweave.llm import chunk_dedup as cd


def slow_cuts(raw, average=cd.AVERAGE):
    """Chunk ends by the recurrence, byte by byte."""
    out, start = [], 0
    for t in range(len(raw)):
        h = 0
        for b in raw[max(0, t - 15) : t + 1]:
            h = (2 * h + int(cd._GEAR[b])) % (1 << 32)
        n = t + 1 - start
        if n >= cd.LEAST and h < (1 << 32) // (average - cd.LEAST) or n == cd.MOST or t == len(raw) - 1:
            out.append(t + 1)
            start = t + 1
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_cuts_match_the_recurrence_and_resist_shifts():
    rng = random.Random(1)
    raw = prose(rng, 300).encode()
    assert cd.cut_points(raw).tolist() == slow_cuts(raw)
    moved = b"inserted words " + raw
    same = set((cd.cut_points(raw) + 15).tolist()) & set(cd.cut_points(moved).tolist())
    assert len(same) >= len(cd.cut_points(raw)) - 4
    assert cd.cut_points(b"").size == 0 and cd.cut_points(b"x").tolist() == [1]
    for constant in (b"a" * 5000, b" " * 5000, b"\0" * 5000):
        assert cd.cut_points(constant).tolist() == slow_cuts(constant) and np.diff(cd.cut_points(constant)).min() >= 1
    long = rng.randbytes(3 * cd.STEP // 2 + 7)
    whole = np.flatnonzero(cd.gear_hashes(np.frombuffer(long, dtype=np.uint8)) <= (1 << 32) // 16 - 1) + 1
    assert cd.candidates(long) == whole.tolist()


def test_threshold_spread():
    raw = np.random.default_rng(0).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    sizes = np.diff(cd.cut_points(raw))
    assert cd.LEAST <= sizes[:-1].min() and sizes.max() <= cd.MOST and 0.9 < sizes.mean() / cd.AVERAGE < 1.1


def slow_words(text):
    """Bytes at which words start, code point by code point."""
    out, at, blank = [], 0, True
    for c in text:
        dense = any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x10BF), (0x1780, 0x17FF), (0x3040, 0x9FFF), (0x20000, 0x3FFFF)))
        if dense or blank and c not in "\t\n\v\f\r ":
            out.append(at)
        at, blank = at + len(c.encode()), c in "\t\n\v\f\r "
    return out


def brute(rows, min_words=cd.MIN_WORDS):
    """For each id the covered spans: byte strings of whole chunks with enough words, searched in all other texts' chunks."""
    seen, own = {}, {}
    for k, t in rows:
        raw, words = t.encode(), slow_words(t)
        ends = slow_cuts(raw)
        starts = [0, *ends[:-1]]
        if 0 < len(words) < min_words:
            starts, ends = [0], [len(raw)]
            seen.setdefault(raw, set()).add(k)
            own.setdefault(k, []).append((0, len(raw)))
        last = None
        for i, a in enumerate(starts):
            for b in ends[i:]:
                if sum(a <= w < b for w in words) >= min_words:
                    seen.setdefault(raw[a:b], set()).add(k)
                    own.setdefault(k, []).append((a, b))
                    last = a
                    break
        if last is not None:
            seen.setdefault(raw[last:], set()).add(k)
            own[k].append((last, len(raw)))
    out = {}
    for k, t in rows:
        covered = sorted(s for s in own.get(k, []) if len(seen[t.encode()[s[0] : s[1]]]) > 1)
        spans = []
        for a, b in covered:
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        if spans:
            out[k] = [(a, b - a) for a, b in spans]
    return out


def test_planted_passages(spark):
    rng = random.Random(7)
    passage, line = prose(rng, 60), prose(rng, 9)
    rows = [(i, prose(rng, rng.randint(5, 150))) for i in range(60)]
    for i in range(20, 40):
        t = rows[i][1].split(" ")
        at = rng.randint(0, len(t))
        rows[i] = (i, " ".join([*t[:at], passage, *t[at:]]))
    for i in range(45, 60):
        rows[i] = (i, line + "\n" + rows[i][1])
    odd = [(900, None), (901, ""), (None, rows[21][1]), rows[22]]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows + odd], "doc_id long, text string, start int")
    got = {r.doc_id: r for r in cd.documents_with_repeats(df).collect()}
    want = brute([*rows, (-1, rows[21][1])])
    assert {k if k is not None else -1: [tuple(s) for s in r.spans] for k, r in got.items()} == want
    assert set(got) == {None, *range(20, 40)}
    assert got[30].removable_bytes > 200 and got[30].first_doc_id is None and got[None].removable_bytes == 0
    assert all(r.repeated_bytes == sum(s.bytes for s in r.spans) and r.n_passages == len(r.spans) for r in got.values())
    assert cd.documents_with_repeats(df.limit(0)).count() == 0
    assert cd.documents_with_repeats(df.where("doc_id < 20")).count() == 0


def test_short_overlaps_with_many_partners_are_no_passage(spark):
    """Sixteen words in a row with each of five others, one after the other, never more with any one."""
    rng = random.Random(4)
    parts = [prose(rng, 16) for _ in range(5)]
    rows = [(i, prose(rng, 40) + " " + p + " " + prose(rng, 40)) for i, p in enumerate(parts)] + [(9, " ".join(parts))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cd.documents_with_repeats(df).count() == 0


def test_long_and_constant_texts(spark):
    rng = random.Random(5)
    long = prose(rng, 40_000)
    rows = [(1, long), (2, "head " + long), (3, "a " * 50_000), (4, "a " * 30_000), (5, "b" * 200_000), (6, "b" * 200_000)]
    got = {r.doc_id: r for r in cd.documents_with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[6].removable_bytes == 200_000 and got[2].removable_bytes > 0.99 * len(long.encode()) and got[1].removable_bytes == 0


def test_words_start_alike_byte_by_byte_and_by_code_point():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "é", "語", "かな", "ไทย", "ລາວ", "မြန်", "ខ្មែ", "𠀀", "한국 ", "。", "　", "€", "😀"]) for _ in range(rng.randint(0, 60)))
        assert cd.word_places(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == slow_words(text)


def test_scripts_without_blanks_short_copies_and_blanks(spark):
    rng = random.Random(8)
    dense = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(n))
    copy, passage, words24 = dense(1800), thai(200), prose(rng, 24)
    rows = [(1, copy), (2, copy), (3, dense(300) + passage + dense(80)), (4, dense(40) + passage + dense(300)), (5, words24), (6, words24), (7, "two words"), (8, "two words"), (9, "two  words")]
    rows += [(10, prose(rng, 30) + " " * 900 + prose(rng, 30)), (11, prose(rng, 30) + " " * 900 + prose(rng, 30)), (12, " " * 900), (13, " " * 900), (14, "\n"), (15, "\n"), (16, dense(20)), (17, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in cd.documents_with_repeats(df).collect()}
    assert {k: [tuple(s) for s in r.spans] for k, r in got.items()} == brute(rows)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert all(got[k].removable_bytes == len(dict(rows)[k].encode()) for k in (2, 6, 8)) and got[4].removable_bytes > 400


def test_every_exact_copy_is_reported(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {}
    for r in docs.collect():
        if (r.text or "").strip():
            texts.setdefault(r.text, []).append(r.doc_id)
    copies = {i for ids in texts.values() if len(ids) > 1 for i in ids}
    got = {r.doc_id: r for r in cd.documents_with_repeats(docs).collect()}
    assert len(copies) > 20 and copies <= set(got)
    for text, ids in texts.items():
        for i in sorted(ids)[1:]:
            assert got[i].removable_bytes == len(text.encode())
