"""Byte-level BPE by merge ranks: texts to ids and ids to bytes.

Matches of the split pattern are laid end to end as one linked list of tokens, whose links stop at their borders. Adjacent pairs wait in buckets,
one for each merge rank, that hold places of the list; a hierarchical bitmap over the ranks says which buckets have
entries, so the next rank is a find-first-set in two words. A merge leaves the entries of the pairs it breaks where they are:
an entry counts only while the pair at its place still has the bucket's rank. Each merge costs the same however long
a match is, so one of a million bytes takes seconds and not hours. The matches of about a megabyte of texts that the cache does not have share a list;
the cache keeps short matches and is bounded in entries and bytes.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType


#: Entries of the cache, and the bytes of its keys and values; whichever comes first empties it.
CACHE = 500_000
CACHE_BYTES = 80 << 20
#: Matches of more code points are not kept.
LONG = 64
#: Code points of texts whose unseen matches are merged together; a longer text is one such group.
GROUP = 1 << 19
#: Places of a list from which its links are arrays, which are smaller than Python's lists and slower.
WIDE = 1 << 17


class RankQueue:
    """Places waiting under their merge rank; taken by smallest rank, all its places in order.

    A bit of a lower word marks a rank with a bucket, a bit of the upper word marks a lower word that is not zero. Python's
    integers have any width, so two levels of about the root of the ranks do.
    """

    def __init__(self, ranks: int, wide: bool = False):
        self.shift = max(6, (max(1, ranks).bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.words = [0] * ((max(1, ranks) >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, list | array] = {}
        self.wide = wide

    def put(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = array("q", (place,)) if self.wide else [place]
        word = rank >> self.shift
        self.words[word] |= 1 << (rank & self.mask)
        self.top |= 1 << word

    def fill(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Each place under its rank, in an empty queue; places ascend."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if ranks.size else order
        ends = [*starts[1:].tolist(), ranks.size]
        held = array("q", places.astype(np.int64).tobytes()) if self.wide else places.tolist()
        for rank, at, to in zip(ranks[starts].tolist(), starts.tolist(), ends, strict=False):
            self.buckets[rank] = held[at:to]
            word = rank >> self.shift
            self.words[word] |= 1 << (rank & self.mask)
            self.top |= 1 << word

    def take(self) -> tuple[int, list | array]:
        """The smallest rank with a bucket, and its places in order; the bucket goes. (-1, []) if there is none."""
        top = self.top
        if not top:
            return -1, []
        low = top & -top
        word = low.bit_length() - 1
        bits = self.words[word]
        least = bits & -bits
        self.words[word] = bits = bits ^ least
        if not bits:
            self.top = top ^ low
        rank = word << self.shift | least.bit_length() - 1
        bucket = self.buckets.pop(rank)
        if self.wide:
            np.frombuffer(bucket, dtype=np.int64).sort()
        else:
            bucket.sort()
        return rank, bucket


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, which is their id, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder of one file of ranks under one split pattern.

    The pattern is read as in the Unicode standard: \\s is the property White_Space, which Python's own leaves for
    four control characters.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.spelled = {i: t for t, i in self.ranks.items()}
        #: Ranks of pairs of bytes by their number, -1 for none.
        self.first = [self.ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece by itself: lowest rank first, leftmost first among equals. A piece that is a token is that one."""
        ids, ends = self._merged(pieces)
        return [x.tolist() for x in np.split(ids, ends[:-1])] if pieces else []

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and where each one's end."""
        rank_of = self.ranks.get
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        raw, n = b"".join(pieces), int(sizes.sum())
        wide = n > WIDE
        queue = RankQueue(max(self.spelled, default=0) + 1, wide)
        put, take, buckets = queue.put, queue.take, queue.buckets
        full = sizes > 0
        starts = (ends - sizes)[full]
        border = bytearray(n + 1)  # 1 where a piece starts, and at the end
        marks = np.frombuffer(border, dtype=np.uint8)
        marks[starts] = marks[n] = 1
        # Of a piece that is a token its first place holds the id and no pair waits; of the others each byte's place does.
        whole = np.fromiter((rank_of(p, -1) for p in pieces), np.int64, len(pieces))[full]
        codes = np.frombuffer(raw, dtype=np.uint8)
        token = np.array([rank_of(bytes((x,)), -2) for x in range(256)], dtype=np.int64)[codes]
        pair = np.full(n, -1, dtype=np.int64)
        pair[:-1] = np.array(self.first, dtype=np.int64)[codes[:-1].astype(np.int64) << 8 | codes[1:]]
        pair[marks[1:] == 1] = -1
        is_whole = np.repeat(whole >= 0, sizes[full])
        pair[is_whole] = token[is_whole] = -1
        token[starts[whole >= 0]] = whole[whole >= 0]
        waiting = np.flatnonzero(pair >= 0)
        queue.fill(pair[waiting], waiting)
        before = np.arange(-1, n - 1)
        before[starts] = -1
        # End of the token that starts at a place, start of the one to its left, rank of the pair with the one to its right, its id (-1: none starts there).
        end, before, pair, token = (array("q", x.tobytes()) if wide else x.tolist() for x in (np.arange(1, n + 1), before, pair, token))
        while True:
            rank, bucket = take()
            if rank < 0:
                break
            for k, i in enumerate(bucket):
                if pair[i] != rank:  # stale: one of its tokens has been merged
                    continue
                j = end[i]
                last = end[i] = end[j]
                pair[j] = pair[i] = token[j] = -1
                token[i] = rank
                lower = rank
                if not border[last]:
                    before[last] = i
                    r = rank_of(raw[i : end[last]])
                    if r is not None:
                        pair[i] = lower = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            put(r, i)
                left = before[i]
                if left >= 0:
                    r = rank_of(raw[left:last])
                    if r is None:
                        pair[left] = -1
                    else:
                        pair[left] = r
                        if r in buckets:
                            buckets[r].append(left)
                        else:
                            put(r, left)
                        if r < lower:
                            lower = r
                if lower < rank:  # a pair of lower rank has come up: it goes first, the rest of the bucket waits
                    for later in bucket[k + 1 :]:
                        put(rank, later)
                    break
        token = np.frombuffer(token, dtype=np.int64) if wide else np.array(token, dtype=np.int64)
        if (token == -2).any():
            raise ValueError("a byte that no token has")
        return token[token >= 0], np.append(0, np.cumsum(token >= 0))[ends]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        split = [self.split.findall(t) for t in texts]
        known = self.cache
        unseen = list(set(chain.from_iterable(split)).difference(known))
        if len(known) + len(unseen) > CACHE or self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
            unseen = list(set(chain.from_iterable(split)))
        merged, ends = self._merged([p.encode() for p in unseen])
        raw, ends = merged.astype(np.int32).tobytes(), (4 * ends).tolist()
        found = {p: raw[at:to] for p, at, to in zip(unseen, [0, *ends[:-1]], ends, strict=False)}
        known.update(found)
        ids = [np.frombuffer(b"".join(map(known.__getitem__, s)), dtype=np.int32) for s in split]
        for p, b in found.items():
            if len(p) > LONG:
                del known[p]
            else:
                self.held += getsizeof(p) + getsizeof(b)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id that no token has is an error."""
        return b"".join(map(self.spelled.__getitem__, ids))

    @functools.cached_property
    def _spellings(self) -> tuple[np.ndarray, pa.Array]:
        """The place of each id (-1: no token) and the bytes that each place spells."""
        places = np.full(max(self.spelled, default=0) + 1, -1)
        places[list(self.spelled)] = np.arange(len(self.spelled))
        return places, pa.array(list(self.spelled.values()), pa.large_binary())

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each row of ids, its rows end to end; an id that no token has is an error."""
        places, spelled = self._spellings
        if ids.size and (ids.min() < 0 or ids.max() >= places.size or (places[ids] < 0).any()):
            raise KeyError("an id that no token has")
        at = places[ids]
        tokens = spelled.take(pa.array(at))
        _, offsets, data = tokens.buffers()
        # The tokens' bytes lie end to end, so the rows are cuts of the same bytes.
        cuts = np.frombuffer(offsets, dtype=np.int64, count=len(tokens) + 1, offset=8 * tokens.offset)[np.append(0, ends)]
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), data]).cast(pa.binary())


@functools.cache
def _pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and ids, array<int>: the ids of every whole text, in order.

    A row for each row of docs, repeated ones too; null text counts as empty, and an empty text has an empty array. Columns
    that are not kept are ignored, one of them may be named ids; a kept one may not. `path` is a rank
    file that every executor has at that place. An empty table gives an empty result.
    """
    if "ids" in keep:
        raise ValueError("the column ids of the result would clash with a kept one")
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(path, pattern)

        def batch(kept: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))
            return pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(keep))), ids], names=schema.names)

        for b in batches:
            column, at = b.column(len(keep)), 0
            while at < b.num_rows:
                texts, size, start = [], 0, at
                while at < b.num_rows and size < GROUP:
                    texts.append(column[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                yield batch(b.slice(start, at - start), pairs.encode(texts))

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with a column `into`, binary: the bytes that the ids spell, which is UTF-8 for the ids of a whole text.

    A null or empty array gives no bytes; a null in an array, or an id that no token has, is an error. A column that is
    already named `into` is replaced, all others pass through.
    """
    rows = rows.drop(into)
    names, schema = rows.columns, StructType([*rows.schema.fields, StructField(into, BinaryType())])
    where = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(path, pattern)
        for b in batches:
            column = b.column(where)
            flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            if flat.null_count:
                raise ValueError("an array of ids holds a null")
            yield pa.RecordBatch.from_arrays([*b.columns, pairs.decode_rows(flat.to_numpy(zero_copy_only=False), ends)], names=[*names, into])

    return rows.mapInArrow(run, schema)
