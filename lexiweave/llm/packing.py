"""Vector bin packing of examples into training sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. While a sequence is
open, the example that fits and has the largest weighted dot product of its demand with what is
left of the limits goes in; weights are the demand of the waiting examples for each limit. Each
partition packs its own rows from a bounded window of waiting examples, so nothing is shuffled and
a lost task repeats to the same sequences. Where pieces may be cut, an example is cut to close a
sequence exactly, and a partition's remainder goes into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordTokens

TOKENS = 2048
SEGMENTS = 256
WINDOW = 384


@dataclass(slots=True)
class Piece:
    owner: object
    start: int
    tokens: int
    loss: int


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


class Packer:
    """Feed pieces with add(), which yields closed sequences (lists of pieces); finish() yields the rest.

    `cut` says that pieces may be cut; a cut piece's loss-bearing tokens are then all its tokens but
    the first of its owner. An uncut piece beyond a limit gets a sequence to itself.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, window: int = WINDOW, cut: bool = True):
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.window, self.cut = window, cut
        self.waiting: list[Piece] = []
        self.demand = np.zeros((window + segments + 2, 3))
        self.total = 0

    def _wait(self, piece: Piece) -> None:
        n = len(self.waiting)
        if n == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[n] = piece.tokens, 1, piece.loss
        self.waiting.append(piece)
        self.total += piece.tokens

    def _take(self, i: int) -> Piece:
        last = self.waiting.pop()
        n = len(self.waiting)
        piece = last
        if i < n:
            piece, self.waiting[i] = self.waiting[i], last
            self.demand[i] = self.demand[n]
        self.total -= piece.tokens
        return piece

    def _part(self, piece: Piece, n: int) -> Piece:
        """The first n tokens of the piece; the rest waits."""
        head = Piece(piece.owner, piece.start, n, n - (piece.start == 0))
        self._wait(Piece(piece.owner, piece.start + n, piece.tokens - n, piece.tokens - n))
        return head

    def _close(self, tokens: int) -> list[Piece]:
        """One sequence of at most `tokens` tokens."""
        left = self.limits.copy()
        left[0] = tokens
        weight = self.demand[: len(self.waiting)].sum(axis=0) / self.limits**2
        got: list[Piece] = []
        while self.waiting and left[0] > 0 and left[1] > 0:
            d = self.demand[: len(self.waiting)]
            fits = (d[:, 0] <= left[0]) & (d[:, 2] <= left[2])
            scores = np.where(fits, d @ (weight * left), -1.0)
            best = int(scores.argmax())
            if scores[best] >= 0:
                piece = self._take(best)
            else:
                room = int(min(left[0], left[2]))
                if not self.cut or room < 1:
                    break
                piece = self._part(self._take(int(d[:, 0].argmax())), room)
            got.append(piece)
            left -= piece.tokens, 1, piece.loss
        size = sum(p.tokens for p in got)
        if self.cut and size not in (0, int(self.limits[0])) and size & (size - 1):
            over = size - _power(size)  # another limit closed it: keep a power of two
            while over:
                piece = got.pop()
                if piece.tokens > over:
                    got.append(self._part(piece, piece.tokens - over))
                    over = 0
                else:
                    over -= piece.tokens
                    self._wait(piece)
        return got

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        most = int(min(self.limits[0], self.limits[2]))
        while self.cut and piece.tokens > most:
            yield [Piece(piece.owner, piece.start, most, most - (piece.start == 0))]
            piece = Piece(piece.owner, piece.start + most, piece.tokens - most, piece.tokens - most)
        if not self.cut and (piece.tokens > self.limits[0] or piece.loss > self.limits[2]):
            yield [piece]
            return
        if piece.tokens == 0 and self.cut:
            return
        self._wait(piece)
        while len(self.waiting) >= self.window and self.total >= self.limits[0]:
            yield self._close(int(self.limits[0]))

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            full = int(self.limits[0])
            yield self._close(full if self.total >= full or not self.cut else _power(self.total))


def _sequence_base() -> int:
    """Sequence numbers are unique over partitions: 2^33 for each."""
    return TaskContext.get().partitionId() << 33


@functools.cache
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, tokens: int = TOKENS, segments: int = SEGMENTS, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokenizes each text (null: empty), appends end_id, and packs all ids into sequences.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens, and the `keep` columns of its document. Plain text bears loss on all ids but a document's first, so
    here the limit on loss is that on tokens; pack_examples has one of its own. Every id lies in exactly one piece. Rows are documents of their own, even where ids
    are null or repeat; other columns are ignored; an empty table gives no pieces. Rows are packed in
    the order in which they are read, within a window.
    """
    schema = docs.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"):
        schema = schema.add(name, "long")
    for field in docs.select(*keep).schema.fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = _word_tokens(path), Packer(tokens, segments, tokens), _sequence_base()
        rows: list[tuple] = []

        def put(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for p in sequence:
                doc_id, ids, kept = p.owner
                rows.append((doc_id, p.start, p.tokens, zlib.crc32(ids[p.start : p.start + p.tokens].tobytes()), ids.size, number, offset, p.loss, *kept))
                offset += p.tokens
            number += bool(sequence)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema.names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)
            rows.clear()
            return made

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 7, *(batch.schema.field(i).type for i in range(2, batch.num_columns))]
            kept = list(zip(*(batch.column(i).to_pylist() for i in range(2, batch.num_columns)), strict=True)) or [()] * batch.num_rows
            for doc_id, text, more in zip(batch.column(0).to_pylist(), batch.column(1), kept, strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                for sequence in packer.add(Piece((doc_id, ids, more), 0, ids.size, ids.size - 1)):
                    put(sequence)
            if len(rows) > 10_000:
                yield out()
        for sequence in packer.finish():
            put(sequence)
        if types:
            yield out()

    return docs.select("doc_id", F.col(text_col).cast("string").alias("__text"), *keep).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS) -> DataFrame:
    """Packs whole instruction examples: (id, tokens, loss, sequence_id, offset, over_limit) for each row.

    Examples are never cut. One beyond a limit has a sequence to itself and over_limit true. Null
    counts are 0; ids may be null or repeat; other columns are ignored.
    """
    schema = examples.select(F.col(id_col).alias("id")).schema.add("tokens", "long").add("loss", "long").add("sequence_id", "long").add("offset", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, kind = Packer(tokens, segments, loss, cut=False), _sequence_base(), None

        def rows_of(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    yield p.owner, p.tokens, p.loss, number, offset, p.tokens > tokens or p.loss > loss
                    offset += p.tokens
                number += 1

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [kind, *[pa.int64()] * 4, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            rows = []
            for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += rows_of(packer.add(Piece(i, 0, t, n)))
            yield out(rows)
        if kind is not None:
            yield out(list(rows_of(packer.finish())))

    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return examples.select(F.col(id_col).alias("id"), count(tokens_col).alias("t"), count(loss_col).alias("n")).mapInArrow(run, schema)


def pack_conversations(conversations: DataFrame, path: str, tokens: int = TOKENS, segments: int = 64, loss: int = TOKENS // 2, end_id: int = 1) -> DataFrame:
    """Packs whole conversations: (id, tokens, loss, sequence_id, offset, over_limit) for each conv_id.

    A turn has the ids of its text (null: none) and end_id; those of role assistant bear loss. All rows of a
    conv_id, null too, are one conversation, repeated rows being turns of their own; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_tokens(path)
        for batch in batches:
            n = np.array([encoder.ids(t.as_py() or "").size + (end_id is not None) for t in batch.column(2)], dtype=np.int64)
            answers = np.array([r == "assistant" for r in batch.column(1).to_pylist()], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.where(answers, n, 0))], names=["conv_id", "n", "bears"])

    schema = conversations.select("conv_id").schema.add("n", "long").add("bears", "long")
    turns = conversations.select("conv_id", F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)
    examples = turns.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("bears").alias("bears"))
    return pack_examples(examples, "conv_id", "n", "bears", tokens, segments, loss)
