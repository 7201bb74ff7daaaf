"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (its lines, long ones cut every 60 words). Each passage is encoded
as a vector: counts and shares of characters and repeats, and hashed bags of its words and of its byte
trigrams. A gated attention layer, learned from document labels alone, weighs the passages, and the weighted mean of their
hidden vectors gives the document's score. The encoder and the network see nothing but the text. Training
runs on the driver over a bounded sample of labelled rows, each with all its passages; scoring
takes all passages of all texts, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .common import stable

PASSAGE_WORDS = 60
#: Bounds of the training sample: rows, and passages of all rows together; at 2 bytes a feature it has 20 MB.
TRAIN_ROWS = 6000
TRAIN_PASSAGES = 65_536
WORD_BINS = 64
GRAM_BINS = 64
THRESHOLD = 0.3

# Character classes by byte: shares of each are features of a passage.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b".", b",", b"!", b"?", b"$", b"%", b"&", b"#", b"*", b"|", b"'\"", b"-_", b"()[]{}", b"=<>/\\+", b":;@^~`"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_N_CLASSES = len(_CLASSES) + 1
WIDTH = _N_CLASSES + 9 + WORD_BINS + GRAM_BINS


class _Bins(dict):
    """The bin of each lower-cased word, remembered for short words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word.lower()) % WORD_BINS
        if len(word) <= 32:
            if len(self) >= 500_000:
                self.clear()
            self[word] = found
        return found


_BINS = _Bins()


def passages(text: str | None) -> list[list[bytes]]:
    """The words of each passage; one empty passage for a text without words."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        out += [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)]
    return out or [[]]


def encode(bag: list[list[bytes]]) -> np.ndarray:
    """One row of WIDTH features for each passage."""
    n = len(bag)
    sizes = np.array([len(w) for w in bag], dtype=np.float64)
    joined = [b" ".join(w) for w in bag]
    lengths = np.array([len(j) for j in joined])
    at = np.repeat(np.arange(n), lengths)
    raw = np.frombuffer(b"".join(joined), dtype=np.uint8)
    kinds = _CLASS[raw]
    share = np.bincount(at * _N_CLASSES + kinds, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES) / np.maximum(lengths, 1)[:, None]
    seen: set[bytes] = set()
    unique = np.empty(n)
    twins = np.empty(n)
    again = np.empty(n)
    for i, (w, j) in enumerate(zip(bag, joined, strict=True)):
        unique[i] = len(set(w))
        twins[i] = sum(map(bytes.__eq__, w, w[1:]))
        again[i] = j in seen
        seen.add(j)
    most = np.maximum(sizes, 1)
    letters = share[:, 0] + share[:, 1]
    more = [sizes / PASSAGE_WORDS, np.log1p(sizes) / 4, lengths / most / 12, unique / most, twins / most, again, share[:, 0] / np.maximum(letters, 1e-9), np.full(n, np.log1p(n) / 6), np.full(n, np.log1p(sizes.sum()) / 9)]
    bins = np.fromiter((_BINS[w] for ws in bag for w in ws), dtype=np.int64)
    words = np.bincount(np.repeat(np.arange(n), sizes.astype(np.int64)) * WORD_BINS + bins, minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    low = raw.astype(np.uint32) | np.uint32(32)
    mixed = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    inside = at[2:] == at[:-2]
    grams = np.bincount(at[2:][inside] * GRAM_BINS + (mixed[inside] >> np.uint32(26)), minlength=n * GRAM_BINS).reshape(n, GRAM_BINS)
    hashed = [np.sqrt(words / most[:, None]), np.sqrt(grams / np.maximum(lengths, 1)[:, None])]
    return np.column_stack([np.sqrt(share), *more, *hashed]).astype(np.float32)


@dataclass
class Model:
    """Gated attention: a = softmax(w . (tanh(V h) * sigmoid(U h))), score = sigmoid(c . sum a h + d), h = tanh(x B + b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["B"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s, "sizes": sizes}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), starts)["s"]


def _gradient(m: Model, f: dict, y: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    p, h, t, g, a, sizes = m.p, f["h"], f["t"], f["g"], f["a"], f["sizes"]
    ds = (f["s"] - y) * weight / weight.sum()
    dz = np.repeat(ds[:, None] * p["c"], sizes, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return {"c": f["z"].T @ ds, "d": np.array([ds.sum()]), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "B": f["x"].T @ dh, "b": dh.sum(axis=0)}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam over mini-batches of whole bags; the rarer label weighs as much as the other in all."""
    rng = np.random.default_rng(seed)
    n, width = sum(len(b) for b in bags), bags[0].shape[1]
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n  # bag by bag: the whole sample in double precision would be large
    spread = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / n)
    start = lambda *s: rng.normal(scale=1 / np.sqrt(s[0]), size=s)
    m = Model(mean, spread + 1e-3, {"B": start(width, hidden), "b": np.zeros(hidden), "V": start(hidden, gate), "U": start(hidden, gate), "w": start(gate), "c": start(hidden), "d": np.zeros(1)})
    ones = max(1.0, y.sum())
    weight = np.where(y == 1, len(y) / 2 / ones, len(y) / 2 / max(1.0, len(y) - ones))
    first, second = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            sizes = [len(bags[i]) for i in part]
            starts = np.cumsum([0, *sizes[:-1]])
            f = m.forward(np.concatenate([bags[i] for i in part]).astype(np.float64), starts)
            grad = _gradient(m, f, y[part], weight[part], starts)
            step += 1
            for k, d in grad.items():
                d = d + decay * m.p[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                m.p[k] = m.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text is divisible by 5: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bags(docs: DataFrame, text_col: str) -> DataFrame:
    """(y, n, bag): the n passages of each text as half-precision rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [encode(passages(t.as_py())).astype(np.float16) for t in b.column(1)]
            arrays = [b.column(0), pa.array([len(x) for x in bags], pa.int32()), pa.array([x.tobytes() for x in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "n", "bag"])

    return docs.select("y", F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "y double, n int, bag binary")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_col: str = "text", most: int = TRAIN_PASSAGES) -> Model | None:
    """Fits on at most `rows` labelled rows that are not held out, drawn by hash of their id, while they have `most` passages together.

    A row is taken with all its passages or not at all; one with more than a sixteenth of `most` is not. Labels of null quality
    are left out; an id with several labels takes the smallest. None without
    any usable label, or with labels of one value only.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    drawn = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "__id"))  # at most `rows` rows
    found = _bags(docs.select(F.col("doc_id"), F.col(text_col)).join(drawn, F.col("doc_id") == F.col("__id")), text_col)
    found = stable(found.where(F.col("n") <= most // 16).withColumn("h", F.xxhash64("bag")))
    # Ids may repeat in docs, so rows are bounded again, by the hash up to which passages and rows are few enough.
    order = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = found.select("h", F.sum("n").over(order).alias("passages"), F.count(F.lit(1)).over(order).alias("rows")).where((F.col("passages") <= most) & (F.col("rows") <= rows))
    last = few.agg(F.max("h").alias("h")).first()["h"]
    got = found.where(F.col("h") <= F.lit(last)).orderBy("h", "y").limit(rows).select("y", "bag").toArrow()
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(b.as_py(), dtype=np.float16).reshape(-1, WIDTH) for b in got["bag"]]
    del got
    return fit(bags, y)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with columns score_col (0 to 1, higher: better) and predicted_col (1 if the score >= threshold, else 0).

    Every text is scored whole; null counts as empty, and an empty text is one empty passage. Without
    a model all rows score 0.5. Other columns pass through as they are; a column of docs that is itself
    named score_col or predicted_col is replaced.
    """
    docs = docs.drop(score_col, predicted_col)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.full(b.num_rows, 0.5)
            at = names.index(text_col)
            for lo in range(0, b.num_rows if model is not None else 0, 128):
                bags = [encode(passages(t.as_py())) for t in b.column(at).slice(lo, 128)]
                starts = np.cumsum([0, *(len(x) for x in bags[:-1])])
                values[lo : lo + len(bags)] = model.score(np.concatenate(bags), starts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=[*names, score_col, predicted_col])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, null ids too. An empty table gives an empty result."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
