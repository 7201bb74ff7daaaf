"""Token counts of whole texts and of all their prefixes, stored once and asked without re-encoding."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PrefixCounts, truncation_point

LIMIT = 512


@functools.cache
def _counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def count_tokens(docs: DataFrame, path: str, budget: int = LIMIT, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_store: bool = False) -> DataFrame:
    """`keep` columns and n_bytes, n_tokens, fits: the most leading code points within `budget` tokens.

    with_store adds `store`, binary: the int8 change of the token count at each code point, from which
    prefix_counts() and truncation_point() answer any later budget. A text whose pieces
    cannot be aligned with the library's has a null store, and a null `fits` unless all of it is within the budget. Null text counts as empty: 0
    bytes, 0 tokens. One row for each row of docs; other columns are ignored.
    """
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("fits", "long")
    if with_store:
        schema = schema.add("store", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            sizes, tokens, fits, stores = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                store = counter.store(text)
                sizes.append(len(text.encode()))
                tokens.append(int(store.sum(dtype=np.int64)))
                known = store.dtype == np.int8
                fits.append(len(text) if tokens[-1] <= budget else truncation_point(store, budget) if known else None)
                if with_store:
                    stores.append(store.tobytes() if store.dtype == np.int8 else None)
            arrays = [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())]
            if with_store:
                arrays.append(pa.array(stores, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
