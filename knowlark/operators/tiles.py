"""Scores of everything for every query, by a grid of tiles: pieces of both sides meet in tasks, and the best of each leave them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text, or values of lists, of a slice of a batch, about.
TEXT, VALUES = 1 << 20, 1 << 17


def by_size(batches: Iterator[pa.RecordBatch], column: int = -1) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about TEXT bytes or VALUES values in a column, so that what is made of few rows is held at a time, however long
    the rows are; a longer row is alone."""
    for batch in batches:
        held = batch.column(column)
        text = pa.types.is_string(held.type) or pa.types.is_large_string(held.type)
        sizes = pc.fill_null(pc.binary_length(held) if text else pc.list_value_length(held), 0)
        ends, most, at = np.cumsum(np.asarray(sizes), dtype=np.int64), TEXT if text else VALUES, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def best(score: np.ndarray, chunk: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, of equal ones those of the smaller chunks."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((chunk[at], -score[at]))[:k]] if len(at) > k else at
    return np.arange(len(score))


def dealt(rows: DataFrame, key: str, mine: str, pieces: int, other: str, all_: int) -> DataFrame:
    """rows in `pieces` by the hash of key (column mine), each row once for each piece of the other side (column other)."""
    piece = F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int")
    return rows.withColumn(mine, piece).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(all_ - 1))))


def met(left: DataFrame, right: DataFrame, key: str, asked: str, down: int, across: int, each: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """each(piece of left, piece of right) for all pairs of pieces: `down` of left by key, `across` of right by asked. Both are dealt by joins, whatever
    their sizes."""
    a = dealt(left, key, "_down", down, "_across", across).groupBy("_down", "_across")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # may have been made of left
    b = dealt(right, asked, "_across", across, "_down", down).groupBy("_down", "_across")
    return a.cogroup(b).applyInArrow(each, schema)
