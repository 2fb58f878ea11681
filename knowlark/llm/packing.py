"""Packing of documents' tokens into sequences of a fixed size, in order, with little padding.

The documents of a partition, in its order, are one stream of tokens, and a sequence is a window of it. Dynamic programming chooses the
windows' edges among the ends of documents and of sentences: the least cost up to an edge is that up to an earlier one, at most `size`
tokens back, plus the window's padding, plus a penalty if the edge cuts a document. Padding grows with the distance from the edge before,
so the best edge before is a minimum over a sliding window of least cost + position, which a monotone queue holds: constant time an edge.
A window whose length is a power of two needs no padding, so the edges a power of two back are tried too; what is left at a partition's
end is one padded window, or one window for each power of two in its length.

Partitions are packed by themselves, in one pass over the scan and without a shuffle; a worker holds about BLOCK tokens and one document.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from knowlark.llm.common import text_of
from knowlark.llm.encoding import blocks, sliced, word_encoder

#: Tokens of the stream whose edges are chosen together; what is behind the best edge near their end waits for the next ones.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: a sequence more, an edge at a sentence's end inside a document, an edge inside a sentence. Of the sentences that
    end in one run of `near` tokens the last is an edge; where none ends for `stride` tokens, there is one after every such number of them."""

    sequence: int = 64
    sentence: int = 8
    near: int = 32
    word: int = 64
    stride: int = 64


def edges(ends: np.ndarray, breaks: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stream where it may be cut, from 0 on, and what a cut costs there. ends are the documents' ends, breaks the sentences'."""
    run = breaks // costs.near
    at = np.union1d(breaks[np.append(run[1:] > run[:-1], True)] if len(run) else breaks, np.append(0, ends))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > costs.stride)
    more = (gaps[wide] - 1) // costs.stride
    steps = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    inside = np.repeat(at[wide], more) + steps * costs.stride
    every = np.union1d(at, inside)
    price = np.full(len(every), costs.sentence, np.int64)
    price[np.searchsorted(every, inside)] = costs.word
    price[np.searchsorted(every, np.append(0, ends))] = 0
    return every, price


def chosen(at: np.ndarray, price: np.ndarray, size: int, costs: Costs, last: bool) -> np.ndarray:
    """The windows' edges of least cost, from at[0] on: up to at[-1] if last, else up to the best edge within `size` before it."""
    n = len(at)
    powers = 2 ** np.arange(size.bit_length())
    powers = powers[powers < size]
    back = [np.searchsorted(at, at - p) for p in powers]
    met = [np.flatnonzero((at >= at[0] + p) & (at[b] == at - p)) for p, b in zip(powers, back, strict=True)]
    to = np.concatenate(met)
    order = np.argsort(to, kind="stable")
    source = np.concatenate([b[m] for b, m in zip(back, met, strict=True)])[order].tolist()
    first = np.searchsorted(to[order], np.arange(n + 1)).tolist()
    place, cost = at.tolist(), price.tolist()
    least, before = [0] * n, [0] * n  # least cost up to an edge, and the edge before it
    rising = [place[0]] + [0] * (n - 1)  # least + place
    queue = deque([0])
    for j in range(1, n):
        p = place[j]
        while place[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        found = rising[i] + size - p
        for k in range(first[j], first[j + 1]):
            if least[source[k]] < found:
                i = source[k]
                found = least[i]
        found += cost[j] + costs.sequence
        least[j], before[j], rising[j] = found, i, found + p
        while queue and rising[queue[-1]] >= found + p:
            queue.pop()
        queue.append(j)
    ends: list[int] = []
    near = [j for j in range(n - 1, -1, -1) if place[-1] - place[j] <= size]
    if last:
        rest, j = min((least[j] + _rest(place[-1] - place[j], size, costs)[0], j) for j in near)
        for length in _rest(place[-1] - place[j], size, costs)[1]:
            ends.append((ends[-1] if ends else place[j]) + length)
    else:  # windows are full but for a little, so what is left costs about its share of a sequence
        j = min((least[j] + costs.sequence * (place[-1] - place[j]) / size, -j, j) for j in near)[2]
    path = [j]
    while path[-1]:
        path.append(before[path[-1]])
    return np.array([place[k] for k in reversed(path)] + ends, np.int64)


def _rest(left: int, size: int, costs: Costs) -> tuple[int, list[int]]:
    """How the last `left` tokens are packed: padded in one sequence, or in powers of two; the cost and the lengths."""
    if not left:
        return 0, []
    parts = [1 << k for k in reversed(range(left.bit_length())) if left >> k & 1]
    ways = [(size - left + costs.sequence, [left]), (len(parts) * costs.sequence + (len(parts) - 1) * costs.word, parts)]
    return min(ways)


class Packer:
    """A partition's stream: documents go in, pieces of finished windows come out."""

    def __init__(self, size: int, costs: Costs, block: int) -> None:
        self.size, self.costs, self.block = size, costs, block
        self.docs: list[tuple[object, int, np.ndarray, np.ndarray]] = []  # id, tokens given out before, all tokens, sentences' ends
        self.held, self.windows = 0, count()

    def add(self, doc: object, ids: np.ndarray, breaks: np.ndarray) -> list[tuple]:
        self.docs.append((doc, 0, ids, breaks))
        self.held += len(ids)
        return self.out(False) if self.held >= self.block else []

    def out(self, last: bool) -> list[tuple]:
        """(doc, start, ids, doc_tokens, window, offset) of the windows whose edges are settled."""
        if not self.docs:
            return []
        done = np.array([d[1] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs] - done)
        begins = np.append(0, ends[:-1])
        breaks = np.concatenate([b[b > d] - d + s for (_, d, _, b), s in zip(self.docs, begins, strict=True)])
        cuts = chosen(*edges(ends, breaks, self.costs), self.size, self.costs, last)
        number = [next(self.windows) for _ in cuts[1:]]
        marks = np.union1d(cuts, ends[ends < cuts[-1]])
        doc_of, window_of = np.searchsorted(ends, marks[:-1], "right"), np.searchsorted(cuts, marks[:-1], "right") - 1
        made = []
        for b, e, k, w in zip(marks[:-1].tolist(), marks[1:].tolist(), doc_of.tolist(), window_of.tolist(), strict=True):
            doc, before, ids, _ = self.docs[k]
            start = b - int(begins[k]) + before
            made.append((doc, start, ids[start : start + e - b], len(ids), number[w], b - int(cuts[w])))
        k = int(np.searchsorted(ends, cuts[-1], "right"))
        if k < len(self.docs):
            doc, before, ids, breaks = self.docs[k]
            self.docs = [(doc, before + int(cuts[-1] - begins[k]), ids, breaks), *self.docs[k + 1 :]]
        else:
            self.docs = []
        self.held = int(ends[-1] - cuts[-1])
        return made


def _pieces(batches: Iterator[pa.RecordBatch], encoder: object, size: int, end: int, costs: Costs, block: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    packer, base = Packer(size, costs, block), TaskContext.get().partitionId() << 33
    for batch in sliced(batches):
        docs, texts = (c.to_pylist() for c in batch.columns)
        for some in blocks(texts):
            made: list[tuple] = []
            ids, tokens, sizes, marks, counts = encoder.value.block(texts[some])
            token_ends, ends = np.cumsum(tokens), np.cumsum(sizes)
            first = np.append(0, np.cumsum(counts))
            for k, doc in enumerate(docs[some]):
                b = int(token_ends[k] - tokens[k])
                mine = slice(first[k], first[k + 1])
                made += packer.add(doc, np.append(ids[b : token_ends[k]], np.uint32(end)), ends[mine][marks[mine]] - b)
            yield from _rows(made, base, kind)
    yield from _rows(packer.out(True), base, kind)


def _rows(made: list[tuple], base: int, kind: pa.DataType, most: int = 4096) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(made), most):
        doc, start, ids, tokens, window, offset = zip(*made[k : k + most], strict=True)
        columns = [
            pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            pa.array(tokens, pa.int64()), pa.array([base + w for w in window], pa.int64()), pa.array(offset, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 2, costs: Costs = Costs(), block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset in the sequence.

    A document's tokens are those of the tokenizer file at path, which the driver reads and broadcasts, and `end` behind them. Sequences
    hold at most `size` tokens; those whose length is not a power of two are to be padded to it. Null texts are empty: their token is
    `end`. Each row is a document of its own, also repeated ones and those without an id; an empty table has no pieces; other columns are
    ignored. Sequence ids are numbered within the partitions of docs, so rows must lie in them as before when a task runs again, as files do.
    """
    spark = docs.sparkSession
    encoder = spark.sparkContext.broadcast(word_encoder(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(partial(_pieces, encoder=encoder, size=size, end=end, costs=costs, block=block, kind=to_arrow_type(kind)), schema)


def sequences(pieces: DataFrame, size: int = 4096, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array, segments array, n_tokens) of pack()'s pieces, padded to size unless the length is a power of two. segments
    numbers the documents of a sequence from 1, for attention masks; padding is 0. A sequence has at most size pieces."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, segments, lengths = [], [], []
            for parts in batch.column(1).to_pylist():
                got = [np.frombuffer(p["ids"], "<u4") for p in parts]
                tokens = np.concatenate(got)
                wide = len(tokens) if len(tokens).bit_count() == 1 else size
                fill = wide - len(tokens)
                ids.append(np.append(tokens, np.full(fill, pad)).astype(np.int32))
                segments.append(np.append(np.repeat(np.arange(1, len(got) + 1), list(map(len, got))), np.zeros(fill)).astype(np.int32))
                lengths.append(len(tokens))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, ints), pa.array(segments, ints), pa.array(lengths, pa.int32())], ["sequence_id", "ids", "segments", "n_tokens"])

    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(each, "sequence_id long, ids array<int>, segments array<int>, n_tokens int")
