"""Alignment of two tokenizers over the same texts by an event sweep.

Every token of either side is an event at the byte where the token before it ends. The events of both sides are brought together by document
and sorted by place, and a sweep reads them with the two tokens that are open as its state: between two events the open tokens overlap,
which is a link, and where both sides have an event a group ends. Events travel in rows of a side's events in WINDOW bytes of a document,
so that rows stay small, and as ids alone, since an id says how long its token is; what the sweep carries from one row to the next is
the group that is open.

Links are then counted over all documents. A pair of ids stands once in each block of the input, DOCUMENTS rows or SPAN characters, so that
counts reach the documents by way of blocks, however many documents hold a pair; a block's documents are swept again where its counts are.
A task runs one Python function at a time: each worker that a task holds keeps its memory for as long as it may be used again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from knowlark.llm.common import partitions, text_of
from knowlark.llm.encoding import Joint, blocks, byte_encoder, byte_sizes, piece_encoder, sliced

#: Bytes of a document whose events share a row, documents of a block, and events that are swept at a time, about.
WINDOW, DOCUMENTS, EVENTS = 1 << 17, 512, 1 << 17
#: Characters of a block, at most; a longer document is alone.
SPAN = 1 << 22
#: Ids of side B are below it: a pair of ids is one number.
WIDE = 1 << 20
LINKS = "array<struct<a:int,b:int,times:int>>"


class Block:
    """Names the blocks of a task's rows by their first keys."""

    def __init__(self, documents: int, span: int) -> None:
        self.documents, self.span, self.name, self.n, self.held = documents, span, None, 0, 0

    def of(self, key: int, text: str) -> int:
        if self.name is None or self.n == self.documents or self.held + len(text) > self.span:
            self.name, self.n, self.held = key, 0, 0
        self.n, self.held = self.n + 1, self.held + len(text)
        return self.name


def _events(batches: Iterator[pa.RecordBatch], both: object, kind: pa.DataType, window: int, documents: int, span: int) -> Iterator[pa.RecordBatch]:
    """Event rows of rows (key, doc_id, text); a text without tokens has one row without events. `place` is the first event's, `last`
    says that the text ends behind the row's tokens."""
    names = ["block", "key", "doc_id", "window", "side", "place", "last", "n", "ids"]
    kinds = (pa.int64(), pa.int64(), kind, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
    lengths = [x.lengths for x in (both.value.a, both.value.b)]
    block = Block(documents, span)
    for batch in sliced(batches):
        keys, docs, texts = (c.to_pylist() for c in batch.columns)
        named = [block.of(key, t) for key, t in zip(keys, texts, strict=True)]
        for some in blocks(texts):
            rows: list[tuple] = []
            spaced = [" " + t if t else "" for t in texts[some]]
            sizes = byte_sizes(spaced)
            sides, good = both.value.block(spaced)
            sides = [(_begins(ids, first, own), ids, first) for (ids, first), own in zip(sides, lengths, strict=True)]
            good &= sizes > 0
            for k, row in enumerate(zip(named[some], keys[some], docs[some], strict=True)):
                if not good[k]:
                    rows.append((*row, 0, 0, 0, False, 0, b""))
                    continue
                for side, (begins, ids, first) in enumerate(sides):
                    places, mine = begins[first[k] : first[k + 1]], ids[first[k] : first[k + 1]]
                    cuts = [0, *np.searchsorted(places, np.arange(window, sizes[k], window)).tolist(), len(places)]
                    for w, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if e > s:
                            small = mine[s:e].astype(np.uint16 if len(lengths[side]) <= 1 << 16 else np.int32)
                            rows.append((*row, w, side, int(places[s]), e == len(places), e - s, pa.compress(small.tobytes(), "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _begins(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token's first byte in its text."""
    ends = np.append(0, np.cumsum(lengths[ids]))
    return ends[:-1] - np.repeat(ends[first[:-1]], np.diff(first))


class Sweep:
    """The machine over sorted events. take() gets the events of both sides of one or more documents in order, the last of which may go on."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], spelled: bool = True) -> None:
        self.lengths, self.spelled = lengths, spelled  # bytes of each side's tokens; whether groups are told as text
        # An id with what stands behind it: the next of its group and side, the other side, the next group, nothing.
        self.names = pa.array([f"{i}{s}" for i in range(max(map(len, lengths)) if spelled else 0) for s in (",", "|", ";", "")], pa.string())

    def events(self, side: int, place: int, last: bool, n: int, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and ids of a row's events. An event without a token, -1, ends the text."""
        lengths = self.lengths[side]
        kind = np.uint16 if len(lengths) <= 1 << 16 else np.int32
        mine = np.frombuffer(pa.decompress(ids, n * kind().itemsize, "zstd"), kind).astype(np.int64) if n else np.zeros(0, np.int64)
        ends = place + np.cumsum(lengths[mine])
        places = np.append(place, ends)[: n + last]
        return places, np.append(mine, -1) if last else mine

    def groups(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of events (places, ids) of both sides: the places where groups begin, each link's place and its two ids as one number, and each
        token's group."""
        (pa_, ia), (pb, ib) = a, b
        every = np.sort(np.concatenate([pa_, pb]), kind="stable")
        every = every[np.append(True, every[1:] != every[:-1])] if len(every) else every
        x, y = np.searchsorted(pa_, every, "right") - 1, np.searchsorted(pb, every, "right") - 1
        open_ = (ia[x] >= 0) & (ib[y] >= 0)
        both = open_ & (pa_[x] == every) & (pb[y] == every)
        begins = every[both]
        return begins, every[open_], (ia[x] * WIDE + ib[y])[open_], np.searchsorted(begins, pa_, "right") - 1, np.searchsorted(begins, pb, "right") - 1

    def told(self, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Groups as text, and where each group begins and ends there. last are the groups behind which nothing stands."""
        n = len(ids_a) + len(ids_b)
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        code = np.zeros(n, np.int64)
        code[at_a] = ids_a * 4 + np.append(group_a[1:] != group_a[:-1], True)
        end_b = np.append(group_b[1:] != group_b[:-1], True)
        code[at_b] = ids_b * 4 + np.where(end_b, np.where(last[group_b], 3, 2), 0)
        text = self.names.take(pa.array(code))
        offsets = np.frombuffer(text.buffers()[1], np.int32)[: n + 1]
        ends = at_b[end_b] + 1
        return text.buffers()[2].to_pybytes() if n else b"", offsets[np.append(0, ends[:-1])] if len(ends) else ends, offsets[ends]


class Rows:
    """Documents' results, from batches of event rows sorted by document, window and side."""

    def __init__(self, sweep: Sweep, kind: pa.DataType) -> None:
        self.sweep, self.kind = sweep, kind
        self.block, self.key, self.doc = None, None, None
        self.carried = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.parts: list[tuple] = []  # of the document that goes on: counts, text, pairs, times

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The documents that a batch of event rows finishes."""
        keys = batch.column(1).to_numpy()
        change = np.append(True, keys[1:] != keys[:-1])
        goes_on = self.key is not None and keys[0] == self.key
        made = [self._document(self._sum())] if self.key is not None and not goes_on else []
        index = (np.cumsum(change) - 1).tolist()
        sides: list[list[tuple]] = [[], []]
        for k, row in zip(index, zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True), strict=True):
            places, ids = self.sweep.events(*row)
            sides[row[0]].append((places + (k << 32), ids, np.full(len(ids), k)))
        if goes_on:
            for side, (places, ids) in zip(sides, self.carried, strict=True):
                side.insert(0, (places, ids, np.zeros(len(ids), np.int64)))
        none = np.zeros(0, np.int64)
        events = [tuple(np.concatenate([none, *c]) for c in zip(*side, strict=True)) if side else (none, none, none) for side in sides]
        firsts = pa.array(np.flatnonzero(change))
        made += self._settle(events, *(batch.column(c).take(firsts).to_pylist() for c in (0, 1, 2)), goes_on)
        return self._batch(made)

    def _settle(self, events: list[tuple], blocks_: list[int], keys: list[int], docs: list, goes_on: bool) -> list[tuple]:
        """Finished documents; the last one's part up to its open group is put aside, with the events of that group."""
        (pa_, ia, da), (pb, ib, db) = events
        n, last = len(keys), len(keys) - 1
        begins, at, pairs, ga, gb = self.sweep.groups((pa_, ia), (pb, ib)) if len(pa_) and len(pb) else (np.zeros(0, np.int64),) * 5
        doc_of_group = begins >> 32
        # The last document is complete only if the event that ends it was seen on both sides.
        finished = not (len(ia) and da[-1] == last) or (ia[-1] < 0 and len(ib) and ib[-1] < 0 and db[-1] == last)
        open_ = begins[-1] if len(begins) and doc_of_group[-1] == last and not finished else None
        if open_ is None and not finished:
            open_ = last << 32  # no group begins in it yet
        real_a, real_b = ia >= 0, ib >= 0
        if open_ is not None:
            real_a, real_b = real_a & (pa_ < open_), real_b & (pb < open_)
            keep = at < open_
            at, pairs = at[keep], pairs[keep]
            groups = begins < open_
            begins, doc_of_group = begins[groups], doc_of_group[groups]
        ends = np.append(doc_of_group[1:] != doc_of_group[:-1], True) if len(doc_of_group) else np.zeros(0, bool)
        if open_ is not None and len(ends) and doc_of_group[-1] == last:
            ends[-1] = False  # a group follows
        text, starts, stops = self.sweep.told(ia[real_a], ga[real_a], ib[real_b], gb[real_b], ends) if len(begins) and self.sweep.spelled else (b"", begins * 0, begins * 0)
        count = lambda d, real: np.bincount(d[real], minlength=n)
        n_a, n_b, n_groups, n_links = count(da, real_a), count(db, real_b), np.bincount(doc_of_group, minlength=n), np.bincount(at >> 32, minlength=n)
        first_group = np.append(0, np.cumsum(n_groups))
        whole, times = np.unique((at >> 32) * (WIDE * WIDE) + pairs, return_counts=True)
        first_pair = np.searchsorted(whole, np.arange(n + 1) * (WIDE * WIDE))
        pair = whole % (WIDE * WIDE)
        out = []
        for k in range(n):
            g, h = first_group[k], first_group[k + 1]
            part = (n_a[k], n_b[k], n_groups[k], n_links[k], text[starts[g] : stops[h - 1]] if h > g else b"", pair[first_pair[k] : first_pair[k + 1]], times[first_pair[k] : first_pair[k + 1]])
            if k == 0 and goes_on:
                self.parts.append(part)
                part = self._sum() if n > 1 else part
            if k < last:
                out.append((blocks_[k], docs[k], *part))
        if not (n == 1 and goes_on):
            self.parts = [part]
        self.block, self.key, self.doc = blocks_[last], keys[last], docs[last]
        cut = open_ if open_ is not None else np.iinfo(np.int64).max
        self.carried = [(p[p >= cut] & 0xFFFFFFFF, i[p >= cut]) for p, i, _ in events]
        return out

    def _sum(self) -> tuple:
        parts = self.parts
        if len(parts) == 1:
            return parts[0]
        pair, where = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True)
        times = np.bincount(where, np.concatenate([p[6] for p in parts]), len(pair)).astype(np.int64)
        return (*(sum(p[k] for p in parts) for k in range(4)), b"".join(p[4] for p in parts), pair, times)

    def _document(self, part: tuple) -> tuple:
        return (self.block, self.doc, *part)

    def rest(self) -> pa.RecordBatch:
        return self._batch([self._document(self._sum())] if self.key is not None else [])

    def _batch(self, made: list[tuple]) -> pa.RecordBatch:
        block, doc, a, b, groups, links, text, pairs, times = zip(*made, strict=True) if made else ((),) * 9
        pair = np.concatenate([np.zeros(0, np.int64), *pairs])
        columns = [pa.array(x.astype(np.int32)) for x in (pair // WIDE, pair % WIDE, np.concatenate([np.zeros(0, np.int64), *times]))]
        offsets = pa.array(np.append(0, np.cumsum([len(p) for p in pairs])).astype(np.int32))
        linked = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["a", "b", "times"]))
        counted = [pa.array([int(v) for v in x], pa.int64()) for x in (a, b, groups, links)]
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(doc, self.kind), *counted, pa.array([t.decode() for t in text], pa.string()), linked], ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def _swept(batches: Iterator[pa.RecordBatch], lengths: tuple, kind: pa.DataType, spelled: bool = True) -> Iterator[pa.RecordBatch]:
    """Documents of event rows that are sorted by document, window and side."""
    rows = Rows(Sweep(lengths, spelled), kind)
    for batch in batches:
        ends = np.cumsum(batch.column(7).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + EVENTS)))
            yield rows.batch(batch.slice(at, end - at))
            at = end
    yield rows.rest()


def _ready(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> tuple[DataFrame, str, dict]:
    """Event rows of docs, brought together by blocks of documents; the type of ids; and what a sweep needs."""
    spark = docs.sparkSession
    a, b = byte_encoder(a_path), piece_encoder(b_path)
    if max(len(a.lengths), len(b.lengths)) > WIDE:
        raise ValueError(f"vocabularies of over {WIDE} tokens")
    lengths = a.lengths, b.lengths
    both = spark.sparkContext.broadcast(Joint(a, b))
    key = F.monotonically_increasing_id()
    rows = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    schema = f"block long, key long, doc_id {name}, window int, side int, place int, last boolean, n int, ids binary"
    events = rows.mapInArrow(partial(_events, both=both, kind=arrow, window=WINDOW, documents=DOCUMENTS, span=SPAN), schema)
    return events.repartition(partitions(spark), "block"), name, {"lengths": lengths, "kind": arrow}


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: block, doc_id, n_a, n_b, n_groups, n_links, groups, links.

    A is a byte-level BPE file, over a space and the text; B a sentencepiece model, which adds the space. groups is text, `a1,a2|b1;a3|b2,b3`:
    ids of A and of B between places where tokens of both end. links are the pairs of ids whose tokens overlap, and how many times they do.
    Texts that are null or empty, or whose tokens' bytes aren't those of space and text, have no tokens: zeros and empty values. Each
    row is a document of its own, also repeated ones and those without an id; an empty table gives an empty result; other columns are
    ignored. block names rows that lie together in the input.
    """
    events, name, sweep = _ready(docs, a_path, b_path, id_col, text_col)
    schema = f"block long, doc_id {name}, n_a long, n_b long, n_groups long, n_links long, groups string, links {LINKS}"
    return _sorted(events).mapInArrow(partial(_swept, **sweep), schema)


def _sorted(events: DataFrame) -> DataFrame:
    return events.sortWithinPartitions("block", "key", "window", "side")


def _pairs(batches: Iterator[pa.RecordBatch], lengths: tuple, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(block, a, b, docs) of sorted event rows: each pair of a block once, and how many of its documents hold it."""

    def made(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        pair, docs = np.unique(np.concatenate(held), return_counts=True)
        columns = [pa.array(np.full(len(pair), block)), *(pa.array(x.astype(np.int32)) for x in (pair // WIDE, pair % WIDE, docs))]
        return pa.RecordBatch.from_arrays(columns, ["block", "a", "b", "docs"])

    now, held = None, []
    for batch in _swept(batches, lengths, kind, spelled=False):
        block, lists = batch.column("block").to_numpy(), batch.column("links")
        links, sizes = lists.flatten(), np.array(lists.value_lengths().fill_null(0))
        pair = links.field("a").to_numpy().astype(np.int64) * WIDE + links.field("b").to_numpy()
        ends = np.append(0, np.cumsum(sizes))
        edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else [0]
        for s, e in zip(edge, edge[1:], strict=False):
            if block[s] != now and held:
                yield made(now, held)
                held = []
            now = int(block[s])
            held.append(pair[ends[s] : ends[e]])
    if held:
        yield made(now, held)


def _looked_up(events: pa.Table, counts: pa.Table, lengths: tuple, kind: pa.DataType) -> pa.Table:
    """A block's documents, swept again, with the counts of their links."""
    a, b, n, best = (counts.column(c).to_numpy() for c in ("a", "b", "count", "best"))
    pair = a.astype(np.int64) * WIDE + b
    order = np.argsort(pair, kind="stable")
    pair, n, best = pair[order], n[order], best[order].astype(np.int64)
    ready = events.sort_by([(c, "ascending") for c in ("key", "window", "side")]).combine_chunks().to_batches(max_chunksize=1024)
    out = []
    for docs in _swept(ready, lengths, kind):
        links = docs.column(7)
        flat, ends = links.flatten(), np.append(0, np.cumsum(np.array(links.value_lengths(), dtype=np.int64)))
        times = flat.field("times").to_numpy().astype(np.int64)
        at = np.searchsorted(pair, flat.field("a").to_numpy().astype(np.int64) * WIDE + flat.field("b").to_numpy())
        sums = [pa.array(np.diff(np.append(0, np.cumsum(times * x[at]))[ends]), pa.int64()) for x in (best, n)]
        out.append(pa.RecordBatch.from_arrays([*docs.columns[1:7], *sums], [*docs.schema.names[1:7], "n_best", "count_sum"]))
    return pa.Table.from_batches(out)


def counted(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """align()'s rows without block and links, but with n_best and count_sum over their links. A pair's count is the number of documents that
    hold it, over all rows; a link is best if no pair with its id of A has a greater count.

    The events are shuffled once, by block, and swept twice: for the blocks' pairs, and where each block's counts have come to its events.
    """
    events, name, sweep = _ready(docs, a_path, b_path, id_col, text_col)
    pairs = _sorted(events).mapInArrow(partial(_pairs, **sweep), "block long, a int, b int, docs int")
    # A pair has a row for each block at most.
    summed = pairs.withColumn("count", F.sum("docs").over(Window.partitionBy("a", "b")))
    # A row for each id of A, whose number the vocabulary bounds. That it reads block too lets both sides of the join read one exchange of the
    # pairs: with fewer columns it would be another, and the sweep behind it run once more.
    most = F.broadcast(summed.groupBy("a").agg(F.max("count").alias("most"), F.max("block").alias("some")))
    best = (F.col("count") == F.col("most")) & F.col("some").isNotNull()
    found = summed.join(most, "a").select("block", "a", "b", "count", best.alias("best"))
    look = partial(_looked_up, **sweep)
    schema = f"doc_id {name}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return events.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda e, c: look(e, c), schema)
