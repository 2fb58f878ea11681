"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words are streamed through the automaton of all items, which tracks the longest suffix that occurs in an
item; words under a matched window are hit. Documents stay where they are read: the job has no shuffle.

Automata are compiled in tasks, each from items of a bounded number of bytes, to flat arrays, and go to the executors as bytes, one at
a time through the driver. A worker streams a bounded number of texts through one automaton after another and unites the
hits, so results don't depend on how many automata there are.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import checkpointed, text_of

#: On lower-cased UTF-8 this is `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all bytes of other characters.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text that a worker streams through one automaton before it takes the next.
BUFFER = 8 << 20


class Automaton:
    """Generalised suffix automaton over word ids, as it is built."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # (state, length, item) of each window's end
        self.names = [name for name, _ in items]
        self.shortest = window
        for k, (_, words) in enumerate(items):
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                path.append(last)
            if words:
                self.shortest = min(self.shortest, len(words))
        # Windows are found by walking each item again: later items may have split states.
        for k, (_, words) in enumerate(items):
            state, length = 0, 0
            need = min(window, len(words))
            for w in words:
                state, length = self.next[state][self.vocab[w]], length + 1
                length = min(length, self.len[state])
                while length > need or self.len[self.link[state]] >= need:
                    state, length = self._cut(state, length, need)
                if need and length == need:
                    ends.append((state, need, k))
        found: dict[int, dict[int, set[int]]] = {}
        for state, length, k in ends:
            found.setdefault(state, {}).setdefault(length, set()).add(k)
        self.found = {s: sorted((n, tuple(sorted(ks))) for n, ks in by.items()) for s, by in found.items()}
        # The nearest state on the suffix path (itself included) at which a window ends.
        self.up = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.up[s] = s if s in self.found else (self.up[self.link[s]] if s else -1)

    def _cut(self, state: int, length: int, need: int) -> tuple[int, int]:
        """The state of the last `need` words of what `state` stands for."""
        while self.len[self.link[state]] >= need:
            state = self.link[state]
        return state, need

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        at = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = at
            p = self.link[p]
        if p == -1:
            self.link[at] = 0
        else:
            q = self.next[p][c]
            self.link[at] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return at

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def compiled(self) -> Compiled:
        """Flat arrays: the first transition of each state, and a table of the further ones, which few states but the root have."""
        first, to, more = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next), {}
        for s, moves in enumerate(self.next):
            for k, (c, t) in enumerate(moves.items()):
                if k:
                    more[s << 32 | c] = t
                else:
                    first[s], to[s] = c, t
        return Compiled(self.vocab, self.names, self.shortest, first, to, more, array("i", self.link), array("i", self.len), array("i", self.up), self.found)


@dataclass
class Compiled:
    """A suffix automaton as documents are streamed through it."""

    vocab: dict[bytes, int]
    names: list[str | None]
    shortest: int
    first: array
    to: array
    more: dict[int, int]
    link: array
    len: array
    up: array
    found: dict[int, list[tuple[int, tuple[int, ...]]]]

    def scan(self, ids: list[int], at: int, hits: np.ndarray, items: set[int]) -> None:
        """Stream the known words ids, which begin at word `at` of the document; mark hits and items."""
        first, to, more, link, lens, up, found = self.first, self.to, self.more, self.link, self.len, self.up, self.found
        state = length = 0
        for i, c in enumerate(ids):
            while True:
                target = to[state] if first[state] == c else more.get(state << 32 | c, -1)
                if target >= 0 or not state:
                    break
                state = link[state]
                length = lens[state]
            if target < 0:
                length = 0
                continue
            state = target
            length += 1
            s = up[state]
            while s > 0:
                for n, ks in found[s]:
                    if n <= length:
                        hits[at + i - n + 1 : at + i + 1] = True
                        items.update(ks)
                s = up[link[s]] if link[s] > 0 else -1

    def match(self, words: list[bytes], hits: np.ndarray) -> set[str | None]:
        """Mark the hits among words; the names of items with occurring windows."""
        items: set[int] = set()
        if len(words) >= self.shortest:
            ids = list(map(self.vocab.get, words, [-1] * len(words)))
            for b, e in _runs(np.fromiter(ids, np.int64, len(ids)) >= 0, self.shortest):
                self.scan(ids[b:e], b, hits, items)
        return {self.names[k] for k in items}


def words_of(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _runs(known: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of true of at least `least`."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - b >= least:
            yield b, e


class Automata:
    """The compiled automata as broadcast bytes. Of several, a worker holds one at a time."""

    def __init__(self, parts: list) -> None:
        self.parts = parts
        self.only: Compiled | None = None

    def __getstate__(self) -> list:
        return self.parts

    def __setstate__(self, parts: list) -> None:
        self.__init__(parts)

    def _loaded(self) -> Iterator[Compiled]:
        if len(self.parts) == 1:
            self.only = self.only or pickle.loads(self.parts[0].value)
            yield self.only
            return
        for part in self.parts:
            yield pickle.loads(part.value)
            vars(part).pop("_value", None)  # the worker's copy of the bytes, which it reads again when needed

    def match(self, texts: list[str | None]) -> list[tuple[np.ndarray, set[str | None]]]:
        """Of each text, which words are hit and the names of items with occurring windows; the union over all automata."""
        out: list[tuple[np.ndarray, set[str | None]]] = []
        begin = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > BUFFER or k + 1 == len(texts):
                words = list(map(words_of, texts[begin : k + 1]))
                found = [(np.zeros(len(w), bool), set()) for w in words]
                for automaton in self._loaded():
                    for w, (hits, names) in zip(words, found, strict=True):
                        names |= automaton.match(w, hits)
                out += found
                begin, size = k + 1, 0
        return out


Batches = Iterator[pa.RecordBatch]
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _spans(hits: np.ndarray) -> list[dict[str, int]]:
    return [{"first": b, "end": e} for b, e in _runs(hits, 1)] if hits.any() else []


def _compile(table: pa.Table, window: int) -> pa.Table:
    """One row: the pickled automaton of a group's items, in a fixed order."""
    rows = sorted(set(zip(table.column("_id").to_pylist(), table.column("_text").to_pylist(), strict=True)), key=lambda r: (r[0] is None, r))
    items = [(i, w) for i, t in rows if (w := words_of(t))]
    return pa.table({"blob": pa.array([pickle.dumps(Automaton(items, window).compiled(), 5)] if items else [], pa.binary())})


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit_mb: float) -> Automata:
    """Automata of at most about limit_mb of items each, or of one longer item. An item with a null id has no name."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text")).where("_text <> ''")
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    count = max(1, math.ceil(total / (limit_mb * 1_000_000)))
    made = rows.withColumn("_group", F.pmod(F.xxhash64("_text"), F.lit(count))).groupBy("_group").applyInArrow(lambda t: _compile(t, window), "blob binary")
    made = checkpointed(made) if count > 1 else made
    # One after another: the driver holds one automaton, Spark's block manager keeps the broadcast ones on disk where memory is short.
    return Automata([spark.sparkContext.broadcast(bytes(r["blob"])) for r in made.toLocalIterator()])


def _counts(batches: Batches, automata: Automata) -> Batches:
    for batch in batches:
        rows = []
        for hits, found in automata.match(batch.column(1).to_pylist()):
            names = ",".join(sorted(n for n in found if n is not None))
            rows.append((len(hits), int(hits.sum()), len(found), hashlib.sha256(names.encode()).hexdigest(), _spans(hits)))
        n, hit, items, sha, spans = zip(*rows, strict=True) if rows else ((),) * 5
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, hit, items)), pa.array(sha, pa.string()), pa.array(spans, SPANS)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, limit_mb: float = 2
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, spans, contaminated.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `window` consecutive words of an item,
    or the whole of a shorter, non-empty item. spans lists maximal runs of hit words as (first, end).
    Null and empty texts have no words; items without words have no windows. Windows of items with a null id hit like
    others; together they count as one item, which has no name in items_sha256. Repeated items are one, texts of one id are items of
    one name. An empty benchmark hits nothing; an empty table gives an empty result. Rows are judged each for itself, repeated ones
    too; very long texts are streamed, at some tens of bytes of memory a word; other columns are ignored.

    limit_mb bounds the items of an automaton, not the benchmark: 2 MB took 2.8 s and 430 MB in the task that compiles them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<first:int,end:int>>"
    out = rows.mapInArrow(partial(_counts, automata=_automata(benchmark, item_id, item_text, window, limit_mb)), schema)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _cut(text: str, hits: np.ndarray) -> str:
    """The text without its hit words' spans."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in TOKEN.finditer(raw.lower())]
    out, last = [], 0
    for b, e in _runs(hits, 1):
        out.append(raw[last : at[b][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def cleaned(texts: list[str | None], match: Callable[[list[str | None]], list[tuple[np.ndarray, set]]], coverage: float) -> list[tuple[str | None, bool]]:
    """(text, whether it stays) of each text: hit words are cut, and again where a cut has joined words to a further hit, until there is none;
    a text of whose words more than `coverage` are cut in all goes."""
    out: list[tuple[str | None, bool]] = [(t, True) for t in texts]
    open_, total, gone = list(range(len(texts))), {}, dict.fromkeys(range(len(texts)), 0)
    while open_:
        again = []
        for k, (hits, _) in zip(open_, match([out[k][0] for k in open_]), strict=True):
            total.setdefault(k, len(hits))
            if hits.any():
                gone[k] += int(hits.sum())
                stays = gone[k] <= coverage * total[k]
                out[k] = (_cut(out[k][0], hits), stays)
                again += [k] * stays
        open_ = again
    return out


def _clean(batches: Batches, automata: Automata, column: int, coverage: float) -> Batches:
    for batch in batches:
        rows = cleaned(batch.column(column).to_pylist(), automata.match, coverage)
        text = pa.array([t for t, _ in rows], batch.schema.field(column).type)
        yield batch.set_column(column, batch.schema.field(column), text).filter(pa.array([stays for _, stays in rows], pa.bool_()))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, coverage: float = 0.5, limit_mb: float = 2) -> DataFrame:
    """docs without what the benchmark leaked: hit spans are cut from the text, and what a cut joins is judged again until nothing is hit;
    a document of whose words more than `coverage` are cut goes.

    Documents without a hit stay as they are, null and empty texts too; all columns are kept, whatever they are called, and the first
    one called text_col is cut. Repeated rows are judged each for itself. An empty benchmark or table changes nothing.
    """
    automata = _automata(benchmark, "item_id", "text", window, limit_mb)
    names = docs.columns
    own = docs.toDF(*(f"_column{k}" for k in range(len(names))))
    return own.mapInArrow(partial(_clean, automata=automata, column=names.index(text_col), coverage=coverage), own.schema).toDF(*names)
