"""Suffix-array dedup: removal of byte strings of threshold length that also start earlier in the corpus.

Suffixes are ordered only through the threshold length, by most-significant-digit passes, and equal groups are the repeated
windows. A digit is the fingerprint of a run of bytes instead of one byte, so that skewed first letters don't make skewed
buckets, and a pass goes on only with suffixes whose group isn't settled:

1. Digit one of a window is its anchor, the window's gram with the least hash. It depends on the window alone, so equal windows
   share it, and a text has one anchor in some 35 bytes. A bucket of one settles all its windows as unique.
2. Digit two is the anchor with all bytes that its windows can reach. Equal ones repeat each other window by window; a bucket
   with a single value of it is settled.
3. Digit three, for anchors that stand in several contexts, is the core that neighbouring windows of an anchor have in common, and
   the last digit is the window. What is dealt are the pieces of text that such neighbours cover.

Buckets are dealt by digit, sorted there, and the first of each equal group (smaller document, then earlier start) stays.
Each task combines equal values before the shuffle, so a passage in a third of all rows is a row for each task. An anchor that stands in
very many different contexts (the edge of a licence line) is dealt by its context, and windows of it by the windows themselves.

Fingerprints find equal bytes and never miss any; that bytes are equal is checked at the end: every removed run names the earlier
place that it repeats, the SHA-256 of its bytes goes to that place's document, and is compared with that of the bytes there. If one
differs, fingerprints have collided, and all is done again with other bases.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowlark.llm.common import checkpointed, partitions, text_of

#: Bytes that are fingerprinted at once, and bytes of text after which a task combines and sends what it has.
BLOCK, FLUSH = 1 << 20, 1 << 24
#: Odd multipliers and mixing constants of the fingerprints (any odd numbers do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
ANCHORS, COVERED, OPEN, PIECES, SEEN, WINDOWS = range(6)
#: Windows that share a core and travel as one piece of text.
TOGETHER = 17
NONE = np.iinfo(np.int64).max
U64 = np.uint64


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.full(n + 1, b, U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


@functools.cache
def _letters(base: int) -> np.ndarray:
    return np.random.default_rng(base & 0xFFFF).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)


def _mixed(x: np.ndarray, constant: int) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(constant)
    return x ^ (x >> U64(29))


class Sums:
    """Prefix sums of a buffer; of(begin, end) are the fingerprints of its substrings."""

    def __init__(self, buffer: np.ndarray, base: int) -> None:
        size = 1 << max(20, int(len(buffer)).bit_length())
        power, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(buffer) + 1, U64)
        np.cumsum(_letters(base)[buffer] * power[: len(buffer)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]


class Shape:
    """Window length and gram length; reach is how far before its anchor a window can start. round_ numbers the attempt, which has its own
    bases; mask is the bits that fingerprints keep; hot are the grams that are dealt by context."""

    def __init__(self, length: int, gram: int, block: int = BLOCK, flush: int = FLUSH, round_: int = 0, mask: int = (1 << 64) - 1) -> None:
        self.length, self.gram, self.reach, self.block, self.flush = length, gram, length - gram, block, flush
        self.bases = [(b + 0x5851F42D4C957F2E * round_) & ((1 << 64) - 1) for b in BASES]
        self.mask, self.hot = U64(mask), np.zeros(0, U64)

    def grams_of(self, sums: Sums, anchor: np.ndarray) -> np.ndarray:
        return _mixed(sums.of(anchor, anchor + self.gram), MIX[0]) & self.mask

    def windows_of(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the windows that start at place."""
        return tuple(_mixed(Sums(text, b).of(place, place + self.length), m) & self.mask for b, m in zip(self.bases, MIX, strict=True))

    def segments(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int, int]]]:
        """Blocks of (text, first byte, end byte, first window, end window); long texts are cut into pieces that overlap."""
        block, size = [], 0
        for k, text in enumerate(texts):
            windows = len(text) - self.length + 1
            for low in range(0, max(0, windows), self.block):
                high = min(windows, low + self.block)
                begin, end = max(0, low - self.reach), min(len(text), high + self.length + self.reach)
                if block and size + end - begin > self.block:
                    yield block
                    block, size = [], 0
                block.append((k, begin, end, low, high))
                size += end - begin
        if block:
            yield block

    def anchored(self, texts: list[bytes], block: list) -> tuple[Sums, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block: its sums, each segment's place in it, the places of its windows, and those of their anchors."""
        buffer = np.frombuffer(b"".join(texts[k][b:e] for k, b, e, _, _ in block), np.uint8)
        base = np.cumsum([0, *(e - b for _, b, e, _, _ in block)])
        sums = Sums(buffer, self.bases[0])
        keys = _mixed(sums.grams(self.gram), MIX[0]) & U64(0xFFFFFFFF00000000) | np.arange(len(buffer) - self.gram + 1, dtype=U64)
        span, have = self.reach + 1, 1
        while have < span:  # least of 1, 2, 4, ... keys; the last step overlaps
            step = min(have, span - have)
            keys = np.minimum(keys[:-step], keys[step:])
            have += step
        valid = np.zeros(len(keys), bool)
        for at, (_, b, _, low, high) in zip(base[:-1].tolist(), block, strict=True):
            valid[at + low - b : at + high - b] = True
        places = np.flatnonzero(valid)
        return sums, base, places, (keys[places] & U64(0xFFFFFFFF)).astype(np.int64)


def _pack(kind: int, *columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of one length; signed ones (documents, starts) as differences, which compress well."""
    parts = [c if c.dtype == U64 else np.diff(c, prepend=0) for c in columns]
    raw = b"".join([*(np.ascontiguousarray(p).tobytes() for p in parts), tail])
    types = "".join("u" if c.dtype == U64 else "i" for c in columns).encode()
    return struct.pack("<BBQQ", kind, len(columns), len(columns[0]), len(raw)) + types + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    _, count, n, size = struct.unpack_from("<BBQQ", blob)
    head = struct.calcsize("<BBQQ")
    types = blob[head : head + count]
    raw = pa.decompress(blob[head + count :], decompressed_size=size, codec="zstd", asbytes=True)
    parts = np.frombuffer(raw, np.int64, n * count).reshape(count, n)
    return [p.view(U64) if t == ord("u") else np.cumsum(p) for p, t in zip(parts, types, strict=True)], raw[8 * n * count :]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, blobs = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _part(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The part of each document, as Spark's xxhash64 gives it (XXH64 of eight bytes, seed 42)."""
    one, two, three, four, five = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << U64(n)) | (x >> U64(64 - n))

    h = (U64(42) + five + U64(8)) ^ (turned(doc.astype(np.int64).view(U64) * two, 31) * one)
    h = turned(h, 27) * one + four
    h = (h ^ (h >> U64(33))) * two
    h = (h ^ (h >> U64(29))) * three
    return ids[(h ^ (h >> U64(32))).view(np.int64) % len(ids)]


def _grouped(part: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each part, in the given order."""
    if len(part):
        order = np.argsort(part, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(part[order])) + 1)


def _split(kind: int, part: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """One blob for each part, rows in the given order."""
    return [(int(part[r[0]]), _pack(kind, *(c[r] for c in columns))) for r in _grouped(part)]


def _bytes_of(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of buffer one after another."""
    ends = np.cumsum(size)
    return buffer[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def _named(place: list[np.ndarray], rest: np.ndarray, first: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """Places rest (document, number, start) and what they repeat: the document and number of first, and how far its start is from theirs.
    n: windows from each start. In order of places."""
    (doc, copy, at), (d, c, a) = ([x[k] for x in place] for k in (rest, first))
    columns = [doc, copy, at, *([] if n is None else [n[rest]]), d, c, a - at]
    back = np.lexsort((at, copy, doc))
    return [x[back] for x in columns]


def _runs(doc: np.ndarray, copy: np.ndarray, at: np.ndarray, *same: np.ndarray) -> list[np.ndarray]:
    """Single windows, in order, as (document, number, first start, windows, ...) of consecutive starts that repeat one place."""
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    return [doc[begin], copy[begin], at[begin], np.diff(begin, append=len(at)), *(x[begin] for x in same)]


def _first(keys: tuple[np.ndarray, np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys, then place (document, its number among rows of one id, start). Returns the order, where a new pair of
    keys begins, the first of each one's group, and which are later places than that."""
    order = np.lexsort((*place[::-1], keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    begins = np.ones(len(order), bool)
    begins[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(begins) - 1
    heads = np.flatnonzero(begins)
    later = np.zeros(len(order), bool)
    for c in place:
        c = c[order]
        later |= c != c[heads][group]
    return order, begins, order[heads][group], later


def _dealt(gram: np.ndarray, context: np.ndarray, shape: Shape, ids: np.ndarray) -> np.ndarray:
    """Parts of anchors: by gram, hot ones by context."""
    by = np.where(np.isin(gram, shape.hot), context, gram)
    return ids[(by % U64(len(ids))).astype(np.int64)]


def _scan(batches: Iterator[pa.RecordBatch], shape: Shape, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Digit one and two of all anchors of a task's documents, equal ones combined."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        gram, context, doc, copy, at = (np.concatenate(c) for c in zip(*held, strict=True))
        order, begins, first, later = _first((gram, context), [doc, copy, at])
        covered = _named([doc, copy, at], order[later], first[later])
        keep = np.sort(order[begins])
        rows = _split(COVERED, _part(covered[0], ids), covered)
        rows += _split(ANCHORS, _dealt(gram[keep], context[keep], shape, ids), [gram[keep], context[keep], doc[keep], copy[keep], at[keep]])
        yield _batch(rows)

    for found in _anchors(batches, shape):
        if found is not None:
            held.append(found)
        elif held:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _anchors(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[np.ndarray, ...] | None]:
    """(gram, context, document, number, start) of the anchors of each block; None after each `flush` bytes of text."""
    size = 0
    for batch in batches:
        docs, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        last = (-1, -1)
        for block in shape.segments(texts):
            sums, base, _, anchor = shape.anchored(texts, block)
            anchor = anchor[np.diff(anchor, prepend=-1) != 0]
            segment = np.searchsorted(base, anchor, "right") - 1
            meta = np.array(block, np.int64)
            text, begin = meta[segment, 0], meta[segment, 1]
            shift = base[segment] - begin
            at = anchor - shift
            if len(at) and (int(text[0]), int(at[0])) == last:  # the anchor that two pieces of a text share
                anchor, segment, text, shift, at = anchor[1:], segment[1:], text[1:], shift[1:], at[1:]
            inside = np.ones(len(at), bool)
            inside[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
            anchor, text, shift, at = anchor[inside], text[inside], shift[inside], at[inside]
            if not len(at):
                continue
            last = (int(text[-1]), int(at[-1]))
            sizes = np.fromiter((len(texts[k]) for k, *_ in block), np.int64)
            n = dict(zip((k for k, *_ in block), sizes.tolist(), strict=True))
            length = np.fromiter((n[k] for k in text.tolist()), np.int64, len(text))
            low = np.maximum(0, at - shape.reach)
            high = np.minimum(at, length - shape.length) + shape.length
            other = Sums(np.frombuffer(b"".join(texts[k][b:e] for k, b, e, _, _ in block), np.uint8), shape.bases[1])
            context = _mixed(other.of(low + shift, high + shift) + ((at - low) * 1_000_003 + high - low).astype(U64), MIX[1]) & shape.mask
            yield shape.grams_of(sums, anchor), context, docs[text], copies[text], at
        size += sum(map(len, texts))
        if size >= shape.flush:
            yield None
            size = 0


def _sampled(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """(gram, context) of anchors, each once in a block."""
    for found in _anchors(batches, shape):
        if found is not None:
            both = np.unique(np.stack(found[:2], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["gram", "context"])


def _gathered(batches: Iterator[pa.RecordBatch], kind: int, others: list[tuple[int, bytes]]) -> tuple[list[np.ndarray], bytes] | None:
    """The columns and tails of this kind; blobs of other kinds go to others."""
    held, tails = [], []
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blob[0] == kind:
                columns, tail = _unpack(blob)
                held.append(columns)
                tails.append(tail)
            else:
                others.append((part, blob))
    return ([np.concatenate(c) for c in zip(*held, strict=True)], b"".join(tails)) if held else None


def _settle_anchors(batches: Iterator[pa.RecordBatch], shape: Shape, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes]] = []
    got = _gathered(batches, ANCHORS, rows)
    if got is not None:
        gram, context, doc, copy, at = got[0]
        order, begins, first, later = _first((gram, context), [doc, copy, at])
        heads = order[begins]
        g = gram[heads]
        same = np.isin(g, shape.hot)  # whether they have other contexts isn't known here
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= g[1:] == g[:-1]
        # One blob to a part: documents, whether the anchor is covered or open, and what a covered one repeats.
        open_ = heads[same]
        rest, named = np.concatenate([order[later], open_]), np.concatenate([first[later], open_])
        which = np.zeros(len(doc), np.int64)
        which[rest] = COVERED
        which[open_] = OPEN
        columns = _named([doc, copy, at], rest, named, which)
        rows += _split(OPEN, _part(columns[0], ids), columns)
    yield _batch(rows)


def _by_document(records: pa.Table) -> dict[int, dict[tuple[int, int], np.ndarray]]:
    """Rows of (start,) of open anchors, (start, document, number, distance) of covered ones, and (start, windows, document, number, distance)
    of windows, by kind and (document, number)."""
    held: dict[int, list[np.ndarray]] = {COVERED: [], OPEN: [], SEEN: []}
    for blob in records.column("blob").to_pylist():
        columns = np.stack(_unpack(blob)[0])
        if blob[0] == OPEN:
            held[COVERED].append(columns[:, columns[3] == COVERED][[0, 1, 2, 4, 5, 6]])
            held[OPEN].append(columns[:3, columns[3] == OPEN])
        else:
            held[blob[0]].append(columns)
    found: dict[int, dict[tuple[int, int], np.ndarray]] = {}
    for kind, parts in held.items():
        of = found[kind] = {}
        if parts:
            all_ = np.concatenate(parts, axis=1)
            all_ = all_[:, np.lexsort(all_[2::-1])]
            cuts = np.flatnonzero((np.diff(all_[0]) != 0) | (np.diff(all_[1]) != 0)) + 1
            for columns in np.split(all_, cuts, axis=1):
                if columns.shape[1]:
                    of[int(columns[0, 0]), int(columns[1, 0])] = columns[2:]
    return found


def _open_windows(docs: pa.Table, records: pa.Table, shape: Shape, ids: np.ndarray) -> pa.Table:
    """Pieces of text under windows whose anchors stand in several contexts, equal pieces combined."""
    found = _by_document(records)
    held: list[tuple[np.ndarray, ...]] = []
    single: list[tuple[np.ndarray, ...]] = []
    texts: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    for doc, copy, text in zip(docs.column("_doc").to_pylist(), docs.column("_copy").to_pylist(), docs.column("_text").to_pylist(), strict=True):
        key = (doc, copy)
        open_ = found[OPEN].get(key)
        if open_ is None or key in seen:  # a repeated row is the same document
            continue
        seen.add(key)
        open_ = open_[0]
        raw = text.encode("utf-8", "surrogatepass")
        done = np.zeros(len(raw) + 1, np.int32)
        if (covered := found[COVERED].get(key)) is not None:
            np.add.at(done, np.maximum(0, covered[0] - shape.reach), 1)
            np.add.at(done, covered[0] + 1, -1)
        done = np.cumsum(done) > 0
        for block in shape.segments([raw]):
            sums, _, places, anchor = shape.anchored([raw], block)
            begin = block[0][1]
            mine = np.minimum(np.searchsorted(open_, anchor + begin), len(open_) - 1)
            take = (open_[mine] == anchor + begin) & ~done[places + begin]
            places, anchor = places[take], anchor[take]
            if len(shape.hot) and len(places):
                hot = np.isin(shape.grams_of(sums, anchor), shape.hot)
                place = places[hot]
                if len(place):
                    one, two = shape.windows_of(np.frombuffer(raw[begin : block[0][2]], np.uint8), place)
                    single.append((one, two, np.full(len(place), doc), np.full(len(place), copy), place + begin))
                places, anchor = places[~hot], anchor[~hot]
            if not len(places):
                continue
            core = anchor - (anchor - places) // TOGETHER * TOGETHER
            new = np.ones(len(places), bool)
            new[1:] = (core[1:] != core[:-1]) | (places[1:] != places[:-1] + 1)
            head = np.flatnonzero(new)
            n = np.diff(head, append=len(places))
            core, place = core[head], places[head]
            end = place + n - 1 + shape.length
            one = _mixed(sums.of(core, core + shape.length - TOGETHER + 1), MIX[0]) & shape.mask
            two = _mixed(sums.of(place, end) + ((core - place) * 1_000_003 + n).astype(U64), MIX[1]) & shape.mask
            held.append((one, two, np.full(len(n), doc), np.full(len(n), copy), place + begin, n))
            texts.append(_bytes_of(np.frombuffer(raw[begin : block[0][2]], np.uint8), place, n - 1 + shape.length))
    rows: list[tuple[int, bytes]] = []
    if held:
        one, two, doc, copy, at, n = (np.concatenate(c) for c in zip(*held, strict=True))
        buffer = np.concatenate(texts)
        size = n - 1 + shape.length
        from_ = np.cumsum(size) - size
        order, begins, first, later = _first((one, two), [doc, copy, at])
        rows += _seen(_named([doc, copy, at], order[later], first[later], n), ids)
        keep = np.sort(order[begins])
        part = ids[(one[keep] % U64(len(ids))).astype(np.int64)]
        for r in _grouped(part):
            k = keep[r]
            rows.append((int(part[r[0]]), _pack(PIECES, one[k], two[k], doc[k], copy[k], at[k], n[k], tail=_bytes_of(buffer, from_[k], size[k]).tobytes())))
    if single:
        one, two, doc, copy, at = (np.concatenate(c) for c in zip(*single, strict=True))
        order, begins, first, later = _first((one, two), [doc, copy, at])
        rows += _seen(_runs(*_named([doc, copy, at], order[later], first[later])), ids)
        keep = np.sort(order[begins])
        rows += _split(WINDOWS, ids[(one[keep] % U64(len(ids))).astype(np.int64)], [one[keep], two[keep], doc[keep], copy[keep], at[keep]])
    return pa.Table.from_batches([_batch(rows)])


def _seen(columns: list[np.ndarray], ids: np.ndarray) -> list[tuple[int, bytes]]:
    return _split(SEEN, _part(columns[0], ids), columns)


def _settle_windows(batches: Iterator[pa.RecordBatch], shape: Shape, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    others: list[tuple[int, bytes]] = []
    got = _gathered(batches, PIECES, others)
    single = [_unpack(blob)[0] for _, blob in others if blob[0] == WINDOWS]
    rows = [r for r in others if r[1][0] != WINDOWS]
    seen: list[list[np.ndarray]] = []
    if single:
        one, two, doc, copy, at = (np.concatenate(c) for c in zip(*single, strict=True))
        order, _, first, later = _first((one, two), [doc, copy, at])
        seen.append(_runs(*_named([doc, copy, at], order[later], first[later])))
    if got is not None:
        (one, two, doc, copy, at, n), tail = got
        buffer = np.frombuffer(tail, np.uint8)
        size = n - 1 + shape.length
        from_ = np.cumsum(size) - size
        order, begins, first, later = _first((one, two), [doc, copy, at])
        seen.append(_named([doc, copy, at], order[later], first[later], n))
        # Of a core's different pieces, compare the windows; a core with one piece is settled.
        heads = order[begins]
        core = one[heads]
        same = np.zeros(len(heads), bool)
        same[1:] = core[1:] == core[:-1]
        same[:-1] |= core[1:] == core[:-1]
        heads = heads[same]
        # Cores come in order, so chunks of whole cores bound what is expanded at once.
        cuts = np.flatnonzero(np.diff(np.cumsum(size[heads]) // shape.block)) + 1
        core = one[heads]
        cuts = np.unique([int(np.searchsorted(core, core[c], "left")) for c in cuts]) if len(cuts) else cuts
        for h in np.split(heads, cuts.astype(np.int64)):
            if not len(h):
                continue
            text = _bytes_of(buffer, from_[h], size[h])
            base = np.cumsum(size[h]) - size[h]
            step = np.arange(int(n[h].sum())) - np.repeat(np.cumsum(n[h]) - n[h], n[h])
            keys = shape.windows_of(text, np.repeat(base, n[h]) + step)
            where = [np.repeat(doc[h], n[h]), np.repeat(copy[h], n[h]), np.repeat(at[h], n[h]) + step]
            order, _, first, later = _first(keys, where)
            seen.append(_runs(*_named(where, order[later], first[later])))
    if seen:
        columns = [np.concatenate(c) for c in zip(*seen, strict=True)]
        back = np.lexsort((columns[2], columns[1], columns[0]))
        rows += _seen([c[back] for c in columns], ids)
    yield _batch(rows)


#: Result rows, and claims that bytes of a document (sha of size bytes from begin) repeat an earlier place.
OUT = pa.schema([
    ("part", pa.int32()), ("claim", pa.bool_()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("doc", pa.int64()), ("copy", pa.int64()), ("begin", pa.int64()), ("size", pa.int64()), ("sha", pa.binary()),
])
OUT_DDL = "part int, claim boolean, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, doc long, copy long, begin long, size long, sha binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ((),) * len(OUT)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def _claims(begin: np.ndarray, end: np.ndarray, doc: np.ndarray, copy: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(first byte, end byte, document, number, distance) of what is claimed, ranges that repeat one place in one piece."""
    order = np.lexsort((begin, shift, copy, doc))
    rows = np.stack([c[order] for c in (begin, end, doc, copy, shift)], axis=1).tolist()
    k = 0
    while k < len(rows):
        b, e, *same = rows[k]
        k += 1
        while k < len(rows) and rows[k][2:] == same and rows[k][0] <= e:
            e = max(e, rows[k][1])
            k += 1
        yield b, e, *same


def _removed(docs: pa.Table, records: pa.Table, shape: Shape, ids: np.ndarray) -> pa.Table:
    """A result for each row, and the claims of its removals for the documents that they name. What a document repeats of itself is
    compared at once; a difference becomes a claim that no document can meet."""
    found = _by_document(records)
    rows: list[tuple] = []
    claims: set[tuple] = set()
    for part, i, doc, copy, text in zip(*(docs.column(c).to_pylist() for c in ("part", "doc_id", "_doc", "_copy", "_text")), strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        mark = np.zeros(len(raw) + 1, np.int32)
        ranges = []
        if (got := found[COVERED].get((doc, copy))) is not None:
            at, *named = got
            ranges.append([np.maximum(0, at - shape.reach), np.minimum(at, len(raw) - shape.length) + shape.length, *named])
        if (got := found[SEEN].get((doc, copy))) is not None:
            at, n, *named = got
            ranges.append([at, at + n - 1 + shape.length, *named])
        if ranges:
            begin, end, *named = (np.concatenate(c) for c in zip(*ranges, strict=True))
            np.add.at(mark, begin, 1)
            np.add.at(mark, end, -1)
            for b, e, d, c, shift in _claims(begin, end, *named):
                if (d, c) == (doc, copy):
                    if raw[b:e] != raw[b + shift : e + shift]:
                        claims.add((d, c, -1, e - b, b""))
                else:
                    claims.add((d, c, b + shift, e - b, hashlib.sha256(raw[b:e]).digest()))
        gone = np.cumsum(mark) > 0
        edges = np.flatnonzero(np.diff(gone, prepend=False))
        spans = [{"start": b, "end": e} for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes() if spans else raw
        rows.append((part, False, i, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, None, None, None, None, None))
    if claims:
        listed = sorted(claims)
        parts = _part(np.array([c[0] for c in listed]), ids).tolist()
        rows += [(p, True, None, None, None, None, None, None, *c) for p, c in zip(parts, listed, strict=True)]
    return _table(rows)


def _verified(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The results, and those claims that the bytes of their document don't bear out."""
    mask = pa.compute.fill_null(found.column("claim"), False)
    claims: dict[tuple[int, int], list[tuple]] = {}
    for d, c, *rest in zip(*(found.filter(mask).column(c).to_pylist() for c in ("doc", "copy", "begin", "size", "sha")), strict=True):
        claims.setdefault((d, c), []).append(tuple(rest))
    wrong: list[tuple] = []
    places = list(zip(docs.column("_doc").to_pylist(), docs.column("_copy").to_pylist(), strict=True))
    at = {p: k for k, p in enumerate(places) if p in claims}
    for place, asked in claims.items():
        raw = docs.column("_text")[at[place]].as_py().encode("utf-8", "surrogatepass") if place in at else b""
        for begin, size, sha in set(asked):
            if begin < 0 or begin + size > len(raw) or hashlib.sha256(raw[begin : begin + size]).digest() != sha:
                wrong.append((None, True, None, None, None, None, None, None, *place, begin, size, sha))
    results = found.filter(pa.compute.invert(mask)).select(OUT.names).cast(OUT)
    return pa.concat_tables([results, _table(wrong)])


def _part_ids(spark: SparkSession, count: int) -> list[int]:
    """For each of count hash partitions a number that Spark deals to it, so that parts and partitions are the same."""
    tried = spark.range(0, 64 * count, 1, 1).select(F.col("id").cast("int").alias("id"))
    found = tried.groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("at")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found, key=lambda r: r["at"])]


def _hot_grams(rows: DataFrame, shape: Shape, count: int, sample: int, least: int) -> np.ndarray:
    """Grams that stand in so many contexts that their part would be four times as large as others. They are looked for in one document of
    `sample`: a gram that is missed, or taken for hot, costs time and nothing else."""
    some = rows.where(F.pmod(F.xxhash64("_doc", F.lit(sample)), F.lit(sample)) == 0).select("_doc", "_copy", "_text")
    pairs = some.mapInArrow(partial(_sampled, shape=shape), "gram long, context long").distinct()
    sizes = checkpointed(pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") > max(least // sample, total // (4 * count))).select("gram").collect()  # 4 x count at most
    return np.sort(np.array([r["gram"] for r in hot], np.int64).view(U64))


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, block: int = BLOCK, flush: int = FLUSH, sample: int = 64, hot: int = 20_000, bits: int = 64, attempts: int = 4
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of (start, end) removed bytes.

    Texts are UTF-8 bytes, null texts empty; a byte goes if a string of `length` bytes that covers it also starts
    earlier: in a document of smaller id, or earlier in the same one. Matches don't cross documents. Ids are integers;
    a null id comes after all others. Rows of one id and one text are the same document, and each gets its result; rows of
    one id with different texts are different documents in the order of the texts' hashes. Texts under `length`
    keep all; very long ones are worked on in blocks. An empty table gives an empty result; other columns are ignored.

    Tasks hold one shuffle partition of fingerprints, or of texts with their results, so spark.sql.shuffle.partitions should follow the
    input's size. bits of the fingerprints are kept in the first attempt, all in the others; each has its own bases.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    numbers = _part_ids(spark, count)
    ids = np.array(numbers)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text")).withColumn("_doc", F.coalesce("doc_id", F.lit(NONE)))
    if rows.groupBy("_doc").count().where("count > 1").limit(1).count():
        rows = rows.withColumn("_hash", F.xxhash64("_text"))
        number = rows.select("_doc", "_hash").distinct().withColumn("_copy", F.row_number().over(Window.partitionBy("_doc").orderBy("_hash")).cast("long"))
        rows = rows.join(number, ["_doc", "_hash"]).drop("_hash")
    else:
        rows = rows.withColumn("_copy", F.lit(1).cast("long"))
    dealt = rows.withColumn("part", F.element_at(F.lit(numbers), (F.pmod(F.xxhash64("_doc"), F.lit(len(numbers))) + 1).cast("int"))).repartition(count, "part")
    for attempt in range(attempts):
        shape = Shape(length, gram, block, flush, attempt, (1 << (64 if attempt else bits)) - 1)
        shape.hot = _hot_grams(rows, shape, count, sample, hot)
        out = checkpointed(_attempt(rows, dealt, shape, ids, count))
        if not out.where("claim").limit(1).count():
            return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    raise RuntimeError(f"fingerprints collided in each of {attempts} attempts")


def _attempt(rows: DataFrame, dealt: DataFrame, shape: Shape, ids: np.ndarray, count: int) -> DataFrame:
    """Results, and claims that turned out wrong. The texts are dealt once and read three times."""
    schema = "part int, blob binary"
    found = rows.select("_doc", "_copy", "_text").mapInArrow(partial(_scan, shape=shape, ids=ids), schema)
    anchors = checkpointed(found.repartition(count, "part").mapInArrow(partial(_settle_anchors, shape=shape, ids=ids), schema))
    by_part = dealt.groupBy("part")

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        return _open_windows(left, right, shape, ids)

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        return _removed(left, right, shape, ids)

    open_ = by_part.cogroup(anchors.groupBy("part")).applyInArrow(windows, schema)
    seen = open_.repartition(count, "part").mapInArrow(partial(_settle_windows, shape=shape, ids=ids), schema)
    claimed = by_part.cogroup(anchors.unionByName(seen).groupBy("part")).applyInArrow(removed, OUT_DDL)
    return by_part.cogroup(claimed.groupBy("part")).applyInArrow(_verified, OUT_DDL)
