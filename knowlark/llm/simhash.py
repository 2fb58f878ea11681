"""SimHash near-dedup by segment-popcount embedding.

A fingerprint's embedding is its bit counts in 32 segments of two bits. The Manhattan distance of two embeddings is at most
their Hamming distance, so fingerprints that link (3 bits or fewer) are within 3 in the embedding. The segments fall into
6 blocks; a distance of 3 leaves at least 3 blocks with equal counts, so a grid with one cell for each choice of 3 blocks
and their counts is a range-join: linked fingerprints meet in a cell. There, the bound and then the exact distance are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import bound_for, checkpointed, hot_pieces, join_unique, partitions, text_of
from knowlark.llm.graph import components

SEGMENTS, BLOCKS, EQUAL, BITS = 32, 6, 3, 3
LOW = 0x5555555555555555
#: Up to this many fingerprints of a cell are compared by shifts over all cells at once.
SHIFTS = 48


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the lower-cased (A-Z) words' shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    totals = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255):  # up to 255 rows of 0 and 1 fit in bytes: eight counts to an addition
        bits = np.unpackbits(hashes[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return int(np.packbits(2 * totals > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choices(segments: list[int]) -> list[list[int]]:
    """Segments of each choice of EQUAL out of BLOCKS blocks. With few segments a block can be empty, which is equal at once."""
    blocks = [segments[len(segments) * k // BLOCKS : len(segments) * (k + 1) // BLOCKS] for k in range(BLOCKS)]
    return [sum(c, []) for c in combinations(blocks, EQUAL)]


def _mask(segments: list[int]) -> int:
    return sum(3 << (2 * s) for s in segments)


def _lane(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)) for m in masks))


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, cell, fp) of hot cells in the cells of each choice of further equal blocks among the segments that their masks leave."""
    for batch in batches:
        mask, prints = batch.column("mask").to_numpy(), batch.column("fp").to_numpy()
        x = prints.view(np.uint64)
        one, two = x & np.uint64(LOW), (x >> np.uint64(1)) & np.uint64(LOW)
        counts = ((one & two) << np.uint64(1)) | (one ^ two)  # 0, 1 or 2 in each segment's two bits
        out: list[tuple[np.ndarray, ...]] = []
        for m in np.unique(mask).tolist():
            rows = mask == m
            rest = [s for s in range(SEGMENTS) if not (m & ((1 << 64) - 1)) >> (2 * s) & 3]
            for new in {(m & ((1 << 64) - 1)) | _mask(c) for c in _choices(rest)}:
                out.append((np.full(rows.sum(), _signed(new)), (counts[rows] & np.uint64(new)).view(np.int64), prints[rows]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mask", "cell", "fp"])


def _cells(prints: DataFrame, count: int, bound: int, levels: int = 3) -> DataFrame:
    """(mask, cell, fp): the cells of each fingerprint. Those of more than bound fingerprints are split by further equal
    blocks among the segments that the mask leaves, which again hold of any pair within the distance, and so on for `levels`: a cell then
    agrees in 28 of the 32 segments' counts."""
    low = F.lit(LOW)
    one, two = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = F.shiftleft(one.bitwiseAND(two), 1).bitwiseOR(one.bitwiseXOR(two))
    chosen = _choices(list(range(SEGMENTS)))
    cells = prints.select("fp", counts.alias("_c"), F.explode(_lane([_mask(c) for c in chosen])).alias("mask")).select("mask", F.col("_c").bitwiseAND(F.col("mask")).alias("cell"), "fp")
    done = None
    for _ in range(levels):
        hot = checkpointed(hot_pieces(cells.select(F.struct("mask", "cell").alias("_key")), "_key", bound))
        if not hot.limit(1).count():
            break
        marked = cells.withColumn("_key", F.struct("mask", "cell")).join(F.broadcast(hot), "_key", "left")
        cold = marked.where("_pieces is null").select("mask", "cell", "fp")
        done = cold if done is None else done.unionByName(cold)
        cells = checkpointed(marked.where("_pieces is not null").select("mask", "cell", "fp").mapInArrow(_finer, "mask long, cell long, fp long").distinct())
    return cells if done is None else done.unionByName(cells)


def _embedded(x: np.ndarray) -> np.ndarray:
    """Segment counts in unary (0, 1, 3), so that the bits by which two embeddings differ are their Manhattan distance."""
    one, low = np.uint64(1), np.uint64(LOW)
    return ((x | (x >> one)) & low) | ((x & (x >> one) & low) << one)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Within BITS: the Manhattan distance of the embeddings first, as the lower bound, then the exact distance."""
    near = np.bitwise_count(_embedded(a) ^ _embedded(b)) <= BITS
    near[near] = np.bitwise_count((a ^ b)[near]) <= BITS
    return near


def _stars(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside sorted groups as a forest: (fingerprint, root) pairs, at most one for each fingerprint of a group."""
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(begins, append=len(group))
    ones, others = [], []
    small = np.repeat(sizes <= SHIFTS, sizes)
    most = int(sizes[sizes <= SHIFTS].max(initial=1))
    index = np.flatnonzero(small)
    for d in range(1, most):
        i = index[index + d < len(group)]
        i = i[group[i] == group[i + d]]
        i = i[_near(prints[i], prints[i + d])]
        ones.append(i)
        others.append(i + d)
    for b, n in zip(begins[sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist(), strict=True):
        rest = np.arange(b, b + n)  # not reached yet; each is compared until reached, and is a source once
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                at = front.pop()
                hit = _near(prints[rest], prints[at])
                found = rest[hit]
                rest = rest[~hit]
                ones.append(np.full(len(found), at))
                others.append(found)
                front.extend(found.tolist())
    if not ones:
        return prints[:0], prints[:0]
    a, b = np.concatenate(ones), np.concatenate(others)
    root = np.arange(len(prints))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(root != np.arange(len(root)))
    return prints[linked], prints[root[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch is held back until its end is known."""
    held: list[np.ndarray] = []

    def found(mask, cell, prints):
        new = np.ones(len(mask), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1])
        a, b = _stars(prints.view(np.uint64), np.cumsum(new) - 1)
        pairs = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        mask, cell, _ = columns
        same = (mask == mask[-1]) & (cell == cell[-1]) if len(mask) else np.zeros(0, bool)
        end = int(len(mask) - same.sum())
        held = [c[end:] for c in columns]
        if end:
            yield found(*(c[:end] for c in columns))
    if held:
        yield found(*held)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) for each row of docs; fp is the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, text_hash long")


def _components(docs: DataFrame, id_col: str, text_col: str, min_cell: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of each row, and (fp, root, component_id) of each fingerprint."""
    count = partitions(docs.sparkSession)
    rows = checkpointed(fingerprints(docs, id_col, text_col))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("_min")))
    # 20 cells for each fingerprint; the bound keeps hot cells to a few times the partitions.
    cells = _cells(prints.select("fp"), count, max(min_cell, 20 * prints.count() // (4 * count)))
    dealt = cells.repartition(count, "mask", "cell").sortWithinPartitions("mask", "cell", "fp")
    edges = checkpointed(dealt.mapInArrow(_links, "a long, b long").distinct())
    roots = components(edges)
    linked = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "_min")
    linked = checkpointed(linked)
    least = linked.groupBy("root").agg(F.min("_min").alias("component_id"))
    return rows, checkpointed(linked.select("fp", "root").join(least, "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cell: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Fingerprints link at 3 or fewer differing bits. Rows with one fingerprint are one vertex, so copies are never
    paired. Null texts count as empty; texts without words have fingerprint zero and link like others. A null id never
    is the smallest; a component of null ids alone has a null component_id. Repeated rows repeat; very long texts count whole; an
    empty table gives an empty result; other columns are ignored. Rows of a hot fingerprint stay where they are.
    """
    rows, of = _components(docs, id_col, text_col, min_cell)
    found = join_unique(rows, of.select("fp", "component_id"), "fp", bound_for(rows.count(), docs.sparkSession), "inner")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (a null id comes last), then the smallest fingerprint and hash of
    its text; of rows repeated in id and text one stays, any of them. Columns stay as they are, whatever they are called; an empty
    table gives an empty result.
    """
    names = docs.columns
    own = docs.toDF(*(f"_column{k}" for k in range(len(names))))  # whatever the columns are called, none clashes
    row, text = f"_column{names.index(id_col)}", f"_column{names.index(text_col)}"
    rows, of = _components(docs, id_col, text_col, 2000)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "text_hash")
    best = rows.select("fp", order.alias("best")).groupBy("fp").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    kept = best.join(of, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash"))
    kept = checkpointed(kept)
    marked = own.withColumn("_hash_of", F.xxhash64(text_of(text)))
    stay = marked.join(kept, F.col(row).eqNullSafe(F.col("_id")) & (F.col("_hash_of") == F.col("_hash")), "left_semi")
    times = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = checkpointed(times.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi"))
    if twice.limit(1).count():
        again = twice.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        same = F.col(row).eqNullSafe(F.col("_id")) & (F.col("_hash_of") == F.col("_hash"))
        stay = stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates([row, "_hash_of"]))
    return stay.drop("_hash_of").toDF(*names)
