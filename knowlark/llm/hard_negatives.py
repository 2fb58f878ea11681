"""Hard negatives by a distributed join of nearest neighbours over Voronoi cells.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the greatest norm (anchors: 0), so that the greatest inner products are the least
distances, and every vector belongs to the cell of its nearest pivot. Anchors of neighbouring cells are a group. A bounded sample of all
vectors tells each anchor how near its k-th candidate is at least; by the triangle inequality a cell's vector can only be that near to some
anchor of a group if its distance to its pivot lies in an interval. A candidate is replicated to the groups whose interval holds it,
groups are joined exactly by matrix products, in pieces of candidates, and the best of all pieces are the result.

This is done twice: for the positives of each anchor, and for the negatives in the range of scores that each positive gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowlark.llm.common import checkpointed, partitions, small, written

#: Anchors of a group and candidates of a piece, about; numbers that a block of scores may hold.
GROUP, PIECE, CELLS = 16_384, 65_536, 1 << 22


@dataclass(frozen=True)
class Rule:
    """How many positives an anchor has, how many negatives each of them, and between which percentages of the positive's score those score."""

    positives: int = 5
    negatives: int = 10
    low: float = 30
    high: float = 90


@dataclass
class Space:
    """What the driver tells the tasks: the greatest norm, pivots in the wider space, the sample, and the group of each cell."""

    most: float
    pivots: np.ndarray
    sample: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    group: np.ndarray
    parts: np.ndarray

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - 1

    def wider(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most**2 - (x * x).sum(1), 0))

    def far(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of vectors with these further components to all pivots."""
        p = self.pivots[:, :-1]
        square = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T + (extra[:, None] - self.pivots[:, -1]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from an anchor what scores `score` lies."""
        return np.sqrt(np.maximum((x * x).sum(1) + self.most**2 - 2 * score, 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists as rows of a matrix; zeros behind shorter ones."""
    sizes = np.array(column.value_lengths())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, of equal ones the smaller ids, in this order."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def fitted(sample: np.ndarray, most: float, pivots: int, rounds: int = 4, seed: int = 42) -> np.ndarray:
    """Pivots of a sample in the wider space: a few rounds of k-means."""
    wide = np.column_stack([sample, np.sqrt(np.maximum(most**2 - (sample * sample).sum(1), 0))])
    centre = wide[np.random.default_rng(seed).choice(len(wide), min(pivots, len(wide)), replace=False)]
    for _ in range(rounds):
        near = ((centre * centre).sum(1) - 2 * wide @ centre.T).argmin(1)
        sums, n = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
        np.add.at(sums, near, wide)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def _assigned(batches: Iterator[pa.RecordBatch], space: object) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, label, anchor, vec) plus their cell and the distance to its pivot."""
    s: Space = space.value
    for batch in batches:
        cells, far = [], []
        x = matrix(batch.column(4), s.width)
        for k in range(0, len(x), 4096):
            some = x[k : k + 4096]
            d = s.far(some, s.wider(some))
            cells.append(d.argmin(1))
            far.append(d[np.arange(len(d)), cells[-1]])
        cell, dist = (np.concatenate([np.zeros(0), *c]) for c in (cells, far))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], [*batch.schema.names, "cell", "dist"])




def _found(kind: str, rule: Rule, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchor: int, label: int, given: list[float], floor: list[float]) -> list[np.ndarray]:
    """Places of what an anchor seeks among scored vectors, for each of its asks: positives once, negatives for each positive. floor is what
    the last of them scores at least."""
    if kind == "positives":
        some = np.flatnonzero((labels == label) & (ids != anchor) & (score >= floor[0]))
        return [some[best(score[some], ids[some], rule.positives)]]
    other = np.flatnonzero((labels != label) & (score >= min(floor)))
    mine, out = score[other], []
    for positive, least in zip(given, floor, strict=True):
        fits = other[(rule.low * positive <= 100 * mine) & (100 * mine <= rule.high * positive) & (mine >= least)]
        out.append(fits[best(score[fits], ids[fits], rule.negatives)])
    return out


def _asked(batches: Iterator[pa.RecordBatch], kind: str, rule: Rule, space: object) -> Iterator[pa.RecordBatch]:
    """Anchors (row, id, label, cell, given, vec) with their group and, from the sample, the least score of each ask that can count."""
    s: Space = space.value
    for batch in batches:
        ids, labels, cell = (batch.column(k).to_numpy() for k in (1, 2, 3))
        given, x = batch.column(4).to_pylist(), matrix(batch.column(5), s.width)
        floors = []
        wanted = rule.positives if kind == "positives" else rule.negatives
        step = max(1, CELLS // max(1, len(s.sample)))
        for first in range(0, len(x), step):
            scores = x[first : first + step] @ s.sample.T
            for k, score in enumerate(scores, first):
                none = [-np.inf] * max(1, len(given[k]))
                found = _found(kind, rule, score, s.ids, s.labels, ids[k], labels[k], given[k], none)
                least = [-np.inf] if kind == "positives" else [rule.low * p / 100 for p in given[k]]
                floors.append([score[f[-1]] if len(f) == wanted else n for f, n in zip(found, least, strict=True)])
        # Anchors that the sample tells nothing are a group of their own: they alone seek everywhere.
        group = np.array([s.group[c] * 2 + (min(f) == -np.inf) for c, f in zip(cell, floors, strict=True)], np.int64).reshape(-1)
        part = batch.column(0).to_numpy() % s.parts[s.group[cell]] if len(cell) else np.zeros(0, np.int64)
        columns = [pa.array(group), pa.array(part.astype(np.int64)), *batch.columns, pa.array(floors, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["group", "part", *batch.schema.names, "floor"])


def _routes(batches: Iterator[pa.RecordBatch], kind: str, rule: Rule, space: object) -> Iterator[pa.RecordBatch]:
    """(group, part, cell, low, high): where vectors of a cell that an anchor of the batch may seek lie, by their distance to the pivot."""
    s: Space = space.value
    names = ["group", "part", "cell", "low", "high"]
    for batch in batches:
        if not batch.num_rows:
            continue
        group, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = matrix(batch.column(7), s.width)
        far = s.far(x, np.zeros(len(x)))
        outer = s.radius(x, np.array([min(f) for f in batch.column(8).to_pylist()]))
        inner = np.zeros(len(x))
        if kind == "negatives":
            inner = s.radius(x, np.array([max(rule.high * p / 100 for p in g) for g in batch.column(6).to_pylist()]))
        slack = 1e-6 * s.most + 1e-9
        low, high = np.maximum(far - outer[:, None], inner[:, None] - far) - slack, far + outer[:, None] + slack
        for g, p in dict.fromkeys(zip(group.tolist(), part.tolist(), strict=True)):
            mine = (group == g) & (part == p)
            n = len(s.pivots)
            columns = [np.full(n, g), np.full(n, p), np.arange(n, dtype=np.int32), low[mine].min(0), high[mine].max(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _joined(key: tuple, anchors: pa.Table, rows: pa.Table, kind: str, rule: Rule, width: int) -> pa.Table:
    """A group's anchors with a piece of its candidates: the best of each ask, whose scores aren't under its floor."""
    out: list[tuple] = []
    ids, labels, x = rows.column("id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("vec").combine_chunks(), width)
    given, floor = anchors.column("given").to_pylist(), anchors.column("floor").to_pylist()
    row, anchor, label = (anchors.column(c).to_pylist() for c in ("row", "id", "label"))
    y = matrix(anchors.column("vec").combine_chunks(), width)
    step = max(1, CELLS // max(1, len(x)))
    for first in range(0, len(y) if len(x) else 0, step):
        for k, score in enumerate(y[first : first + step] @ x.T, first):
            for ask, found in enumerate(_found(kind, rule, score, ids, labels, anchor[k], label[k], given[k], floor[k])):
                out.extend((row[k], anchor[k], ask, i, v) for i, v in zip(ids[found].tolist(), score[found].tolist(), strict=True))
    columns = zip(*out, strict=True) if out else ((),) * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "id", "ask", "found", "score"])


def sought(rows: DataFrame, anchors: DataFrame, kind: str, rule: Rule, space: object, n: int) -> DataFrame:
    """(row, id, ask, found, score, rank) of anchors (row, id, label, cell, given, vec) over the assigned rows."""
    spark = rows.sparkSession
    s: Space = space.value
    asked = written(anchors.mapInArrow(partial(_asked, kind=kind, rule=rule, space=space), "group long, part long, row long, id long, label long, cell int, given array<double>, vec array<double>, floor array<double>"))
    routes = asked.mapInArrow(partial(_routes, kind=kind, rule=rule, space=space), "group long, part long, cell int, low double, high double")
    routes = checkpointed(routes.groupBy("group", "part", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    groups = max(1, int(s.parts.sum()))
    pieces = max(-(-n // PIECE), -(-partitions(spark) // groups))
    # A place in the input, not an id, says which piece a row is in, so that repeated ids are dealt out too.
    candidates = rows.join(small(routes), "cell").where((F.col("dist") >= F.col("low")) & (F.col("dist") <= F.col("high")))
    candidates = candidates.select("group", "part", F.pmod(F.xxhash64("row"), F.lit(pieces)).alias("piece"), "id", "label", "vec")
    everywhere = asked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    keys = ["group", "part", "piece"]
    join = partial(_joined, kind=kind, rule=rule, width=s.width)
    found = everywhere.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda k, a, b: join(k, a, b), "row long, id long, ask int, found long, score double")
    first = Window.partitionBy("row", "ask").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= (rule.positives if kind == "positives" else rule.negatives))


def mine(vectors: DataFrame, anchor: Column, rule: Rule = Rule(), sample: int = 20_000, pivots: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score) of vectors (id long, label long, vec array<double>).

    anchor says which rows are anchors. A row's score is its inner product with the anchor; greater scores come first, of equal ones smaller
    ids. Positives are the first rows with the anchor's label and another id, negatives the first with another label whose score lies
    between rule.low and rule.high percent of the positive's. Scores are exact for whole numbers, as long as sums stay under 2^46.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Shorter vectors count as if zeros followed. A row
    that is repeated is several candidates, and several anchors. An empty table, or one without anchors, gives an empty result. At most
    about `sample` rows, chosen by their ids' hash, place the pivots (by default the square root of the rows, 8 to 256) and tell first
    bounds; every row is searched.
    """
    spark = vectors.sparkSession
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(finite)
    rows = good.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vec").cast("array<double>").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(square)).first()
    result = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score double, negative_score double"
    if not n:
        return spark.createDataFrame([], result)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * sample / n) + 1))
    # Repeated ids fall into the sample together: of each id one row.
    taken = rows.where(share).groupBy("id").agg(F.min_by(F.struct("label", "vec"), "row").alias("r")).select("id", "r.label", "r.vec").orderBy("id").toArrow()
    some = matrix(taken.column("vec").combine_chunks(), max(1, width)) if taken.num_rows else np.zeros((1, max(1, width)))
    ids, labels = (taken.column(c).to_numpy() for c in ("id", "label"))
    # Norms are of the exact square root at least, so that no component is the root of a negative number.
    centre = fitted(some, float(np.sqrt(most)), pivots or int(np.clip(n**0.5, 8, 256)))
    space = Space(float(np.sqrt(most)), centre, some[: len(ids)], ids, labels, np.zeros(len(centre), np.int64), np.ones(1, np.int64))
    shared = spark.sparkContext.broadcast(space)
    kinds = "row long, id long, label long, anchor boolean, vec array<double>, cell int, dist double"
    rows = written(rows.mapInArrow(partial(_assigned, space=shared), kinds))
    sizes = {r["cell"]: r["count"] for r in rows.where("anchor").groupBy("cell").count().collect()}  # a row a cell
    grouped(space, sizes)
    shared = spark.sparkContext.broadcast(space)
    anchors = rows.where("anchor")
    given = F.array(F.lit(0.0)).alias("given")
    positives = written(sought(rows, anchors.select("row", "id", "label", "cell", given, "vec"), "positives", rule, shared, n))
    lists = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found").alias("positive_id"), "score"))).alias("held"))  # rule.positives at most
    again = anchors.join(lists, "row").select("row", "id", "label", "cell", F.transform("held", lambda h: h["score"]).alias("given"), "vec")
    negatives = sought(rows, again, "negatives", rule, shared, n)
    named = positives.select("row", (F.col("rank") - 1).alias("ask"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(named, ["row", "ask"])
    return out.select(
        F.col("id").alias("anchor_id"), "positive_id", (F.col("ask") + 1).alias("positive_rank"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def grouped(space: Space, sizes: dict[int, int], most: int = GROUP) -> None:
    """Deal cells to groups of about `most` anchors, neighbouring cells together: in the order of their pivots' places along the direction in
    which pivots differ most. A cell of more anchors is a group whose anchors are dealt to parts."""
    p = space.pivots - space.pivots.mean(0)
    order = np.argsort(p @ np.linalg.svd(p, full_matrices=False)[2][0], kind="stable")
    group, held, now = np.zeros(len(p), np.int64), [0], 0
    for c in order.tolist():
        if held[now] and held[now] + sizes.get(c, 0) > most:
            held.append(0)
            now += 1
        group[c] = now
        held[now] += sizes.get(c, 0)
    space.group, space.parts = group, np.array([max(1, -(-h // most)) for h in held], np.int64)
