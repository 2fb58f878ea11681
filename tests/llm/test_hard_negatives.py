"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowlark.llm import hard_negatives
from knowlark.llm.hard_negatives import Rule, Space, best, fitted, grouped, matrix, mine

SCHEMA = "id long, label long, vec array<double>, row string, cell int, dist string"


def brute(rows, anchors, rule, width):
    """Sorted result rows, by all pairs of the rows that take part."""
    good = [(i, y, np.array([*v, *[0.0] * (width - len(v))])) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if not anchors(i):
            continue
        scored = sorted((-float(v @ x), j, z) for j, z, x in good)
        for rank, (s, j, _) in enumerate([t for t in scored if t[2] == y and t[1] != i][: rule.positives], 1):
            fits = [t for t in scored if t[2] != y and rule.low * -s <= 100 * -t[0] <= rule.high * -s]
            out += [(i, j, rank, k, t[1], -s, -t[0]) for k, t in enumerate(fits[: rule.negatives], 1)]
    return sorted(out)


def made(n, seed, labels=4, width=6, spread=8):
    rnd = random.Random(seed)
    centres = [[rnd.randint(-spread, spread) for _ in range(width)] for _ in range(labels)]
    return [(k, y, [float(c + rnd.randint(-3, 3)) for c in centres[y]]) for k in range(n) for y in [rnd.randrange(labels)]]


ODD = [
    (None, 1, [1.0] * 6), (9001, None, [1.0] * 6), (9002, 1, None), (9003, 1, [1.0, None]), (9004, 1, [float("nan")] * 6), (9005, 1, [float("inf")] * 6), (9010, 1, []), (9020, 2, [3.0]),
    (9030, 77, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0]), (9040, 2, [0.0] * 6), (9050, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]),
]


def check(spark, rows, rule, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, mine(df, F.col("id") % 10 == 0, rule, **options).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, rule, 6)
    return got


@pytest.mark.parametrize("group,piece,sample", [(16_384, 65_536, 20_000), (5, 40, 60), (3, 1_000, 10)])
def test_mine(spark, monkeypatch, group, piece, sample):
    """Several groups, parts and pieces, a sample that is most of the rows or hardly any; odd rows and ties."""
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "PIECE", piece)
    monkeypatch.setattr(hard_negatives.grouped, "__defaults__", (group,))
    rows = made(300, 1) + ODD
    assert check(spark, rows, Rule(), sample=sample, pivots=9)
    check(spark, rows, Rule(positives=2, negatives=3, low=-50, high=100), sample=sample, pivots=5)


def test_mine_repeated(spark):
    """One vector a third of the time, one id a third of the time, and repeated anchors."""
    rows = made(90, 2) + [(1000 + k, 1, [2.0, 2.0, 2.0, 2.0, 2.0, 2.0]) for k in range(60)] + [(20, 2, [4.0, -1.0, 3.0, 2.0, 1.0, 0.0])] * 40
    assert check(spark, rows, Rule(), sample=50, pivots=6)


def test_mine_empty(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in made(20, 3)], SCHEMA)
    assert mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert mine(df, F.col("id") < 0).count() == 0
    assert mine(df.where("id = 0"), F.col("id") == 0).count() == 0
    assert mine(spark.createDataFrame([(0, 1, [])], "id long, label long, vec array<double>"), F.col("id") == 0).count() == 0


def test_bounds():
    """Distances in the wider space follow the scores, pivots' intervals hold what they should, groups are bounded."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 5)) * 20)
    most = float(np.sqrt((x * x).sum(1).max()))
    space = Space(most, fitted(x, most, 7), x, np.arange(200), np.zeros(200), np.zeros(7, np.int64), np.ones(1, np.int64))
    extra = space.wider(x)
    anchors = x[:20]
    real = np.sqrt(((np.column_stack([anchors, np.zeros(20)])[:, None] - np.column_stack([x, extra])[None]) ** 2).sum(2))
    for k in range(20):
        assert np.allclose(space.radius(np.repeat(anchors[k : k + 1], 200, 0), x @ anchors[k]), real[k], atol=1e-5)
    to_pivot, own = space.far(anchors, np.zeros(20)), space.far(x, extra)
    cell = own.argmin(1)
    s = own[np.arange(200), cell]
    assert (np.abs(to_pivot[:, cell] - s) <= real + 1e-6).all() and (to_pivot[:, cell] + s >= real - 1e-6).all()
    grouped(space, {0: 3, 1: 50, 2: 4, 3: 0, 4: 9, 5: 1, 6: 2}, 10)
    held = np.bincount(space.group, [3, 50, 4, 0, 9, 1, 2])
    assert space.parts[space.group[1]] >= 5 and all(h <= 10 * p for h, p in zip(held, space.parts, strict=True))
    score, ids = np.array([1.0, 3, 3, 2, 3]), np.array([9, 8, 7, 1, 6])
    assert best(score, ids, 2).tolist() == [4, 2] and best(score, ids, 9).tolist() == [4, 2, 1, 3, 0]
    import pyarrow as pa

    assert matrix(pa.array([[1.0], [], [2.0, 3.0]], pa.list_(pa.float64())), 2).tolist() == [[1, 0], [0, 0], [2, 3]]
