"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: each step fits a shallow tree to one feature's binned residuals and adds it, at a small rate, to that
feature's lookup table; then the pairs that explain most of what is left get two-way tables the same way. A score is the
logistic function of an intercept and the looked-up values, added for whole batches at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import text_of

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "blank", "newline", "punctuation", "symbol", "pipe", "mark_run", "other", "word_length",
    "short_words", "long_words", "distinct_words", "top_word", "line_words", "distinct_lines", "top_line", "short_lines", "ended_lines", "symbol_words", "capital_words", "distinct_pairs",
)
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:!?'\"-()", 5), (b"#$%&*+/<=>@[\\]^_`{}~", 6), (b"|", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_RUN = re.compile(rb"[^\w\s\x80-\xff]{2,}")
_SYMBOL = re.compile(rb"[#$%&*+/<=>@\[\\\]^_`{}~|0-9]")


def features(text: str | None) -> np.ndarray:
    """The features of a whole text; all are 0 for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    counts = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9) / len(raw)
    n, distinct = len(words), set(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    different = set(lines)
    by_length = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.array([
        np.log1p(len(raw)), np.log1p(n), counts[1], counts[2], counts[3], counts[4], counts[5], counts[6], counts[7],
        len(_RUN.findall(raw)) / n, counts[8], lengths.mean(), (lengths <= 3).mean(), (lengths >= 12).mean(), len(distinct) / n, _most(words) / n,
        n / len(lines), len(different) / len(lines), _most(lines) / len(lines), (by_length < 30).mean(), sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines) / len(lines),
        sum(map(bool, map(_SYMBOL.search, distinct))) / len(distinct), sum(w[:1].isupper() for w in distinct) / len(distinct), len(set(zip(words, words[1:]))) / n,
    ])


def _most(things: list[bytes]) -> int:
    return max(Counter(things).values(), default=0)


@dataclass
class Model:
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cuts, x[:, f], "right")]
        for f, g, table in self.pairs:
            z += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles as bin edges, each edge halfway between neighbouring values."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    at = np.searchsorted(values, np.unique(np.quantile(x, np.arange(1, bins) / bins)))
    at = np.unique(np.clip(at, 1, len(values) - 1))
    return (values[at - 1] + values[at]) / 2


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """A tree over ordered bins with at most `leaves` leaves: the steps that it adds to each bin."""
    g, w = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))

    def gain(b, e):
        return (g[e] - g[b]) ** 2 / (w[e] - w[b] + ridge)

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for b, e in parts:
            cut = np.arange(b + 1, e)
            cut = cut[(w[cut] - w[b] >= least) & (w[e] - w[cut] >= least)]
            if len(cut):
                gains = gain(b, cut) + gain(cut, e) - gain(b, e)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], (b, e), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for b, e in parts:
        out[b:e] = (g[e] - g[b]) / (w[e] - w[b] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 300, pair_rounds: int = 60, pairs: int = 10, rate: float = 0.1, ridge: float = 1.0, least: float = 0.5) -> Model:
    """Boost lookup tables on rows x and labels y (0 or 1). Without rows of both labels the score is the labels' share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    count = x.shape[1]
    cuts, rough = [_cuts(x[:, f], bins) if len(x) else np.zeros(0) for f in range(count)], [_cuts(x[:, f], coarse) if len(x) else np.zeros(0) for f in range(count)]
    model = Model(cuts, rough, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [])
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f in range(count):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), 4, ridge, least)
            model.tables[f] += step
            z += step[at[f]]
    two = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(rough)]
    p = 1 / (1 + np.exp(-z))
    strength = []
    for f, g in combinations(range(count), 2):
        cell = two[f] * (len(rough[g]) + 1) + two[g]
        size = (len(rough[f]) + 1) * (len(rough[g]) + 1)
        strength.append((float((np.bincount(cell, y - p, size) ** 2 / (np.bincount(cell, p * (1 - p), size) + ridge)).sum()), f, g))
    chosen = [(f, g, np.zeros((len(rough[f]) + 1, len(rough[g]) + 1))) for _, f, g in sorted(strength, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for f, g, table in chosen:
            p = 1 / (1 + np.exp(-z))
            cell = two[f] * table.shape[1] + two[g]
            grad, weight = np.bincount(cell, y - p, table.size).reshape(table.shape), np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            # A tree of depth two: a cut of the first feature, then one of the second on either side.
            left = _tree(grad.sum(1), weight.sum(1), 2, ridge, least)
            step = np.zeros_like(table)
            for side in np.unique(left):
                rows = left == side
                step[rows] = _tree(grad[rows].sum(0), weight[rows].sum(0), 2, ridge, least)
            table += rate * step
            z += rate * step[two[f], two[g]]
    model.pairs = chosen
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tolist() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def _scored(batches: Iterator[pa.RecordBatch], model: object, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t) for t in batch.column(2).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
        score = model.value.score(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def held_out(column: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 0 modulo 5. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, _text, doc_id) of about `most` labelled ids at most, chosen by their hashes, that aren't held out; one row each.

    Of an id's several labels the least counts, of its several texts that of the least hash. docs stay where they are but for the chosen rows.
    """
    slim = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
    slim = slim.groupBy("doc_id").agg(F.min("label").alias("label"))
    total = slim.count()
    if total > most:
        slim = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 60)) < (most << 60) // total)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    chosen = texts.join(F.broadcast(slim), "doc_id").groupBy("doc_id", "label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return chosen.select("label", "_text", "doc_id")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= threshold).

    The model learns from labels (id, 0 or 1) of at most about `most` rows (their features, not their texts, reach the
    driver, and the sample's ids are broadcast) outside the held-out fifth; inputs are counts over the whole text alone. Null
    texts count as empty and get a score like others; very long ones count whole. Labels that are null or not 0 or 1, and labels without a row in docs,
    teach nothing; without labels of both kinds the score is constant. Repeated rows repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels, label, most, id_col, text_col).select("label", "_text").mapInArrow(_featured, "label int, x array<double>").collect()
    # Sorted, for the same sums in any order of rows.
    rows = sorted((tuple(r["x"]), r["label"]) for r in rows)
    x = np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES))
    model = spark.sparkContext.broadcast(fit(x, np.array([r[1] for r in rows], dtype=float)))
    all_ = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("_text"))
    kind = all_.schema["doc_id"].dataType.simpleString()
    return all_.mapInArrow(partial(_scored, model=model, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")
