"""Dense vectors as arrays: similarity, norms and the hashing embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 512


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; 0 with null or different lengths."""
    total = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), 0.0).otherwise(total)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / norm))


def token_hash(token: Column) -> Column:
    """The 32-bit string hash s*31 + c of a token's characters, unsigned."""
    return F.aggregate(F.split(token, ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))


def token_weight(token: Column, hashed: Column) -> Column:
    """Signed weight of a token in the embedding, by kind and length; negative if its signed hash is."""
    word = F.least(F.lit(2.5), 0.8 + (F.length(token) - 1) * 0.25)
    kind = F.substring(token, 1, 2)
    size = F.when(F.substring(token, 1, 1) != "c", word).when(kind == "c1", 0.6).when(kind == "c2", 1.0).when(kind == "c3", 1.5).otherwise(word)
    return F.when(hashed >= (1 << 31), -size).otherwise(size)


def token_slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(DIM)).cast("int")


def hashed_token(token: str) -> tuple[int, float]:
    """token_slot and token_weight of one token."""
    h = 0
    for c in token:
        h = (h * 31 + ord(c)) % (1 << 32)
    word = min(2.5, 0.8 + (len(token) - 1) * 0.25)
    size = {"c1": 0.6, "c2": 1.0, "c3": 1.5}.get(token[:2], word)
    return h % DIM, -size if h >= 1 << 31 else size


def hashed_tokens(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """hashed_token of many tokens as arrays, a character of all of them at a time."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # longest first: those that have a next character are the first ones
    h, alive = np.zeros(len(tokens), np.uint64), len(tokens)
    for k in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(-sizes[order[:alive]], -k, "left"))
        some = order[:alive]
        h[some] = (h[some] * np.uint64(31) + chars[begins[some] + k]) & np.uint64(0xFFFFFFFF)
    weight = np.minimum(2.5, 0.8 + (sizes - 1) * 0.25)
    kinds = {"c1": 0.6, "c2": 1.0, "c3": 1.5}
    for k, t in enumerate(tokens):
        if t[:1] == "c":
            weight[k] = kinds.get(t[:2], weight[k])
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >= 1 << 31, -weight, weight)


@F.pandas_udf(T.BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    """A vector as big-endian 32-bit floats."""
    return v.map(lambda x: np.asarray(x, ">f4").tobytes(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    """The vector that to_bytes() made; bytes beyond whole floats are left out."""
    return b.map(lambda x: np.frombuffer(x[: len(x) // 4 * 4], ">f4").astype("f4"), na_action="ignore")
