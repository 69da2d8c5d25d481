"""Columns of dense vectors and sparse weights. Sums run in doubles."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of score scales.
SCALES = ("shifted", "cosine", "clamped")


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]) if vector else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm, or by 1e-9 if that is larger."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(1e-9))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def score(cosine: Column, scale: str = "shifted") -> Column:
    """shifted: (cos + 1) / 2; cosine: as it is, clamped to -1 and 1; clamped: to 0 and 1."""
    if scale == "shifted":
        return (cosine + 1.0) / 2.0
    low = F.lit(-1.0 if scale == "cosine" else 0.0)
    return F.least(F.greatest(cosine, low), F.lit(1.0))


def from_distance(l2: Column) -> Column:
    """Clamped score of the L2 distance of unit vectors."""
    away = F.least(F.greatest(l2 * l2 / 2.0, F.lit(0.0)), F.lit(2.0))
    return F.least(F.greatest(1.0 - away, F.lit(0.0)), F.lit(1.0))


def sparse_dot(weights: Column, query: dict[int, float]) -> Column:
    """Sum of products over the query's token ids."""
    if not query:
        return F.lit(0.0)
    pairs = F.array(*[F.struct(F.lit(int(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in sorted(query.items())])
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce(F.element_at(weights, p["t"]).cast("double"), F.lit(0.0)) * p["w"])


def encode_f32(vector: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def decode_f32(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data[: len(data) // 4 * 4]))
