"""Vector scalars in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x
    )


def sign_code(v: Column, bits: int) -> Column:
    """Bucket code of the first ``bits`` signs: coordinate hyperplanes through the origin."""
    out = F.lit(0)
    for i in range(bits):
        out = out + F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0))
    return out
