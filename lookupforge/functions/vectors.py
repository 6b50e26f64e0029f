"""Vectors as array Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookupforge.specs import Quantization


def clip_value(x: Column, low: float | None, high: float | None) -> Column:
    """``x`` within the bounds that are given; a null stays null."""
    if low is not None:
        x = F.when(x < low, F.lit(float(low))).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(float(high))).otherwise(x)
    return x


def clip(vec: Column, low: float | None, high: float | None) -> Column:
    return vec if low is None and high is None else F.transform(vec, lambda x: clip_value(x, low, high))


def pad(vec: Column, dim: int, value: float = 0.0) -> Column:
    """``vec`` lengthened to ``dim``."""
    return F.concat(vec, F.array_repeat(F.lit(float(value)), F.greatest(F.lit(dim) - F.size(vec), F.lit(0)).cast("int")))


def unpad(vec: Column, dim: int) -> Column:
    return F.slice(vec, 1, dim)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def quantize_value(x: Column, q: Quantization) -> Column:
    """The nearest of ``buckets`` evenly spaced values from low to high (this engine's rule: halves go up)."""
    step = (q.high - q.low) / (q.buckets - 1)
    return F.lit(q.low) + F.floor((clip_value(x, q.low, q.high) - F.lit(q.low)) / F.lit(step) + F.lit(0.5)) * F.lit(step)


def quantize(vec: Column, q: Quantization | None) -> Column:
    return vec if q is None else F.transform(vec, lambda x: quantize_value(x, q))


def squeeze(vec: Column) -> Column:
    """The value of a one-dimensional vector."""
    return F.element_at(vec, 1)


def sums(value: Column, weight: Column, dim: int) -> list[Column]:
    """Weighted sum of vectors, a column for each dimension: partial sums are kept per key, and no list is gathered."""
    return [F.sum(weight * value[i].cast("double")).alias(f"__d{i}") for i in range(dim)]


#: Dimensions that one aggregate sums; beyond about a hundred columns an aggregate is no longer compiled as a whole.
BLOCK = 64


def summed(df: DataFrame, keys: list[str], value: str, weight: str, dim: int, name: str, **more: Column) -> DataFrame:
    """(keys, name, more): the weighted sum of the vectors of each key, and further aggregates. Wide vectors are summed in
    blocks of dimensions, as rows of their own; the blocks of a key, a fixed number, are put together after."""
    v, w = F.col(value), F.col(weight)
    if dim <= BLOCK:
        return df.groupBy(*keys).agg(*sums(v, w, dim), *[x.alias(n) for n, x in more.items()]).select(*keys, gathered(dim).alias(name), *more)
    parts = F.transform(F.sequence(F.lit(0), F.lit((dim - 1) // BLOCK)), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))
    cut = df.select("*", F.posexplode(F.when(v.isNull(), F.array(F.lit(None).cast("array<double>"))).otherwise(parts)).alias("__block", "__part"))
    add = [F.sum(w * F.get("__part", F.lit(i)).cast("double")).alias(f"__d{i}") for i in range(BLOCK)]
    each = cut.groupBy(*keys, "__block").agg(*add, *[F.when(F.col("__block") == 0, x).alias(n) for n, x in more.items()])
    whole = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__block", gathered(BLOCK).alias("x")))).alias("__all"), *[F.max(n).alias(n) for n in more])
    return whole.select(*keys, F.slice(F.flatten(F.transform("__all", lambda b: b["x"])), 1, dim).alias(name), *more)


def gathered(dim: int) -> Column:
    return F.array(*[F.col(f"__d{i}") for i in range(dim)])
