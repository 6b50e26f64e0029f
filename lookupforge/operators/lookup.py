"""Lookup: rows (sample, id, gain) joined to a table of vectors and summed per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.functions import vectors as V
from lookupforge.operators.coo import total_weight
from lookupforge.sources.staging import staged
from lookupforge.specs import Quantization


#: Vectors that take no more, in their own type, are sent to every executor whole.
BROADCAST_BYTES = 64 << 20


def fits(table: DataFrame, dim: int, vec: str = "vec") -> bool:
    """Whether the table's rows, counted up to the bound, are few enough to be broadcast."""
    wide = 4 if table.schema[vec].dataType.elementType.typeName() == "float" else 8
    most = BROADCAST_BYTES // (wide * dim + 64)
    return table.limit(most + 1).count() <= most


def wanted(rows: DataFrame, table: DataFrame, dim: int) -> DataFrame | None:
    """The part of (__id, __vec) to broadcast: the whole table, or the vectors of the ids that ``rows`` have, which are read
    once more for that; None if those are too many as well."""
    if fits(table, dim, "__vec"):
        return table
    used = table.join(staged(rows.select("__id").distinct(), "ids"), "__id", "left_semi")
    return used if fits(used, dim, "__vec") else None


def lookup(coo: DataFrame, table: DataFrame, dim: int, keys: tuple[str, ...] = ("sample",), id_: str = "id", vec: str = "vec", samples: DataFrame | None = None, quantization: Quantization | None = None, by: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, vec): the weighted sum of each sample's vectors; zeros for samples of ``samples`` without ids.

    Rows are much smaller than vectors. If the vectors ``wanted`` fit, rows are dealt by ``by`` (some or all of the keys; empty
    if they are dealt so already) and meet the broadcast vectors there, so that no vector and no sum is shuffled, here or in a
    later aggregate by ``by``. Else the join is left to the planner, with AQE's skew handling, and partial sums per dimension
    (``vectors.summed``) are shuffled by sample.
    """
    rows = coo.select(*keys, F.col(id_).alias("__id"), "gain")
    t = table.select(F.col("id").alias("__id"), V.quantize(F.col(vec), quantization).alias("__vec"))
    if (few := wanted(rows, t, dim)) is not None:
        by = keys if by is None else by
        rows, t = rows.repartition(*by) if by else rows, F.broadcast(few)
    out = V.summed(rows.join(t, "__id"), list(keys), "__vec", "gain", dim, "vec")
    if samples is not None:
        out = samples.select(*keys).join(out, list(keys), "left").select(*keys, F.coalesce("vec", V.zeros(dim)).alias("vec"))
    return out


def _pooled(coo: DataFrame, table: DataFrame, dim: int, combiner: str, keys: tuple[str, ...], weight: str, quantization: Quantization | None) -> DataFrame:
    """(keys, __sum, __total): the sums of the samples of which any id is in the table, not yet divided."""
    w = F.col(weight).cast("double")
    rows = coo.select(*keys, F.col("id").alias("__id"), w.alias("__weight"), (w * w).alias("__square"))
    t = table.select(F.col("id").alias("__id"), V.quantize(F.col("vec"), quantization).alias("__vec"))
    if (few := wanted(rows, t, dim)) is not None:
        rows, t = rows.repartition(*keys), F.broadcast(few)
    total = total_weight(combiner, F.col("__weight"), F.col("__square"))
    return V.summed(rows.join(t, "__id", "left"), list(keys), "__vec", "__weight", dim, "__sum", __total=total, __found=F.count("__vec")).where("__found > 0").drop("__found")


def pooled(coo: DataFrame, table: DataFrame, dim: int, combiner: str, keys: tuple[str, ...] = ("sample",), weight: str = "weight", samples: DataFrame | None = None, quantization: Quantization | None = None) -> DataFrame:
    """(keys, vec): the same as ``lookup`` of ``with_gains``, with the rows read once.

    The gain's divisor is one for a sample, so it is taken at the end. If the vectors ``wanted`` fit, rows are dealt by sample,
    once, to meet the broadcast vectors, and none is shuffled. Else the exchange after the join is of partial sums. Ids that the
    table lacks count in the divisor only.
    """
    out = _pooled(coo, table, dim, combiner, keys, weight, quantization)
    each = F.col("__sum") if combiner == "sum" else F.transform("__sum", lambda x: F.try_divide(x, F.col("__total")))
    out = out.select(*keys, each.alias("vec"))
    if samples is not None:
        out = samples.select(*keys).join(out, list(keys), "left").select(*keys, F.coalesce("vec", V.zeros(dim)).alias("vec"))
    return out


def pooled_values(coo: DataFrame, table: DataFrame, dim: int, combiner: str, keys: tuple[str, ...] = ("sample",), weight: str = "weight", quantization: Quantization | None = None) -> DataFrame:
    """(keys, d, value): ``pooled``, a row for each dimension, and divided as such: a lambda over the vector isn't compiled.
    No vector is null or empty here, so the outer form only keeps a filter on that away, which would make vectors twice."""
    each = _pooled(coo, table, dim, combiner, keys, weight, quantization).select(*keys, "__total", F.posexplode_outer("__sum").alias("d", "value"))
    value = F.col("value") if combiner == "sum" else F.try_divide("value", "__total")
    return each.select(*keys, F.col("d").cast("long").alias("d"), value.alias("value"))


def explode_vectors(df: DataFrame, *keys: str, vec: str = "vec", value: str = "value") -> DataFrame:
    """(keys, d, value): one row for each dimension."""
    return df.select(*keys, F.posexplode(vec).alias("d", value)).withColumn("d", F.col("d").cast("long"))


def sequence_lookup(rows: DataFrame, table: DataFrame, dim: int, samples: DataFrame | None = None) -> DataFrame:
    """Lookup of sequences: a vector for each (sample, step)."""
    return lookup(rows, table, dim, keys=("sample", "step"), samples=samples)
