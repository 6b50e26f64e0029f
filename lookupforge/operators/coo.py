"""From feature batches to the core relation: one row (feature, sample, id, gain) for each id of each sample.

Batches come dense or ragged (an array of ids a sample), as coordinates, or as a long id list with row offsets. Gains follow
the combiner: the weight (sum), the weight over the sample's sum of weights (mean), or over the root of its sum of squares
(sqrtn). They are fixed before duplicates merge and before limits drop anything.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookupforge.functions.ids import div
from lookupforge.specs import COMBINERS


def from_arrays(batch: DataFrame, sample: str = "sample", ids: str = "ids", weights: str | None = None, keep_empty: bool = False) -> DataFrame:
    """(sample, pos, id, weight) of a dense or ragged batch; samples without ids give a row of nulls with ``keep_empty``."""
    pairs = F.arrays_zip(F.col(ids).alias("id"), F.col(weights).alias("weight")) if weights else F.transform(F.col(ids), lambda x: F.struct(x.alias("id"), F.lit(1.0).alias("weight")))
    if weights:
        pairs = F.transform(pairs, lambda x: F.struct(x["id"].alias("id"), x["weight"].cast("double").alias("weight")))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return batch.select(F.col(sample).alias("sample"), explode(pairs).alias("pos", "x")).select("sample", F.col("pos").cast("long").alias("pos"), F.col("x.id").alias("id"), F.col("x.weight").alias("weight"))


def row_pointers(coordinates: DataFrame, samples: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, n, start, end) of a coordinate batch, for every sample of the batch: empty ones get equal pointers.

    Starts are summed per range of samples first, so no window covers all rows.
    """
    counts = samples.select(sample).join(coordinates.groupBy(sample).agg(F.count("*").alias("n")), sample, "left").select(F.col(sample).alias("sample"), F.coalesce("n", F.lit(0)).alias("n"))
    return running(counts, "sample", "n").select("sample", "n", F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("end"))


def running(df: DataFrame, order: str, value: str, width: int = 4096) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows of smaller ``order`` (distinct whole numbers).

    Blocks of ``width`` values are summed first; only block totals (one row for each ``width`` rows) are ordered in one task,
    and each block is ordered by itself.
    """
    b = df.withColumn("__block", div(F.col(order), width))
    totals = b.groupBy("__block").agg(F.sum(value).alias("__total"))
    starts = totals.select("__block", (F.sum("__total").over(Window.orderBy("__block")) - F.col("__total")).alias("__start"))
    within = F.sum(value).over(Window.partitionBy("__block").orderBy(order)) - F.col(value)
    return b.withColumn("__within", within).join(starts, "__block").withColumn("before", F.col("__start") + F.col("__within")).drop("__block", "__start", "__within")


def from_row_splits(lists: DataFrame, ids: str = "ids", offsets: str = "offsets", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, sample, pos, id) from lists of ids with the offsets of their samples (the last is the end), both arrays."""
    n = F.size(offsets) - 1
    part = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(ids), F.get(F.col(offsets), i) + 1, F.get(F.col(offsets), i + 1) - F.get(F.col(offsets), i)))
    each = lists.where(n > 0).select(*keys, F.posexplode(part).alias("sample", "part"))
    return each.select(*keys, F.col("sample").cast("long").alias("sample"), F.posexplode("part").alias("pos", "id")).withColumn("pos", F.col("pos").cast("long"))


def from_fixed_valency(flat: DataFrame, valency: int, pos: str = "pos", id_: str = "id") -> DataFrame:
    """(sample, pos, id) of a flat list in which every sample has ``valency`` ids."""
    return flat.select(div(F.col(pos), valency).alias("sample"), F.pmod(F.col(pos), F.lit(valency)).alias("pos"), F.col(id_).alias("id"))


def validate_ids(coo: DataFrame, vocabulary: int, id_: str = "id") -> DataFrame:
    """The same rows; a query over an id below 0 or beyond the vocabulary fails."""
    ok = (F.col(id_) >= 0) & (F.col(id_) < vocabulary)
    return coo.withColumn(id_, F.when(ok, F.col(id_)).otherwise(F.raise_error(F.concat(F.lit("id outside the vocabulary: "), F.col(id_).cast("string"))).cast(coo.schema[id_].dataType)))


def total_weight(combiner: str, weight: Column, square: Column | None = None) -> Column:
    """What a sample's weights are divided by, as an aggregate of its raw rows, or of merged ones with their sums of squares."""
    if combiner not in COMBINERS:
        raise ValueError(f"unknown combiner {combiner!r}")
    return {"sum": F.lit(1.0), "mean": F.sum(weight), "sqrtn": F.sqrt(F.sum(weight * weight if square is None else square))}[combiner]


def with_gains(coo: DataFrame, combiner: str, keys: tuple[str, ...] = ("sample",), weight: str = "weight", deal: bool = False) -> DataFrame:
    """Merged rows (keys, id, gain, n_raw): equal ids of a sample add up.

    Raw rows are pre-aggregated on (keys, id) before any shuffle; the sample's totals are an aggregate of the raw rows and
    join back on the keys, so a sample with very many ids is never gathered. A zero total gives a null gain. With ``deal``, raw
    rows are dealt by the keys, once, and totals are a window over the sample; the result stays dealt: for what gathers a
    sample's rows anyway.
    """
    if combiner not in COMBINERS:
        raise ValueError(f"unknown combiner {combiner!r}")
    w = F.col(weight).cast("double")
    if deal:
        coo = coo.repartition(*keys)
    squares = [F.sum(w * w).alias("__q")] if deal and combiner == "sqrtn" else []
    merged = coo.groupBy(*keys, "id").agg(F.sum(w).alias("__w"), F.count("*").alias("n_raw"), *squares)
    if combiner == "sum":
        return merged.select(*keys, "id", F.col("__w").alias("gain"), "n_raw")
    if deal:  # a join with totals would shuffle the rows again for them
        whole = Window.partitionBy(*keys)
        total = F.sum("__w").over(whole) if combiner == "mean" else F.sqrt(F.sum("__q").over(whole))
        merged = merged.where(functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).withColumn("__total", total)
        return merged.select(*keys, "id", F.try_divide(F.col("__w"), F.col("__total")).alias("gain"), "n_raw")
    totals = coo.groupBy(*keys).agg(total_weight(combiner, w).alias("__total"))
    return merged.join(totals, list(keys)).select(*keys, "id", F.try_divide(F.col("__w"), F.col("__total")).alias("gain"), "n_raw")


def raw_gains(coo: DataFrame, combiner: str, keys: tuple[str, ...] = ("sample",), weight: str = "weight") -> DataFrame:
    """Every raw row with its gain, unmerged."""
    w = F.col(weight).cast("double")
    if combiner == "sum":
        return coo.withColumn("gain", w)
    totals = coo.groupBy(*keys).agg(total_weight(combiner, w).alias("__total"))
    return coo.join(totals, list(keys)).withColumn("gain", F.try_divide(w, F.col("__total"))).drop("__total")


def union_features(features: dict[str, DataFrame]) -> DataFrame:
    """All features' rows with their names: one relation, so that one plan serves them all."""
    out = None
    for name, df in sorted(features.items()):
        one = df.withColumn("feature", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no feature is given")
    return out


def process_slice(df: DataFrame, process: int, processes: int, batch: int, sample: str = "sample") -> DataFrame:
    """The rows of one process's share of a batch."""
    per = batch // processes
    return df.where((F.col(sample) >= process * per) & (F.col(sample) < (process + 1) * per))


def sequence_rows(batch: DataFrame, length: int, sample: str = "sample", steps: str = "steps") -> DataFrame:
    """(sample, step, pos, id, row) of sequences of id lists: each step is a row of its own."""
    a = batch.select(F.col(sample).alias("sample"), F.posexplode(steps).alias("step", "ids"))
    return a.select("sample", F.col("step").cast("long").alias("step"), F.posexplode("ids").alias("pos", "id")).withColumn("pos", F.col("pos").cast("long")).withColumn("row", F.col("sample") * F.lit(length) + F.col("step"))
