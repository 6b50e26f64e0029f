"""Backward pass: route gradients to ids, sum them, apply the optimizer once for each touched id, merge.

Tables are (id, vec, one array column for each slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.functions import vectors as V
from lookupforge.operators.optimizers import initial_slots, kind_of
from lookupforge.specs import Optimizer


def gradient_sums(coo: DataFrame, grads: DataFrame, dim: int, keys: tuple[str, ...] = ("sample",), by: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, grad): each id's sum of gain times its samples' gradients. Partial sums are kept per id before the shuffle."""
    g = grads.select(*keys, F.col("grad").alias("__grad"))
    return V.summed(coo.join(g, list(keys)), list(by), "__grad", "gain", dim, "grad")


def with_slots(table: DataFrame, opt: Optimizer) -> DataFrame:
    """The table with every slot of the optimizer, at its first value where it is missing."""
    for name, first in initial_slots(opt).items():
        if name not in table.columns:
            table = table.withColumn(name, F.array_repeat(F.lit(float(first)), F.size("vec")))
    return table


def touched(table: DataFrame, sums: DataFrame, opt: Optimizer, step: int | None = None) -> DataFrame:
    """New (id, vec, slots) of the ids that have a gradient, even of zero; no other rows."""
    kind, params = kind_of(opt)
    names, lr = list(initial_slots(opt)), opt.rate(step)
    rows = with_slots(table, opt).join(sums.select("id", "grad"), "id")

    def one(x):  # noqa: ANN001, ANN202
        w, slots = kind.rule(x["vec"].cast("double"), x["grad"], {n: x[n] for n in names}, lr, step, **params)
        return F.struct(V.clip_value(w, opt.clip_low, opt.clip_high).alias("vec"), *[slots[n].alias(n) for n in names])

    done = rows.select("id", F.transform(F.arrays_zip("vec", "grad", *names), one).alias("__new"))
    return done.select("id", *[F.col("__new").getField(n).alias(n) for n in ("vec", *names)])


def merge(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new rows in place of the old; all others as they were."""
    renamed = new.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in new.columns if c != "id"])
    cols = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c).cast(new.schema[c].dataType)).alias(c) if c in new.columns and c != "id" else F.col(c) for c in table.columns]
    return table.join(renamed, "id", "left").select(*cols)


def update(table: DataFrame, coo: DataFrame, grads: DataFrame, dim: int, opt: Optimizer, step: int | None = None, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """One training step's new table."""
    full = with_slots(table, opt)
    return merge(full, touched(full, gradient_sums(coo, grads, dim, keys), opt, step))
