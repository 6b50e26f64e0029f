"""Statistics of limits: merged in a process, across files, across contributors, and applied to stack specs."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookupforge.specs import StackSpec


def merge_in_process(stats: DataFrame, *keys: str) -> DataFrame:
    """Limits by their maximum, drops by their sum."""
    return stats.groupBy(*keys).agg(F.max("max_ids").alias("max_ids"), F.max("max_unique").alias("max_unique"), F.max("buffer").alias("buffer"), F.sum("dropped").alias("dropped"))


def merge_across_files(stats: DataFrame, *keys: str) -> DataFrame:
    """Every field by its maximum, drops as well."""
    return stats.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("max_ids", "max_unique", "buffer", "dropped")])


def latest_per_process(stats: DataFrame, process: str = "process", at: str = "at") -> DataFrame:
    """The rows of each process's last publication."""
    last = stats.groupBy(process).agg(F.max(at).alias(at))
    return stats.join(last, [process, at], "left_semi")


def any_flag(flags: DataFrame, *keys: str) -> DataFrame:
    return flags.groupBy(*keys).agg(F.bool_or("flag").alias("flag"))


def or_masks(masks: DataFrame, *keys: str) -> DataFrame:
    return masks.groupBy(*keys).agg(F.bit_or("mask").alias("mask"))


def first_contributions(messages: DataFrame, key: str = "sync_key", source: str = "source", order: str = "at") -> DataFrame:
    """The first message of each source for each key; later ones are ignored."""
    return messages.groupBy(key, source).agg(F.min_by("flag", order).alias("flag"), F.min(order).alias(order))


def missing_sources(messages: DataFrame, sources: DataFrame, keys: DataFrame, key: str = "sync_key", source: str = "source") -> DataFrame:
    """(key, source) pairs that have not been heard of. ``sources`` is the list of ranks; each key is expanded in place."""
    ranks = sources.agg(F.sort_array(F.collect_set(source)).alias("all"))  # as many as there are hosts
    heard = messages.groupBy(key).agg(F.collect_set(source).alias("heard"))
    wanted = keys.groupBy(F.col(key).alias("__key")).agg(F.lit(1).alias("__one"))
    expected = wanted.join(heard.withColumnRenamed(key, "__heard"), F.col("__key") == F.col("__heard"), "left").join(F.broadcast(ranks)).withColumnRenamed("__key", key)
    return expected.select(key, F.explode(F.array_except("all", F.coalesce("heard", F.array()))).alias(source))


def per_device(stats: DataFrame, sc_per_device: int, value: str, *keys: str) -> DataFrame:
    return stats.groupBy(*keys).agg((F.max(value) * F.lit(sc_per_device)).alias(value))


def apply_limits(stacks: list[StackSpec], observed: DataFrame) -> list[StackSpec]:
    """Stacks with the observed (stack, max_ids, max_unique, buffer); those without observation stay as they are."""
    by = {r.stack: r for r in observed.groupBy("stack").agg(F.max("max_ids").alias("max_ids"), F.max("max_unique").alias("max_unique"), F.max("buffer").alias("buffer")).collect()}  # one row a stack
    return [s if s.name not in by else dataclasses.replace(s, max_ids_per_partition=int(by[s.name].max_ids), max_unique_ids_per_partition=int(by[s.name].max_unique), suggested_buffer=int(by[s.name].buffer)) for s in stacks]


def feature_row_offsets(features: DataFrame) -> DataFrame:
    """(feature, stack, samples, row_offset): features of a stack in the order of their names."""
    w = Window.partitionBy("stack").orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)
    return features.withColumn("row_offset", F.coalesce(F.sum("samples").over(w), F.lit(0)))
