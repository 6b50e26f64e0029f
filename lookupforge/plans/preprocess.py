"""Preprocessing of a whole batch: features of arrays or coordinates in, placed rows and statistics out.

Every feature's rows get their gains, their place in the stack's address space and their row in the stacked batch; features of
a stack are one union, merged once. The result is lazy but for the two answers that decide the plan's shape: whether limits
are passed, and the split mask.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookupforge.functions import vectors as V
from lookupforge.functions.ids import bucket, div, shift_offset, stacked_row, unstacked_sample
from lookupforge.operators import coo as C
from lookupforge.operators import layout as L
from lookupforge.operators import minibatch as M
from lookupforge.specs import FeatureSpec, StackSpec, Topology, same_keys


class Batch(Protocol):
    """A feature's batch."""

    size: int

    def to_coo(self) -> DataFrame:
        """(sample, pos, id, weight)"""


@dataclass(frozen=True)
class Arrays:
    """Dense or ragged: (sample, ids[, weights])."""

    df: DataFrame
    size: int
    weights: str | None = None

    def to_coo(self) -> DataFrame:
        return C.from_arrays(self.df, weights=self.weights)


@dataclass(frozen=True)
class Coordinates:
    """Sparse coordinates: (sample, pos, id), weights of one."""

    df: DataFrame
    size: int

    def to_coo(self) -> DataFrame:
        return self.df.select("sample", "pos", "id", F.lit(1.0).alias("weight"))


@dataclass(frozen=True)
class Rows:
    """Rows that are there already: (sample, id, weight)."""

    df: DataFrame
    size: int

    def to_coo(self) -> DataFrame:
        return self.df


@dataclass(frozen=True)
class Preprocessed:
    """``rows``: (stack, local_sc, bucket, global_sc, local_id, row, id, gain, n_raw[, minibatch]), ids in the stack's address
    space. ``stats``: (stack, local_sc, global_sc, ids, unique_ids, required) before any split or drop."""

    rows: DataFrame
    stats: DataFrame
    dropped: DataFrame
    minibatches: int
    offsets: dict[str, int]
    batch_rows: dict[str, int]


def row_offsets(features: dict[str, FeatureSpec], sizes: dict[str, int], stack_of: dict[str, str]) -> tuple[dict[str, int], dict[str, int]]:
    """Each feature's first row in its stack, in the order of names, and the stacks' rows."""
    offsets: dict[str, int] = {}
    total: dict[str, int] = {}
    for name in sorted(features):
        stack = stack_of[features[name].table]
        offsets[name] = total.get(stack, 0)
        total[stack] = offsets[name] + sizes[name]
    return offsets, total


def preprocess(batches: dict[str, Batch], features: dict[str, FeatureSpec], stacks: list[StackSpec], topology: Topology, allow_id_dropping: bool = False, enable_minibatching: bool = False, hash_: Callable[[Column], Column] = F.xxhash64) -> Preprocessed:
    """Place a batch. ValueError where names differ, sizes don't divide among the shards, or limits are passed and neither
    dropping nor minibatches are allowed."""
    same_keys(batches, features, "features")
    place_of = {p.table: (s, p) for s in stacks for p in s.tables}
    if missing := {f.table for f in features.values()} - set(place_of):
        raise ValueError(f"tables without a stack: {sorted(missing)}")
    slices, g = topology.local_scs, topology.num_scs
    offsets, total = row_offsets(features, {n: b.size for n, b in batches.items()}, {t: s.name for t, (s, _) in place_of.items()})
    rows, stats, dropped, over, masks = [], [], [], False, None
    for s in stacks:
        own = []
        for name in sorted(n for n in features if place_of[features[n].table][0].name == s.name):
            p = place_of[features[name].table][1]
            at = stacked_row(F.col("sample"), batches[name].size, slices, total[s.name] // slices, offsets[name])
            own.append(batches[name].to_coo().select(at.alias("row"), shift_offset(F.col("id"), p.rotation, p.row_offset_in_shard * g, g).alias("id"), F.col("weight").cast("double").alias("weight")))
        if not own:
            continue
        union = own[0]
        for x in own[1:]:
            union = union.unionByName(x)
        placed = L.place(C.with_gains(union, s.combiner, ("row",), deal=True), topology, total[s.name] // slices, row="row", bucket=bucket(F.col("id"), hash_) if enable_minibatching else None)
        whole = L.partition_stats(placed.withColumn("bucket", F.lit(0).cast("long")))
        stats.append(whole.join(L.required_buffer(whole), "local_sc").select(F.lit(s.name).alias("stack"), "local_sc", "global_sc", "ids", "unique_ids", "required"))
        limits = s.max_ids_per_partition, s.max_unique_ids_per_partition
        top = L.check_limits(L.place(union.select("row", "id", F.lit(1.0).alias("gain"), F.lit(1).alias("n_raw")), topology, total[s.name] // slices, row="row"), *limits, allow_dropping=True)
        if top["ids"] > limits[0] or top["unique_ids"] > limits[1]:  # raw rows only bound the merged ones, but are counted without a shuffle of rows
            top = L.check_limits(placed.withColumn("bucket", F.lit(0).cast("long")), *limits, allow_dropping=allow_id_dropping or enable_minibatching)
        over |= top["ids"] > limits[0] or top["unique_ids"] > limits[1]
        rows.append((s, placed, limits))
    if over and enable_minibatching:
        for _, placed, limits in rows:
            m = M.global_mask(placed, *limits).select("mask")
            masks = m if masks is None else masks.union(m)
        masks = masks.agg(F.bit_or("mask").alias("mask"))
    out = None
    for s, placed, limits in rows:
        if masks is not None:
            placed = M.with_minibatch(placed, masks).withColumn("bucket", F.col("minibatch"))
        else:
            placed = placed.withColumn("bucket", F.lit(0).cast("long")).withColumn("minibatch", F.lit(0).cast("long"))
        kept = L.drop_beyond_limits(placed, *limits) if over and (allow_id_dropping or enable_minibatching) else placed
        dropped.append(L.drop_counts(placed, *limits).select(F.lit(s.name).alias("stack"), "local_sc", "dropped"))
        one = kept.select(F.lit(s.name).alias("stack"), "local_sc", "minibatch", "global_sc", "local_id", "row", "id", "gain", "n_raw")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no feature is given")
    n = 1 if masks is None else int(masks.select(F.bit_count("mask") + 1).first()[0])
    return Preprocessed(out, _union(stats), _union(dropped), n, offsets, {s.name: total[s.name] for s, _, _ in rows})


@dataclass(frozen=True)
class Buffers:
    """A stack's buffers. ``rows``: (local_sc, position, embedding_id, sample_id, gain), with aligned places; with minibatches,
    ``local_sc`` is the device. ``pointers``: (local_sc, slot, pointer), or the minibatches' partitions (device, local_sc,
    minibatch, global_sc, ids, start). ``dropped``: (local_sc, limits, overflow). ``capacity``: places of a source or device."""

    rows: DataFrame
    pointers: DataFrame
    dropped: DataFrame
    capacity: int

    def total_dropped(self) -> int:
        return self.dropped.agg(F.coalesce(F.sum(F.col("limits") + F.col("overflow")), F.lit(0))).first()[0]


def buffers(pre: Preprocessed, stack: StackSpec, topology: Topology, padding: bool = True) -> Buffers:
    """Lay a stack's rows out in buffers of the suggested size, or of the theoretical one. What finds no place is dropped and
    counted; minibatches share the buffer of their device."""
    mini = pre.minibatches > 1
    size = L.buffer_size(stack.max_ids_per_partition, topology, stack.suggested_buffer, mini)
    batch = pre.batch_rows[stack.name] // topology.local_scs
    placed = pre.rows.where(F.col("stack") == stack.name).withColumn("bucket", F.col("minibatch"))
    lost = pre.dropped.where(F.col("stack") == stack.name).groupBy("local_sc").agg(F.sum("dropped").alias("limits"))
    if not mini:
        capacity = size // topology.sc_per_device
        rows, pointers = L.csr_rows(placed, capacity, batch, padding), L.row_pointers(placed, topology, topology.local_scs, capacity)
        over = L.overflow_counts(placed, capacity)
    else:
        capacity, keys = size, ["local_sc", "minibatch", "global_sc"]
        pointers = L.pack_minibatches(placed, topology.sc_per_device)
        at = L.ranked(placed).join(pointers.select("device", *keys, "start"), keys).withColumn("position", F.col("start") + F.col("rank") - 1)
        rows = at.where(F.col("position") < capacity).select(F.col("device").alias("local_sc"), "position", F.col("local_id").alias("embedding_id"), F.pmod("row", F.lit(batch)).alias("sample_id"), F.col("gain").cast("double").alias("gain"))
        over = at.where(F.col("position") >= capacity).groupBy("local_sc").agg(F.count("*").alias("overflow"))
    sources = placed.sparkSession.range(topology.local_scs).select(F.col("id").alias("local_sc"))
    dropped = sources.join(lost, "local_sc", "left").join(over, "local_sc", "left").select("local_sc", F.coalesce("limits", F.lit(0)).alias("limits"), F.coalesce("overflow", F.lit(0)).alias("overflow"))
    return Buffers(rows, pointers, dropped, capacity)


def shapes(features: dict[str, FeatureSpec], stacks: list[StackSpec], topology: Topology, minibatching: bool = False) -> dict[str, dict[str, int]]:
    """Sizes of each stack's buffers of one device, from specs alone: row pointers, places, and rows of the stacked batch."""
    of = {p.table: s.name for s in stacks for p in s.tables}
    batch: dict[str, int] = {}
    for f in features.values():
        batch[of[f.table]] = batch.get(of[f.table], 0) + math.prod(f.input_shape[:-1])
    return {s.name: {"row_pointers": L.row_pointer_size(topology, minibatching), "places": L.buffer_size(s.max_ids_per_partition, topology, s.suggested_buffer, minibatching), "rows": batch[s.name]} for s in stacks if s.name in batch}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def stacked_ids(stack: StackSpec, topology: Topology, stacked: DataFrame) -> DataFrame:
    """A stacked table's (row, vec) by the ids that ``preprocess`` gives."""
    g, size = topology.num_scs, stack.vocab // topology.num_scs
    return stacked.select((F.pmod("row", F.lit(size)) * F.lit(g) + div(F.col("row"), size)).alias("id"), *[c for c in stacked.columns if c not in ("row", "shard")])


def feature_rows(pre: Preprocessed, activations: DataFrame, name: str, stack: StackSpec, size: int, topology: Topology, dim: int | None = None) -> DataFrame:
    """(sample, vec) of one feature out of a stack's (row, vec), cut to ``dim``; ValueError beyond the stack's dimension."""
    if dim is not None and dim > stack.dim:
        raise ValueError(f"{name} wants {dim} dimensions of a stack of {stack.dim}")
    slices = topology.local_scs
    at = unstacked_sample(F.col("row"), size, slices, pre.batch_rows[stack.name] // slices, pre.offsets[name])
    vec = F.col("vec") if dim is None else V.unpad(F.col("vec"), dim)
    return activations.select(at.alias("sample"), vec.alias("vec")).where("sample is not null")


def stacked_gradients(pre: Preprocessed, gradients: dict[str, DataFrame], sizes: dict[str, int], stack: StackSpec, topology: Topology) -> DataFrame:
    """(row, grad) of a stack out of its features' (sample, grad), padded to the stack's dimension."""
    slices, out = topology.local_scs, []
    for name, grads in sorted(gradients.items()):
        at = stacked_row(F.col("sample"), sizes[name], slices, pre.batch_rows[stack.name] // slices, pre.offsets[name])
        out.append(grads.select(at.alias("row"), V.pad(F.col("grad").cast("array<double>"), stack.dim).alias("grad")))
    return _union(out)

