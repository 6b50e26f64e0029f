"""Stacks: several tables in one address space, modulo-sharded with a rotation for each table."""

from __future__ import annotations

import dataclasses
import math
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookupforge.functions import vectors as V
from lookupforge.functions.ids import div, logical_row, physical_row
from lookupforge.specs import FeatureSpec, Placement, StackSpec, TableSpec, Topology, grouped_names, round_up, stack_name, unique_names

MEMORY_LIMIT = 2 << 20


def default_limit(stack: str, batch: int) -> int:
    return 256


def stack_tables(tables: Iterable[TableSpec], topology: Topology, name: str | None = None, rotation: int | None = None, limits: Callable[[str, int], int] = default_limit, batch: int = 0, taken: Iterable[str] = (), stacked: Iterable[str] = ()) -> StackSpec:
    """One stack of the tables, in their order. ValueError for tables that repeat, are stacked already, or differ in
    optimizer, combiner or quantization, and for a name that is taken."""
    tables = list(tables)
    unique_names(tables, "table")
    if not tables:
        raise ValueError("a stack needs a table")
    if again := {t.name for t in tables} & set(stacked):
        raise ValueError(f"already stacked: {sorted(again)}")
    for what in ("optimizer", "combiner", "quantization"):
        if len({getattr(t, what) for t in tables}) > 1:
            raise ValueError(f"the tables of a stack need the same {what}")
    name = name or stack_name(t.name for t in tables)
    if name in set(taken):
        raise ValueError(f"the stack name {name!r} is taken")
    g = topology.num_scs
    step = topology.sc_per_device if rotation is None else rotation
    dim = max(round_up(t.embedding_dim, 8) for t in tables)
    placed, offset = [], 0
    for i, t in enumerate(tables):
        vocab = round_up(t.vocabulary_size, 8 * g)
        placed.append(Placement(t.name, name, vocab, dim, offset // g, i * step % g, t.vocabulary_size, t.embedding_dim))
        offset += vocab
    first = tables[0]
    ids, unique = first.max_ids_per_partition, first.max_unique_ids_per_partition
    if len(tables) > 1:
        warnings.warn(f"limits of stack {name} come from a default, not from its tables", stacklevel=2)
        ids = unique = limits(name, batch)
    return StackSpec(name, offset, dim, first.combiner, first.optimizer, ids, unique, tuple(placed), first.quantization)


def activation_bytes(table: TableSpec, samples: int, topology: Topology) -> int:
    return round_up(table.embedding_dim, 8) * -(-samples // topology.num_scs) * 4


def auto_stack(tables: Iterable[TableSpec], features: Iterable[FeatureSpec], topology: Topology, memory: int = MEMORY_LIMIT, **kw: object) -> list[StackSpec]:
    """Stacks by padded dimension, optimizer, combiner and quantization, filled first-fit under the activation memory limit,
    in the given order."""
    samples: dict[str, int] = defaultdict(int)
    for f in features:
        samples[f.table] += math.prod(f.output_shape[:-1])
    bins: dict[tuple, list[list[TableSpec]]] = defaultdict(list)
    use: dict[int, int] = {}
    for t in unique_names(tables, "table").values():
        need = activation_bytes(t, samples[t.name], topology)
        group = bins[round_up(t.embedding_dim, 8), t.optimizer, t.combiner, t.quantization]
        home = next((b for b in group if use[id(b)] + need <= memory), None)
        if home is None:
            group.append(home := [])
            use[id(home)] = 0
        home.append(t)
        use[id(home)] += need
    out: list[StackSpec] = []
    for group in bins.values():
        for b in group:
            out.append(stack_tables(b, topology, taken=[s.name for s in out], **kw))
    return out


def members(stacks: Iterable[StackSpec]) -> dict[str, list[str]]:
    return {s.name: [p.table for p in s.tables] for s in stacks}


def placement_rows(spark, stacks: Iterable[StackSpec]) -> DataFrame:  # noqa: ANN001
    """The specs as a relation, for joins on table names."""
    rows = [dataclasses.astuple(p) for s in stacks for p in s.tables]
    return spark.createDataFrame(rows, "table string, stack string, padded_vocab long, padded_dim int, row_offset_in_shard long, rotation int, vocabulary_size long, embedding_dim int")


def shard_table(table: DataFrame, p: Placement, stack_vocab: int, topology: Topology, pad: float = float("nan"), columns: tuple[str, ...] = ("vec",)) -> DataFrame:
    """(row, columns) of one table in its stack, padded rows and dimensions included: a projection and one join with the
    range of padding rows, no sort."""
    g = topology.num_scs
    place = lambda c: physical_row(c, g, stack_vocab, p.row_offset_in_shard, p.rotation)
    own = table.where(F.col("id") < p.vocabulary_size).select(place(F.col("id")).alias("row"), *[V.pad(F.col(c).cast("array<double>"), p.padded_dim, pad).alias(c) for c in columns])
    if p.padded_vocab > p.vocabulary_size:
        empty = F.array_repeat(F.lit(float(pad)), p.padded_dim)
        own = own.union(table.sparkSession.range(p.vocabulary_size, p.padded_vocab).select(place(F.col("id")).alias("row"), *[empty.alias(c) for c in columns]))
    return own


def stack_and_shard(tables: dict[str, DataFrame], stack: StackSpec, topology: Topology, pad: float = float("nan"), columns: tuple[str, ...] = ("vec",)) -> DataFrame:
    """(row, shard, columns) of a whole stack: every row of its address space once."""
    if missing := {p.table for p in stack.tables} - set(tables):
        raise ValueError(f"tables are missing: {sorted(missing)}")
    out = None
    for p in stack.tables:
        one = shard_table(tables[p.table], p, stack.vocab, topology, pad, columns)
        out = one if out is None else out.unionByName(one)
    return out.select("row", div(F.col("row"), stack.vocab // topology.num_scs).alias("shard"), *columns)


def unstack(stacked: DataFrame, stack: StackSpec, table: str, topology: Topology, columns: tuple[str, ...] = ("vec",)) -> DataFrame:
    """(id, columns) of one table of a stack, without padding: arithmetic and a filter."""
    p = next((p for p in stack.tables if p.table == table), None)
    if p is None:
        raise ValueError(f"{table} isn't in stack {stack.name}")
    g, size = topology.num_scs, stack.vocab // topology.num_scs
    at = F.pmod(F.col("row"), F.lit(size)) - F.lit(p.row_offset_in_shard)
    mine = stacked.where((at >= 0) & (at < p.padded_vocab // g))
    rows = mine.select(logical_row(F.col("row"), g, stack.vocab, p.row_offset_in_shard, p.rotation).alias("id"), *columns)
    return rows.where(F.col("id") < p.vocabulary_size).select("id", *[V.unpad(F.col(c), p.embedding_dim).alias(c) for c in columns])


def reshard(stacked: DataFrame, source: StackSpec, source_topology: Topology, target: StackSpec, target_topology: Topology, columns: tuple[str, ...] = ("vec",), pad: float = 0.0) -> DataFrame:
    """A stack's rows laid out for another topology or other offsets; slots are columns like the vectors."""
    return stack_and_shard({p.table: unstack(stacked, source, p.table, source_topology, columns) for p in source.tables}, target, target_topology, pad, columns)


def restack(stacks: Iterable[StackSpec], tables: dict[str, TableSpec], topology: Topology, features: Iterable[FeatureSpec] | None = None, regroup: bool = False, memory: int = MEMORY_LIMIT) -> list[StackSpec]:
    """Stacks for another topology: grouped anew with ``regroup`` (by ``auto_stack``), else the same groups of tables. With
    ``features``, ValueError where a kept group passes the activation memory limit there."""
    stacks = list(stacks)
    grouped_names([[p.table for p in s.tables] for s in stacks], tables)
    if regroup:
        return auto_stack(tables.values(), features or (), topology, memory)
    samples: dict[str, int] = defaultdict(int)
    for f in features or ():
        samples[f.table] += math.prod(f.output_shape[:-1])
    for s in stacks:
        if (need := sum(activation_bytes(tables[p.table], samples[p.table], topology) for p in s.tables)) > memory:
            raise ValueError(f"stack {s.name} needs {need} bytes of activations, the limit is {memory}")
    return [dataclasses.replace(stack_tables([tables[p.table] for p in s.tables], topology, s.name), max_ids_per_partition=s.max_ids_per_partition, max_unique_ids_per_partition=s.max_unique_ids_per_partition) for s in stacks]


def shard_rows(table: DataFrame, g: int, vocab: int) -> DataFrame:
    """(row, shard, local, ...) of one table, modulo-sharded and laid shard after shard."""
    return table.select(F.pmod("id", F.lit(g)).alias("shard"), div(F.col("id"), g).alias("local"), (F.pmod("id", F.lit(g)) * F.lit(vocab // g) + div(F.col("id"), g)).alias("row"), *[c for c in table.columns if c != "id"])


def unshard_rows(table: DataFrame, g: int, vocab: int) -> DataFrame:
    return table.select((F.pmod("row", F.lit(vocab // g)) * F.lit(g) + div(F.col("row"), vocab // g)).alias("id"), *[c for c in table.columns if c not in ("row", "shard", "local")])


def init_table(spark, rows: int, dim: int, value: Callable[[Column, Column], Column], slots: dict[str, float] | None = None) -> DataFrame:  # noqa: ANN001
    """(id, vec, slots): each value from its row and dimension."""
    d = F.sequence(F.lit(0), F.lit(dim - 1))
    out = spark.range(rows).select("id", F.transform(d, lambda i: value(F.col("id"), i).cast("double")).alias("vec"))
    for name, first in (slots or {}).items():
        out = out.withColumn(name, F.array_repeat(F.lit(float(first)), dim))
    return out
