"""Training as plans: single steps, runs of steps over versioned tables, and the pipelined order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookupforge.operators.lookup import lookup
from lookupforge.operators.update import update, with_slots
from lookupforge.plans.preprocess import Batch, Preprocessed, feature_rows, preprocess, stacked_gradients
from lookupforge.sources.staging import staged
from lookupforge.specs import FeatureSpec, Optimizer, StackSpec, Topology, same_keys

GradFn = Callable[[DataFrame, int], DataFrame]


class EmbeddingLayer:
    """preprocess, lookup and apply_gradient over one table: the new table takes the place of the old one."""

    def __init__(self, dim: int, opt: Optimizer):
        self.dim, self.opt = dim, opt

    def __call__(self, coo: DataFrame, table: DataFrame, samples: DataFrame | None = None) -> DataFrame:
        return lookup(coo, table, self.dim, samples=samples)

    def apply_gradient(self, coo: DataFrame, table: DataFrame, grads: DataFrame, step: int | None = None) -> DataFrame:
        return update(table, coo, grads, self.dim, self.opt, step)


class StackedLayer:
    """The same over all features of several stacks, with tables by stack: (id, vec, slots), ids as ``preprocess`` gives them."""

    def __init__(self, features: dict[str, FeatureSpec], stacks: list[StackSpec], topology: Topology):
        self.features, self.topology = features, topology
        self.stacks = {s.name: s for s in stacks}
        self.stack_of = {p.table: s.name for s in stacks for p in s.tables}
        one_lookup_per_table([p.table for s in stacks for p in s.tables], list(self.stack_of))

    def _features(self, stack: str) -> list[str]:
        return sorted(n for n, f in self.features.items() if self.stack_of[f.table] == stack)

    def preprocess_inputs(self, batches: dict[str, Batch], **options: bool) -> Preprocessed:
        return preprocess(batches, self.features, list(self.stacks.values()), self.topology, **options)

    def __call__(self, pre: Preprocessed, tables: dict[str, DataFrame], sizes: dict[str, int]) -> dict[str, DataFrame]:
        """(sample, vec) of each feature."""
        same_keys(tables, self.stacks, "tables and stacks")
        out = {}
        for name, stack in self.stacks.items():
            act = lookup(pre.rows.where(F.col("stack") == name), tables[name], stack.dim, ("row",), quantization=stack.quantization)
            for f in self._features(name):
                out[f] = feature_rows(pre, act, f, stack, sizes[f], self.topology, self.features[f].output_shape[-1])
        return out

    def apply_gradient(self, pre: Preprocessed, tables: dict[str, DataFrame], gradients: dict[str, DataFrame], sizes: dict[str, int], step: int | None = None) -> dict[str, DataFrame]:
        """The new tables, from (sample, grad) of each feature."""
        same_keys(gradients, self.features, "gradients and features")
        out = {}
        for name, stack in self.stacks.items():
            grads = stacked_gradients(pre, {f: gradients[f] for f in self._features(name)}, sizes, stack, self.topology)
            rows = pre.rows.where(F.col("stack") == name).select("row", "id", "gain")
            out[name] = update(tables[name], rows, grads, stack.dim, stack.optimizer, step, keys=("row",))
        return out


def staged_version(table: DataFrame, step: int) -> DataFrame:
    return staged(table, f"version-{step}")


def run_steps(table: DataFrame, batches: list[DataFrame], gradient: GradFn, dim: int, opt: Optimizer, keep: Callable[[DataFrame, int], DataFrame] = staged_version) -> DataFrame:
    """The table after one update for each batch. ``gradient`` makes (sample, grad) from the batch's activations and step.
    ``keep`` writes each version and reads it back: a version is used several times, and a plan that holds all of them would
    grow with the power of the steps."""
    layer, table = EmbeddingLayer(dim, opt), with_slots(table, opt)
    for step, coo in enumerate(batches):
        table = keep(layer.apply_gradient(coo, table, gradient(layer(coo, table), step), step), step)
    return table


@dataclass(frozen=True)
class Stages:
    """The three parts of a step. ``forward`` (batch, table) and ``dense`` (what forward gave, step) give a frame and an
    auxiliary result of any kind; ``backward`` (batch, table, gradients, step) gives the new table."""

    forward: Callable[[DataFrame, DataFrame], tuple[DataFrame, object]]
    dense: Callable[[DataFrame, int], tuple[DataFrame, object]]
    backward: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


def default_stages(gradient: GradFn, dim: int, opt: Optimizer) -> Stages:
    layer = EmbeddingLayer(dim, opt)
    return Stages(lambda coo, table: (layer(coo, table), None), lambda act, step: (gradient(act, step), None), lambda coo, table, grads, step: layer.apply_gradient(coo, table, grads, step))


@dataclass(frozen=True)
class PipelineState:
    """What a cycle hands to the next: the last batch's activations and the last but one's gradients."""

    activations: DataFrame
    gradients: DataFrame


def initial_state(spark: SparkSession) -> PipelineState:
    """Before the first batch: no activations, no gradients; an update with them changes nothing."""
    return PipelineState(spark.createDataFrame([], "sample long, vec array<double>"), spark.createDataFrame([], "sample long, grad array<double>"))


def run_stages(table: DataFrame, batches: list[DataFrame], stages: Stages, keep: Callable[[DataFrame, int], DataFrame] = staged_version) -> tuple[DataFrame, list[DataFrame], list[tuple]]:
    """(table, activations, auxiliary results of forward and dense of each batch) in the pipelined order: cycle i first applies
    batch i-2's gradients, then looks up batch i, then makes batch i-1's gradients. A lookup sees updates up to two batches
    back. Cycles without a gradient change nothing."""
    n = len(batches)
    active: dict[int, tuple] = {}
    grads: dict[int, tuple] = {}
    for i in range(n + 2):
        if i - 2 in grads:
            table = keep(stages.backward(batches[i - 2], table, grads[i - 2][0], i - 2), i - 2)
        if i < n:
            active[i] = stages.forward(batches[i], table)
        if 0 <= i - 1 < n:
            grads[i - 1] = stages.dense(active[i - 1][0], i - 1)
    return table, [active[i][0] for i in range(n)], [(active[i][1], grads[i][1]) for i in range(n)]


def run_pipelined(table: DataFrame, batches: list[DataFrame], gradient: GradFn, dim: int, opt: Optimizer, keep: Callable[[DataFrame, int], DataFrame] = staged_version) -> tuple[DataFrame, list[DataFrame]]:
    """(table, activations of each batch) in the pipelined order (``run_stages``), with the usual stages."""
    return run_stages(with_slots(table, opt), batches, default_stages(gradient, dim, opt), keep)[:2]


def one_lookup_per_table(lookups: list[str], updates: list[str]) -> None:
    """ValueError unless every table is looked up once and updated once."""
    if len(set(lookups)) != len(lookups) or len(set(updates)) != len(updates) or set(lookups) != set(updates):
        raise ValueError("each table needs exactly one lookup and one update")


def cross_entropy(logits: DataFrame, labels: DataFrame, key: str = "sample") -> DataFrame:
    """(loss, n): mean softmax cross-entropy of (key, vec) with (key, label)."""
    top = F.array_max("vec")
    log_sum = top + F.log(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return logits.join(labels, key).agg(F.avg(log_sum - F.get("vec", F.col("label").cast("int"))).alias("loss"), F.count("*").alias("n"))
