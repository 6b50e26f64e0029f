"""Frozen descriptions of tables, features, stacks, topologies and optimizers, and their JSON form."""

from __future__ import annotations

import dataclasses
import hashlib
import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

COMBINERS = ("sum", "mean", "sqrtn")


def round_up(value: int, multiple: int) -> int:
    return -(-value // multiple) * multiple


@dataclass(frozen=True)
class Topology:
    """Logical shards; independent of Spark's partitions."""

    devices: int = 1
    sc_per_device: int = 4
    local_devices: int | None = None

    def __post_init__(self) -> None:
        if self.num_scs < 1 or self.num_scs & (self.num_scs - 1):
            raise ValueError(f"the number of shards must be a power of two, not {self.num_scs}")

    @property
    def num_scs(self) -> int:
        return self.devices * self.sc_per_device

    @property
    def local_scs(self) -> int:
        return (self.local_devices or self.devices) * self.sc_per_device


#: Shards of one device, by kind. Fixed values.
SC_PER_DEVICE = {"v5": 4, "v5p": 4, "v6e": 2, "v6 lite": 2, "7x": 2}


def sc_per_device(kind: str) -> int:
    """Shards of a device of this kind; ValueError for an unknown one."""
    try:
        return SC_PER_DEVICE[kind.lower()]
    except KeyError:
        raise ValueError(f"unknown device kind {kind!r}") from None


@dataclass(frozen=True)
class Quantization:
    low: float
    high: float
    buckets: int

    def __post_init__(self) -> None:
        if self.buckets < 2 or not self.low < self.high:
            raise ValueError("quantization needs two buckets or more and low < high")


@dataclass(frozen=True)
class Optimizer:
    """A name of ``operators.optimizers.RULES`` with its hyperparameters; a custom one brings its ``rule`` and the first
    values of its ``slots``."""

    name: str = "sgd"
    learning_rate: float | Callable[..., float] = 0.001
    params: tuple[tuple[str, Any], ...] = ()
    clip_low: float | None = None
    clip_high: float | None = None
    rule: Callable | None = None
    slots: tuple[tuple[str, float], ...] = ()

    def rate(self, step: int | None = None) -> float:
        """The learning rate of a step: a constant, a function of nothing, or a function of the step."""
        if not callable(self.learning_rate):
            return float(self.learning_rate)
        n = len([p for p in inspect.signature(self.learning_rate).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)])
        if n == 0:
            return float(self.learning_rate())
        if n > 1:
            raise ValueError("a learning rate function takes the step at most")
        if step is None:
            raise ValueError("this learning rate needs a step")
        return float(self.learning_rate(step))


@dataclass(frozen=True)
class TableSpec:
    name: str
    vocabulary_size: int
    embedding_dim: int
    combiner: str = "sum"
    optimizer: Optimizer = field(default_factory=Optimizer)
    max_ids_per_partition: int = 256
    max_unique_ids_per_partition: int = 256
    quantization: Quantization | None = None

    def __post_init__(self) -> None:
        if self.combiner not in COMBINERS:
            raise ValueError(f"unknown combiner {self.combiner!r}")
        if self.vocabulary_size < 1 or self.embedding_dim < 1:
            raise ValueError("a table has at least one row and one dimension")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    table: str
    input_shape: tuple[int, ...]
    output_shape: tuple[int, ...]


@dataclass(frozen=True)
class Placement:
    """A table's place in its stack."""

    table: str
    stack: str
    padded_vocab: int
    padded_dim: int
    row_offset_in_shard: int
    rotation: int
    vocabulary_size: int
    embedding_dim: int


@dataclass(frozen=True)
class StackSpec:
    name: str
    vocab: int
    dim: int
    combiner: str
    optimizer: Optimizer
    max_ids_per_partition: int
    max_unique_ids_per_partition: int
    tables: tuple[Placement, ...]
    quantization: Quantization | None = None
    suggested_buffer: int | None = None


def unique_names(items: Iterable, what: str) -> dict:
    """By name; ValueError where a name repeats."""
    out: dict = {}
    for x in items:
        if x.name in out:
            raise ValueError(f"{what} {x.name!r} is given twice")
        out[x.name] = x
    return out


def same_keys(a: dict, b: dict, what: str) -> None:
    if set(a) != set(b):
        raise ValueError(f"{what} differ: {sorted(set(a) ^ set(b))}")


def flatten(tree: Any, prefix: str = "") -> dict[str, Any]:
    """A nested dict or sequence as one dict of slash-joined paths."""
    if isinstance(tree, dict):
        return {k: v for name, x in tree.items() for k, v in flatten(x, f"{prefix}{name}/").items()}
    if isinstance(tree, list | tuple):
        return {k: v for i, x in enumerate(tree) for k, v in flatten(x, f"{prefix}{i}/").items()}
    return {prefix.rstrip("/"): tree}


def stack_name(tables: Iterable[str]) -> str:
    """The tables' names joined by ``_``; beyond 50 characters the first 50, ``...`` and 12 hex digits of the whole's SHA-256."""
    name = "_".join(tables)
    return name if len(name) <= 50 else f"{name[:50]}...{hashlib.sha256(name.encode()).hexdigest()[:12]}"


def tag_of(function: Callable) -> str:
    """What a function goes by in JSON: its ``tag`` or its module and name."""
    tag = getattr(function, "tag", None)
    name = getattr(function, "__qualname__", "")
    if tag or (name and "<" not in name):
        return str(tag or f"{function.__module__}.{name}")
    raise TypeError("a function without a name needs a tag to be written as JSON")


def grouped_names(groups: Iterable[Iterable[str]], tables: Iterable[str]) -> list[list[str]]:
    """The groups as lists; ValueError unless they hold every table once and nothing else."""
    out = [list(g) for g in groups]
    flat = [t for g in out for t in g]
    if len(flat) != len(set(flat)):
        raise ValueError("a table stands in two groups")
    if set(flat) != set(tables):
        raise ValueError(f"tables and groups differ: {sorted(set(flat) ^ set(tables))}")
    return out


def to_json(spec: Any) -> str:
    """JSON of a spec or a list of specs. Functions are written as their tag (``tag_of``); those without one raise TypeError."""

    def plain(x: Any) -> Any:
        if dataclasses.is_dataclass(x):
            return {"kind": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        if isinstance(x, list | tuple):
            return [plain(y) for y in x]
        if callable(x):
            return {"kind": "Tag", "tag": tag_of(x)}
        return x

    return json.dumps(plain(spec), sort_keys=True)


def from_json(text: str, functions: dict[str, Callable] | None = None) -> Any:
    """The specs of ``to_json``; ``functions`` are looked up by their tags, ValueError for one that is missing."""
    kinds = {c.__name__: c for c in (Topology, Quantization, Optimizer, TableSpec, FeatureSpec, Placement, StackSpec)}

    def made(x: Any) -> Any:
        if isinstance(x, dict) and x["kind"] == "Tag":
            if x["tag"] not in (functions or {}):
                raise ValueError(f"no function is given for the tag {x['tag']!r}")
            return functions[x["tag"]]
        if isinstance(x, dict):
            return kinds[x["kind"]](**{k: made(v) for k, v in x.items() if k != "kind"})
        if isinstance(x, list):
            return tuple(made(y) for y in x)
        return x

    out = made(json.loads(text))
    return list(out) if isinstance(out, tuple) else out
