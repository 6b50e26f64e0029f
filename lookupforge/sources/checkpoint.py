"""Versioned checkpoints: ``base/tables/step=N/table=NAME`` in Parquet, and the specs as one JSON line beside each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookupforge.operators.stacking import reshard, restack
from lookupforge.specs import StackSpec, TableSpec, Topology, from_json, to_json


def save(spark: SparkSession, base: str, step: int, tables: dict[str, DataFrame], specs: list, topology: Topology) -> None:
    """Write all tables of a step; writing a step again replaces it, so a repeated step does no harm."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/tables/step={step}/table={name}")
    spark.createDataFrame([(to_json(list(specs)), to_json(topology), sorted(tables))], "specs string, topology string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{base}/specs/step={step}")


def steps(spark: SparkSession, base: str) -> list[int]:
    """Steps whose specs were written, which comes last."""
    try:
        found = spark.read.json(f"{base}/specs")
    except Exception as e:  # the folder isn't there
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return []
        raise
    return sorted(r.step for r in found.select("step").distinct().collect())


def restore(spark: SparkSession, base: str, step: int | None = None, want: set[str] | None = None) -> tuple[int, dict[str, DataFrame], list, Topology]:
    """(step, tables, specs, topology) of the given or the latest step; FileNotFoundError or KeyError for what is missing."""
    there = steps(spark, base)
    if not there or step is not None and step not in there:
        raise FileNotFoundError(f"no step {step if step is not None else ''} in {base}; there are {there}")
    step = there[-1] if step is None else step
    meta = spark.read.json(f"{base}/specs/step={step}").first()
    if want and (missing := want - set(meta.tables)):
        raise KeyError(f"step {step} lacks {sorted(missing)}")
    return step, {n: spark.read.parquet(f"{base}/tables/step={step}/table={n}") for n in meta.tables}, from_json(meta.specs), from_json(meta.topology)


def convert(spark: SparkSession, source: str, target: str, tables: dict[str, TableSpec], topology: Topology, step: int | None = None) -> int:
    """Lay a checkpoint of stacks out for another topology, slots included."""
    step, data, specs, old = restore(spark, source, step)
    stacks = [s for s in specs if isinstance(s, StackSpec)]
    new = restack(stacks, tables, topology)
    out = {}
    for a, b in zip(stacks, new, strict=True):
        columns = tuple(c for c in data[a.name].columns if c not in ("row", "shard"))
        out[a.name] = reshard(data[a.name], a, old, b, topology, columns)
    save(spark, target, step, out, new, topology)
    return step


def main(args: list[str] | None = None) -> None:
    """spark-submit this file with --input, --output, --tables (JSON), --devices, --kind or --sc-per-device."""
    import argparse

    from lookupforge.specs import sc_per_device

    p = argparse.ArgumentParser(description="Lay a checkpoint out for another topology.")
    for name in ("input", "output", "tables"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--devices", type=int, required=True)
    p.add_argument("--kind", default="v5p")
    p.add_argument("--sc-per-device", type=int)
    p.add_argument("--step", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    text = "".join(r.value for r in spark.read.text(a.tables).select(F.col("value")).collect())  # one small file
    convert(spark, a.input, a.output, {t.name: t for t in from_json(text)}, Topology(a.devices, a.sc_per_device or sc_per_device(a.kind)), a.step)


if __name__ == "__main__":
    main()
