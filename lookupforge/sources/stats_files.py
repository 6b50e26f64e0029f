"""Statistics files: one publication of a process each, read back as the latest of every process."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookupforge.operators.stats import apply_limits, latest_per_process
from lookupforge.sources.staging import staged
from lookupforge.specs import StackSpec

SCHEMA = "stack string, shard int, max_ids long, max_unique long, buffer long, dropped long"


class StatsClient(ABC):
    """Record a batch's statistics, publish what was recorded, load what all processes published."""

    @abstractmethod
    def record(self, stats: DataFrame) -> None: ...

    @abstractmethod
    def publish(self) -> None: ...

    @abstractmethod
    def load(self) -> DataFrame: ...


class _Files(StatsClient):
    kind = "parquet"

    def __init__(self, spark: SparkSession, base: str, process: int = 0):
        self.spark, self.base, self.process = spark, base, process
        self.recorded: list[DataFrame] = []

    def record(self, stats: DataFrame) -> None:
        """A batch's statistics are written as they come, so that publishing doesn't compute the batches again."""
        self.recorded.append(staged(stats.select([f.split()[0] for f in SCHEMA.split(", ")]), "recorded-stats"))

    def _rows(self) -> DataFrame:
        out = self.recorded[0]
        for more in self.recorded[1:]:
            out = out.unionByName(more)
        return out

    def publish(self) -> None:
        if self.recorded:
            rows = self._rows().withColumn("process", F.lit(self.process)).withColumn("at", F.lit(time.time_ns()))
            self._write(rows)

    def load(self) -> DataFrame:
        """(stack, shard, max_ids, max_unique, buffer, dropped): the greatest of each over every process's last publication."""
        rows = latest_per_process(self._read())
        return rows.groupBy("stack", "shard").agg(*[F.max(c).alias(c) for c in ("max_ids", "max_unique", "buffer", "dropped")])


class ParquetStats(_Files):
    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.base)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", process int, at long").parquet(self.base)


class CsvStats(_Files):
    """The same as CSV; without ``retain_history`` a publication holds the maxima of what was recorded."""

    def __init__(self, spark: SparkSession, base: str, process: int = 0, retain_history: bool = True):
        super().__init__(spark, base, process)
        self.retain_history = retain_history

    def _rows(self) -> DataFrame:
        rows = super()._rows()
        return rows if self.retain_history else rows.groupBy("stack", "shard").agg(*[F.max(c).alias(c) for c in ("max_ids", "max_unique", "buffer", "dropped")])

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").csv(self.base, header=True)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", process int, at long").csv(self.base, header=True)


def next_limits(client: StatsClient, stacks: list[StackSpec], stats: DataFrame, dropped: DataFrame | None = None) -> list[StackSpec]:
    """One turn of the limits cycle: a batch's statistics (stack, local_sc, global_sc, ids, unique_ids, required) and drops
    (stack, local_sc, dropped) are recorded by shard and published; the stacks come back with the limits that all processes
    have observed, for the next batch."""
    per = stats.groupBy("stack", F.col("global_sc").cast("int").alias("shard")).agg(F.max("ids").alias("max_ids"), F.max("unique_ids").alias("max_unique"), F.max("required").alias("buffer"))
    lost = per.limit(0).select("stack", F.lit(0).cast("long").alias("dropped")) if dropped is None else dropped.groupBy("stack").agg(F.sum("dropped").cast("long").alias("dropped"))
    client.record(per.join(lost, "stack", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0))))
    client.publish()
    return apply_limits(stacks, client.load())
