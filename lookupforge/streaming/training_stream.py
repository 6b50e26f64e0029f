"""Training and statistics as streams.

The training stream reads micro-batches of merged rows with gradients and writes one version of the table for each, named by
the micro-batch's id: a batch that is repeated after a failure writes the same version again from the same predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lookupforge.functions import vectors as V
from lookupforge.operators.stats import missing_sources
from lookupforge.operators.update import merge, touched, with_slots
from lookupforge.specs import Optimizer


def version(base: str, step: int) -> str:
    return f"{base}/step={step}"


def drop_version(spark: SparkSession, base: str, step: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(version(base, step))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def start_training(rows: DataFrame, base: str, checkpoint: str, dim: int, opt: Optimizer, versions: int = 3) -> StreamingQuery:
    """Train from a stream of (sample, id, gain, grad); ``base/step=-1`` holds the first table. Step n reads version n - 1, which
    a repeated step n needs again; the last ``versions`` (2 at least) stay, older ones are deleted."""

    def one(batch: DataFrame, step: int) -> None:
        spark = batch.sparkSession
        table = with_slots(spark.read.parquet(version(base, step - 1)), opt)
        # Each row carries its sample's gradient, so ids are summed without a join.
        sums = V.summed(batch, ["id"], "grad", "gain", dim, "grad")
        merge(table, touched(table, sums, opt, step)).write.mode("overwrite").parquet(version(base, step))
        drop_version(spark, base, step - max(2, versions))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_contributions(messages: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first message of each (sync_key, source) within the watermark; repeats and messages that come later are dropped."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark(["sync_key", "source"])


def observed_limits(stats: DataFrame) -> DataFrame:
    """Running maxima by stack, for output mode ``update`` or ``complete``."""
    return stats.groupBy("stack").agg(*[F.max(c).alias(c) for c in ("max_ids", "max_unique", "buffer", "dropped")])


def windowed_batches(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(sample, id, weight): counts of (window, user, type) as a feature batch for each window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("weight"))
    return w.select(F.col("w.start").alias("start"), F.col("user_id").alias("sample"), "event_type", "n", "weight")


def missing_after(spark: SparkSession, messages: DataFrame, sources: list[int]) -> DataFrame:
    """Ranks that a key still waits for, from what has been received."""
    return missing_sources(messages, spark.createDataFrame([(s,) for s in sources], "source int"), messages)
