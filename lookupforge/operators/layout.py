"""Placement of merged rows on shards: ranks, limits, drops, capacity, and row pointers.

Rows are (local_sc, global_sc, local_id, row, id, gain, n_raw[, bucket]): where the sample lives, where the id lives. Within a
partition (local_sc, bucket, global_sc) rows go by local id, then row. A partition is a unit of the layout itself, so its
ranks are windows over the partition; limits become window group limits in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookupforge.functions.ids import div, local_id, round_up, shard_id
from lookupforge.specs import Topology
from lookupforge.specs import round_up as up

#: Ids of places that only align. Fixed value.
PAD = (1 << 31) - 1
PARTITION = ("local_sc", "bucket", "global_sc")


def place(merged: DataFrame, topology: Topology, batch_per_sc: int, row: str = "sample", bucket: Column | None = None) -> DataFrame:
    g = topology.num_scs
    return merged.select(
        div(F.col(row), batch_per_sc).alias("local_sc"), (F.lit(0) if bucket is None else bucket).cast("long").alias("bucket"), shard_id(F.col("id"), g).cast("long").alias("global_sc"),
        local_id(F.col("id"), g).alias("local_id"), F.col(row).cast("long").alias("row"), F.col("id").cast("long").alias("id"), "gain", F.col("n_raw").cast("long").alias("n_raw"),
    )


def ranked(placed: DataFrame) -> DataFrame:
    """Adds ``rank`` (of the row) and ``id_rank`` (of the distinct id) within the partition."""
    part = Window.partitionBy(*PARTITION)
    return placed.withColumn("rank", F.row_number().over(part.orderBy("local_id", "row")).cast("long")).withColumn("id_rank", F.dense_rank().over(part.orderBy("local_id")).cast("long"))


def within_limits(max_ids: int, max_unique: int) -> Column:
    """Ranks count dropped rows too, so an id that starts beyond the limit of distinct ids is dropped whole."""
    return (F.col("rank") <= max_ids) & (F.col("id_rank") <= max_unique)


def first_rows(placed: DataFrame, most: int) -> DataFrame:
    """Adds ``rank`` and keeps the first ``most`` rows of each partition: every task sends that many of a partition at most."""
    part = Window.partitionBy(*PARTITION)
    return placed.withColumn("rank", F.row_number().over(part.orderBy("local_id", "row"))).where(F.col("rank") <= F.lit(min(most, (1 << 31) - 1))).withColumn("rank", F.col("rank").cast("long"))


def drop_beyond_limits(placed: DataFrame, max_ids: int, max_unique: int) -> DataFrame:
    """Rows within both limits, with ``rank`` and ``id_rank``. Rows beyond the first limit change no rank of those within it."""
    near = first_rows(placed, max_ids)
    return near.withColumn("id_rank", F.dense_rank().over(Window.partitionBy(*PARTITION).orderBy("local_id")).cast("long")).where(F.col("id_rank") <= max_unique)


def check_limits(placed: DataFrame, max_ids: int, max_unique: int, allow_dropping: bool = False) -> dict:
    """The largest partition's rows and ids; ValueError where they pass the limits and nothing may be dropped."""
    top = partition_stats(placed).agg(F.max("ids").alias("ids"), F.max("unique_ids").alias("unique_ids")).first()
    found = {"ids": top.ids or 0, "unique_ids": top.unique_ids or 0}
    if not allow_dropping and (found["ids"] > max_ids or found["unique_ids"] > max_unique):
        raise ValueError(f"a partition has {found['ids']} ids, {found['unique_ids']} of them different; the limits are {max_ids} and {max_unique}")
    return found


def partition_stats(placed: DataFrame) -> DataFrame:
    """(local_sc, bucket, global_sc, ids, unique_ids), merged rows and distinct ids. Two plain aggregates: ids first."""
    per_id = placed.groupBy(*PARTITION, "id").agg(F.count("*").alias("n"))
    return per_id.groupBy(*PARTITION).agg(F.sum("n").alias("ids"), F.count("*").alias("unique_ids"))


def max_over_sources(stats: DataFrame) -> DataFrame:
    """(global_sc, max_ids, max_unique_ids) over the sources."""
    return stats.groupBy("global_sc").agg(F.max("ids").alias("max_ids"), F.max("unique_ids").alias("max_unique_ids"))


def required_buffer(stats: DataFrame) -> DataFrame:
    """(local_sc, required): sum of the partitions' sizes, each rounded up to 8."""
    return stats.groupBy("local_sc").agg(F.sum(round_up(F.col("ids"), 8)).alias("required"))


def drop_counts(placed: DataFrame, max_ids: int, max_unique: int) -> DataFrame:
    """(local_sc, dropped): raw occurrences lost to the limits, as what there is less what stays."""
    whole = placed.groupBy("local_sc").agg(F.sum("n_raw").alias("whole"))
    kept = drop_beyond_limits(placed, max_ids, max_unique).groupBy("local_sc").agg(F.sum("n_raw").alias("kept"))
    return whole.join(kept, "local_sc", "left").select("local_sc", (F.col("whole") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def partition_offsets(stats: DataFrame) -> DataFrame:
    """Adds ``start``: where each partition begins in its source's buffer, every partition rounded up to 8."""
    w = Window.partitionBy("local_sc").orderBy("bucket", "global_sc").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("start", F.coalesce(F.sum(round_up(F.col("ids"), 8)).over(w), F.lit(0)))


def fit_buffer(placed: DataFrame, capacity: int) -> DataFrame:
    """Adds ``position`` in the source's buffer, and keeps the rows whose position lies within the capacity."""
    offsets = partition_offsets(partition_stats(placed)).select(*PARTITION, "start")
    at = first_rows(placed, capacity).join(offsets, list(PARTITION)).withColumn("position", F.col("start") + F.col("rank") - 1)
    return at.where(F.col("position") < capacity)


def overflow_counts(placed: DataFrame, capacity: int) -> DataFrame:
    """(local_sc, overflow): merged rows that find no place in their source's buffer."""
    stats = partition_offsets(partition_stats(placed))
    over = F.least(F.col("ids"), F.greatest(F.lit(0), F.col("start") + F.col("ids") - capacity))
    return stats.groupBy("local_sc").agg(F.sum(over).cast("long").alias("overflow")).where("overflow > 0")


def row_pointers(placed: DataFrame, topology: Topology, local_scs: int, capacity: int) -> DataFrame:
    """(local_sc, slot, pointer): the end of each partition's rows, up to the capacity; absent partitions end where they would
    begin, and slots beyond the shards (there are at least 8) hold the aligned end."""
    slots = max(topology.num_scs, 8)
    spark = placed.sparkSession
    grid = spark.range(local_scs * slots).select(div(F.col("id"), slots).alias("local_sc"), F.pmod("id", F.lit(slots)).alias("slot"))
    stats = partition_stats(placed).select("local_sc", F.col("global_sc").alias("slot"), "ids")
    full = grid.join(stats, ["local_sc", "slot"], "left").withColumn("ids", F.coalesce("ids", F.lit(0)))
    w = Window.partitionBy("local_sc").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(round_up(F.col("ids"), 8)).over(w), F.lit(0))
    return full.select("local_sc", "slot", F.least(start + F.col("ids"), F.lit(capacity)).alias("pointer"))


def csr_rows(placed: DataFrame, capacity: int, batch_per_sc: int, padding: bool = True) -> DataFrame:
    """(local_sc, position, embedding_id, sample_id, gain): the buffer of each source. Places that only align a partition hold
    ``PAD`` ids and a NaN gain."""
    own = fit_buffer(placed, capacity).select("local_sc", "position", F.col("local_id").alias("embedding_id"), F.pmod(F.col("row"), F.lit(batch_per_sc)).alias("sample_id"), F.col("gain").cast("double").alias("gain"))
    if not padding:
        return own
    ends = partition_offsets(partition_stats(placed)).where(F.pmod("ids", F.lit(8)) != 0)
    gap = F.explode(F.sequence(F.col("start") + F.col("ids"), F.col("start") + round_up(F.col("ids"), 8) - 1))
    pads = ends.select("local_sc", gap.alias("position")).where(F.col("position") < capacity)
    return own.union(pads.select("local_sc", "position", F.lit(PAD).alias("embedding_id"), F.lit(PAD).alias("sample_id"), F.lit(float("nan")).alias("gain")))


def pack_minibatches(rows: DataFrame, sc_per_device: int) -> DataFrame:
    """(device, local_sc, minibatch, global_sc, ids, start): where each minibatch's partitions begin in the device's shared
    buffer, sources and minibatches in order, every partition rounded up to 8. A device has a bounded number of partitions."""
    stats = rows.groupBy("local_sc", "minibatch", "global_sc").agg(F.count("*").alias("ids")).withColumn("device", div(F.col("local_sc"), sc_per_device))
    w = Window.partitionBy("device").orderBy("local_sc", "minibatch", "global_sc").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("start", F.coalesce(F.sum(round_up(F.col("ids"), 8)).over(w), F.lit(0)))


def sorted_within_sources(placed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Physical order of the layout: sources apart, rows by bucket, shard, local id, row."""
    apart = placed.repartition(partitions, "local_sc") if partitions else placed.repartition("local_sc")
    return apart.sortWithinPartitions("local_sc", "bucket", "global_sc", "local_id", "row")


def theoretical_buffer(max_ids: int, topology: Topology, minibatching: bool = False) -> int:
    return up(max_ids, 8) * topology.sc_per_device * topology.num_scs * (64 if minibatching else 1)


def buffer_size(max_ids: int, topology: Topology, suggested: int | None = None, minibatching: bool = False) -> int:
    """The suggested size rounded up, at most the theoretical one; ValueError beyond 31 bits or beyond the theoretical size."""
    most = theoretical_buffer(max_ids, topology, minibatching)
    size = most if suggested is None else up(suggested, 8 * topology.sc_per_device)
    if size > most:
        raise ValueError(f"the suggested buffer {size} passes {most}")
    if size >= 1 << 31:
        raise ValueError(f"a buffer of {size} can't be addressed")
    return size


def row_pointer_size(topology: Topology, minibatching: bool = False) -> int:
    return max(topology.num_scs, 8) * (64 if minibatching else 1) * topology.sc_per_device
