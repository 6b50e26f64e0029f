"""Data-dependent minibatches: 64 hash buckets, a binary tree of splits, and the merge of buckets that need no split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookupforge.operators.layout import partition_stats

BUCKETS = 64


def required(placed: DataFrame, max_ids: int, max_unique: int) -> DataFrame:
    """(required): whether any partition passes a limit; false without rows."""
    over = (F.col("ids") > max_ids) | (F.col("unique_ids") > max_unique)
    return partition_stats(placed).agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("required"))


def bucket_counts(placed: DataFrame) -> DataFrame:
    """(local_sc, global_sc, ids, unique_ids): arrays over the buckets, zeros where a bucket is empty."""
    stats = partition_stats(placed).groupBy("local_sc", "global_sc")
    per = stats.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("ids", "unique_ids")))).alias("m"))  # 64 entries at most
    def dense(f: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.col("m")[b.cast("long")][f], F.lit(0)))
    return per.select("local_sc", "global_sc", dense("ids").alias("ids"), dense("unique_ids").alias("unique_ids"))


def _pairs(level: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct((F.get(level, 2 * i) + F.get(level, 2 * i + 1)).alias("both"), F.greatest(F.get(level, 2 * i), F.get(level, 2 * i + 1)).alias("top")))


def _bits(pairs: Column, limit: int, at: int) -> Column:
    """The level's split bits, the first at ``at``."""
    bit = F.transform(pairs, lambda p, i: F.when(p["both"] > limit, F.call_function("shiftleft", F.lit(1).cast("long"), (i + at).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda acc, x: acc + x)


def with_split_mask(df: DataFrame, counts: str, limit: int, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds the tree's split bits, lowest level first: a node splits when its halves' sum passes the limit, and then stands
    for the larger half towards its parent, else for the sum. Each level is a column of its own, so that no expression is
    written out again in the next."""
    df = df.withColumn("__level", F.transform(F.col(counts), lambda x: x.cast("long"))).withColumn(name, F.lit(0).cast("long"))
    at, size = 0, buckets // 2
    while size:
        df = df.withColumn("__pairs", _pairs(F.col("__level"), size))
        df = df.withColumn(name, F.col(name) + _bits(F.col("__pairs"), limit, at))
        df = df.withColumn("__level", F.transform("__pairs", lambda p: F.when(p["both"] > limit, p["top"]).otherwise(p["both"])))
        at, size = at + size, size // 2
    return df.drop("__level", "__pairs")


def global_mask(placed: DataFrame, max_ids: int, max_unique: int) -> DataFrame:
    """(mask, minibatches): the OR of all partitions' masks, for ids and for distinct ids."""
    c = with_split_mask(with_split_mask(bucket_counts(placed), "ids", max_ids, "m1"), "unique_ids", max_unique, "m2")
    return c.agg(F.coalesce(F.bit_or(F.col("m1").bitwiseOR(F.col("m2"))), F.lit(0)).alias("mask")).select("mask", (F.bit_count("mask") + 1).cast("long").alias("minibatches"))


def boundary_bit(bucket: int, buckets: int = BUCKETS) -> int:
    """The mask's bit that says whether a cut lies between ``bucket - 1`` and ``bucket``: that of their nearest common node."""
    level = (bucket & -bucket).bit_length() - 1
    return buckets - (buckets >> level) + (bucket >> (level + 1))


def assignment(mask: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, minibatch) from a one-row (mask)."""
    bits = [F.lit(0)] + [F.shiftrightunsigned("mask", boundary_bit(b, buckets)).bitwiseAND(F.lit(1)) for b in range(1, buckets)]
    each = mask.select(F.posexplode(F.array(*[b.cast("long") for b in bits])).alias("bucket", "cut"), F.array(*[b.cast("long") for b in bits]).alias("all"))
    upto = F.aggregate(F.slice("all", 1, F.col("bucket") + 1), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return each.select(F.col("bucket").cast("long").alias("bucket"), upto.alias("minibatch"))


def with_minibatch(placed: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows with their minibatch; the mapping has 64 rows and is broadcast."""
    return placed.join(F.broadcast(assignment(mask)), "bucket")
