"""The engine's operators as queries over the standard tables, each with SQL that gives the same rows.

Features: the order's parts (sample ``l_orderkey``, id ``l_partkey % 500``, weight ``l_quantity``) and its suppliers; the vector
table is ``embeddings``. Values are rounded to six places on both sides.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lookupforge.functions import ids as I
from lookupforge.functions import vectors as V
from lookupforge.operators import coo as C
from lookupforge.operators import layout as L
from lookupforge.operators import minibatch as M
from lookupforge.operators import stacking as S
from lookupforge.operators import stats as ST
from lookupforge.operators.lookup import explode_vectors, lookup, pooled, pooled_values
from lookupforge.operators.optimizers import initial_slots
from lookupforge.operators.update import gradient_sums, merge, touched, with_slots
from lookupforge.plans import preprocess as PP
from lookupforge.plans import training as T
from lookupforge.sources import text as X
from lookupforge.sources.staging import shared_dir, staged
from lookupforge.specs import FeatureSpec, Optimizer, Quantization, TableSpec, Topology

DIM, SCS = 64, 4
TOPOLOGY = Topology(devices=2, sc_per_device=4)
G = TOPOLOGY.num_scs
LIMITS, SPLIT_LIMITS = (1000, 50), (200, 20)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs
def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), (F.col("l_partkey") % 500).alias("id"), F.col("l_quantity").alias("weight"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("weight"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("sample"))


def ragged(spark: SparkSession, d: str) -> DataFrame:
    """(sample, ids, weights) of every order's lines."""
    line = F.struct("l_linenumber", (F.col("l_partkey") % 500).alias("id"), F.col("l_quantity").alias("weight"))
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    return g.select("sample", F.transform("x", lambda s: s["id"]).alias("ids"), F.transform("x", lambda s: s["weight"]).alias("weights"))


COO = "coo AS (SELECT l_orderkey AS sample, l_partkey % 500 AS id, l_quantity AS weight FROM lineitem)"
SUPP = "coo AS (SELECT l_orderkey AS sample, l_suppkey AS id, l_quantity AS weight FROM lineitem)"
POS = "lines AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 500, l_quantity) - 1 AS pos, l_partkey % 500 AS id, l_quantity AS weight, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
GAIN = {"sum": "sum(weight)", "mean": "sum(weight) / t", "sqrtn": "sum(weight) / sqrt(q)"}


def merged_sql(combiner: str = "mean", source: str = COO) -> str:
    return f"{source}, tot AS (SELECT sample, sum(weight) AS t, sum(weight * weight) AS q FROM coo GROUP BY sample), merged AS (SELECT c.sample, c.id, {GAIN[combiner]} AS gain, count(*) AS n_raw FROM coo c JOIN tot USING (sample) GROUP BY c.sample, c.id, t, q)"


TABLE = f"tab AS (SELECT vec_id AS id, unnest(range({DIM})) AS d, unnest(embedding)::DOUBLE AS w FROM embeddings)"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Halves away from zero, as in SQL; whole numbers of millionths, as Spark's own ``round`` goes through decimal text."""
    def one(x: Column) -> Column:
        y = x * F.lit(1e6)
        near = F.when(y < 0, -F.floor(F.lit(0.5) - y)).otherwise(F.floor(y + F.lit(0.5))) / F.lit(1e6)
        return F.when(F.abs(x) < 1e9, near).otherwise(F.round(x, 6)) + F.lit(0.0)

    return df.withColumns({c: one(F.col(c)) for c in cols})


def rsql(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


# ---------------------------------------------------------------- sources
@query(f"WITH {POS} SELECT sample, pos, id, weight FROM lines")
def scan_dense(spark: SparkSession, d: str) -> DataFrame:
    return C.from_arrays(ragged(spark, d), weights="weights")


@query(f"WITH {POS} SELECT o.o_orderkey AS sample, pos, id, weight FROM orders o LEFT JOIN lines l ON o.o_orderkey = l.sample")
def scan_ragged_outer(spark: SparkSession, d: str) -> DataFrame:
    return C.from_arrays(orders(spark, d).join(ragged(spark, d), "sample", "left"), weights="weights", keep_empty=True)


@query(f"WITH {POS} SELECT sample, pos, id, 1.0::DOUBLE AS weight FROM lines")
def scan_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return C.from_arrays(ragged(spark, d)).withColumn("weight", F.col("weight").cast("double"))


@query("WITH c AS (SELECT o_orderkey AS sample, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT sample, n, (sum(n) OVER (ORDER BY sample) - n)::BIGINT AS \"start\", (sum(n) OVER (ORDER BY sample))::BIGINT AS \"end\" FROM c")
def scan_coo_row_pointers(spark: SparkSession, d: str) -> DataFrame:
    return C.row_pointers(parts(spark, d), orders(spark, d))


@query(f"WITH {POS} SELECT sample AS list, CASE WHEN pos < n // 2 THEN 0 ELSE 1 END::BIGINT AS sample, CASE WHEN pos < n // 2 THEN pos ELSE pos - n // 2 END AS pos, id FROM lines")
def scan_row_splits(spark: SparkSession, d: str) -> DataFrame:
    r = ragged(spark, d)
    lists = r.select(F.col("sample").alias("list"), "ids", F.array(F.lit(0), I.div(F.size("ids"), 2).cast("int"), F.size("ids")).alias("offsets"))
    return C.from_row_splits(lists, keys=("list",))


@query("SELECT event_id // 4 AS sample, event_id % 4 AS pos, user_id AS id FROM events")
def scan_fixed_valency(spark: SparkSession, d: str) -> DataFrame:
    return C.from_fixed_valency(read(spark, d, "events"), 4, "event_id", "user_id")


TOKENS = "tok AS (SELECT doc_id AS key, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS word FROM documents)"


@query(f"WITH {TOKENS}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY word) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS id FROM c ORDER BY n DESC, word LIMIT 256")
def top_vocab_ids(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(X.words(read(spark, d, "documents"), "doc_id", "text"), 256)


@query(f"WITH {TOKENS}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY word), v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM c ORDER BY n DESC, word LIMIT 256) SELECT key, coalesce(id, 0) AS id, count(*) AS n FROM tok LEFT JOIN v USING (word) GROUP BY ALL")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    tok = X.words(read(spark, d, "documents"), "doc_id", "text")
    return X.to_ids(tok, X.vocabulary(tok, 256)).groupBy("key", "id").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT conv_id * 1000 + turn AS key, list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), lambda x: length(x)) AS l FROM conversations), p AS (SELECT key, l, unnest(range(len(l))) AS pos FROM s) SELECT key, pos, list_aggregate(list_transform(range(4), lambda k: l[(pos + k) % len(l) + 1]), 'string_agg', ',') AS context, l[(pos + 4) % len(l) + 1]::BIGINT AS label FROM p")
def next_token_windows(spark: SparkSession, d: str) -> DataFrame:
    conv = read(spark, d, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    cut = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    lists = conv.select("key", F.transform(cut, lambda x: F.length(x).cast("long")).alias("ids"))
    return X.next_token_rows(lists, 4).select("key", "pos", F.array_join("context", ",").alias("context"), "label")


# ---------------------------------------------------------------- id arithmetic
@query(f"SELECT p_partkey, p_partkey % {G} AS shard FROM part")
def shard_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", I.shard_id(F.col("p_partkey"), G).alias("shard"))


@query(f"SELECT p_partkey, p_partkey // {G} AS local_id FROM part")
def local_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", I.local_id(F.col("p_partkey"), G).alias("local_id"))


@query(f"SELECT p_partkey, (p_partkey + 3) % {G} + (p_partkey // {G}) * {G} + 64 AS moved FROM part")
def shift_offset_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", I.shift_offset(F.col("p_partkey"), 3, 64, G).alias("moved"))


@query("SELECT p_partkey, p_partkey % 64 AS bucket FROM part")
def bucket_identity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", I.bucket(F.col("p_partkey"), lambda c: c).alias("bucket"))


@query("SELECT p_partkey, (p_partkey + 7) // 8 * 8 AS rounded FROM part")
def round_up(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", I.round_up(F.col("p_partkey"), 8).alias("rounded"))


@query("WITH k AS (SELECT l_orderkey, l_partkey, ((l_partkey % 64)::HUGEINT * (1::HUGEINT << 58) + ((l_partkey // 8) + (l_partkey % 8) * 536870912)::HUGEINT * 67108864 + l_orderkey % 67108864) AS key FROM lineitem) SELECT l_orderkey, l_partkey, (CASE WHEN key >= 9223372036854775808::HUGEINT THEN key - 18446744073709551616::HUGEINT ELSE key END)::BIGINT AS key FROM k")
def group_key_pack(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", I.pack_key(F.col("l_partkey") % 64, F.col("l_partkey"), F.col("l_orderkey"), 8).alias("key"))


def _orders_count(spark: SparkSession, d: str) -> int:
    return read(spark, d, "orders").count()


N = "n AS (SELECT count(*) AS n FROM orders)"


@query(f"WITH {N} SELECT o_orderkey AS sample, o_orderkey // (n // {SCS}) * (2 * n // {SCS}) + n // {SCS} + o_orderkey % (n // {SCS}) AS row FROM orders, n")
def split_then_stack_rows(spark: SparkSession, d: str) -> DataFrame:
    n = _orders_count(spark, d)
    return orders(spark, d).select("sample", I.stacked_row(F.col("sample"), n, SCS, 2 * n // SCS, n).alias("row"))


@query(f"WITH {TABLE} SELECT id, d, {rsql('-0.25 + floor((least(greatest(w, -0.25), 0.25) + 0.25) / (0.5 / 15) + 0.5) * (0.5 / 15)', 'value')} FROM tab")
def quantize_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = vectors(spark, d).withColumn("vec", V.quantize(F.col("vec").cast("array<double>"), Quantization(-0.25, 0.25, 16)))
    return rounded(explode_vectors(t, "id"), "value")


@query("WITH s AS (SELECT conv_id AS sample, turn AS step, string_split_regex(trim(text), '[ \\t\\n\\r]+') AS l FROM conversations), p AS (SELECT sample, step, generate_subscripts(l, 1) - 1 AS pos, length(unnest(l))::BIGINT AS id FROM s) SELECT sample, step, pos, id, sample * 64 + step AS row FROM p WHERE id > 0")
def sequence_flatten(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.trim("text"), r"[ \t\n\r]+"), lambda x: x != "")
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.transform(words, lambda x: F.length(x).cast("long")).alias("ids"))
    top = F.max("turn").cast("int")
    conv = turns.groupBy(F.col("conv_id").alias("sample")).agg(F.map_from_entries(F.collect_list(F.struct("turn", "ids"))).alias("m"), top.alias("top"))
    conv = conv.withColumn("steps", F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.coalesce(F.col("m")[i.cast("long")], F.array().cast("array<bigint>"))))
    return C.sequence_rows(conv, 64)


# ---------------------------------------------------------------- gains and lookups
def _gain(combiner: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return rounded(C.with_gains(parts(spark, d), combiner), "gain")

    f.__name__ = f"gain_{combiner}"
    query(f"WITH {merged_sql(combiner)} SELECT sample, id, {rsql('gain', 'gain')}, n_raw FROM merged")(f)


def _lookup(combiner: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return rounded(explode_vectors(pooled(parts(spark, d), vectors(spark, d), DIM, combiner), "sample"), "value")

    f.__name__ = f"lookup_{combiner}"
    query(f"WITH {merged_sql(combiner)}, {TABLE} SELECT sample, d, {rsql('sum(gain * w)', 'value')} FROM merged JOIN tab USING (id) GROUP BY sample, d")(f)


for _c in ("sum", "mean", "sqrtn"):
    _gain(_c)
    _lookup(_c)


@query(f"WITH {COO} SELECT sample, id, sum(weight) AS gain, count(*) AS n_raw FROM coo GROUP BY sample, id")
def dedup_gain(spark: SparkSession, d: str) -> DataFrame:
    return C.with_gains(parts(spark, d), "sum")


@query(f"WITH {COO}, t AS (SELECT sample, sum(weight) AS t FROM coo GROUP BY sample) SELECT sample, id, weight, {rsql('weight / t', 'gain')} FROM coo JOIN t USING (sample)")
def raw_gain_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.raw_gains(parts(spark, d), "mean"), "gain").select("sample", "id", "weight", "gain")


@query(f"WITH {merged_sql()}, {TABLE}, a AS (SELECT sample, d, sum(gain * w) AS v FROM merged JOIN tab USING (id) GROUP BY sample, d) SELECT o.o_orderkey AS sample, r.d, {rsql('coalesce(v, 0)', 'value')} FROM orders o CROSS JOIN (SELECT unnest(range({DIM})) AS d) r LEFT JOIN a ON a.sample = o.o_orderkey AND a.d = r.d")
def lookup_empty_samples(spark: SparkSession, d: str) -> DataFrame:
    found = pooled(parts(spark, d), vectors(spark, d), DIM, "mean", samples=orders(spark, d))
    return rounded(explode_vectors(found, "sample"), "value")


@query(f"WITH {merged_sql('sum')}, {TABLE} SELECT sample, d, {rsql('sum(gain * w)', 'value')} FROM merged JOIN tab USING (id) GROUP BY sample, d")
def lookup_local(spark: SparkSession, d: str) -> DataFrame:
    """One shard: no routing, no limits."""
    one = L.place(C.with_gains(parts(spark, d), "sum"), Topology(1, 1), 1 << 40)
    return rounded(explode_vectors(lookup(one.withColumnRenamed("row", "sample"), vectors(spark, d), DIM), "sample"), "value")


@query(f"WITH a AS (SELECT 'parts' AS feature, l_orderkey AS sample, l_partkey % 500 AS id, l_quantity AS weight FROM lineitem UNION ALL SELECT 'suppliers', l_orderkey, l_suppkey, l_quantity FROM lineitem), t AS (SELECT feature, sample, sum(weight) AS t FROM a GROUP BY ALL), {TABLE} SELECT feature, sample, d, {rsql('sum(weight / t * w)', 'value')} FROM a JOIN t USING (feature, sample) JOIN tab USING (id) GROUP BY ALL")
def lookup_two_features(spark: SparkSession, d: str) -> DataFrame:
    both = C.union_features({"parts": parts(spark, d), "suppliers": suppliers(spark, d)})
    keys = ("feature", "sample")
    return rounded(pooled_values(both, vectors(spark, d), DIM, "mean", keys), "value")


# ---------------------------------------------------------------- layout and statistics
def placed(spark: SparkSession, d: str, combiner: str = "sum", bucket: Column | None = None, deal: bool = False) -> DataFrame:
    return L.place(C.with_gains(parts(spark, d), combiner, deal=deal), TOPOLOGY, _orders_count(spark, d) // SCS, bucket=bucket)


PLACED = f"{merged_sql('sum')}, {N}, placed AS (SELECT sample // (n // {SCS}) AS local_sc, 0 AS bucket, id % {G} AS global_sc, id // {G} AS local_id, sample AS row, id, gain, n_raw FROM merged, n)"
STATS = "stats AS (SELECT local_sc, bucket, global_sc, count(*) AS ids, count(DISTINCT id) AS unique_ids FROM placed GROUP BY ALL)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY local_sc, bucket, global_sc ORDER BY local_id, row) AS rank, dense_rank() OVER (PARTITION BY local_sc, bucket, global_sc ORDER BY local_id) AS id_rank FROM placed)"
OFFSETS = "offsets AS (SELECT *, coalesce(sum((ids + 7) // 8 * 8) OVER (PARTITION BY local_sc ORDER BY bucket, global_sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"start\" FROM stats)"


@query(f"WITH {PLACED}, {STATS} SELECT local_sc, global_sc, ids FROM stats")
def ids_per_partition(spark: SparkSession, d: str) -> DataFrame:
    return L.partition_stats(placed(spark, d)).select("local_sc", "global_sc", "ids")


@query(f"WITH {PLACED}, {STATS} SELECT local_sc, global_sc, unique_ids FROM stats")
def unique_ids_per_partition(spark: SparkSession, d: str) -> DataFrame:
    return L.partition_stats(placed(spark, d)).select("local_sc", "global_sc", "unique_ids")


@query(f"WITH {PLACED}, {STATS} SELECT global_sc, max(ids) AS max_ids, max(unique_ids) AS max_unique_ids FROM stats GROUP BY 1")
def max_over_sources(spark: SparkSession, d: str) -> DataFrame:
    return L.max_over_sources(L.partition_stats(placed(spark, d)))


@query(f"WITH {PLACED}, {STATS} SELECT local_sc, sum((ids + 7) // 8 * 8)::BIGINT AS required FROM stats GROUP BY 1")
def required_buffer(spark: SparkSession, d: str) -> DataFrame:
    return L.required_buffer(L.partition_stats(placed(spark, d)))


@query(f"WITH {PLACED}, {RANKED} SELECT local_sc, sum(CASE WHEN rank <= {LIMITS[0]} AND id_rank <= {LIMITS[1]} THEN 0 ELSE n_raw END)::BIGINT AS dropped FROM ranked GROUP BY 1")
def drop_count(spark: SparkSession, d: str) -> DataFrame:
    return L.drop_counts(placed(spark, d), *LIMITS)


@query(f"WITH {PLACED}, {RANKED} SELECT local_sc, global_sc, row, id, rank FROM ranked")
def rank_in_partition(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked(placed(spark, d)).select("local_sc", "global_sc", "row", "id", "rank")


@query(f"WITH {PLACED}, {RANKED} SELECT local_sc, global_sc, row, id, id_rank FROM ranked")
def dense_rank_ids(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked(placed(spark, d)).select("local_sc", "global_sc", "row", "id", "id_rank")


@query(f"WITH {PLACED}, {RANKED} SELECT local_sc, global_sc, row, id, gain FROM ranked WHERE rank <= {LIMITS[0]} AND id_rank <= {LIMITS[1]}")
def id_dropping(spark: SparkSession, d: str) -> DataFrame:
    return L.drop_beyond_limits(placed(spark, d), *LIMITS).select("local_sc", "global_sc", "row", "id", "gain")


@query(f"WITH {PLACED}, {STATS}, {OFFSETS} SELECT local_sc, global_sc, ids, \"start\" FROM offsets")
def aligned_offsets(spark: SparkSession, d: str) -> DataFrame:
    return L.partition_offsets(L.partition_stats(placed(spark, d))).select("local_sc", "global_sc", "ids", "start")


@query(f"WITH {PLACED}, {STATS}, g AS (SELECT s.x AS local_sc, t.x AS slot FROM range({SCS}) s(x), range({G}) t(x)), f AS (SELECT local_sc, slot, coalesce(ids, 0) AS ids FROM g LEFT JOIN (SELECT local_sc, global_sc AS slot, ids FROM stats) USING (local_sc, slot)) SELECT local_sc, slot, least(coalesce(sum((ids + 7) // 8 * 8) OVER (PARTITION BY local_sc ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ids, 8000)::BIGINT AS pointer FROM f")
def row_pointers(spark: SparkSession, d: str) -> DataFrame:
    return L.row_pointers(placed(spark, d), TOPOLOGY, SCS, 8000)


@query(f"WITH {PLACED}, {STATS}, {OFFSETS}, {RANKED} SELECT r.local_sc, r.global_sc, row, id, \"start\" + rank - 1 AS position FROM ranked r JOIN offsets o ON r.local_sc = o.local_sc AND r.global_sc = o.global_sc WHERE \"start\" + rank - 1 < 8000")
def static_overflow(spark: SparkSession, d: str) -> DataFrame:
    return L.fit_buffer(placed(spark, d), 8000).select("local_sc", "global_sc", "row", "id", "position")


@query(f"WITH {PLACED}, {STATS}, {OFFSETS}, {RANKED}, b AS (SELECT r.local_sc, (\"start\" + rank - 1)::BIGINT AS position, local_id AS embedding_id, row % (n // {SCS}) AS sample_id, {rsql('gain', 'gain')} FROM ranked r JOIN offsets o ON r.local_sc = o.local_sc AND r.global_sc = o.global_sc, n UNION ALL SELECT local_sc, unnest(range(\"start\" + ids, \"start\" + (ids + 7) // 8 * 8)), 2147483647, 2147483647, NULL FROM offsets) SELECT * FROM b WHERE position < 8000")
def csr_layout(spark: SparkSession, d: str) -> DataFrame:
    csr = L.csr_rows(placed(spark, d), 8000, _orders_count(spark, d) // SCS)
    return rounded(csr.withColumn("gain", F.when(~F.isnan("gain"), F.col("gain"))), "gain").withColumn("embedding_id", F.col("embedding_id").cast("long")).withColumn("sample_id", F.col("sample_id").cast("long"))


@query(f"WITH {PLACED}, {STATS}, {OFFSETS}, {RANKED} SELECT r.local_sc, count(*) AS overflow FROM ranked r JOIN offsets o ON r.local_sc = o.local_sc AND r.global_sc = o.global_sc WHERE \"start\" + rank - 1 >= 8000 GROUP BY 1")
def overflow_drops(spark: SparkSession, d: str) -> DataFrame:
    return L.overflow_counts(placed(spark, d), 8000)


@query(SQL["csr_layout"])
def preprocess_buffers(spark: SparkSession, d: str) -> DataFrame:
    """A batch preprocessed as a whole, and the stack's buffers laid out: what the layout of the placed rows gives."""
    n, rows_ = _orders_count(spark, d), read(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    top = Topology(devices=2, sc_per_device=4, local_devices=1)
    stack = dataclasses.replace(S.stack_tables([TableSpec("embeddings", rows_, DIM, max_ids_per_partition=1 << 40, max_unique_ids_per_partition=1 << 40)], top), suggested_buffer=8000 * top.sc_per_device)
    pre = PP.preprocess({"parts": PP.Rows(parts(spark, d), n)}, {"parts": FeatureSpec("parts", "embeddings", (n, 1), (n, DIM))}, [stack], top)
    csr = PP.buffers(pre, stack, top).rows
    return rounded(csr.withColumn("gain", F.when(~F.isnan("gain"), F.col("gain"))), "gain").withColumn("embedding_id", F.col("embedding_id").cast("long")).withColumn("sample_id", F.col("sample_id").cast("long"))


@query(f"WITH {PLACED} SELECT local_sc, global_sc, local_id, row, row_number() OVER (PARTITION BY local_sc ORDER BY bucket, global_sc, local_id, row) AS position FROM placed")
def sorted_coo(spark: SparkSession, d: str) -> DataFrame:
    """Position in the source's order: the partition's start (unaligned) and the rank in it."""
    from pyspark.sql import Window

    p = placed(spark, d)
    w = Window.partitionBy("local_sc").orderBy("bucket", "global_sc").rowsBetween(Window.unboundedPreceding, -1)
    start = L.partition_stats(p).select(*L.PARTITION, F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("before"))
    return L.ranked(p).join(start, list(L.PARTITION)).select("local_sc", "global_sc", "local_id", "row", (F.col("before") + F.col("rank")).alias("position"))


def _event_stats(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_type", "user_id", F.col("event_id").alias("max_ids"), F.col("user_id").alias("max_unique"), F.length("props").cast("long").alias("buffer"), (F.col("event_id") % 5).alias("dropped"), "event_id")


EVENT_STATS = "s AS (SELECT event_type, user_id, event_id AS max_ids, user_id AS max_unique, length(props) AS buffer, event_id % 5 AS dropped, event_id FROM events)"


@query(f"WITH {EVENT_STATS} SELECT event_type, max(max_ids) AS max_ids, max(max_unique) AS max_unique, max(buffer) AS buffer, sum(dropped)::BIGINT AS dropped FROM s GROUP BY 1")
def stats_merge_process(spark: SparkSession, d: str) -> DataFrame:
    return ST.merge_in_process(_event_stats(spark, d), "event_type")


@query(f"WITH {EVENT_STATS} SELECT event_type, max(max_ids) AS max_ids, max(max_unique) AS max_unique, max(buffer) AS buffer, max(dropped) AS dropped FROM s GROUP BY 1")
def stats_merge_files(spark: SparkSession, d: str) -> DataFrame:
    return ST.merge_across_files(_event_stats(spark, d), "event_type")


@query("SELECT user_id, event_id, event_type, value FROM events e WHERE event_id = (SELECT max(event_id) FROM events f WHERE f.user_id = e.user_id)")
def latest_stats_per_process(spark: SparkSession, d: str) -> DataFrame:
    return ST.latest_per_process(read(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, bool_or(value > 50) AS flag FROM events GROUP BY 1")
def flag_or(spark: SparkSession, d: str) -> DataFrame:
    return ST.any_flag(read(spark, d, "events").select("user_id", (F.col("value") > 50).alias("flag")), "user_id")


@query("SELECT user_id, bit_or(event_id) AS mask FROM events GROUP BY 1")
def mask_or(spark: SparkSession, d: str) -> DataFrame:
    return ST.or_masks(read(spark, d, "events").select("user_id", F.col("event_id").alias("mask")), "user_id")


@query("SELECT event_type, max(event_id) * 4 AS event_id FROM events GROUP BY 1")
def per_device_scalar(spark: SparkSession, d: str) -> DataFrame:
    return ST.per_device(read(spark, d, "events"), 4, "event_id", "event_type")


@query("SELECT user_id AS sync_key, event_type AS source, arg_min(value > 50, event_id) AS flag, min(event_id) AS at FROM events GROUP BY ALL")
def dedup_contributions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("sync_key"), F.col("event_type").alias("source"), (F.col("value") > 50).alias("flag"), F.col("event_id").alias("at"))
    return ST.first_contributions(e)


@query("SELECT u.user_id AS sync_key, t.event_type AS source FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)")
def missing_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("sync_key"), F.col("event_type").alias("source"))
    return ST.missing_sources(e, e, e)


@query("WITH f AS (SELECT 'f_' || lower(n_name) AS feature, 'r' || n_regionkey AS stack, (n_nationkey + 1) * 16 AS samples FROM nation) SELECT feature, stack, samples::BIGINT AS samples, coalesce(sum(samples) OVER (PARTITION BY stack ORDER BY feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_offset FROM f")
def stack_row_offsets(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "nation").select(F.concat(F.lit("f_"), F.lower("n_name")).alias("feature"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("stack"), ((F.col("n_nationkey").cast("long") + 1) * 16).alias("samples"))
    return ST.feature_row_offsets(f)


# ---------------------------------------------------------------- gradients and optimizers
def sample_grads(samples: DataFrame) -> DataFrame:
    """A fixed gradient: ((sample + d) mod 7 - 3) / 10."""
    return samples.select("sample", F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: ((F.pmod(F.col("sample") + i, F.lit(7)) - 3) / 10).cast("double")).alias("grad"))


GRAD = f"gs AS (SELECT id, d, sum(gain * ((sample + d) % 7 - 3) / 10.0::DOUBLE) AS g FROM merged, (SELECT unnest(range({DIM})) AS d) GROUP BY id, d)"


def _sums(spark: SparkSession, d: str, combiner: str = "mean") -> DataFrame:
    return gradient_sums(C.with_gains(parts(spark, d), combiner), sample_grads(orders(spark, d)), DIM)


@query(f"WITH {merged_sql()}, {GRAD} SELECT id, d, {rsql('g', 'value')} FROM gs")
def grad_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explode_vectors(_sums(spark, d), "id", vec="grad"), "value")


def _update(name: str, opt: Optimizer, step: int | None, cols: dict[str, str], steps: str = "") -> None:
    """``cols``: SQL of the new value (vec) and slots, over w, g and what ``steps`` defines."""
    slots = list(initial_slots(opt))

    def f(spark: SparkSession, d: str) -> DataFrame:
        new = touched(vectors(spark, d), _sums(spark, d), opt, step)
        each = new.select("id", F.posexplode(F.arrays_zip("vec", *slots)).alias("d", "x"))
        return rounded(each.select("id", F.col("d").cast("long").alias("d"), F.col("x.vec").alias("value"), *[F.col(f"x.{s}").alias(s) for s in slots]), "value", *slots)

    f.__name__ = name
    body = f"u AS (SELECT *{', ' + steps if steps else ''} FROM tab JOIN gs USING (id, d))"
    query(f"WITH {merged_sql()}, {GRAD}, {TABLE}, {body} SELECT id, d, {rsql(cols['vec'], 'value')}{''.join(', ' + rsql(cols[s], s) for s in slots)} FROM u")(f)


LR = 0.1
_update("update_sgd", Optimizer("sgd", LR), None, {"vec": "w - 0.1::DOUBLE * g"})
_update("update_clipped", Optimizer("sgd", LR, (), -0.05, 0.05), None, {"vec": "least(greatest(w - 0.1::DOUBLE * g, -0.05), 0.05)"})
_update("update_adagrad", Optimizer("adagrad", LR), None, {"vec": "w - 0.1::DOUBLE * g / sqrt(a)", "accumulator": "a"}, "0.1::DOUBLE + g * g AS a")
_b = (1 - 0.999**3) ** 0.5
_update("update_adam", Optimizer("adam", LR), 2, {"vec": f"w - {LR * _b / (1 - 0.9**3)!r}::DOUBLE * m / (sqrt(v) + {1e-8 * _b!r}::DOUBLE)", "momentum": "m", "velocity": "v"}, f"{1 - 0.9!r}::DOUBLE * g AS m, {1 - 0.999!r}::DOUBLE * (g * g) AS v")
_update("update_adagrad_momentum", Optimizer("adagrad_momentum", LR), None, {"vec": "w - 0.1::DOUBLE * s", "accumulator": "a", "momentum": "s"}, "0.1::DOUBLE + g * g AS a, pow(0.1::DOUBLE + g * g + 1e-10::DOUBLE, -0.5::DOUBLE) * g AS s")
_update("update_adagrad_nesterov", Optimizer("adagrad_momentum", LR, (("nesterov", True), ("beta2", 0.95))), None, {"vec": "w - 0.1::DOUBLE * (0.9::DOUBLE * s + s)", "accumulator": "a", "momentum": "s"}, f"0.95::DOUBLE * 0.1::DOUBLE + {1 - 0.95!r}::DOUBLE * g * g AS a, pow(0.95::DOUBLE * 0.1::DOUBLE + {1 - 0.95!r}::DOUBLE * g * g + 1e-10::DOUBLE, -0.5::DOUBLE) * g AS s")
_update("update_ftrl", Optimizer("ftrl", LR, (("l1", 0.01), ("l2", 0.1), ("beta", 0.5))), None, {"vec": "(greatest(least(l, 0.01), -0.01) - l) / ((sqrt(a) + 0.5::DOUBLE) / 0.1::DOUBLE + 0.2::DOUBLE)", "accumulator": "a", "linear": "l"}, "0.1::DOUBLE + g * g AS a, g - (sqrt(0.1::DOUBLE + g * g) - sqrt(0.1::DOUBLE)) / 0.1::DOUBLE * w AS l")
_update("update_ftrl_mult_lr", Optimizer("ftrl", LR, (("l1", 0.01), ("l2", 0.1), ("beta", 0.5), ("multiply", True))), None, {"vec": "(greatest(least(l, 0.001), -0.001) - l) / (sqrt(a) + 0.02::DOUBLE + 0.5::DOUBLE)", "accumulator": "a", "linear": "l"}, "0.1::DOUBLE + g * g AS a, 0.1::DOUBLE * g - (sqrt(0.1::DOUBLE + g * g) - sqrt(0.1::DOUBLE)) * w AS l")
_d = 0.95 * (1 - 0.95**2) / (1 - 0.95**3)
_update("update_laprop", Optimizer("laprop", LR), 2, {"vec": "w - 0.1::DOUBLE * m", "momentum": "m", "velocity": "v"}, f"{1 - _d!r}::DOUBLE * (g * g + 1e-30::DOUBLE) AS v, {(1 - 0.9**2) ** 0.5!r}::DOUBLE * g / sqrt({1 - _d!r}::DOUBLE * (g * g + 1e-30::DOUBLE)) AS m")
_update("update_frequency_adagrad", Optimizer("frequency_adagrad", LR, (("l1", 0.01), ("l2", 0.1))), 5, {"vec": "w - 0.1::DOUBLE * (sqrt(5.0::DOUBLE) * g / sqrt(a) + 0.01::DOUBLE * sign(w) + 0.1::DOUBLE * w)", "accumulator": "a", "count": "c"}, "0.1::DOUBLE + g * g AS a, 1.0::DOUBLE AS c")


@query(f"WITH {merged_sql(source=SUPP)}, {GRAD}, {TABLE} SELECT id, d, {rsql('CASE WHEN g IS NULL THEN w ELSE w - 0.05::DOUBLE * g END', 'value')} FROM tab LEFT JOIN gs USING (id, d)")
def merge_untouched(spark: SparkSession, d: str) -> DataFrame:
    opt = Optimizer("sgd", lambda step: 0.1 / (step + 1))
    table = vectors(spark, d)
    sums = gradient_sums(C.with_gains(suppliers(spark, d), "mean"), sample_grads(orders(spark, d)), DIM)
    return rounded(explode_vectors(merge(table, touched(table, sums, opt, 1)), "id"), "value")


@query(f"WITH {merged_sql()}, {GRAD}, {TABLE} SELECT id, d, {rsql('w - 0.025::DOUBLE * g', 'value')} FROM tab JOIN gs USING (id, d)")
def lr_schedule_step(spark: SparkSession, d: str) -> DataFrame:
    new = touched(vectors(spark, d), _sums(spark, d), Optimizer("sgd", lambda step: 0.1 / (step + 1)), 3)
    return rounded(explode_vectors(new, "id"), "value")


def custom_optimizer(spark: SparkSession, d: str) -> DataFrame:
    signed = Optimizer("signed", LR, rule=lambda w, g, s, lr, step: (w - F.lit(lr) * F.signum(g) * F.sqrt(F.abs(g)), {}))
    return rounded(explode_vectors(touched(vectors(spark, d), _sums(spark, d), signed), "id"), "value")


query(f"WITH {merged_sql()}, {GRAD}, {TABLE} SELECT id, d, {rsql('w - 0.1::DOUBLE * sign(g) * sqrt(abs(g))', 'value')} FROM tab JOIN gs USING (id, d)")(custom_optimizer)


# ---------------------------------------------------------------- stacking
def _stack(spark: SparkSession, d: str, topology: Topology = TOPOLOGY) -> tuple:
    import warnings

    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("vec"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.lit(1.0)).alias("vec"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        stack = S.stack_tables([TableSpec("part", p.count(), 2), TableSpec("supplier", s.count(), 3)], topology, rotation=3)
    return {"part": p, "supplier": s}, stack


def placed_sql(g: int) -> str:
    """Rows of the stack (part, supplier), padding included, for ``g`` shards and rotation 3."""
    up = lambda t: f"((SELECT count(*) FROM {t}) + {8 * g - 1}) // {8 * g} * {8 * g}"
    return f"""sz AS (SELECT {up('part')} AS pv, {up('supplier')} AS sv), st AS (SELECT pv + sv AS v, pv, sv FROM sz),
rw AS (SELECT 'part' AS t, unnest(range(pv)) AS r, 0 AS off, 0 AS rot, v FROM st UNION ALL SELECT 'supplier', unnest(range(sv)), pv // {g}, {3 % g}, v FROM st),
ph AS (SELECT t, r, ((r % {g} + rot) % {g}) * (v // {g}) + r // {g} + off AS row, v FROM rw),
vals AS (SELECT 'part' AS t, p_partkey AS r, [p_retailprice, p_size::DOUBLE] AS x FROM part UNION ALL SELECT 'supplier', s_suppkey, [s_acctbal, s_nationkey::DOUBLE, 1.0::DOUBLE] FROM supplier)"""


@query(f"WITH {placed_sql(G)} SELECT t, r AS id, row FROM ph JOIN vals USING (t, r)")
def physical_row_ids(spark: SparkSession, d: str) -> DataFrame:
    tables, stack = _stack(spark, d)
    at = S.placement_rows(spark, [stack])
    rows = C.union_features({k: v.select("id") for k, v in tables.items()}).join(F.broadcast(at), F.col("feature") == F.col("table"))
    g = F.lit(G)
    row = F.pmod(F.pmod("id", g) + F.col("rotation"), g) * F.lit(stack.vocab // G) + I.div(F.col("id"), G) + F.col("row_offset_in_shard")
    return rows.select(F.col("feature").alias("t"), "id", row.alias("row"))


STACKED = f"SELECT row, row // (v // {{g}}) AS shard, d, {rsql('coalesce(x[d + 1], 0)', 'value')} FROM ph LEFT JOIN vals USING (t, r), (SELECT unnest(range(8)) AS d)"


@query(f"WITH {placed_sql(G)} {STACKED.format(g=G)}")
def stack_shard(spark: SparkSession, d: str) -> DataFrame:
    tables, stack = _stack(spark, d)
    return rounded(explode_vectors(S.stack_and_shard(tables, stack, TOPOLOGY, 0.0), "row", "shard"), "value")


@query(f"SELECT 'part' AS t, p_partkey AS id, d, {rsql('[p_retailprice, p_size::DOUBLE][d + 1]', 'value')} FROM part, (SELECT unnest(range(2)) AS d) UNION ALL SELECT 'supplier', s_suppkey, d, {rsql('[s_acctbal, s_nationkey::DOUBLE, 1.0][d + 1]', 'value')} FROM supplier, (SELECT unnest(range(3)) AS d)")
def unstack_unshard(spark: SparkSession, d: str) -> DataFrame:
    tables, stack = _stack(spark, d)
    whole = S.stack_and_shard(tables, stack, TOPOLOGY)
    back = C.union_features({t: S.unstack(whole, stack, t, TOPOLOGY) for t in tables})
    return rounded(explode_vectors(back.withColumnRenamed("feature", "t"), "t", "id"), "value")


@query(f"WITH {placed_sql(16)} {STACKED.format(g=16)}")
def reshard_topology(spark: SparkSession, d: str) -> DataFrame:
    tables, stack = _stack(spark, d)
    wide = Topology(devices=4, sc_per_device=4)
    _, target = _stack(spark, d, wide)
    moved = S.reshard(S.stack_and_shard(tables, stack, TOPOLOGY), stack, TOPOLOGY, target, wide)
    return rounded(explode_vectors(moved, "row", "shard"), "value")


@query(f"WITH v AS (SELECT (count(*) + {G - 1}) // {G} * {G} AS v FROM part) SELECT p_partkey % {G} AS shard, p_partkey // {G} AS local, (p_partkey % {G}) * (v // {G}) + p_partkey // {G} AS row, p_size FROM part, v")
def mod_shard(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return S.shard_rows(p, G, -(-p.count() // G) * G)


@query("WITH s AS (SELECT n_regionkey, string_agg(lower(n_name), '_' ORDER BY n_name) AS long FROM nation GROUP BY 1) SELECT n_regionkey, CASE WHEN length(long) <= 50 THEN long ELSE substring(long, 1, 50) || '...' || substring(sha256(long), 1, 12) END AS name FROM s")
def stack_names(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "nation").groupBy("n_regionkey").agg(F.concat_ws("_", F.transform(F.sort_array(F.collect_list("n_name")), F.lower)).alias("long"))
    short = F.concat(F.substring("long", 1, 50), F.lit("..."), F.substring(F.sha2("long", 256), 1, 12))
    return g.select("n_regionkey", F.when(F.length("long") <= 50, F.col("long")).otherwise(short).alias("name"))


@query("WITH n AS (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k, ((n_nationkey + 1) * 10 + 63) // 64 * 64 AS v FROM nation) SELECT n_name, n_regionkey, v::BIGINT AS padded_vocab, (coalesce(sum(v) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8)::BIGINT AS row_offset_in_shard, (k * 4 % 8)::INTEGER AS rotation FROM n")
def stack_offsets(spark: SparkSession, d: str) -> DataFrame:
    import warnings

    names: dict[int, list] = {}
    for r in read(spark, d, "nation").orderBy("n_name").collect():  # specs: a handful of tables
        names.setdefault(r.n_regionkey, []).append(r)
    out = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for region, rows in names.items():
            stack = S.stack_tables([TableSpec(r.n_name, (r.n_nationkey + 1) * 10, 8) for r in rows], TOPOLOGY)
            out += [(p.table, region, p.padded_vocab, p.row_offset_in_shard, p.rotation) for p in stack.tables]
    return spark.createDataFrame(out, "n_name string, n_regionkey int, padded_vocab long, row_offset_in_shard long, rotation int")


@query(f"WITH {merged_sql()}, {TABLE}, {N}, a AS (SELECT sample, d, sum(gain * w) AS v FROM merged JOIN tab USING (id) GROUP BY sample, d) SELECT sample // (n // {SCS}) * (2 * n // {SCS}) + sample % (n // {SCS}) AS row, d, {rsql('v', 'value')} FROM a, n")
def stack_gradients(spark: SparkSession, d: str) -> DataFrame:
    n = _orders_count(spark, d)
    act = pooled(parts(spark, d), vectors(spark, d), DIM, "mean")
    rows = act.select(I.stacked_row(F.col("sample"), n, SCS, 2 * n // SCS, 0).alias("row"), V.pad(F.col("vec"), DIM).alias("vec"))
    return rounded(explode_vectors(rows, "row"), "value")


@query(f"WITH {merged_sql()}, {TABLE} SELECT sample, d, {rsql('sum(gain * w)', 'value')} FROM merged JOIN tab USING (id) GROUP BY sample, d")
def unstack_activations(spark: SparkSession, d: str) -> DataFrame:
    """Stack two features' rows, then take the first one's back out by arithmetic."""
    n = _orders_count(spark, d)
    act = pooled(parts(spark, d), vectors(spark, d), DIM, "mean")
    rows = act.select(I.stacked_row(F.col("sample"), n, SCS, 2 * n // SCS, 0).alias("row"), "vec").union(act.select(I.stacked_row(F.col("sample"), n, SCS, 2 * n // SCS, n).alias("row"), "vec"))
    back = rows.select(I.unstacked_sample(F.col("row"), n, SCS, 2 * n // SCS, 0).alias("sample"), V.unpad(F.col("vec"), DIM).alias("vec")).where("sample is not null")
    return rounded(explode_vectors(back, "sample"), "value")


@query("SELECT unnest(range(100)) AS id, d, round(unnest(range(100)) + d / 1000.0::DOUBLE, 6) + 0.0 AS value FROM (SELECT unnest(range(8)) AS d)")
def init_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explode_vectors(S.init_table(spark, 100, 8, lambda r, i: r + i / 1000), "id"), "value")


@query(f"WITH t AS (SELECT n_name AS tab, n_regionkey AS stack, ((n_nationkey % 5 + 1) * 3 + 7) // 8 * 8 AS dim, (n_nationkey + 1) * 16 AS samples FROM nation) SELECT stack, sum(samples)::BIGINT AS samples, sum(dim * ((samples + {G - 1}) // {G}) * 4)::BIGINT AS bytes FROM t GROUP BY 1")
def activation_memory(spark: SparkSession, d: str) -> DataFrame:
    """Samples and activation bytes per shard of each stack, from the specs as a relation."""
    n = F.col("n_nationkey").cast("long")
    t = read(spark, d, "nation").select(F.col("n_regionkey").alias("stack"), I.round_up((n % 5 + 1) * 3, 8).alias("dim"), ((n + 1) * 16).alias("samples"))
    return t.groupBy("stack").agg(F.sum("samples").alias("samples"), F.sum(F.col("dim") * I.div(F.col("samples") + (G - 1), G) * 4).alias("bytes"))


# ---------------------------------------------------------------- minibatches
BUCKETED = PLACED.replace("0 AS bucket", "id % 64 AS bucket")
COUNTS = f"{STATS}, grid AS (SELECT l.x AS local_sc, s.x AS global_sc, b.x AS bucket FROM (SELECT DISTINCT local_sc AS x FROM stats) l, (SELECT DISTINCT global_sc AS x FROM stats) s, range(64) b(x)), cnt AS (SELECT grid.local_sc, grid.global_sc, grid.bucket, coalesce(ids, 0) AS ids, coalesce(unique_ids, 0) AS unique_ids FROM grid LEFT JOIN stats USING (local_sc, global_sc, bucket))"


def bucketed(spark: SparkSession, d: str, deal: bool = False) -> DataFrame:
    return placed(spark, d, bucket=I.bucket(F.col("id"), lambda c: c), deal=deal)


@query(f"WITH {PLACED}, {STATS} SELECT bool_or(ids > {LIMITS[0]} OR unique_ids > {LIMITS[1]}) AS required FROM stats")
def minibatch_required(spark: SparkSession, d: str) -> DataFrame:
    return M.required(placed(spark, d), *LIMITS)


@query(f"WITH {BUCKETED}, {COUNTS} SELECT local_sc, global_sc, bucket, ids, unique_ids FROM cnt")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    c = M.bucket_counts(bucketed(spark, d))
    return c.select("local_sc", "global_sc", F.posexplode(F.arrays_zip("ids", "unique_ids")).alias("bucket", "x")).select("local_sc", "global_sc", F.col("bucket").cast("long").alias("bucket"), F.col("x.ids").alias("ids"), F.col("x.unique_ids").alias("unique_ids"))


def _mask_sql() -> str:
    """Six levels of pairs; each gives its bits and what it stands for above."""
    out, at, size = "l0 AS (SELECT local_sc, global_sc, bucket AS i, ids AS a, unique_ids AS u FROM cnt)", 0, 32
    for k in range(1, 7):
        pair = f"SELECT local_sc, global_sc, i // 2 AS i, sum(a) AS sa, max(a) AS ma, sum(u) AS su, max(u) AS mu FROM l{k - 1} GROUP BY ALL"
        out += f", p{k} AS ({pair}), l{k} AS (SELECT local_sc, global_sc, i, CASE WHEN sa > {SPLIT_LIMITS[0]} THEN ma ELSE sa END AS a, CASE WHEN su > {SPLIT_LIMITS[1]} THEN mu ELSE su END AS u FROM p{k}), b{k} AS (SELECT {at} + i AS bit FROM p{k} WHERE sa > {SPLIT_LIMITS[0]} OR su > {SPLIT_LIMITS[1]})"
        at, size = at + size, size // 2
    bits = " UNION ".join(f"SELECT bit FROM b{k}" for k in range(1, 7))
    return f"{out}, bits AS ({bits}), mask AS (SELECT coalesce(sum(1::HUGEINT << bit::INTEGER), 0)::BIGINT AS mask, count(*) + 1 AS minibatches FROM bits)"


@query(f"WITH {BUCKETED}, {COUNTS}, {_mask_sql()} SELECT mask, minibatches FROM mask")
def split_mask(spark: SparkSession, d: str) -> DataFrame:
    return M.global_mask(bucketed(spark, d), *SPLIT_LIMITS)


@query(f"WITH {BUCKETED}, {COUNTS}, {_mask_sql()}, bb AS (SELECT b.x AS b, 64 - (64 >> lv) + (b.x >> (lv + 1)) AS bit FROM range(1, 64) b(x), LATERAL (SELECT (bit_count((b.x & -b.x) - 1))::INTEGER AS lv)), cuts AS (SELECT b FROM bb JOIN bits USING (bit)) SELECT k.x AS bucket, (SELECT count(*) FROM cuts WHERE b <= k.x) AS minibatch FROM range(64) k(x)")
def minibatch_assignment(spark: SparkSession, d: str) -> DataFrame:
    return M.assignment(M.global_mask(bucketed(spark, d), *SPLIT_LIMITS).select("mask"))


ASSIGN = "bb AS (SELECT b.x AS b, 64 - (64 >> lv) + (b.x >> (lv + 1)) AS bit FROM range(1, 64) b(x), LATERAL (SELECT (bit_count((b.x & -b.x) - 1))::INTEGER AS lv)), cuts AS (SELECT b FROM bb JOIN bits USING (bit)), asg AS (SELECT k.x AS bucket, (SELECT count(*) FROM cuts WHERE b <= k.x) AS minibatch FROM range(64) k(x))"


@query(f"WITH {BUCKETED}, {COUNTS}, {_mask_sql()}, {ASSIGN}, p AS (SELECT local_sc // 2 AS device, local_sc, minibatch, global_sc, count(*) AS ids FROM placed JOIN asg USING (bucket) GROUP BY ALL) SELECT device, local_sc, minibatch, global_sc, ids, coalesce(sum((ids + 7) // 8 * 8) OVER (PARTITION BY device ORDER BY local_sc, minibatch, global_sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"start\" FROM p")
def minibatch_packing(spark: SparkSession, d: str) -> DataFrame:
    b = bucketed(spark, d)
    return L.pack_minibatches(M.with_minibatch(b, M.global_mask(b, *SPLIT_LIMITS).select("mask")), 2)


@query(SQL["lookup_sum"])
def minibatch_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each minibatch's lookups: what a single pass gives."""
    b = bucketed(spark, d, deal=True)
    rows = M.with_minibatch(b, M.global_mask(b, *SPLIT_LIMITS).select("mask")).withColumnRenamed("row", "sample")
    each = lookup(rows, vectors(spark, d), DIM, ("minibatch", "sample"), by=())
    whole = each.groupBy("sample").agg(*V.sums(F.col("vec"), F.lit(1.0), DIM)).select("sample", V.gathered(DIM).alias("vec"))
    return rounded(explode_vectors(whole, "sample"), "value")


@query(SQL["lookup_two_features"])
def preprocess_and_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Two features of one table, stacked, placed, looked up and taken apart: what each alone gives."""
    n, rows_ = _orders_count(spark, d), read(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    spec = TableSpec("embeddings", rows_, DIM, "mean", max_ids_per_partition=1 << 40, max_unique_ids_per_partition=1 << 40)
    stack, top = S.stack_tables([spec], TOPOLOGY), Topology(devices=2, sc_per_device=4, local_devices=1)
    features = {f: FeatureSpec(f, "embeddings", (n, 1), (n, DIM)) for f in ("parts", "suppliers")}
    pre = PP.preprocess({"parts": PP.Rows(parts(spark, d), n), "suppliers": PP.Rows(suppliers(spark, d), n)}, features, [stack], top)
    table = PP.stacked_ids(stack, top, S.stack_and_shard({"embeddings": vectors(spark, d)}, stack, top, 0.0))
    act = lookup(pre.rows, table, DIM, ("row",), by=())  # without limits, rows are as they were dealt
    back = C.union_features({f: PP.feature_rows(pre, act, f, stack, n, top) for f in features})
    return rounded(explode_vectors(back, "feature", "sample"), "value")


# ---------------------------------------------------------------- state across steps
def _batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """All rows, dealt into three batches by sample; merged once."""
    whole = staged(C.with_gains(parts(spark, d), "mean"), "batches")
    return [whole.where(F.pmod("sample", F.lit(3)) == k) for k in range(3)]


def _as_gradient(act: DataFrame, step: int) -> DataFrame:
    return act.select("sample", F.col("vec").alias("grad"))


def _step_sql(k: int, act: str, table: str, out: str) -> str:
    """Batch k's activations from table ``act``, and the table ``out`` after their update of ``table``."""
    return f"x{k} AS (SELECT sample, d, sum(gain * w) AS v FROM merged JOIN {act} USING (id) WHERE sample % 3 = {k} GROUP BY sample, d), g{k} AS (SELECT id, d, sum(gain * v) AS g FROM merged JOIN x{k} USING (sample) GROUP BY id, d), {out} AS (SELECT id, d, CASE WHEN g IS NULL THEN w ELSE w - 0.1::DOUBLE * g / sqrt(a + g * g) END AS w, CASE WHEN g IS NULL THEN a ELSE a + g * g END AS a FROM {table} LEFT JOIN g{k} USING (id, d))"


T0 = "t0 AS (SELECT id, d, w, 0.1::DOUBLE AS a FROM tab)"


def _table_rows(t: DataFrame) -> DataFrame:
    each = t.select("id", F.posexplode(F.arrays_zip("vec", "accumulator")).alias("d", "x"))
    return rounded(each.select("id", F.col("d").cast("long").alias("d"), F.col("x.vec").cast("double").alias("value"), F.col("x.accumulator").alias("accumulator")), "value", "accumulator")


@query(f"WITH {merged_sql()}, {TABLE}, {T0}, {_step_sql(0, 't0', 't0', 't1')}, {_step_sql(1, 't1', 't1', 't2')}, {_step_sql(2, 't2', 't2', 't3')} SELECT id, d, {rsql('w', 'value')}, {rsql('a', 'accumulator')} FROM t3")
def three_step_adagrad(spark: SparkSession, d: str) -> DataFrame:
    return _table_rows(T.run_steps(vectors(spark, d), _batches(spark, d), _as_gradient, DIM, Optimizer("adagrad", LR)))


@query(f"WITH {merged_sql()}, {TABLE}, {T0}, {_step_sql(0, 't0', 't0', 't1')}, {_step_sql(1, 't0', 't1', 't2')}, {_step_sql(2, 't1', 't2', 't3')} SELECT id, d, {rsql('w', 'value')}, {rsql('a', 'accumulator')} FROM t3")
def pipelined_three_steps(spark: SparkSession, d: str) -> DataFrame:
    return _table_rows(T.run_pipelined(vectors(spark, d), _batches(spark, d), _as_gradient, DIM, Optimizer("adagrad", LR))[0])


@query(f"WITH {merged_sql()}, {TABLE}, a AS (SELECT sample, d, sum(gain * w) AS v FROM merged JOIN tab USING (id) GROUP BY sample, d), l AS (SELECT sample, ln(sum(exp(v))) AS z, sum(CASE WHEN d = sample % {DIM} THEN v END) AS hit FROM a GROUP BY sample) SELECT {rsql('avg(z - hit)', 'loss')}, count(*) AS n FROM l")
def mean_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    act = pooled(parts(spark, d), vectors(spark, d), DIM, "mean")
    return rounded(T.cross_entropy(act, act.select("sample", F.pmod("sample", F.lit(DIM)).alias("label"))), "loss")


def checkpoint_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A stack saved, restored and laid out for another topology: rows as ``reshard_topology`` gives them."""
    import uuid

    from lookupforge.sources import checkpoint as K

    base = f"{shared_dir(spark)}/stack-{uuid.uuid4().hex}"
    tables, stack = _stack(spark, d)
    K.save(spark, base, 7, {stack.name: S.stack_and_shard(tables, stack, TOPOLOGY, 0.0)}, [stack], TOPOLOGY)
    _, data, specs, old = K.restore(spark, base)
    wide = Topology(devices=4, sc_per_device=4)
    moved = S.reshard(data[stack.name], specs[0], old, _stack(spark, d, wide)[1], wide)
    return rounded(explode_vectors(moved, "row", "shard"), "value")


query(SQL["reshard_topology"])(checkpoint_round_trip)
SQL = {k: v for k, v in SQL.items() if v}
