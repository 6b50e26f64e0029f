"""Literal cases and properties of the engine's operators."""

import dataclasses
import random
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lookupforge import specs as P
from lookupforge.functions import ids as I
from lookupforge.functions import vectors as V
from lookupforge.operators import coo as C
from lookupforge.operators import layout as L
from lookupforge.operators import lookup as LK
from lookupforge.operators import minibatch as M
from lookupforge.operators import optimizers as O
from lookupforge.operators import stacking as S
from lookupforge.operators import stats as ST
from lookupforge.operators import update as U
from lookupforge.operators.lookup import lookup, pooled, sequence_lookup
from lookupforge.plans import preprocess as PP
from lookupforge.plans import queries as Q
from lookupforge.plans import training as T
from lookupforge.sources import checkpoint as K
from lookupforge.sources import stats_files as SF
from lookupforge.sources import text as X
from lookupforge.streaming import training_stream as TS


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- arithmetic
@pytest.mark.parametrize("id_, shift, offset, g, want", [(2, 4, 32, 4, 34), (38, 0, 0, 4, 38), (10, 0, 32, 8, 42), (26, 0, 0, 4, 26)])
def test_shift_offset(spark, id_, shift, offset, g, want):
    assert one(spark, I.shift_offset(F.lit(id_), shift, offset, g)) == want


def test_bad_arithmetic():
    for bad in (lambda: I.shard_id(F.lit(1), 6), lambda: I.shift_offset(F.lit(1), 0, 5, 4), lambda: P.Topology(3, 1), lambda: I.stacked_row(F.lit(1), 10, 4, 8, 0)):
        with pytest.raises((ValueError, AssertionError)):
            bad()


def test_key_round_trip(spark):
    r = random.Random(4)
    data = [(r.randrange(64), r.randrange(1 << 31), r.randrange(1 << 26)) for _ in range(200)]
    df = spark.createDataFrame(data, "b long, i long, r long").withColumn("k", I.pack_key(F.col("b"), F.col("i"), F.col("r"), 8))
    b, i, row = I.unpack_key(F.col("k"), 8)
    assert rows(df.select(b, i, row)) == sorted(data)
    order = [tuple(x)[:3] for x in df.orderBy(F.col("k").bitwiseXOR(F.lit(-(1 << 63)))).collect()]
    assert order == sorted(data, key=lambda x: (x[0], x[1] % 8, x[1] // 8, x[2]))


@pytest.mark.parametrize("g, vocab, off, rot", [(4, 64, 0, 0), (8, 256, 8, 3), (8, 128, 0, 7)])
def test_physical_rows(spark, g, vocab, off, rot):
    p = spark.range(vocab // 2).withColumn("p", I.physical_row(F.col("id"), g, vocab, off, rot))
    got = p.select("id", "p", I.logical_row(F.col("p"), g, vocab, off, rot).alias("back")).collect()
    assert len({x.p for x in got}) == len(got) and all(x.back == x.id for x in got)


def test_quantize(spark):
    q = P.Quantization(0.0, 15.0, 256)
    got = one(spark, V.quantize(F.array(*[F.lit(x) for x in (-1.0, 0.0, 7.31, 15.0, 99.0)]), q))
    assert got[0] == 0.0 and got[-1] == 15.0 and abs(got[2] - 7.31) <= 15 / 255 / 2
    with pytest.raises(ValueError):
        P.Quantization(1.0, 1.0, 4)


def test_clip_and_pad(spark):
    v = F.array(F.lit(-2.0), F.lit(0.5), F.lit(3.0))
    assert one(spark, V.clip(v, -1.0, None)) == [-1.0, 0.5, 3.0] and one(spark, V.clip(v, None, 1.0)) == [-2.0, 0.5, 1.0]
    assert one(spark, V.pad(v, 5, 9.0)) == [-2.0, 0.5, 3.0, 9.0, 9.0] and one(spark, V.unpad(v, 2)) == [-2.0, 0.5] and one(spark, V.squeeze(v)) == -2.0


# ---------------------------------------------------------------- batches and gains
RAGGED = [[5, 18], [0, 2, 31], [18, 0, 20, 6], [1, 28, 5, 8], [0], [12, 7, 3, 11], [18, 0, 7, 3], [6, 4, 19, 2]]


def test_ragged(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*RAGGED, []])], "sample long, ids array<int>")
    assert rows(C.from_arrays(df).select("sample", "pos", "id")) == sorted((i, p, v) for i, x in enumerate(RAGGED) for p, v in enumerate(x))
    assert C.from_arrays(df, keep_empty=True).where("id is null").count() == 1


def test_row_splits(spark):
    df = spark.createDataFrame([([0, 1, 2, 0, 0, 2], [0, 3, 4, 5, 6])], "ids array<long>, offsets array<int>")
    assert rows(C.from_row_splits(df).select("sample", "id")) == sorted([(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (3, 2)])
    none = spark.createDataFrame([([], [0])], "ids array<long>, offsets array<int>")
    assert C.from_row_splits(none).count() == 0


def test_row_pointers(spark):
    coo = spark.createDataFrame([(0, 1), (0, 2), (3, 1)], "sample long, id long")
    assert rows(C.row_pointers(coo, spark.range(5).withColumnRenamed("id", "sample"))) == [(0, 2, 0, 2), (1, 0, 2, 2), (2, 0, 2, 2), (3, 1, 2, 3), (4, 0, 3, 3)]


def test_running_blocks(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = rows(C.running(df, "id", "v", width=64).select("id", "before"))
    total, want = 0, []
    for i in range(1000):
        want.append((i, total))
        total += i % 7
    assert got == want


@pytest.mark.parametrize("combiner", P.COMBINERS)
def test_gains(spark, combiner):
    data = [(0, 1, 2.0), (0, 1, 3.0), (0, 4, 5.0), (1, 2, 0.0), (2, 3, 1.5)]
    got = {(r.sample, r.id): r.gain for r in C.with_gains(spark.createDataFrame(data, "sample long, id long, weight double"), combiner).collect()}
    t = {"sum": 1, "mean": 10.0, "sqrtn": (4 + 9 + 25) ** 0.5}[combiner]
    assert got[0, 1] == pytest.approx(5 / t) and got[0, 4] == pytest.approx(5 / t)
    assert got[1, 2] == (0.0 if combiner == "sum" else None)


def test_gain_errors(spark):
    df = spark.createDataFrame([(0, 9)], "sample long, id long").withColumn("weight", F.lit(1.0))
    with pytest.raises(ValueError):
        C.with_gains(df, "median")
    with pytest.raises(Exception, match="outside the vocabulary"):
        C.validate_ids(df, 9).collect()
    assert C.validate_ids(df, 10).count() == 1


def test_process_slice_and_sequences(spark):
    df = spark.range(16).withColumnRenamed("id", "sample")
    assert [r.sample for r in C.process_slice(df, 1, 4, 16).orderBy("sample").collect()] == [4, 5, 6, 7]
    seq = spark.createDataFrame([(0, [[1, 2], [3]]), (1, [[2], [2, 2]])], "sample long, steps array<array<int>>")
    flat = C.sequence_rows(seq, 2)
    assert rows(flat.select("row", "id")) == [(0, 1), (0, 2), (1, 3), (2, 2), (3, 2), (3, 2)]
    table = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, vec array<double>")
    got = sequence_lookup(C.with_gains(flat.withColumn("weight", F.lit(1.0)), "sum", ("sample", "step")), table, 1)
    assert rows(got.select("sample", "step", V.squeeze(F.col("vec")))) == [(0, 0, 3.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]


# ---------------------------------------------------------------- layout
def dense(spark, n=16, ids=4):
    return spark.createDataFrame([(s, i, 1.0) for s in range(n) for i in range(ids)], "sample long, id long, weight double")


def test_id_dropping(spark):
    """16 samples with ids 0..3 on 4 shards, limits 2 and 1: 32 dropped, 4 ids and 1 id a partition, buffers of 32."""
    placed = L.place(C.with_gains(dense(spark), "sum"), P.Topology(1, 4), 4)
    kept = L.drop_beyond_limits(placed, 2, 1)
    assert L.drop_counts(placed, 2, 1).agg(F.sum("dropped")).first()[0] == 32
    assert rows(L.max_over_sources(L.partition_stats(placed))) == [(g, 4, 1) for g in range(4)]
    assert rows(L.required_buffer(L.partition_stats(placed))) == [(s, 32) for s in range(4)]
    assert {r.row % 4 for r in kept.collect()} == {0, 1} and kept.count() == 32
    with pytest.raises(ValueError):
        L.check_limits(placed, 2, 1)
    assert L.check_limits(placed, 2, 1, allow_dropping=True) == {"ids": 4, "unique_ids": 1}


def test_merged_stats_example(spark):
    coo = spark.createDataFrame([(0, i, 1.0) for i in (0, 0, 0, 2, 4, 1)] + [(1, i, 1.0) for i in (1, 1, 1, 3, 3, 5, 5, 7, 7, 0)], "sample long, id long, weight double")
    st_ = L.partition_stats(L.place(C.with_gains(coo, "sum"), P.Topology(1, 2), 1))
    assert rows(L.max_over_sources(st_)) == [(0, 3, 3), (1, 4, 4)]
    assert rows(L.required_buffer(st_)) == [(0, 16), (1, 16)]


def test_buffers_and_pointers(spark):
    top = P.Topology(1, 4)
    placed = L.place(C.with_gains(dense(spark), "sum"), top, 4)
    assert L.theoretical_buffer(5, top) == 8 * 4 * 4 and L.buffer_size(5, top, 33) == 64 and L.row_pointer_size(top) == 32
    with pytest.raises(ValueError):
        L.buffer_size(5, top, 1000)
    assert rows(L.row_pointers(placed, top, 4, 20))[:8] == [(0, 0, 4), (0, 1, 12), (0, 2, 20), (0, 3, 20), (0, 4, 20), (0, 5, 20), (0, 6, 20), (0, 7, 20)]
    assert L.fit_buffer(placed, 20).count() == 4 * 12
    parts = L.sorted_within_sources(placed, 4).select("local_sc", "global_sc", "local_id", "row").rdd.glom().collect()
    assert all([tuple(x) for x in p] == sorted(tuple(x) for x in p) for p in parts)


# ---------------------------------------------------------------- minibatches
@pytest.mark.parametrize("counts, limit, mask", [([10] * 8, 100, 0), ([100] * 8, 150, 0b1111111), ([10, 20, 30, 40, 50, 60, 70, 80], 100, 0b1101100), ([50, 50, 20, 80, 10, 10, 70, 10], 100, 0b1010000), ([2, 5, 1, 6, 3, 4, 2, 0], 7, 0b1110000)])
def test_split_mask(spark, counts, limit, mask):
    df = M.with_split_mask(spark.createDataFrame([(counts,)], "c array<int>"), "c", limit, "m", 8)
    assert df.first().m == mask


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=64, max_size=64))
def test_minibatches_keep_limits(spark, counts):
    df = M.with_split_mask(spark.createDataFrame([(counts,)], "c array<int>"), "c", 64, "mask").select("mask")
    batch = {r.bucket: r.minibatch for r in M.assignment(df).collect()}
    sums: dict = {}
    for b, n in enumerate(counts):
        sums[batch[b]] = sums.get(batch[b], 0) + n
    assert all(batch[b] <= batch[b + 1] <= batch[b] + 1 for b in range(63))
    assert len(sums) == df.select(F.bit_count("mask")).first()[0] + 1


# ---------------------------------------------------------------- whole batches
def model(batches, spec_of, vocab_offset, rotation, combiner, g, slices):
    """Plain version: {(row, id in the stack): gain}, with split-then-stack rows."""
    offset, out = 0, {}
    total = sum(len(b) for b in batches.values())
    for name in sorted(batches):
        n = len(batches[name])
        for sample, ids in enumerate(batches[name]):
            per = n // slices
            row = sample // per * (total // slices) + offset // slices + sample % per
            for i in ids:
                t = spec_of[name]
                at = (i + rotation[t]) % g + i // g * g + vocab_offset[t] * g
                out[row, at] = out.get((row, at), 0) + {"sum": 1, "mean": 1 / len(ids), "sqrtn": 1 / len(ids) ** 0.5}[combiner]
        offset += n
    return out


@pytest.mark.parametrize("combiner", P.COMBINERS)
def test_preprocess_model(spark, combiner):
    r = random.Random(3)
    top, vocab = P.Topology(2, 2, local_devices=1), {"a": 40, "b": 90}
    batches = {n: [[r.randrange(vocab[t]) for _ in range(r.randrange(6))] for _ in range(8)] for n, t in (("x", "a"), ("y", "b"), ("z", "a"))}
    tables = {n: spec(n, v, 8, combiner=combiner) for n, v in vocab.items()}
    st_ = stack(tables.values(), top)
    feats = {n: P.FeatureSpec(n, t, (8, 1), (8, 8)) for n, t in (("x", "a"), ("y", "b"), ("z", "a"))}
    given = {n: PP.Arrays(spark.createDataFrame(list(enumerate(b)), "sample long, ids array<long>"), 8) for n, b in batches.items()}
    given["z"] = PP.Coordinates(spark.createDataFrame([(s, p, i) for s, ids in enumerate(batches["z"]) for p, i in enumerate(ids)], "sample long, pos long, id long"), 8)
    pre = PP.preprocess(given, feats, [st_], top)
    place = {p.table: p for p in st_.tables}
    want = model(batches, {n: f.table for n, f in feats.items()}, {t: p.row_offset_in_shard for t, p in place.items()}, {t: p.rotation for t, p in place.items()}, combiner, top.num_scs, top.local_scs)
    got = {(x.row, x.id): x.gain for x in pre.rows.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert pre.minibatches == 1 and pre.dropped.agg(F.sum("dropped")).first()[0] == 0
    per: dict = {}
    for row, i in want:
        per.setdefault((row // (24 // top.local_scs), i % top.num_scs), []).append(i)
    assert rows(pre.stats.select("local_sc", "global_sc", "ids", "unique_ids")) == sorted((*k, len(v), len(set(v))) for k, v in per.items())
    small_ = dataclasses.replace(st_, max_ids_per_partition=2, max_unique_ids_per_partition=2)
    with pytest.raises(ValueError):
        PP.preprocess(given, feats, [small_], top)
    cut = PP.preprocess(given, feats, [small_], top, allow_id_dropping=True)
    assert cut.rows.agg(F.sum("n_raw")).first()[0] + cut.dropped.agg(F.sum("dropped")).first()[0] == sum(len(i) for b in batches.values() for i in b)
    mid = dataclasses.replace(st_, max_ids_per_partition=12, max_unique_ids_per_partition=12)
    split = PP.preprocess(given, feats, [mid], top, enable_minibatching=True)
    assert split.minibatches > 1 and {(x.row, x.id): x.gain for x in split.rows.collect()}.keys() <= got.keys()
    assert split.rows.groupBy("local_sc", "minibatch", "global_sc").count().agg(F.max("count")).first()[0] <= 12
    with pytest.raises(ValueError):
        PP.preprocess({"x": given["x"]}, feats, [st_], top)
    with pytest.raises(ValueError):
        PP.preprocess(given, feats, [], top)


# ---------------------------------------------------------------- optimizers
TABLE = [(i, [float(i + 1)] * 8) for i in range(32)]


@pytest.mark.parametrize("clip", [(None, None), (0.0, 5.0)])
def test_adagrad(spark, clip):
    """Row i is i + 1, accumulator 0.002, rate 0.1, gradient 0.012: rows touched n times get one step of n gradients."""
    ids = [5, 18, 0, 20, 6, 15, 12, 7, 3, 11, 8, 26, 0, 18, 7, 2]
    coo = spark.createDataFrame(list(enumerate(ids)), "sample long, id long").withColumn("weight", F.lit(1.0))
    grads = spark.range(16).select(F.col("id").alias("sample"), F.array_repeat(F.lit(0.012), 8).alias("grad"))
    opt = P.Optimizer("adagrad", 0.1, (("initial", 0.002),), *clip)
    out = {r.id: r for r in U.update(spark.createDataFrame(TABLE, "id long, vec array<double>"), C.with_gains(coo, "sum"), grads, 8, opt).collect()}
    for i in range(32):
        n = ids.count(i)
        g = 0.012 * n
        a = 0.002 + g * g
        w = i + 1 - 0.1 * g / a**0.5 if n else float(i + 1)
        if n and clip[1]:
            w = min(max(w, clip[0]), clip[1])
        assert out[i].vec == pytest.approx([w] * 8) and out[i].accumulator == pytest.approx([a if n else 0.002] * 8)


def test_touched_by_zero_gradient(spark):
    table = spark.createDataFrame(TABLE, "id long, vec array<double>")
    sums = spark.createDataFrame([(3, [0.0] * 8)], "id long, grad array<double>")
    new = U.touched(table, sums, P.Optimizer("frequency_adagrad", 0.1), 1)
    assert [(r.id, r["count"][0]) for r in new.collect()] == [(3, 1.0)]


def test_optimizer_errors(spark):
    for bad in (P.Optimizer("none"), P.Optimizer("sgd", 0.1, (("x", 1),))):
        with pytest.raises(ValueError):
            O.kind_of(bad)
    with pytest.raises(ValueError):
        P.Optimizer("sgd", lambda a, b: 1.0).rate(1)
    with pytest.raises(ValueError):
        P.Optimizer("sgd", lambda step: 1.0).rate()
    assert P.Optimizer("sgd", lambda: 0.5).rate() == 0.5 and P.Optimizer("sgd", lambda s: 0.5 * s).rate(2) == 1.0
    with pytest.raises(ValueError):
        O.register("x", None)
    with pytest.raises(ValueError):
        O.RULES["laprop"].rule(F.lit(1.0), F.lit(1.0), {"momentum": F.lit(0.0), "velocity": F.lit(0.0)}, 0.1, None, 0.9, 0.95, 1e-30, 1.0)


# ---------------------------------------------------------------- stacking
def spec(name, vocab, dim, **kw):
    return P.TableSpec(name, vocab, dim, **kw)


def stack(tables, top, **kw):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return S.stack_tables(tables, top, **kw)


@pytest.mark.parametrize("top, rotation", [(P.Topology(1, 4), None), (P.Topology(2, 4), 3)])
def test_stack_round_trip(spark, top, rotation):
    specs = [spec("a", 64, 12), spec("b", 120, 10), spec("c", 7, 16)]
    tables = {}
    for k, t in enumerate(specs):
        vec = F.transform(F.sequence(F.lit(0), F.lit(t.embedding_dim - 1)), lambda i: (F.col("id") + i / 1000 + F.lit(k * 1000)).cast("double"))
        tables[t.name] = spark.range(t.vocabulary_size).select("id", vec.alias("vec"))
    st_ = stack(specs, top, rotation=rotation)
    whole = S.stack_and_shard(tables, st_, top)
    assert sorted(r.row for r in whole.collect()) == list(range(st_.vocab))
    for t in specs:
        assert rows(S.unstack(whole, st_, t.name, top)) == rows(tables[t.name])
    wide = P.Topology(4, 4)
    target = S.restack([st_], {t.name: t for t in specs}, wide)[0]
    moved = S.reshard(whole, st_, top, target, wide)
    for t in specs:
        assert rows(S.unstack(moved, target, t.name, wide)) == rows(tables[t.name])
    with pytest.raises(ValueError):
        S.stack_and_shard({}, st_, top)
    with pytest.raises(ValueError):
        S.unstack(whole, st_, "z", top)


def test_stack_errors():
    top, a, b = P.Topology(1, 4), spec("a", 8, 8), spec("b", 8, 8)
    for bad in ([a, a], [], [a, dataclasses.replace(b, combiner="mean")], [a, dataclasses.replace(b, optimizer=P.Optimizer("adam"))]):
        with pytest.raises(ValueError):
            stack(bad, top)
    for kw in ({"name": "s", "taken": ["s"]}, {"stacked": ["a"]}):
        with pytest.raises(ValueError):
            stack([a, b], top, **kw)
    with pytest.warns(UserWarning):
        assert S.stack_tables([a, b], top).max_ids_per_partition == 256
    assert stack([dataclasses.replace(a, max_ids_per_partition=9)], top).max_ids_per_partition == 9


def test_auto_stack():
    tables = [spec("a", 8, 5), spec("b", 8, 16), spec("c", 8, 8), spec("d", 8, 8, combiner="mean"), spec("e", 8, 7)]
    features = [P.FeatureSpec(f"f{t.name}", t.name, (64, 1), (64, t.embedding_dim)) for t in tables]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = S.members(S.auto_stack(tables, features, P.Topology(1, 4), memory=2 * 8 * 16 * 4))
    assert list(got.values()) == [["a", "c"], ["e"], ["b"], ["d"]]
    assert P.stack_name("a" * 30 for _ in range(3)).startswith("a" * 30 + "_" + "a" * 19 + "...") and len(P.stack_name(["x" * 80])) == 65


def test_specs_json():
    st_ = stack([spec("a", 8, 8, quantization=P.Quantization(0.0, 1.0, 4), optimizer=P.Optimizer("laprop", 0.1))], P.Topology(1, 4))
    assert P.from_json(P.to_json([st_, P.Topology(2, 2)])) == [st_, P.Topology(2, 2)]
    with pytest.raises(TypeError):
        P.to_json(P.Optimizer("sgd", lambda: 1.0))
    assert P.sc_per_device("v5p") == 4 and P.sc_per_device("v6e") == 2
    for bad in (lambda: P.sc_per_device("x"), lambda: P.unique_names([spec("a", 1, 1)] * 2, "table"), lambda: P.same_keys({"a": 1}, {"b": 1}, "names"), lambda: spec("a", 0, 1), lambda: spec("a", 1, 1, combiner="x"), lambda: T.one_lookup_per_table(["a", "a"], ["a"])):
        with pytest.raises(ValueError):
            bad()
    assert P.flatten({"a": [1, {"b": 2}]}) == {"a/0": 1, "a/1/b": 2}


def test_shard_unshard(spark):
    t = spark.range(40).withColumn("v", F.col("id") * 2)
    assert rows(S.unshard_rows(S.shard_rows(t, 8, 40), 8, 40)) == rows(t)


# ---------------------------------------------------------------- files, streams, steps
def test_stats_files(spark, tmp_path):
    def stats(*v):
        return spark.createDataFrame([("one", i, x, y, 256, 1) for i, (x, y) in enumerate(v)], SF.SCHEMA)

    for cls, kw in ((SF.ParquetStats, {}), (SF.CsvStats, {}), (SF.CsvStats, {"retain_history": False})):
        base = str(tmp_path / f"{cls.__name__}{len(kw)}")
        a, b = cls(spark, base, 0, **kw), cls(spark, base, 1, **kw)
        a.record(stats((99, 99), (99, 99)))
        a.publish()
        a.recorded.clear()
        a.record(stats((10, 1), (20, 2)))
        a.record(stats((5, 9), (30, 1)))
        a.publish()
        b.record(stats((7, 3), (8, 4)))
        b.publish()
        got = b.load()
        assert rows(got.select("shard", "max_ids", "max_unique")) == [(0, 10, 9), (1, 30, 4)]
        new = ST.apply_limits([stack([spec("one", 8, 8)], P.Topology(1, 4)), stack([spec("two", 8, 8)], P.Topology(1, 4))], got)
        assert [(s.name, s.max_ids_per_partition, s.suggested_buffer) for s in new] == [("one", 30, 256), ("two", 256, None)]


def test_checkpoint(spark, tmp_path):
    base, top, wide = str(tmp_path / "c"), P.Topology(1, 4), P.Topology(2, 4)
    specs = {"a": spec("a", 20, 3), "b": spec("b", 33, 5)}
    data = {n: spark.range(t.vocabulary_size).select("id", F.transform(F.sequence(F.lit(1), F.lit(t.embedding_dim)), lambda i: (F.col("id") * i).cast("double")).alias("vec")).withColumn("accumulator", F.transform("vec", lambda x: x + 1)) for n, t in specs.items()}
    st_ = stack(specs.values(), top)
    with pytest.raises(FileNotFoundError):
        K.restore(spark, base)
    for step in (1, 2):
        K.save(spark, base, step, {st_.name: S.stack_and_shard(data, st_, top, 0.0, ("vec", "accumulator"))}, [st_], top)
    step, tables, got, old = K.restore(spark, base)
    assert (step, got, old) == (2, [st_], top)
    with pytest.raises(KeyError):
        K.restore(spark, base, want={"x"})
    with pytest.raises(FileNotFoundError):
        K.restore(spark, base, step=9)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        K.convert(spark, base, str(tmp_path / "d"), specs, wide, 1)
    _, tables, got, _ = K.restore(spark, str(tmp_path / "d"))
    for n in specs:
        assert rows(S.unstack(tables[st_.name], got[0], n, wide, ("vec", "accumulator"))) == rows(data[n])
    (tmp_path / "tables.json").write_text(P.to_json(list(specs.values())))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        K.main(["--input", base, "--output", str(tmp_path / "e"), "--tables", str(tmp_path / "tables.json"), "--devices", "2", "--kind", "v6e"])
    step, tables, got, top = K.restore(spark, str(tmp_path / "e"))
    assert (step, top) == (2, P.Topology(2, 2)) and rows(S.unstack(tables[st_.name], got[0], "b", top)) == rows(data["b"].select("id", "vec"))


def test_training_stream(spark, tmp_path):
    """The streamed versions are those of the same steps done in a row; a repeated batch changes nothing."""
    opt, base = P.Optimizer("adagrad", 0.1), str(tmp_path / "t")
    table = spark.createDataFrame(TABLE, "id long, vec array<double>")
    table.write.parquet(TS.version(base, -1))
    data = [[(0, i, 1.0, [0.1 * i] * 8) for i in range(5)], [(1, 2, 0.5, [1.0] * 8)]]
    schema = "sample long, id long, gain double, grad array<double>"
    want = U.with_slots(table, opt)
    for n, part in enumerate(data):
        src = str(tmp_path / "in")
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = TS.start_training(spark.readStream.schema(schema).parquet(src), base, str(tmp_path / "cp"), 8, opt)
        q.awaitTermination()
        df = spark.createDataFrame(part, schema)
        sums = U.gradient_sums(df.select("sample", "id", "gain"), df.select("sample", "grad").dropDuplicates(["sample"]), 8) if n else df.select("id", F.transform("grad", lambda g: g).alias("grad"))
        want = U.merge(want, U.touched(want, sums, opt, n))
        assert rows(spark.read.parquet(TS.version(base, n)).select("id", "vec", "accumulator")) == rows(want.select("id", "vec", "accumulator"))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "m")
    spark.sql("select * from values (timestamp'2024-01-01 00:00:00', 1, 7, true), (timestamp'2024-01-01 00:00:05', 1, 7, false), (timestamp'2024-01-01 00:00:06', 1, 8, false) t(ts, sync_key, source, flag)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, sync_key int, source int, flag boolean").parquet(src)
    q = TS.first_contributions(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("firsts").select("sync_key", "source")) == [(1, 7), (1, 8)]
    assert rows(TS.missing_after(spark, spark.table("firsts"), [7, 8, 9])) == [(1, 9)]
    limits = str(tmp_path / "l")
    spark.createDataFrame([("s", 0, 3, 1, 8, 0), ("s", 1, 5, 2, 16, 4)], SF.SCHEMA).write.parquet(limits)
    q = TS.observed_limits(spark.readStream.schema(SF.SCHEMA).parquet(limits)).writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("limits")) == [("s", 5, 2, 16, 4)]
    events = TS.windowed_batches(spark.sql("select timestamp'2024-01-01 05:00:00' ts, 1L user_id, 'a' event_type, 2.0D value"))
    assert events.first().n == 1 and events.first().weight == 2.0


def test_pipelined_staleness(spark):
    """The third lookup is the first that sees an update."""
    table = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    batch = spark.createDataFrame([(0, 0, 1.0)], "sample long, id long, gain double")
    _, act = T.run_pipelined(table, [batch] * 4, lambda a, _: a.select("sample", F.array(F.lit(1.0)).alias("grad")), 1, P.Optimizer("sgd", 0.5))
    assert [a.first().vec for a in act] == [[1.0], [1.0], [0.5], [0.0]]


def test_layer(spark):
    layer = T.EmbeddingLayer(1, P.Optimizer("sgd", 0.5))
    table = spark.createDataFrame([(0, [1.0]), (1, [4.0])], "id long, vec array<double>")
    coo = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5)], "sample long, id long, gain double")
    samples = spark.range(2).withColumnRenamed("id", "sample")
    act = layer(coo, table, samples)
    assert rows(act) == [(0, [3.0]), (1, [0.0])]
    assert rows(layer.apply_gradient(coo, table, act.withColumnRenamed("vec", "grad"))) == [(0, [-0.5]), (1, [3.25])]
    assert rows(lookup(coo, table, 1, quantization=P.Quantization(0.0, 2.0, 3))) == [(0, [2.0])]


def add_one(step):
    return 0.1 * (step + 1)


def test_learning_rate_tags():
    import functools

    opt = P.Optimizer("sgd", add_one)
    assert P.from_json(P.to_json(opt), {P.tag_of(add_one): add_one}) == opt
    with pytest.raises(ValueError):
        P.from_json(P.to_json(opt))
    assert P.Optimizer("sgd", functools.partial(lambda a, step: a * step, 2.0)).rate(3) == 6.0
    assert P.grouped_names([["a"], ("b", "c")], {"a", "b", "c"}) == [["a"], ["b", "c"]]
    for bad in ([["a"]], [["a", "b"], ["b", "c"]], [["a", "b", "c", "d"]]):
        with pytest.raises(ValueError):
            P.grouped_names(bad, ["a", "b", "c"])


def test_rows_within_vocabulary(spark):
    df = spark.createDataFrame([(3,), (8,)], "id long")
    assert df.where("id < 8").select(I.physical_row(F.col("id"), 4, 16, 0, 1, 8).alias("r")).first().r == 0
    with pytest.raises(Exception, match="row outside a vocabulary of 8: 8"):
        df.select(I.physical_row(F.col("id"), 4, 16, 0, 1, 8).alias("r")).collect()


@pytest.mark.parametrize("dim", [3, 150])
def test_wide_vectors(spark, dim):
    """Sums by blocks of dimensions; ids that the table lacks; wide gradients."""
    r = random.Random(4)
    table = {i: [r.random() for _ in range(dim)] for i in range(9)}
    raw = [(s, r.randrange(11), float(r.randrange(1, 5))) for s in range(6) for _ in range(5)] + [(9, 10, 1.0)]
    coo, tab = spark.createDataFrame(raw, "sample long, id long, weight double"), spark.createDataFrame(list(table.items()), "id long, vec array<double>")
    for combiner in P.COMBINERS:
        got = {x.sample: x.vec for x in pooled(coo, tab, dim, combiner).collect()}
        for s in range(6):
            w = [(i, x) for t, i, x in raw if t == s]
            total = {"sum": 1, "mean": sum(x for _, x in w), "sqrtn": sum(x * x for _, x in w) ** 0.5}[combiner]
            assert got[s] == pytest.approx([sum(x * table[i][d] for i, x in w if i in table) / total for d in range(dim)])
        assert 9 not in got
        assert {k: pytest.approx(v) for k, v in got.items()} == {x.sample: x.vec for x in lookup(C.with_gains(coo, combiner), tab, dim).collect()}


def above_join(df):
    """The exchanges that stand above the join with the table, where rows hold vectors or their sums."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [__id" in plan
    return plan[: plan.index("BroadcastHashJoin [__id")].count("Exchange hashpartitioning")


def test_two_features_shuffle_no_vectors(spark, sf_dir):
    """Sums of 64 dimensions are complete where the rows of a sample meet."""
    assert above_join(Q.QUERIES["lookup_two_features"](spark, sf_dir)) == 0


def test_two_features_of_a_large_table(spark, sf_dir, monkeypatch):
    """Rows are shuffled once; of a table beyond the bound, the vectors of the ids that occur are broadcast."""
    whole = Q.QUERIES["lookup_two_features"](spark, sf_dir)
    monkeypatch.setattr(LK, "BROADCAST_BYTES", 300 * (4 * 64 + 64))
    assert not LK.fits(Q.vectors(spark, sf_dir), 64)
    some = Q.QUERIES["lookup_two_features"](spark, sf_dir)
    assert above_join(some) == 0
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert whole.exceptAll(some).count() == 0 and whole.count() == some.count()


def test_minibatches_of_a_large_table(spark, sf_dir, monkeypatch):
    """Rows are dealt by sample once for the sums and once for the mask; a table beyond the bound as above."""
    whole = Q.QUERIES["minibatch_equivalence"](spark, sf_dir)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(sample#") == 2
    monkeypatch.setattr(LK, "BROADCAST_BYTES", 300 * (4 * 64 + 64))
    some = Q.QUERIES["minibatch_equivalence"](spark, sf_dir)
    assert above_join(some) == 0
    assert whole.exceptAll(some).count() == 0 and whole.count() == some.count()


def test_preprocessed_rows_of_a_large_table(spark, sf_dir, monkeypatch):
    """Each feature's rows are dealt by their row once; a table beyond the bound as above."""
    whole = Q.QUERIES["preprocess_and_lookup"](spark, sf_dir)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(row#") == 2
    monkeypatch.setattr(LK, "BROADCAST_BYTES", 300 * (8 * 64 + 64))
    some = Q.QUERIES["preprocess_and_lookup"](spark, sf_dir)
    assert above_join(some) == 0
    assert whole.exceptAll(some).count() == 0 and whole.count() == some.count()


@pytest.mark.parametrize("combiner", P.COMBINERS)
def test_gains_of_dealt_rows(spark, combiner):
    """The same merged rows with one shuffle; equal and null ids, null weights and samples, a zero total."""
    raw = [(1, 2, 3.0), (1, 2, 4.0), (1, 9, 5.0), (1, None, 2.0), (2, 9, 1.0), (3, 0, None), (3, 1, 2.0), (4, 1, 0.0), (5, 3, None), (None, 1, 2.0)]
    coo = spark.createDataFrame(raw, "sample long, id long, weight double")
    dealt = C.with_gains(coo, combiner, deal=True)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    a, b = ({(r.sample, r.id): (r.gain, r.n_raw) for r in df.collect()} for df in (dealt, C.with_gains(coo, combiner)))
    assert set(a) == set(b) and all(a[k] == (b[k][0] if b[k][0] is None else pytest.approx(b[k][0]), b[k][1]) for k in b)
    assert a[1, 2][0] == pytest.approx(7 / {"sum": 1, "mean": 14, "sqrtn": 54**0.5}[combiner])


def test_bound_counts_vectors_in_their_own_type(spark, monkeypatch):
    tab = spark.createDataFrame([(i, [0.0] * 64) for i in range(10)], "id long, vec array<float>")
    monkeypatch.setattr(LK, "BROADCAST_BYTES", 10 * (4 * 64 + 64))
    assert LK.fits(tab, 64) and not LK.fits(tab.selectExpr("id", "cast(vec AS array<double>) vec"), 64)


def test_minibatches_shuffle_no_vectors(spark, sf_dir):
    """Minibatches of a sample meet by sample, so that their sums need no shuffle either."""
    assert above_join(Q.QUERIES["minibatch_equivalence"](spark, sf_dir)) == 0


def test_preprocessed_rows_shuffle_no_vectors(spark, sf_dir):
    """Rows of a stacked batch are dealt by their row before they meet the table."""
    assert above_join(Q.QUERIES["preprocess_and_lookup"](spark, sf_dir)) == 0


@pytest.mark.parametrize("combiner", P.COMBINERS)
def test_pooled_by_either_plan(spark, monkeypatch, combiner):
    """Tables beyond the bound are joined by shuffles, with the same sums; equal ids, null weights and unknown ids."""
    raw = [(1, 2, 3.0), (1, 2, 4.0), (1, 9, 5.0), (2, 9, 1.0), (3, 0, None), (3, 1, 2.0), (None, 1, 2.0)]
    coo, tab = spark.createDataFrame(raw, "sample long, id long, weight double"), spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, vec array<double>")
    one = {x.sample: x.vec for x in pooled(coo, tab, 2, combiner).collect()}
    monkeypatch.setattr(LK, "BROADCAST_BYTES", 2 * (8 * 2 + 64))
    assert not LK.fits(tab, 2) and LK.fits(tab.limit(2), 2)
    two = {x.sample: x.vec for x in pooled(coo, tab, 2, combiner).collect()}
    assert {k: pytest.approx(v) for k, v in one.items()} == two and set(one) == {1, 3, None}
    total = {"sum": 1, "mean": 12, "sqrtn": 50**0.5}[combiner]
    assert one[1] == pytest.approx([14 / total, 7 / total])


def test_next_token_rows(spark):
    lists = [(1, [5]), (2, [1, 2, 3]), (3, []), (4, None), (5, list(range(9)))]
    a = rows(X.next_token_rows(spark.createDataFrame(lists, "key long, ids array<long>"), 4))
    flat = [(k, p, i) for k, ids in lists for p, i in enumerate(ids or [])]
    assert a == rows(X.next_token_windows(spark.createDataFrame(flat, "key long, pos long, id long"), 4)) and len(a) == 13


def test_buffers(spark):
    """The whole batch laid out: what finds no place is counted with what the limits dropped."""
    r = random.Random(5)
    top = P.Topology(2, 2, local_devices=1)
    batch = [(s, [r.randrange(40) for _ in range(r.randrange(8))]) for s in range(16)]
    st_ = stack([spec("a", 40, 8)], top)
    feats = {"x": P.FeatureSpec("x", "a", (16, 1), (16, 8))}
    given = {"x": PP.Arrays(spark.createDataFrame(batch, "sample long, ids array<long>"), 16)}
    merged = len({(s, i) for s, ids in batch for i in ids})
    whole = PP.buffers(PP.preprocess(given, feats, [st_], top), st_, top)
    real = whole.rows.where(F.col("embedding_id") != L.PAD)
    assert real.count() == merged and whole.total_dropped() == 0 and whole.pointers.count() == top.local_scs * 8
    assert whole.rows.groupBy("local_sc", "position").count().where("count > 1").count() == 0
    tight = dataclasses.replace(st_, suggested_buffer=32)
    cut = PP.buffers(PP.preprocess(given, feats, [tight], top), tight, top)
    assert cut.capacity == 16 and cut.rows.where(F.col("embedding_id") != L.PAD).count() + cut.total_dropped() == merged and cut.total_dropped() > 0
    mini = dataclasses.replace(st_, max_ids_per_partition=6, max_unique_ids_per_partition=6)
    split = PP.preprocess(given, feats, [mini], top, enable_minibatching=True)
    laid = PP.buffers(split, mini, top)
    assert split.minibatches > 1 and laid.rows.count() + laid.dropped.agg(F.sum("overflow")).first()[0] == split.rows.count()
    assert laid.rows.groupBy("local_sc", "position").count().where("count > 1").count() == 0
    assert PP.shapes(feats, [tight], top) == {tight.name: {"row_pointers": 16, "places": 32, "rows": 16}}


def test_stacked_layer(spark):
    """Two features of two tables of one stack: forward and backward as each table alone."""
    top = P.Topology(1, 4)
    tables = {n: spec(n, v, d, combiner="mean", optimizer=P.Optimizer("sgd", 0.5)) for n, v, d in (("a", 10, 8), ("b", 20, 6))}
    st_ = stack(tables.values(), top)
    feats = {"x": P.FeatureSpec("x", "a", (8, 1), (8, 8)), "y": P.FeatureSpec("y", "b", (8, 1), (8, 6))}
    r = random.Random(6)
    coo = {f: spark.createDataFrame([(s, r.randrange(tables[feats[f].table].vocabulary_size), 1.0) for s in range(8) for _ in range(3)], "sample long, id long, weight double") for f in feats}
    first = {n: S.init_table(spark, t.vocabulary_size, t.embedding_dim, lambda i, d: i + d / 10) for n, t in tables.items()}
    layer, sizes = T.StackedLayer(feats, [st_], top), {"x": 8, "y": 8}
    pre = layer.preprocess_inputs({f: PP.Rows(c, 8) for f, c in coo.items()})
    stacked = {st_.name: PP.stacked_ids(st_, top, S.stack_and_shard(first, st_, top, 0.0))}
    act = layer(pre, stacked, sizes)
    new = layer.apply_gradient(pre, stacked, {f: a.withColumnRenamed("vec", "grad") for f, a in act.items()}, sizes)[st_.name]
    g, size = top.num_scs, st_.vocab // top.num_scs
    back = new.select((F.pmod("id", F.lit(g)) * size + I.div(F.col("id"), g)).alias("row"), "vec")
    for f, spec_ in feats.items():
        t = spec_.table
        want = lookup(C.with_gains(coo[f], "mean"), first[t], tables[t].embedding_dim)
        assert {x.sample: pytest.approx(x.vec) for x in want.collect()} == {x.sample: x.vec for x in act[f].collect()}
        alone = T.EmbeddingLayer(tables[t].embedding_dim, tables[t].optimizer).apply_gradient(C.with_gains(coo[f], "mean"), first[t], want.withColumnRenamed("vec", "grad"))
        assert {x.id: pytest.approx(x.vec) for x in alone.collect()} == {x.id: x.vec for x in S.unstack(back, st_, t, top).collect()}
    with pytest.raises(ValueError):
        PP.feature_rows(pre, back, "x", st_, 8, top, dim=99)
    with pytest.raises(ValueError):
        layer(pre, {}, sizes)


def test_stages_and_initial_state(spark):
    table = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    batch = spark.createDataFrame([(0, 0, 1.0)], "sample long, id long, gain double")
    opt = P.Optimizer("sgd", 0.5)
    usual = T.default_stages(lambda a, _: a.select("sample", F.array(F.lit(1.0)).alias("grad")), 1, opt)
    stages = dataclasses.replace(usual, dense=lambda act, step: (usual.dense(act, step)[0], f"loss {step}"))
    last, act, aux = T.run_stages(table, [batch] * 3, stages)
    assert last.first().vec == [-0.5] and [a.first().vec for a in act] == [[1.0], [1.0], [0.5]] and aux == [(None, f"loss {k}") for k in range(3)]
    none = T.initial_state(spark)
    assert rows(T.EmbeddingLayer(1, opt).apply_gradient(batch, table, none.gradients)) == rows(table) and none.activations.count() == 0


def test_restack():
    tables = {t.name: t for t in (spec("a", 8, 8), spec("b", 8, 8))}
    feats = [P.FeatureSpec(f"f{n}", n, (64, 1), (64, 8)) for n in tables]
    both = [stack(tables.values(), P.Topology(1, 4))]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert S.members(S.restack(both, tables, P.Topology(1, 2))) == {both[0].name: ["a", "b"]}
        with pytest.raises(ValueError):
            S.restack(both, tables, P.Topology(1, 2), feats, memory=1100)
        assert list(S.members(S.restack(both, tables, P.Topology(1, 2), feats, regroup=True, memory=1100)).values()) == [["a"], ["b"]]
        with pytest.raises(ValueError):
            S.restack(both, {"a": tables["a"]}, P.Topology(1, 2))


def test_limits_cycle(spark, tmp_path):
    """Recorded, published, loaded, applied: the next batch runs with the limits observed."""
    top = P.Topology(1, 2)
    st_ = stack([spec("a", 16, 8)], top)
    feats = {"x": P.FeatureSpec("x", "a", (4, 1), (4, 8))}
    given = {"x": PP.Arrays(spark.createDataFrame([(s, [s, s + 2, s + 4]) for s in range(4)], "sample long, ids array<long>"), 4)}
    client = SF.ParquetStats(spark, str(tmp_path / "stats"))
    pre = PP.preprocess(given, feats, [st_], top)
    (now,) = SF.next_limits(client, [st_], pre.stats, pre.dropped)
    top_ = pre.stats.agg(F.max("ids"), F.max("unique_ids"), F.max("required")).first()
    assert (now.max_ids_per_partition, now.max_unique_ids_per_partition, now.suggested_buffer) == tuple(top_)
    again = PP.preprocess(given, feats, [now], top)
    assert again.rows.count() == pre.rows.count()
