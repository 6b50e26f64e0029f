"""Near-duplicate embeddings by E8 lattice hashing.

Equal vectors of one label are first folded into a class. Each class's direction is projected to eight dimensions by ``TABLES``
random orthonormal projections, scaled, and decoded to the nearest point of the E8 lattice. The class lives in that cell of each
table and visits the ``PROBES`` neighbouring cells (of the 240 that touch it) nearest to it. Pairs that meet in a cell are
compared by cosine in double precision, as a matrix product within the task: no pair is ever sent. A pair counts in the first
table and place where it meets, so counts are exact for all pairs that meet at all; each task sends, for each of its classes,
its number of links and one edge to the smallest member linked with it, from which components follow.

Cells with more than ``CELL`` members are cut into blocks and compared block against block, so no cell is too large for a
task and none is capped. Two vectors at cosine 0.98 meet in one table with probability 0.91 (simulated), in one of four with
0.9999; closer ones more often.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with null labels, link with
nothing; vectors of different lengths never link; repeated rows count as vectors; different vectors that share a vec_id are
linked and counted each by itself; an empty table gives an empty result; a null vec_id has a null component and is
not kept; other columns, whatever their names, are ignored. The work on a cell of near copies that are all different grows
with the square of their number.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import bound_batches, components, connected, groups, mix, remove, stage, table

THRESHOLD = 0.98
TABLES, PROBES, SCALE = 4, 2, 0.2
CELL = 512


# ---------------------------------------------------------------- lattice
@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    k = np.abs(e).argmax(axis=1)[odd]
    r[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.cache
def projection(dim: int, number: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, 8))) if dim >= 8 else (np.eye(dim, 8), None)
    return q


def _name(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.copy()
    for i in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.rint(points[:, i] * 2).astype(np.int64).view(np.uint64) + np.uint64(i + 1))
    return h


def codes(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """(vector, table, 1 + probes) cell names: the home cell first."""
    out = np.zeros((len(unit), tables, 1 + probes), np.uint64)
    near = neighbours()
    for t in range(tables):
        x = unit @ projection(unit.shape[1], t) / (scale * (1.0 if unit.shape[1] >= 64 else np.sqrt(64 / max(unit.shape[1], 8))))
        home = decode(x)
        salt = mix(label.astype(np.int64).view(np.uint64) * np.uint64(2654435761) + np.uint64(unit.shape[1] * 1000 + t))
        out[:, t, 0] = _name(home, salt)
        best = np.argsort(-((x - home) @ near.T), axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            out[:, t, k + 1] = _name(home + near[best[:, k]], salt)
    return out


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- tasks
_ROW = "cell long, block int, id long, weight long, home int, vector binary, codes binary"


def _spread(batches: Iterator[pa.RecordBatch], tables: int, probes: int, scale: float) -> Iterator[pa.RecordBatch]:
    """A row for each cell that a class lives in or visits."""
    for b in batches:
        ids, weight, label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        rows = b.column(3).to_pylist()
        for dim in sorted({len(r) for r in rows}):
            at = np.array([i for i, r in enumerate(rows) if len(r) == dim])
            raw = np.array([rows[i] for i in at], np.float64)
            c = codes(unit_vectors(raw), label[at], tables, probes, scale)
            n = tables * (1 + probes)
            cells = c.reshape(len(at), n).view(np.int64)
            per = lambda x: np.repeat(x, n)
            home = np.tile(np.tile([1] + [0] * probes, tables), len(at))
            table_no = np.tile(np.repeat(np.arange(tables), 1 + probes), len(at))
            vec, code = [r.tobytes() for r in raw], [r.tobytes() for r in c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel()), pa.array(table_no, pa.int32()), pa.array(per(ids[at])), pa.array(per(weight[at])), pa.array(home, pa.int32()), pa.array([v for v in vec for _ in range(n)], pa.binary()), pa.array([v for v in code for _ in range(n)], pa.binary())],
                names=[x.split()[0] for x in _ROW.replace("block", "tab").split(", ")],
            )


def _compare(batches: Iterator[pa.RecordBatch], tables: int, probes: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each tile: (id, links, smallest id linked within the tile, directly or not)."""
    for t in groups(batches, 3):
        if len(t) < 2:
            continue
        ti, tj = t["ti"][0].as_py(), t["tj"][0].as_py()
        block, ids, weight, home, tab = (t[c].to_numpy() for c in ("block", "id", "weight", "home", "tab"))
        a, z = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
        if not len(a) or not len(z) or not home.any():
            continue
        vec = unit_vectors(np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(len(t), -1))
        code = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint64).reshape(len(t), tables, 1 + probes)
        x, y = np.nonzero(vec[a] @ vec[z].T >= threshold)
        x, y = a[x], z[y]
        ok = (ids[x] < ids[y]) if ti == tj else (ids[x] != ids[y])
        ok &= (home[x] | home[y]) == 1
        x, y = x[ok], y[ok]
        now = int(tab[0])
        # Both at home: here. One visiting: here, unless the other visits the first one's home too and has the smaller id.
        both = (home[x] & home[y]) == 1
        guest, host = np.where(home[x] == 0, x, y), np.where(home[x] == 0, y, x)
        back = (code[host, now, 1:] == code[guest, now, :1]).any(axis=1)
        ok = both | ~back | (ids[guest] < ids[host])
        for e in range(now):  # met in an earlier table
            met = (code[x, e, :1] == code[y, e]).any(axis=1) | (code[y, e, :1] == code[x, e]).any(axis=1)
            ok &= ~met
        root = components(len(t), x, y)
        # Rows of one class may stand twice in a tile (never in one block), so links are summed by row and roots given as ids.
        n = np.zeros(len(t), np.int64)
        np.add.at(n, x[ok], weight[y[ok]])
        np.add.at(n, y[ok], weight[x[ok]])
        low = np.full(len(t), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        some = np.unique(np.concatenate([x, y]))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(low[root[some]])], names=["id", "n", "root"])


def link_embeddings(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch: list[str] = []
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("good", good)
    keyed = keyed.withColumn("k1", F.when(F.col("good"), F.xxhash64("label", "e")).otherwise(F.xxhash64(F.lit("none"), "id")))
    keyed = keyed.withColumn("k2", F.when(F.col("good"), F.xxhash64(F.reverse("e"), "label")).otherwise(F.lit(0)))
    classes = keyed.where("good").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min("label").alias("label"), F.first("e").alias("e"))
    # Different vectors may share an id, so classes get numbers of their own; staged, they stay the same.
    classes = stage(classes.withColumnRenamed("id", "low").withColumn("id", F.monotonically_increasing_id()), "classes", scratch)
    spread = classes.select("id", "weight", "label", "e").mapInArrow(lambda it: _spread(it, tables, probes, scale), _ROW.replace("block", "tab"))
    sizes = spread.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    big = stage(sizes.select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")), "big-cells", scratch)
    cut = spread.join(big, "cell", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("ti"), F.greatest(j, F.col("block")).alias("tj"))))
    tiles = cut.withColumn("tile", tile).select("cell", F.col("tile.ti").alias("ti"), F.col("tile.tj").alias("tj"), "block", "tab", "id", "weight", "home", "vector", "codes")
    met = tiles.repartition("cell", "ti", "tj").sortWithinPartitions("cell", "ti", "tj")
    links = stage(met.mapInArrow(lambda it: _compare(it, tables, probes, threshold), "id long, n long, root long"), "links", scratch)
    roots = connected(links.selectExpr("id u", "root v"), "vectors").select(F.col("node").alias("id"), "root")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    placed = classes.select("k1", "k2", "id", "low", "weight").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    whole = stage(placed.join(lowest, "root").select("k1", "k2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.col("component").alias("root")), "vector-classes")
    remove(spark, scratch)
    out = keyed.select("id", "k1", "k2", "good").join(whole, ["k1", "k2"], "left")
    component = F.when(F.col("good"), F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op2_embedding_lattice(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return link_embeddings(table(spark, sf_dir, "embeddings"))
