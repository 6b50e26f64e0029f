"""Shared parts of the training-data operators: text to hashed words, staging, connected components.

Words are cut and hashed for a whole Arrow batch at once: a 256-entry byte class marks word bytes, a polynomial prefix
sum over the bytes gives every word's 64-bit hash without a Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one longer document still makes one chunk.
CHUNK_BYTES = 1 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM2 = np.uint64(0xA0761D6478BD642F)


# ---------------------------------------------------------------- sessions and staging
def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python by bytes, so that long texts don't add up. Lower bounds of the session stay; plans
    are lazy, so the setting has to last."""
    for name, most in ((_ARROW_BYTES, 8 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 1024)):
        now = spark.conf.get(name).lower().removesuffix("b")  # a size in other units is a larger one
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One is made only where the session names none and is one local process (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        made = sc._jsc.sc().getCheckpointDir()
        if not made.isDefined():
            if not sc.isLocal:
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            made = sc._jsc.sc().getCheckpointDir()
        named = made.get()
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. ``scratch`` notes the
    path, for tables that are of no use once what was made of them has been written."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    if scratch is not None:
        scratch.append(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, scratch: list[str]) -> None:
    """Delete staged tables, through the file system that Spark itself writes to."""
    for path in scratch:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    scratch.clear()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing
def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a uint64 array."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """base**i and base**-i modulo 2**64, grown when needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


_BYTES, _G1, _G2 = _Powers(_BASE), _Powers(_GRAM), _Powers(_GRAM2)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is false for the given byte ranges (both ends included), true elsewhere."""
    t = np.ones(256, bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, and of ``[^\x20\x09-\x0D]+``.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ALNUM[0x41:0x5B] = True
NONSPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += np.uint64(32)
#: Bytes, or values, whose prefix sums are made at once.
_BLOCK = 1 << 20


def hash_ranges(data: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; of equal bytes equal, wherever they stand. Prefix sums cover a block of bytes (and its last
    range) at a time, so a very long text takes no more memory for them."""
    out = np.zeros(len(start), np.uint64)
    order = None
    if len(start) and (np.diff(start) < 0).any():
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    a = 0
    while a < len(start):
        low = start[a]
        z = max(a + 1, int(np.searchsorted(start, low + _BLOCK)))
        part = data[low : end[a:z].max()]
        up, down = _BYTES.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        x, y = start[a:z] - low, end[a:z] - low
        out[a:z] = mix((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        a = z
    if order is None:
        return out
    back = np.empty_like(out)
    back[order] = out
    return back


class Words:
    """The words of a run of texts: ``doc``, ``start``, ``end`` (bytes in ``data``), ``hash``; ``first[d]:first[d+1]`` are those of text d."""

    def __init__(self, data: np.ndarray, off: np.ndarray, keep: np.ndarray, lower: bool):
        n, docs = len(data), len(off) - 1
        self.data, self.off, self.docs, self._values = data, off, docs, _LOWER if lower else _SAME
        if n == 0:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
            return
        k = keep[data]
        edge = np.zeros(n, bool)
        edge[0] = True
        edge[1:] = ~k[:-1]
        edge[off[:-1][off[:-1] < n]] = True
        self.start = np.flatnonzero(k & edge)
        edge[-1] = True
        edge[:-1] = ~k[1:]
        inner = off[1:] - 1
        edge[inner[inner >= 0]] = True
        self.end = np.flatnonzero(k & edge) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hash_ranges(self.data, self._values, start, end)

    def __len__(self) -> int:
        return len(self.start)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))


def grams(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of every ``size`` consecutive values of ``h`` (text borders are the caller's concern)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _BLOCK):
        part = h[a : a + _BLOCK + size - 1]
        up, down = (_G2 if second else _G1).get(len(part) + 1)
        s = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=s[1:])
        m = len(part) - size + 1
        out[a : a + m] = mix((s[size:] - s[:m]) * down[:m])
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their text bytes and offsets, at most ``most`` bytes at once (or one row). Null texts are empty."""
    for b in batches:
        arr = b.column(b.schema.get_field_index(text))
        if arr.null_count:
            arr = pc.fill_null(arr, "")
        wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        bufs, n = arr.buffers(), len(arr)
        if n == 0:
            continue
        off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            z = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield b.slice(a, z - a), data[off[a] : off[z]], off[a : z + 1] - off[a]
            a = z
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: a worker process serves many tasks, and what it holds counts as the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


class IdTable:
    """A bounded table from a word's 64-bit hash to its ids, all in arrays: about 40 bytes a word, and a run's words are found
    at once. New words collect in a small sorted part that is merged into the large one; when ``most`` words are in, the
    small part is emptied instead. It only saves work: a word that isn't in is encoded again.

    Two words of one hash would get the same ids: with ``most`` words in, a word not met before has a chance of most / 2**64.
    """

    def __init__(self, most: int):
        self.most = most
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # large, small: hash, start, n
        self.ids, self.used, self.large = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each (sorted) hash's ids start, and how many they are; -1 for words that aren't in."""
        start, n = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for keys, at, many in self.parts:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                start[hit], n[hit] = at[i[hit]], many[i[hit]]
        return start, n

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray, stay: np.ndarray) -> np.ndarray:
        """Store new words' ids (one after the other) and return where they start; those that don't ``stay`` only until the
        next call."""
        order = np.argsort(~stay, kind="stable")
        begin = np.cumsum(n) - n
        upto = np.cumsum(n[order])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + len(ids) + (1 << 16), np.uint32)])
        put = np.arange(len(ids)) + np.repeat(begin[order] - (upto - n[order]), n[order])
        self.ids[self.used : self.used + len(ids)] = ids[put]
        start = np.empty(len(h), np.int64)
        start[order] = self.used + upto - n[order]
        keys, at, many = (np.concatenate(x) for x in zip(self.parts[1], (h[stay], start[stay], n[stay]), strict=True))
        by = np.argsort(keys, kind="stable")
        self.parts = [self.parts[0], (keys[by], at[by], many[by])]
        self.used += int(n[stay].sum())
        return start

    def settle(self) -> None:
        """Merge or empty the small part if it is large. What was found before isn't valid any more."""
        if len(self.parts[1][0]) <= self.most // 8:
            return
        both = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        empty = tuple(x[:0] for x in both)
        if len(both[0]) <= self.most:
            by = np.argsort(both[0], kind="stable")
            self.parts, self.large = [tuple(x[by] for x in both), empty], self.used
        else:
            self.parts, self.used = [self.parts[0], empty], self.large


def gather(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``ids[start:start + n]`` of each, one after the other."""
    upto = np.cumsum(n)
    return ids[np.arange(int(upto[-1]) if len(n) else 0) + np.repeat(start - (upto - n), n)]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` (integer) columns of sorted batches; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(len(b), bool)
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in cols)
        at = 0
        for z in [*np.flatnonzero(new).tolist(), len(b)]:
            if z > at:
                held.append(b.slice(at, z - at))
            if z < len(b) and held:
                yield pa.Table.from_batches(held)
                held = []
            at = z
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- connected components
def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one batch -> (member, root) stars of that batch's components; as many rows as nodes at most."""
    for b in batches:
        a, z = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        ids, back = np.unique(np.concatenate([a, z]), return_inverse=True)
        root = components(len(ids), back[: len(a)], back[len(a) :])
        out = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]])], names=["u", "v"])


def components(n: int, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' components, for edges a-z, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rz = root[a], root[z]
        open_ = ra != rz
        a, z, ra, rz = a[open_], z[open_], ra[open_], rz[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rz), np.minimum(ra, rz))
        while (root[root] != root).any():
            root = root[root]
    return root


def connected(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (u long, v long): (node, root), root the smallest id reachable.

    Large-star and small-star rounds (Kiveris et al. 2014). Every round is two joins on a node id over staged tables, so AQE
    splits a hub's rows; minima are pre-aggregated. No edges: an empty table. Self-loops, nulls and repeated edges do no harm.
    """
    spark = edges.sparkSession
    bound_batches(spark)
    scratch: list[str] = []
    e = edges.selectExpr("cast(u as long) u", "cast(v as long) v").where("u is not null and v is not null and u <> v")
    e = e.mapInArrow(_local_forest, "u long, v long")
    e = stage(e.selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), f"{name}-edges", scratch)
    mark = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u goes to the smallest id known at u.
        both = e.union(e.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = e.selectExpr("v u", "u v")  # u < v: the larger neighbours of u
        e2 = stage(big.join(low, "u").selectExpr("v u", "m v").where("u <> v").distinct(), f"{name}-large", scratch)
        # Small star: u and its smaller neighbours all go to the smallest of them.
        low2 = e2.groupBy("u").agg(F.min("v").alias("m"))
        moved = e2.join(low2, "u").selectExpr("v u", "m v").where("u <> v")
        made: list[str] = []
        e = stage(moved.union(low2.selectExpr("u", "m v")).distinct(), f"{name}-edges", made)
        before, was = was, mark(e)
        remove(spark, scratch)
        scratch += made
        if before == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.selectExpr("u node", "v root")
