"""Repeated passages by level-wise doubling.

A window of words can repeat only if the shorter windows inside it repeat. Level 0 takes windows of about a quarter of the
wanted length, and each level windows twice as long as the one before, up to the wanted length; only what survived a level is
asked about in the next. Below the wanted length a window is asked about by its minimiser (the shorter window of smallest hash
inside it, the same wherever the window stands), so that one position in ten or so is asked about at level 0. At the wanted
length the windows themselves are asked about; with ``extend`` the doubling goes on until no candidate survives, and every
span reports the longest window that repeats in it.

Asking is one shuffle: documents are packed (``CHUNK_BYTES`` of text a pack) and staged; each pack sends its distinct window
hashes in packed slices, by hash bucket, with a flag for those that stand twice in the pack. A bucket answers each slice with a
bitmap. A window that a third of all documents share reaches its bucket once per pack, never once per document. Answers are
staged and joined to the packs, whose texts travel compressed; packs without an answer don't come to the next level.
Full-length windows compare by two 64-bit hashes.

Defined cases: null texts have no words; texts shorter than a window lose nothing; a very long text makes a pack of its own;
repeated rows repeat each other's windows and are all cut; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import NONSPACE, Words, bound_batches, chunks, grams, remove, stage, table

WINDOW = 35
#: Text bytes for each hash bucket; buckets grow with the input, so that one bucket's hashes fit a task.
BUCKET_BYTES = 8 << 20

_ASK = "bucket long, pack long, hashes binary, twice binary, n int"
_REPLY = "level int, pack long, bucket long, n int, bits binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
    for b, data, off in chunks(batches, "text"):
        keys = b.column(0)
        cols = [pa.array([seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([press.compress(data.tobytes())], pa.binary()), pa.array([off.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["pack", "keys", "blob", "off"])
        seq += 1


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        a = np.minimum(a[: len(a) - k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (width - k)], a[width - k :]) if width > k else a


class Distinct:
    """Distinct keys of one level in one pack, in order of bucket and hash, cut into slices by bucket."""

    def __init__(self, keys: list[np.ndarray], buckets: int):
        bucket = ((keys[0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((*reversed(keys), bucket))
        new = np.ones(len(order), bool)
        if len(order):
            same = np.ones(len(order) - 1, bool)
            for k in keys:
                same &= k[order][1:] == k[order][:-1]
            new[1:] = ~same
        first = np.flatnonzero(new)
        self.which = np.empty(len(order), np.int64)  # of each input: its distinct key
        self.which[order] = np.cumsum(new) - 1
        self.keys = [k[order[first]] for k in keys]
        self.count = np.diff(np.append(first, len(order)))
        self.bucket = bucket[order[first]]

    def slices(self) -> Iterator[tuple[int, int, int]]:
        b, a = np.unique(self.bucket, return_index=True)
        yield from zip(b.tolist(), a.tolist(), np.append(a, len(self.bucket))[1:].tolist(), strict=True)

    def answered(self, replies: dict[int, tuple[int, bytes]]) -> np.ndarray:
        """For each input: whether its key repeats."""
        hit = np.zeros(len(self.bucket), bool)
        for b, a, z in self.slices():
            if b in replies:
                n, bits = replies[b]
                if n != z - a:
                    raise ValueError("the input changed between two reads")
                hit[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return hit[self.which]


def short_levels(window: int) -> list[int]:
    """Lengths of the levels below the wanted one."""
    out = [-(-window // 4)]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return [x for x in out if x < window]


class Pack:
    """One pack's words and, level by level, its candidate windows."""

    def __init__(self, blob: bytes, off: bytes, window: int, buckets: int):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        self.words = Words(data, np.frombuffer(off, "<i8"), NONSPACE, False)
        self.left, self.window, self.buckets = self.words.left(), window, buckets
        self.short = short_levels(window)

    def _minimisers(self, length: int, starts: np.ndarray) -> Distinct:
        if not len(starts):
            return Distinct([np.zeros(0, np.uint64)], self.buckets)
        g = grams(self.words.hash, length)
        d = Distinct([_sliding_min(g, self.window - length + 1)[starts]], self.buckets)
        # A key stands twice if two positions hold it, however many windows share one position.
        values, count = np.unique(g[self.left[: len(g)] >= length], return_counts=True)
        d.count = count[np.searchsorted(values, d.keys[0])]
        return d

    def level(self, k: int, replies: dict[int, dict]) -> tuple[int, np.ndarray, Distinct]:
        """(length, starts, distinct keys) of level k, given the answers to the levels before."""
        h, starts, length = self.words.hash, np.flatnonzero(self.left >= self.window), self.window
        for i, short in enumerate(self.short):
            d = self._minimisers(short, starts)
            if i == k:
                return short, starts, d
            starts = starts[d.answered(replies.get(i, {}))]
        for i in range(len(self.short), k + 1):
            d = Distinct([grams(h, length)[starts], grams(h, length, True)[starts]], self.buckets)
            if i == k:
                break
            again = starts[d.answered(replies.get(i, {}))]
            starts = again[np.isin(again + length, again) & (self.left[again] >= 2 * length)]
            length *= 2
        return length, starts, d

    def repeated(self, k: int, replies: dict[int, dict]) -> tuple[int, np.ndarray]:
        """(length, starts) of the windows of level k that repeat, at the wanted length or beyond."""
        length, starts, d = self.level(k, replies)
        return length, starts[d.answered(replies.get(k, {}))]


def _by_level(rows: list[dict] | None) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for r in rows or []:
        out.setdefault(r["level"], {})[r["bucket"]] = (r["n"], r["bits"])
    return out


def _ask(batches: Iterator[pa.RecordBatch], k: int, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            pack, blob, off = (b.column(c)[i].as_py() for c in (0, 1, 2))
            replies = _by_level(b.column(3)[i].as_py()) if k else {}
            _, _, d = Pack(blob, off, window, buckets).level(k, replies)
            rows = [(s, pack, np.concatenate([x[a:z] for x in d.keys]).tobytes(), np.packbits(d.count[a:z] > 1).tobytes(), z - a) for s, a, z in d.slices()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=[x.split()[0] for x in _ASK.split(", ")])


def _answer(t: pa.Table, k: int, width: int) -> pa.Table:
    """One bucket's slices answered; keys are of ``width`` hashes."""
    ns = t["n"].to_numpy()
    parts = [np.frombuffer(x, "<u8").reshape(width, -1) for x in t["hashes"].to_pylist()]
    keys = np.concatenate(parts, axis=1)
    hit = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["twice"].to_pylist(), ns, strict=True)]).astype(bool)
    order = np.lexsort(keys[::-1])
    same = (keys[:, order[1:]] == keys[:, order[:-1]]).all(axis=0)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cut = np.cumsum(ns)[:-1]
    rows = [(p, b, n, np.packbits(x).tobytes()) for p, b, n, x in zip(t["pack"].to_pylist(), t["bucket"].to_pylist(), ns.tolist(), np.split(hit, cut), strict=True) if x.any()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([pa.array([k] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=[x.split()[0] for x in _REPLY.split(", ")])


def _answerer(k: int, width: int):
    return lambda t: _answer(t, k, width)


def _cut(batches: Iterator[pa.RecordBatch], top: int, window: int, buckets: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            keys, blob, off = b.column(0).slice(i, 1).flatten(), b.column(1)[i].as_py(), b.column(2)[i].as_py()
            replies = _by_level(b.column(3)[i].as_py())
            p = Pack(blob, off, window, buckets)
            w, longest = p.words, np.zeros(len(p.words), np.int64)
            for k in range(len(p.short), top + 1):
                length, starts = p.repeated(k, replies)
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                longest[np.cumsum(edge[:-1]) > 0] = length
            gone, first = longest > 0, w.first
            removed = np.diff(np.append(0, np.cumsum(gone))[first])
            raw, digests, texts, spans = w.data.tobytes(), [], [], []
            for d in range(w.docs):
                words = raw[w.off[d] : w.off[d + 1]].split()
                mine = gone[first[d] : first[d + 1]]
                if removed[d]:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                    spans.append([{"start": a, "end": z, "window": int(longest[first[d] + a : first[d] + z].max())} for a, z in edge.reshape(-1, 2).tolist()])
                    words = list(itertools.compress(words, (~mine).tolist()))
                else:
                    spans.append([])
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(first)), pa.array(removed), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.int64())]))), pa.array(texts, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, extend: bool = False, keep_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, spans, kept): words covered by a window of ``window`` words that stands anywhere
    else are removed. ``spans`` are the removed word ranges, with the longest repeating window found in each (with
    ``extend``; else ``window``). ``kept`` is null without ``keep_text``."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    scratch: list[str] = []
    packs = stage(rows.mapInArrow(_packs, f"pack long, keys array<{kind}>, blob binary, off binary"), "packs", scratch)
    replies: DataFrame | None = None

    def answered(how: str, *columns: str) -> DataFrame:
        by_pack = replies.groupBy("pack").agg(F.collect_list(F.struct("level", "bucket", "n", "bits")).alias("replies"))
        return packs.select("pack", *columns).join(by_pack.hint("merge"), "pack", how)

    k, whole = 0, len(short_levels(window))
    while True:
        told = answered("inner", "blob", "off").select("pack", "blob", "off", "replies") if k else packs.select("pack", "blob", "off")
        asked = told.mapInArrow(lambda it, k=k: _ask(it, k, window, buckets), _ASK)
        new = stage(asked.groupBy("bucket").applyInArrow(_answerer(k, 1 if k < whole else 2), _REPLY), f"repeats-{k}", scratch)
        replies = new if replies is None else replies.union(new)
        if k >= whole and not extend or not new.limit(1).count():
            break
        k += 1
    out = answered("left", "keys", "blob", "off").select("keys", "blob", "off", "replies").mapInArrow(lambda it: _cut(it, k, window, buckets, keep_text), f"key {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long,window:long>>, kept string")
    out = stage(out.withColumnRenamed("key", key), "without-repeats")
    remove(spark, scratch)
    return out


def op8_substring_doubling(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated 35-word windows."""
    found = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
