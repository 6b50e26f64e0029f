"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each segment (about ``CHUNK_BYTES`` of text) stores its terms in order, each term's
posting list of word positions, and the word range of each document. Segments are written to the shared folder. Phrases are
sent to all segments in blocks of bounded size. In a segment, each phrase starts from the postings of its rarest term,
adjusted by the term's offset, and is intersected with the next rarest lists until no term is left; proximity search keeps
the starts within whose span every term occurs. No posting is shuffled: hits stay with their segment.

Terms are 64-bit hashes of words. A phrase's terms must all agree in order, so a false hit needs a hash collision of two
words inside a text that otherwise repeats the phrase.

Defined cases: null texts have no words and are never contaminated; a very long text makes a segment of its own; items without words are ignored; repeated rows, and
items that repeat an id, stay and count as one item id; items without an id mark words like others, but no list names them
(and their proximity matches have a null item); empty tables give empty or clean results; other columns,
whatever their names, are ignored or kept as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookupforge.llm.common import ALNUM, Words, bound_batches, chunks, fresh, new_dir, remove, stage, table, tidy

WINDOW = 13
#: Phrases sent to the tasks at once: at most this many terms (8 bytes each).
BLOCK_TERMS = 1 << 20

_SEGMENT = "terms binary, lists binary, positions binary, doc_ids array<{k}>, doc_start binary, n_postings long"


# ---------------------------------------------------------------- index
def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in chunks(batches, "text"):
        w = Words(data, off, ALNUM, True)
        order = np.argsort(w.hash, kind="stable")
        sorted_ = w.hash[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(w) else np.zeros(0, np.int64)
        # Positions as steps within a term's list: small numbers, which compress.
        step = np.diff(order, prepend=0)
        step[first] = order[first]
        row = [sorted_[first].tobytes(), first.astype("<i4").tobytes(), step.astype("<i4").tobytes(), None, w.first.astype("<i4").tobytes(), len(w)]
        cols = [pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row]
        ids = b.column(0)
        cols[3] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SEGMENT.split(", ")])


def build_index(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the segments of ``docs`` to ``out`` and return them."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(_build, _SEGMENT.format(k=kind))
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(out)
    return spark.read.schema(made.schema).parquet(out)


class Segment:
    """One segment's postings, ready for lookups."""

    def __init__(self, terms: bytes, lists: bytes, positions: bytes, doc_start: bytes):
        self.terms = np.frombuffer(terms, "<u8")
        first = np.frombuffer(lists, "<i4").astype(np.int64)
        step = np.frombuffer(positions, "<i4").astype(np.int64)
        self.doc_start = np.frombuffer(doc_start, "<i4").astype(np.int64)
        self.n = len(step)
        self.bounds = np.append(first, self.n)
        run = np.cumsum(step)
        before = np.zeros(len(first), np.int64)
        before[1:] = run[first[1:] - 1]
        self.positions = run - np.repeat(before, np.diff(self.bounds))  # within each list
        self.keys: np.ndarray | None = None

    def lists_of(self, terms: np.ndarray) -> np.ndarray:
        """The list number of each term, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, lists: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether the list holds the position."""
        if self.keys is None:  # lists stand in order, positions in order within them
            self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds)) * (self.n + 1) + self.positions
        want = lists * (self.n + 1) + positions
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (positions >= 0) & (positions < self.n)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, positions, "right") - 1

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, start) of every exact occurrence of phrases of one length."""
        lists = self.lists_of(phrases)
        live = np.flatnonzero((lists >= 0).all(axis=1))
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists, size = lists[live], np.diff(self.bounds)
        order = np.argsort(size[lists], axis=1, kind="stable")  # rarest first
        rows = np.arange(len(live))
        anchor = lists[rows, order[:, 0]]
        n = size[anchor]
        who = np.repeat(rows, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[self.bounds[anchor][who] + nth] - order[who, 0]
        for k in range(1, phrases.shape[1]):
            ok = self.has(lists[who, order[who, k]], start + order[who, k])
            who, start = who[ok], start[ok]
        last = start + phrases.shape[1] - 1
        ok = (start >= 0) & (self.doc_of(start) == self.doc_of(last))
        return live[who[ok]], start[ok]

    def near(self, phrase: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """(start, end) of the shortest spans, at most ``len(phrase) + slop`` words of one document, that hold the phrase's
        terms in any order, each as often as the phrase does; one span for each place of the rarest term."""
        terms, need = np.unique(phrase, return_counts=True)
        lists = self.lists_of(terms)
        if (lists < 0).any():
            return []
        places = [self.positions[self.bounds[i] : self.bounds[i + 1]] for i in lists]
        rare = min(range(len(terms)), key=lambda i: len(places[i]))
        reach, found = len(phrase) + slop, set()
        for p in places[rare].tolist():
            d = int(self.doc_of(np.array([p]))[0])
            low, high = max(p - reach + 1, int(self.doc_start[d])), min(p + reach, int(self.doc_start[d + 1]))
            near = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in places]
            at = np.concatenate(near)
            what = np.repeat(np.arange(len(near)), [len(x) for x in near])
            o = np.argsort(at)
            at, what, count, missing, a, best = at[o], what[o], np.zeros(len(near), int), int(need.sum()), 0, None
            for z in range(len(at)):  # the usual two-pointer window over at most 2 * reach places
                count[what[z]] += 1
                missing -= count[what[z]] <= need[what[z]]
                while missing == 0:
                    if at[a] <= p <= at[z] and at[z] - at[a] < reach and (best is None or at[z] + 1 - at[a] < best[1] - best[0]):
                        best = (int(at[a]), int(at[z]) + 1)
                    missing += count[what[a]] <= need[what[a]]
                    count[what[a]] -= 1
                    a += 1
            if best:
                found.add(best)
        return sorted(found)


# ---------------------------------------------------------------- phrases
def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), off, ALNUM, True)
    return [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(raw))]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    if not len(words):
        return np.zeros((0, size), np.uint64)
    return np.lib.stride_tricks.sliding_window_view(words, min(size, len(words)))


def phrase_blocks(items: DataFrame, key: str, text: str, size: int) -> Iterator[dict[int, tuple[np.ndarray, list[str]]]]:
    """Blocks of the items' windows: length -> (distinct phrases, the item ids of each, comma-joined;
    items without an id add none). Items come to the driver a few at a time, and no block holds more than ``BLOCK_TERMS``
    terms (or one item)."""
    held, terms = defaultdict(dict), 0
    for row in items.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").toLocalIterator():
        w = windows(word_hashes([row.text])[0], size)
        for phrase in w:
            held[w.shape[1]].setdefault(phrase.tobytes(), set()).update([] if row.id is None else [row.id])
        terms += w.size
        if terms >= BLOCK_TERMS:
            yield _packed(held)
            held, terms = defaultdict(dict), 0
    yield _packed(held)


def _packed(held: dict) -> dict[int, tuple[np.ndarray, list]]:
    return {n: (np.frombuffer(b"".join(d), np.uint64).reshape(-1, n), [sorted(x) for x in d.values()]) for n, d in held.items()}


# ---------------------------------------------------------------- search
def _mark(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[pa.RecordBatch]:
    """Add one block's hits to a segment's state: covered words, and the item ids of each document."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            terms, lists, positions, doc_start, covered, items = (row.column(k)[0].as_py() for k in (0, 1, 2, 4, 6, 7))
            seg = Segment(terms, lists, positions, doc_start)
            hit = np.frombuffer(zlib.decompress(covered), np.uint8).astype(bool) if covered else np.zeros(seg.n, bool)
            found: dict[int, set[str]] = defaultdict(set)
            for at, names in items or []:
                found[at].update(names)
            for size, (phrases, ids) in block.items():
                who, start = seg.exact(phrases)
                edge = np.zeros(seg.n + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                hit |= np.cumsum(edge[:-1]) > 0
                for d, p in set(zip(seg.doc_of(start).tolist(), who.tolist(), strict=True)):
                    found[d].update(ids[p])
            state = pa.array([[(d, sorted(x)) for d, x in sorted(found.items())]], pa.map_(pa.int32(), pa.list_(pa.string())))
            hit = pa.array([zlib.compress(hit.tobytes(), 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*row.columns[:6], hit, state], names=[*row.schema.names[:6], "covered", "items"])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids, doc_start, covered, items = batch.column(3).slice(i, 1).flatten(), *(batch.column(k)[i].as_py() for k in (4, 6, 7))
            first = np.frombuffer(doc_start, "<i4").astype(np.int64)
            hit = np.frombuffer(zlib.decompress(covered), np.uint8) if covered else np.zeros(first[-1], np.uint8)
            n_hit = np.diff(np.append(0, np.cumsum(hit, dtype=np.int64))[first])
            found = dict(items or [])
            names = [found.get(d, []) for d in range(len(ids))]
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            spans: list[list] = [[] for _ in names]
            cut = set(first.tolist())
            for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                points = [a, *sorted(c for c in cut if a < c < z), z] if len(cut) < z - a else [a, *(c for c in range(a + 1, z) if c in cut), z]
                for x, y in zip(points, points[1:]):
                    d = int(np.searchsorted(first, x, "right")) - 1
                    spans[d].append({"start": x - int(first[d]), "end": y - int(first[d])})
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(n_hit), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["key", "n_words", "n_hit", "items", "spans"])
    tidy()


def find_phrases(index: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, items, spans) of every document of the index: words inside an exact occurrence of a window of
    ``size`` words of an item (of the whole item, where it is shorter), the item ids with occurrences, sorted as strings,
    and the hit word ranges."""
    spark = index.sparkSession
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    state = _SEGMENT.format(k=kind) + ", covered binary, items map<int,array<string>>"
    marked = index.withColumn("covered", F.lit(None).cast("binary")).withColumn("items", F.lit(None).cast("map<int,array<string>>"))
    blocks = phrase_blocks(items, item_key, text, size)
    block = next(blocks)
    scratch: list[str] = []
    for later in blocks:  # a block is out of memory again before the next one goes out
        sent, done = spark.sparkContext.broadcast(block), scratch
        scratch = []
        marked = stage(marked.mapInArrow(lambda it, s=sent: _mark(it, s.value), state), "marked", scratch)
        sent.destroy()
        remove(spark, done)
        block = later
    last = spark.sparkContext.broadcast(block)  # at most BLOCK_TERMS terms
    return marked.mapInArrow(lambda it: _report(_mark(it, last.value)), f"key {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def _near(batches: Iterator[pa.RecordBatch], phrases: list[tuple[str, np.ndarray]], slop: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            seg = Segment(*(batch.column(k)[i].as_py() for k in (0, 1, 2, 4)))
            ids, rows = batch.column(3).slice(i, 1).flatten(), []
            for name, phrase in phrases:
                for a, z in seg.near(phrase, slop) if len(phrase) else []:
                    d = int(seg.doc_of(np.array([a]))[0])
                    rows.append((d, name, a - int(seg.doc_start[d]), z - int(seg.doc_start[d])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["key", "item", "start", "end"])


def find_near(index: DataFrame, items: DataFrame, slop: int, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, start, end): proximity matches of whole items, all words within their number plus ``slop`` words."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"key {kind}, item string, start long, end long"
    out, block, terms = None, [], 0

    def more(out: DataFrame | None, block: list) -> DataFrame:
        sent = index.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_TERMS terms
        one = stage(index.mapInArrow(lambda it: _near(it, sent.value, slop), schema), "near")
        sent.destroy()
        return one if out is None else out.union(one)

    for row in items.select(F.col(item_key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null").toLocalIterator():
        block.append((row.id, word_hashes([row.text])[0]))
        terms += len(block[-1][1])
        if terms >= BLOCK_TERMS:
            out, block, terms = more(out, block), [], 0
    return more(out, block) if block or out is None else out


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without contamination, with their own columns. Keys go with the text's hash, so that rows that share
    an id are judged each by its own text; of a key and text that repeats, all rows share the verdict."""
    own = fresh(docs, "own")
    keyed = docs.withColumn(own, F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(text)))
    postings = new_dir(docs.sparkSession, "postings")
    index = build_index(keyed.select(F.col(own).alias("own"), F.col(text).alias("text")), postings, "own")
    bad = stage(find_phrases(index, items).where(contaminated()).select(F.col("key").alias(own)).distinct(), "contaminated")
    remove(docs.sparkSession, [postings])
    return keyed.join(bad, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document with the benchmark's 13-word windows."""
    postings = new_dir(spark, "postings")
    index = build_index(table(spark, sf_dir, "documents"), postings)
    found = find_phrases(index, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    out = found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))
    out = stage(out, "contamination")
    remove(spark, [postings])
    return out
