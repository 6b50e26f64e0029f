"""Token-id files with a minimal perfect hash index.

Documents are ranged and sorted by key, encoded, and written as shards of about ``SHARD_IDS`` ids: one Parquet row holds a
shard's raw payload (little-endian unsigned 32-bit ids, documents one after the other, each ended by the end id; pages are
zstd-compressed by Parquet) and its index. The index is a minimal perfect hash over the shard's documents, each known by its
key and its number among the shard's documents of that key: levels of bit arrays in which a document's bit is set where no
other one of the level fell; its slot is the rank of its bit. A slot stores a 32-bit fingerprint, the offset and the number of
the document's ids. Whoever reads a document gets its place and length from its slot: by key (``read_keys``), or for all keys
that the shards list (``read_documents``). Readers never scan ids to find a document.

Texts go to the tokenizer in distinct pre-token pieces: byte-level BPE never crosses a piece, so a document's ids are the
pieces' ids in order. Pieces are cut here only for tokenizers that cut by the common byte-level rule, and only in texts of
plain Latin characters, where both cutters are known to agree; any other text, and any that spells a special token, goes to
the library whole.

Defined cases: null texts encode to the end id alone; null keys sort first and can be read back, but not by key; documents of
a repeated key lie side by side, in no set order, perhaps in several shards, and are returned together; a very long text is
one document of one shard, which may thus pass ``SHARD_IDS``; an empty table writes no shard and reads back empty; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lookupforge.llm.common import IdTable, Words, bound_batches, byte_class, gather, mix, new_dir, table, tidy

#: Ids of a shard, but for its last document.
SHARD_IDS = 1 << 17
#: Key ranges handed to the Parquet reader.
RANGES = 256
CACHE_WORDS = 1_500_000
#: Longer words (bytes) are encoded each time.
LONG = 64
CACHE_PIECES = 100_000
#: Texts encoded at once.
RUN = 512
END_ID = 2
GAMMA = 1.5

#: Plain Latin text (no digits or signs that cutters class differently, no odd white space), and its pieces. Fixed values.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

#: A space before white space; texts that have one are cut into pieces throughout.
_UNSPACED = byte_class((0x20, 0x20))
_RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")


_SIGNS = ".,;:!?"
_SIGN = ~byte_class(*[(ord(c), ord(c)) for c in _SIGNS])
_LETTER = ~byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC9))
#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from U+0100 on.
_ALPHABET = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)], range(256, 512)))


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to Latin letters (two-byte ones from U+00C0 on, without the two arithmetic signs there)."""
    out = _LETTER[data]
    sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    out[sign] = False
    return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that its cache stays warm."""
    return Encoder(path)


class Encoder:
    """Texts to little-endian uint32 ids, with a bounded cache of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        cut = made["pre_tokenizer"] or {}
        self.known = made["normalizer"] is None and made["model"]["type"] == "BPE" and made["post_processor"] is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.spaced = IdTable(CACHE_WORDS)  # what stands between two single spaces
        self.pieces: dict[str, bytes] = {}
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        self.signs = np.zeros(256, np.uint32)
        for c in _SIGNS:
            self.signs[ord(c)] = self.tok.encode(c, add_special_tokens=False).ids[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, new: list[str]) -> list[bytes]:
        """Many strings without white space but a first space, one a line of a longer text: a line end before them is a
        piece of its own."""
        if len(self.line) != 1:
            return self._whole(new)
        out: list[bytes] = []
        blocks = [new[a : a + 512] for a in range(0, len(new), 512)]
        for block, e in zip(blocks, self.tok.encode_batch_fast(["\n".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.line[0]) * 4).tolist(), 4 * len(ids)]
            if len(ends) != len(block):
                out += self._whole(block)
                continue
            raw, a = ids.tobytes(), 0
            for z in ends:
                out.append(raw[a:z])
                a = z + 4
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Plain texts by their pieces."""
        cut = [_PIECE.findall(t) for t in texts]
        new = list({p for c in cut for p in c if p not in self.pieces})
        self.pieces.update(zip(new, self._whole(new), strict=True))
        get = self.pieces.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _new(self, w: Words, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words ``at`` of the run (of hashes ``h``) start in the table, and how many they are.

        A word of letters, with a sign at its end or not, is two pieces at most: the letters go to the model by themselves,
        which skips the cutting, and are looked up without their sign first.
        """
        begin, end, start, n = w.start[at], w.end[at], np.full(len(at), -1), np.zeros(len(at), np.int64)
        first = np.isin(at, w.first[:-1])
        upto = np.append(0, np.cumsum(_letters(w.data)))
        sign = _SIGN[w.data[end - 1]] & (end - begin > 1)
        stop = end - sign
        fast = ~first & (upto[stop] - upto[begin] == stop - begin) & (end - begin <= LONG)
        if fast.any():
            stems, one, back = np.unique(w.span(begin[fast], stop[fast]), return_index=True, return_inverse=True)
            s_start, s_n = self.spaced.find(stems)
            lack = np.flatnonzero(s_start < 0)
            if len(lack):
                a, z = begin[fast][one[lack]].tolist(), stop[fast][one[lack]].tolist()
                raw, tokenize = w.data.tobytes().decode("latin-1"), self.tok.model.tokenize
                own = [x if x.isascii() else x.translate(_ALPHABET) for x in map(raw.__getitem__, map(slice, a, z))]
                ids = [[t.id for t in tokenize("\u0120" + x)] for x in own]
                s_n[lack] = np.fromiter(map(len, ids), np.int64, len(ids))
                s_start[lack] = self.spaced.add(stems[lack], np.array([x for i in ids for x in i], np.uint32), s_n[lack], np.ones(len(lack), bool))
            start[fast], n[fast] = s_start[back], s_n[back]
            signed = np.flatnonzero(fast & sign)
            if len(signed):
                many = n[signed] + 1
                ids = np.repeat(self.signs[w.data[end[signed] - 1]], many)
                ids[np.delete(np.arange(len(ids)), np.cumsum(many) - 1)] = gather(self.spaced.ids, start[signed], n[signed])
                start[signed], n[signed] = self.spaced.add(h[signed], ids, many, np.ones(len(signed), bool)), many
        slow = np.flatnonzero(~fast)
        if len(slow):
            text = [w.data[a:z].tobytes().decode() for a, z in zip(begin[slow].tolist(), end[slow].tolist())]
            alone = first[slow].tolist()
            odd = [i for i, t in enumerate(text) if alone[i] or not t.split() or len(t.split()[0]) < len(t)]
            ids = [b""] * len(text)
            for i, x in zip(odd, self._cut([text[i] if alone[i] else " " + text[i] for i in odd]), strict=True):
                ids[i] = x
            plain = sorted(set(range(len(text))) - set(odd))
            for i, x in zip(plain, self._lines([" " + text[i] for i in plain]), strict=True):
                ids[i] = x
            n[slow] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            start[slow] = self.spaced.add(h[slow], np.frombuffer(b"".join(ids), "<u4"), n[slow], end[slow] - begin[slow] <= LONG)
        return start, n

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Plain texts whose words stand one space apart: each distinct word of the run is looked up once, by its hash, and
        the texts' ids are then one gather. A text's first word has no space before it, so it is another word."""
        raw = [t.encode() for t in texts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), _UNSPACED, False)
        h = w.hash
        h[w.first[:-1]] = mix(h[w.first[:-1]] + np.uint64(0x9E3779B97F4A7C15))
        words, at, back = np.unique(h, return_index=True, return_inverse=True)
        self.spaced.settle()
        start, n = self.spaced.find(words)
        new = np.flatnonzero(start < 0)
        if len(new):
            start[new], n[new] = self._new(w, words[new], at[new])
        whole = gather(self.spaced.ids, start[back], n[back]).astype("<u4", copy=False).tobytes()
        cut = np.append(0, 4 * np.cumsum(n[back]))[w.first].tolist()
        return [whole[a:z] for a, z in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """A space before a character that isn't white space starts a piece, so single-spaced texts split there."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        if not self.known:
            return self._whole(texts)
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        kind = [2 if not ok else 1 if not t or t[0] == " " or t[-1] == " " or any(x in t for x in _RUNS) else 0 for t, ok in zip(texts, plain, strict=True)]
        done = [iter(f([t for t, k in zip(texts, kind, strict=True) if k == want])) for want, f in enumerate((self._spaced, self._cut, self._whole))]
        return [next(done[k]) for k in kind]


# ---------------------------------------------------------------- minimal perfect hash
def key_hash(keys: list) -> np.ndarray:
    """64-bit hashes of integers or strings, the same in every process; nulls have one of their own."""
    own = [k for k in keys if k is not None]
    if own and isinstance(own[0], int):
        h = np.array(own, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    else:
        raw = [str(k).encode() for k in own]
        h = np.array([zlib.crc32(r) | zlib.crc32(r, 0x5BD1E995) << 32 for r in raw], np.uint64) + np.array([len(r) for r in raw], np.uint64)
    out = np.full(len(keys), 0xA0761D6478BD642F, np.uint64)
    out[[k is not None for k in keys]] = mix(h)
    return out


def document_hash(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Of a shard's ``nth`` document (from 0) of each key hash."""
    return mix(keys + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _nth(keys: list) -> np.ndarray:
    """How many documents of the same key stand before each, in sorted keys."""
    new = np.array([i == 0 or k != keys[i - 1] for i, k in enumerate(keys)], bool)
    first = np.flatnonzero(new)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def build_mph(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the levels' bits (one array) and the slot of each of the distinct hashes."""
    sizes, bits, slot, rest, base = [], [], np.full(len(h), -1), np.arange(len(h)), 0
    while len(rest):
        size = max(8, int(len(rest) * GAMMA) + 7 & ~7)
        at = _place(h[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        b = np.zeros(size, bool)
        b[at[alone]] = True
        slot[rest[alone]] = base + at[alone]
        sizes.append(size)
        bits.append(b)
        base += size
        rest = rest[~alone]
        if len(sizes) > 200:
            raise ValueError("two keys of a shard have one 64-bit hash")
    all_bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(all_bits) - 1
    return sizes, all_bits, rank[slot] if len(h) else slot


def find_mph(h: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each hash; of hashes that were not built in, -1 or any slot (compare the fingerprint)."""
    rank, out, base = np.cumsum(bits) - 1, np.full(len(h), -1), 0
    rest = np.arange(len(h))
    for level, size in enumerate(sizes):
        at = base + _place(h[rest], level, size)
        hit = bits[at]
        out[rest[hit]] = rank[at[hit]]
        rest, base = rest[~hit], base + size
    return out


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype("<u4") ^ h.astype("<u4")


# ---------------------------------------------------------------- files
_SHARD = "part int, seq int, least {k}, most {k}, n_docs long, n_ids long, payload binary, keys array<{k}>, level_sizes array<int>, bits binary, slots binary"
_SLOT = np.dtype([("print", "<u4"), ("ids", "<u4"), ("first", "<u8")])
#: A page for each shard's row, so that the pages' key ranges lead to one shard; payloads have no dictionary.
_FORMAT = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def _shard(part: int, seq: int, keys: list, ids: list[bytes], key_type: pa.DataType) -> pa.RecordBatch:
    n = np.array([len(x) // 4 for x in ids], np.int64)
    h = document_hash(key_hash(keys), _nth(keys))
    sizes, bits, slot = build_mph(h)
    slots = np.zeros(len(keys), _SLOT)
    slots["print"][slot], slots["ids"][slot], slots["first"][slot] = fingerprint(h), n, np.cumsum(n) - n
    real = [k for k in keys if k is not None]
    row = [part, seq, real[0] if real else None, real[-1] if real else None, len(keys), int(n.sum()), b"".join(ids), keys, sizes, np.packbits(bits).tobytes(), slots.tobytes()]
    kinds = [pa.int32(), pa.int32(), key_type, key_type, pa.int64(), pa.int64(), pa.binary(), pa.list_(key_type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _SHARD.split(", ")])


class Index:
    """A shard's index: levels' bits and slots."""

    def __init__(self, sizes: list[int], bits: bytes, slots: bytes):
        self.sizes, self.slots = sizes, np.frombuffer(slots, _SLOT)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[: sum(sizes)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each document hash, and whether its fingerprint agrees."""
        at = find_mph(h, self.sizes, self.bits)
        found = at >= 0
        found[found] = self.slots["print"][at[found]] == fingerprint(h[found])
        return self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(h), _SLOT), found


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    enc, end, part, seq = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
    keys, ids, size, kind = [], [], 0, None
    for b in batches:
        kind = b.schema.field(0).type
        texts = b.column(1).to_pylist()
        for a in range(0, len(texts), RUN):
            for k, x in zip(b.column(0).slice(a, RUN).to_pylist(), enc.encode([t or "" for t in texts[a : a + RUN]]), strict=True):
                if size >= shard_ids * 4:  # a key's documents may go on in the next shard
                    yield _shard(part, seq, keys, ids, kind)
                    keys, ids, size, seq = [], [], 0, seq + 1
                keys.append(k)
                ids.append(x + end)
                size += len(ids[-1])
    if keys:
        yield _shard(part, seq, keys, ids, kind)
    tidy()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write the shards to ``out``, in ascending order of the key. Documents of one key, or of none, go
    by a hash of their text, so that a key with very many is dealt over several tasks."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("salt", F.xxhash64("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ranged = rows.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("key", "text")
    ranged.mapInArrow(lambda it: _write(it, tokenizer, end_id, shard_ids), _SHARD.format(k=kind)).write.options(**_FORMAT).parquet(out)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of each shard: its slot says where its ids are."""
    for batch in batches:
        for i in range(len(batch)):
            part, seq, payload, keys, sizes, bits, slots = (c[i].as_py() for c in batch.columns)
            slot, found = Index(sizes, bits, slots).find(document_hash(key_hash(keys), _nth(keys)))
            if not found.all():
                raise ValueError("a stored fingerprint differs")
            start, n, view, size = slot["first"].astype(np.int64), slot["ids"].astype(np.int64), memoryview(payload), len(keys)
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(start.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * size, pa.int32()), pa.array([seq] * size, pa.int32()), pa.array(keys, batch.column(3).type.value_type), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "key", "local", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all documents before it."""
    shards = read_shards(spark, out)
    kind = shards.schema["least"].dataType.simpleString()
    docs = shards.select("part", "seq", "payload", "keys", "level_sizes", "bits", "slots").mapInArrow(_documents, f"part int, seq int, key {kind}, local long, n_tokens long, ids_crc32 long")
    # Starts of the parts from the parts' totals (a few rows for each file), then of the shards within each part.
    heads = shards.select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = heads.withColumn("within", within).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select(F.col("key").alias(key), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _lookup(batches: Iterator[pa.RecordBatch], wanted: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            least, most, part, seq, payload, sizes, bits, slots = (c[i].as_py() for c in batch.columns)
            near = [] if least is None else wanted[bisect.bisect_left(wanted, least) : bisect.bisect_right(wanted, most)]
            index, h, k, keys, ids = Index(sizes, bits, slots), key_hash(near), 0, [], []
            while near:  # a key's documents are numbered from 0 on in each shard
                slot, found = index.find(document_hash(h, np.full(len(near), k)))
                near, h, k = [x for x, f in zip(near, found.tolist(), strict=True) if f], h[found], k + 1
                keys += near
                ids += [np.frombuffer(payload, "<u4", int(x["ids"]), 4 * int(x["first"])).astype(np.int64).tolist() for x in slot[found]]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(ids, pa.list_(pa.int64())), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32())], names=["key", "ids", "part", "seq"])


def read_keys(spark: SparkSession, out: str, wanted: list, key: str = "doc_id") -> DataFrame:
    """(key, ids, part, seq) of every document of the given keys.

    The keys' ranges go to the Parquet reader, which skips the files, row groups and pages of other shards: a key reads the
    page of its shard (``SHARD_IDS`` ids), one slot and one slice. Beyond ``RANGES`` keys, only the range from the smallest to
    the largest is left to the reader. Absent keys give no row, but for a fingerprint that agrees by chance (1 in 2**32).
    """
    shards = read_shards(spark, out)
    kind = shards.schema["least"].dataType.simpleString()
    wanted = sorted({k for k in wanted if k is not None})
    if not wanted:
        return spark.createDataFrame([], f"{key} {kind}, ids array<long>, part int, seq int")
    ranges = [(k, k) for k in wanted] if len(wanted) <= RANGES else [(wanted[0], wanted[-1])]
    near = [(F.col("least") <= F.lit(z)) & (F.col("most") >= F.lit(a)) for a, z in ranges]
    while len(near) > 1:  # a balanced tree of alternatives
        near = [x if y is None else x | y for x, y in zip(near[::2], [*near[1::2], None])]
    rows = shards.where(near[0]).select("least", "most", "part", "seq", "payload", "level_sizes", "bits", "slots")
    return rows.mapInArrow(lambda it: _lookup(it, wanted), f"key {kind}, ids array<long>, part int, seq int").withColumnRenamed("key", key)


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    """All documents' ids, written and read back."""
    import public_tokenizers

    out = new_dir(spark, "token-shards")
    write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, out)
