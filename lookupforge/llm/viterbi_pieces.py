"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text maximises the sum of the pieces' scores. Positions are extended one character at a time; a
position's best predecessor lies at most ``longest`` characters back, so only that window of scores is kept. All surviving
backpointer paths start in the window: when they meet in one boundary, everything before it is final and its ids are
committed. Memory is bounded by the longest stretch without such a boundary, not by the text.

No piece holds a space sign after another character, so every path has a boundary before each run of them, whatever follows.
Texts are cut there first; every stretch goes through the stream, and its ids are remembered in a bounded table, which saves
work and decides nothing. Models with other pieces have whole texts streamed.

The model file is read directly (pieces, scores, kinds, dummy prefix, white-space rules, byte fallback). Its scores rank
pieces; where the file calls itself BPE they are used the same way, so ids are the best-scored segmentation, which is not
always what merging in rank order gives. Equal sums go to the longer last piece.

Defined cases: null and empty texts have no ids; very long texts, and texts without a space, need the window only; characters without a piece become byte pieces (or the unknown id); repeated
rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import IdTable, Words, bound_batches, byte_class, chunks, gather, mix, table

SPACE = "▁"
CACHE = 1_500_000
#: Longer words (bytes) are encoded each time.
LONG = 64
#: Characters that the stream takes in at once.
PORTION = 4096
UNKNOWN_PENALTY = 10.0
_UNSPACED = byte_class((0x20, 0x20))


# ---------------------------------------------------------------- model file
def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A model file: pieces with scores, and how texts are prepared."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.names: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy, self.trim, self.escape, self.unknown_id, charsmap = True, True, True, 0, b""
        for number, value in _fields(self.raw):
            if number == 1:
                one = dict(_fields(value))
                self.names.append(one.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, 1))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap:
            raise ValueError("a model with a character map needs its normaliser")
        # Kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
        self.unknown_id = self.kinds.index(2)
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k in (1, 4)}
        self.longest = max(map(len, self.ids), default=1)
        self.low = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == 1), default=0.0) - UNKNOWN_PENALTY
        #: The pieces as a tree, by character: (what may follow, id or -1, score).
        self.root: dict = {}
        for name, i in self.ids.items():
            at = self.root
            for c in name[:-1]:
                at = at.setdefault(c, ({}, -1, 0.0))[0]
            at[name[-1]] = (at.get(name[-1], ({},))[0], i, self.scores[i])
        self.bytes_at = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == 6}
        #: Whether the only pieces with a space sign after their first character are runs of it.
        self.words = all(SPACE not in n[1:] or set(n) == {SPACE} for n in self.ids)

    def prepare(self, text: str) -> str:
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.dummy:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; without the dummy prefix. Byte pieces that form no UTF-8 become U+FFFD."""
        out, pending = [], bytearray()
        for i in ids:
            if self.kinds[i] == 6:
                pending.append(int(self.names[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] != 3:
                out.append(self.names[i] if self.kinds[i] != 2 else " ⁇ ")
        out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


# ---------------------------------------------------------------- streaming search
class Stream:
    """Feed characters, take ids as they become final."""

    def __init__(self, pieces: Pieces):
        self.p, self.window = pieces, 0  # window: most characters ever kept
        self._start()

    def _start(self) -> None:
        self.chars = ""  # from the last committed boundary
        self.best, self.back, self.took = [0.0], [0], [-1]  # of each boundary since then: score, last boundary, piece or -1
        self.open: list[tuple] = []  # boundaries from which the characters so far begin a piece: place, score, where in the tree
        self._next_look = 2 * self.p.longest

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for a in range(0, len(text), PORTION):
            out += self._feed(text[a : a + PORTION])
        return out

    def _feed(self, text: str) -> list[int]:
        out, z, low, root = [], len(self.chars), self.p.low, self.p.root.get
        self.chars += text
        best, back, took, open_ = self.best, self.back, self.took, self.open
        for c in text:
            here = best[z]
            top, at, piece, still = here + low, z, -1, []  # a character that is no piece
            for a, score, node in open_:  # the longest first, so that it wins a tie
                if node := node.get(c):
                    more, i, own = node
                    if i >= 0 and ((own := own + score) > top or piece < 0 and own == top):
                        top, at, piece = own, a, i
                    if more:
                        still.append((a, score, more))
            if node := root(c):
                more, i, own = node
                if i >= 0 and ((own := own + here) > top or piece < 0 and own == top):
                    top, at, piece = own, z, i
                if more:
                    still.append((z, here, more))
            open_ = still
            z += 1
            best.append(top)
            back.append(at)
            took.append(piece)
            if z >= self._next_look:
                self.open = open_
                out += self._commit(z)
                best, back, took, open_, z = self.best, self.back, self.took, self.open, len(self.best) - 1
        self.open = open_
        self.window = max(self.window, z)
        return out

    def _commit(self, z: int) -> list[int]:
        """Ids before the boundary in which the paths of all boundaries that can still be extended meet."""
        self.window = max(self.window, z)
        live = {z, *(a for a, _, _ in self.open)}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(self.back[far])
        meet = live.pop()
        out = self._path(meet)
        if meet:
            low = self.best[meet]
            self.chars, self.best, self.back, self.took = self.chars[meet:], [b - low for b in self.best[meet:]], [max(0, b - meet) for b in self.back[meet:]], self.took[meet:]
            self.open = [(a - meet, score - low, node) for a, score, node in self.open]
        self._next_look = len(self.best) - 1 + self.p.longest
        return out

    def _path(self, end: int) -> list[int]:
        out: list[int] = []
        while end:
            a = self.back[end]
            if self.took[end] >= 0:
                out.append(self.took[end])
            elif self.p.bytes_at:
                out += [self.p.bytes_at[b] for b in reversed(self.chars[a:end].encode())]
            else:
                out.append(self.p.unknown_id)
            end = a
        return out[::-1]

    def close(self) -> list[int]:
        out = self._path(len(self.chars))
        self._start()
        return out


class Encoder:
    """Whole texts to little-endian uint32 ids. Every stretch of every text goes through the stream; ids of words met before
    are taken from a bounded table."""

    def __init__(self, pieces: Pieces):
        self.p, self.known, self.stream = pieces, IdTable(CACHE), Stream(pieces)
        # Every run of space signs starts a piece, and no other piece holds one: texts can be cut there.
        self.cuts = pieces.words and pieces.dummy and pieces.escape and not pieces.trim

    def one(self, text: str) -> list[int]:
        return self.stream.feed(text) + self.stream.close()

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts, and where each text's begin (one more entry at the end)."""
        if not self.cuts:
            ids = [np.array(self.one(self.p.prepare(data[a:z].tobytes().decode())), np.uint32) for a, z in zip(off, off[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        start, end, first, h = self._units(data, off)
        words, at, back = np.unique(h, return_index=True, return_inverse=True)
        self.known.settle()
        where, n = self.known.find(words)
        new = np.flatnonzero(where < 0)
        if len(new):
            a, z, dummy = start[at[new]], end[at[new]], np.isin(at[new], first[:-1])
            sign = lambda a, z, d: (SPACE if d else "") + data[a:z].tobytes().decode().replace(" ", SPACE)
            ids = [self.one(sign(*x)) for x in zip(a.tolist(), z.tolist(), dummy.tolist(), strict=True)]
            n[new] = np.fromiter(map(len, ids), np.int64, len(ids))
            where[new] = self.known.add(words[new], np.fromiter(itertools.chain.from_iterable(ids), np.uint32, n[new].sum()), n[new], z - a <= LONG)
        n = n[back]
        return gather(self.known.ids, where[back], n), np.append(0, np.cumsum(n))[first]

    @staticmethod
    def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A word with the spaces before it, or the spaces at a text's end: start, end, each text's first unit, hash."""
        w = Words(data, off, _UNSPACED, False)
        full = np.flatnonzero(np.diff(w.first))
        tail = np.where(np.diff(w.first) > 0, 0, off[:-1])
        tail[full] = w.end[w.first[full + 1] - 1]
        tail = np.stack([tail, off[1:]])[:, off[1:] > tail]
        end = np.concatenate([w.end, tail[1]])
        order = np.argsort(end, kind="stable")
        end = end[order]
        first = np.searchsorted(end, off, "right")
        start = np.append(0, end[:-1])
        h = w.span(start, end) if len(data) else np.zeros(0, np.uint64)
        begins = first[:-1][np.diff(first) > 0]
        h[begins] = mix(h[begins] + np.uint64(0x9E3779B97F4A7C15))
        return start, end, first, h


class Decoder:
    """Ids to UTF-8 bytes, a run of documents at a time, as one gather over the pieces' bytes."""

    def __init__(self, pieces: Pieces):
        raw = [b"" if k == 3 else bytes([int(n[3:5], 16)]) if k == 6 else " \u2047 ".encode() if k == 2 else n.replace(SPACE, " ").encode() for n, k in zip(pieces.names, pieces.kinds, strict=True)]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.dummy = pieces.dummy

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        out, upto = gather(self.data, self.start[ids], size).tobytes(), np.append(0, np.cumsum(size))[cut].tolist()
        texts = [out[a:z] for a, z in zip(upto, upto[1:])]
        return [t[1:] if t[:1] == b" " else t for t in texts] if self.dummy else texts


@functools.cache
def encoder(model: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that its table stays warm."""
    return Encoder(Pieces(model))


def _encode(batches: Iterator[pa.RecordBatch], model: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(model)
    dec = Decoder(enc.p)
    for b, data, off in chunks(batches, "text"):
        ids, cut = enc.encode(data, off)
        back = [x == data[a:z].tobytes() for x, a, z in zip(dec.decode(ids, cut), off[:-1].tolist(), off[1:].tolist(), strict=True)]
        raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * cut).tolist()
        each = [raw[a:z] for a, z in zip(at, at[1:])]
        cols = [b.column(0), pa.array(np.diff(cut), pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(back, pa.bool_())]
        out = ["key", "n_pieces", "ids_crc32", "round_trip"]
        if keep_ids:
            cols.append(pa.array(each, pa.binary()))
            out.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=out)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(key, n_pieces, ids_crc32, round_trip[, ids]): ids as little-endian unsigned 32-bit integers; round_trip says whether
    decoding them gives the text back byte by byte."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _encode(it, model, keep_ids), f"key {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids binary" * keep_ids)
    return out.withColumnRenamed("key", key)


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(model)
    for b in batches:
        texts = [None if x is None else pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])


def decode_documents(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from the ids that ``encode_documents`` gives; null ids stay null."""
    bound_batches(encoded.sparkSession)
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _decode(it, model), f"key {kind}, text string").withColumnRenamed("key", key)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_viterbi_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again for comparison."""
    return encode_documents(table(spark, sf_dir, "documents"), model_path(), keep_ids=False)
