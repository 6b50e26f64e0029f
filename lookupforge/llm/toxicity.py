"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo ``2**BITS``, of its words, its words' stems (their first bytes), its pairs
of neighbours and its pairs with one word between. The model learns with per-coordinate rates and L1, so most weights are exactly zero; what is left is a table
of at most ``2**BITS`` weights, which bounds the broadcast. It is fitted on at most ``FIT_ROWS`` labelled rows, chosen by the
hash of their id, and on at most ``FIT_BYTES`` of their features, none of them held out; every text is scored, whole, also a
very long one (its features are distinct: a megabyte at most).

Defined cases: null and empty texts have no feature and get the model's base rate; documents without a label are scored;
repeated labels of one document count once (toxic if any says so), null labels not at all; of rows that share a labelled id,
one text (the first in order) is learnt from; without labels of both kinds, or without documents to learn from, every score
is 0.0; an empty table gives an empty result; repeated rows stay; a score of exactly the threshold is toxic; other columns,
whatever their names, are ignored or kept as they are. A row is held out when crc32 of its id as text is divisible by 5 (null ids: true).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import ALNUM, Words, bound_batches, chunks, fresh, mix, table

BITS = 18
FIT_ROWS, FIT_BYTES = 12_000, 256 << 20
EPOCHS = 4
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0


def features(data: np.ndarray, off: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and sorted, of a run of texts; with ``only``, a table of features, no others."""
    w = Words(data, off, ALNUM, True)
    left, mask = w.left(), np.uint64((1 << BITS) - 1)
    doc, feat = [w.doc], [mix(w.hash ^ np.uint64(1)) & mask]
    for size in STEMS:
        at = np.flatnonzero(w.end - w.start > size)
        doc.append(w.doc[at])
        feat.append(mix(w.span(w.start[at], w.start[at] + size) ^ np.uint64(size)) & mask)
    for gap in (1, 2):
        at = np.flatnonzero(left > gap)
        doc.append(w.doc[at])
        feat.append(mix(w.hash[at] * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + gap] + np.uint64(gap)) & mask)
    if only is not None:
        hit = [only[f] for f in feat]
        doc, feat = [d[h] for d, h in zip(doc, hit, strict=True)], [f[h] for f, h in zip(feat, hit, strict=True)]
    key = np.unique(np.concatenate(doc).astype(np.int64) << BITS | np.concatenate(feat).astype(np.int64))
    return key >> BITS, key & int(mask)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows in the given order: indices and weights that are not zero, and the bias."""
    dim = 1 << BITS
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.0
    base = float(np.log(rate / (1 - rate))) if len(labels) else 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            i = np.append(row, dim)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(base + w.sum(), -30, 30)))
            g = p - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(dim + 1))
    kept = np.flatnonzero(w[:dim])
    return kept.astype(np.int32), w[kept], base + float(w[dim])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, off in chunks(batches, "text"):
        doc, feat = features(data, off)
        cut = np.searchsorted(doc, np.arange(len(b) + 1))
        feat = feat.astype("<i4")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([feat[cut[i] : cut[i + 1]].tobytes() for i in range(len(b))], pa.binary())], names=["id", "toxic", "features"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` come in the order in which rows are chosen; those beyond ``FIT_BYTES`` are left out."""
    rows, size = [], 0
    for i, y, f in ((str(i), y, f) for b in batches for i, y, f in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        size += len(f)
        if size > FIT_BYTES:
            break
        rows.append((i, y, f))
    rows.sort()
    order = np.random.default_rng(7).permutation(len(rows))
    labels = np.array([rows[i][1] for i in order], float)
    if not len(labels) or labels.min() == labels.max():
        return
    at, w, bias = fit([np.frombuffer(rows[i][2], "<i4") for i in order], labels)
    yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.astype("<f8").tobytes()]), pa.array([bias])], names=["at", "weights", "bias"])


def _score(batches: Iterator[pa.RecordBatch], names: list[str], at: bytes, weights: bytes, bias: float | None) -> Iterator[pa.RecordBatch]:
    w = np.zeros(1 << BITS)
    w[np.frombuffer(at, "<i4")] = np.frombuffer(weights, "<f8")
    for b, data, off in chunks(batches, "text"):
        doc, feat = features(data, off, w != 0)
        if bias is None:
            score = np.zeros(len(b))
        else:
            score = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[feat], len(b)) + bias, -60, 60)))
        keep = [i for i, n in enumerate(b.schema.names) if n in names]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(score)], names=names)


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(True))


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> tuple[bytes, bytes, float | None]:
    """Weights learnt from at most ``rows`` labelled documents that are not held out."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)  # ids and labels only: at most ``rows`` rows are broadcast
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    made = texts.mapInArrow(_features, f"id {kind}, toxic int, features binary").repartition(1).sortWithinPartitions(F.xxhash64(F.col("id").cast("string")), "id").mapInArrow(_fit, "at binary, weights binary, bias double").collect()
    return (bytes(made[0].at), bytes(made[0].weights), made[0].bias) if made else (b"", b"", None)


def score_documents(docs: DataFrame, model: tuple[bytes, bytes, float | None], columns: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """The given columns and ``score`` (a name they lack) for every row of ``docs``; with ``text`` among the columns it stays."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], *([] if text in columns else [F.col(f"`{text}`")]))
    if text != "text":
        raise ValueError("the text column must be called text")
    from pyspark.sql import types as T

    out = T.StructType([f for f in rows.schema.fields if f.name in columns] + [T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(lambda it, n=out.names, m=model: _score(it, n, *m), out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    name = fresh(docs, "score")
    scored = score_documents(docs, fit_model(docs, labels), docs.columns, score=name)
    return scored.where(F.col(name) < threshold).drop(name)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
