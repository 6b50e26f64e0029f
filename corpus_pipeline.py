"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all but
the last keep the columns of documents, whatever further columns there are and however they are called. Rows whose columns are
null stay unless a stage rejects them; very long texts are handled whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lookupforge.llm import decontaminate, minhash_paths, secret_ledger, toxicity, viterbi_pieces
from lookupforge.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows that are not held out, scores below one half.

    Null and empty texts get the base rate; a score of exactly one half goes; repeated rows share their verdict; without
    labels of both kinds every document stays.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more: the one of the smallest id.

    Null texts and texts without words are like nothing and stay; rows with a null id stay; of rows that repeat an id and its
    text one stays; rows that share an id only are judged each by its own text.
    """
    return minhash_paths.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in 13-word windows of the benchmark.

    Null texts have no words and stay; exactly a twentieth goes; repeated rows share their verdict; items without an id mark
    words like others; without items every document stays.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced; n_chars follows.

    Null texts stay null; overlapping findings become one replacement; every repeated row is redacted.
    """
    return secret_ledger.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, ids): little-endian unsigned 32-bit piece ids of each text.

    Null and empty texts have no ids; segmentations of one score go to the longer last piece; repeated rows stay.
    """
    return viterbi_pieces.encode_documents(docs, viterbi_pieces.model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("piece_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted model and piece encoding can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
