"""Text as id sequences: vocabulary by frequency, and next-token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word) of white-space separated texts; null texts have no words."""
    cut = F.filter(F.split(F.col(text), r"[ \t\n\r]+"), lambda x: x != "")
    return texts.select(F.col(key).alias("key"), F.posexplode(cut).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def vocabulary(tokens: DataFrame, size: int, word: str = "word") -> DataFrame:
    """(word, n, id) of the ``size`` most frequent words, ids from 1 in order of frequency, then of the word. Only ``size`` rows
    are ever ordered in one task: the top is taken first."""
    top = tokens.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return top.select("word", "n", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long").alias("id"))


def to_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, pos, id); words outside the vocabulary are id 0."""
    return tokens.join(vocab.select("word", "id"), "word", "left").select("key", "pos", F.coalesce("id", F.lit(0)).alias("id"))


def next_token_rows(texts: DataFrame, length: int, key: str = "key", ids: str = "ids") -> DataFrame:
    """The same windows from texts that are one array of ids a row: no row leaves its task."""
    n, a = F.size(ids), F.col(ids)
    wrap = F.flatten(F.array_repeat(a, F.ceil(F.lit(length) / n).cast("int") + 1))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("__wrap", i + 1, length + 1))
    each = texts.where(n > 0).withColumn("__wrap", wrap).select(F.col(key).alias("key"), F.posexplode(at).alias("pos", "__ids"))
    return each.select("key", F.col("pos").cast("long").alias("pos"), F.slice("__ids", 1, length).alias("context"), F.element_at("__ids", length + 1).alias("label"))


def next_token_windows(ids: DataFrame, length: int) -> DataFrame:
    """(key, pos, context, label): ``length`` ids from each position and the id that follows, round the end of each sequence.

    Each id is sent to the windows that hold it, so no sequence is gathered and none is joined with itself.
    """
    n = ids.groupBy("key").agg(F.count("*").alias("n"))
    sent = ids.join(n, "key").select("key", "id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length)), lambda k: F.struct(F.pmod(F.col("pos") - k, F.col("n")).alias("start"), k.alias("k")))).alias("w"))
    g = sent.groupBy("key", F.col("w.start").alias("pos"))
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col("w.k").alias("k"), "id"))), lambda x: x["id"])  # length + 1 ids
    return g.agg(seq.alias("ids")).select("key", "pos", F.slice("ids", 1, length).alias("context"), F.element_at("ids", length + 1).alias("label"))
