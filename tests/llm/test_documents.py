"""Chosen-path joins against all pairs."""

import random

import brute
import pytest

from lookupforge.llm import minhash_paths as M
from lookupforge.llm.common import stage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("leaf", [200, 4])
def test_odd(spark, odd_docs, odd, monkeypatch, leaf):
    monkeypatch.setattr(M, "LEAF", leaf)
    got = rows(M.link_documents(stage(odd_docs, "odd")))
    assert got == sorted(brute.op6(odd))


def test_many_near_copies(spark, monkeypatch):
    """A large group of near copies, some far from each other, and a passage that strangers share."""
    monkeypatch.setattr(M, "LEAF", 20)
    r = random.Random(9)
    base, shared = [f"w{r.random()}" for _ in range(150)], [f"s{r.random()}" for _ in range(80)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = f"x{r.random()}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(shared + [f"y{r.random()}" for _ in range(40 + i)])) for i in range(80)]
    docs += [(2000 + i, " ".join([f"p{i // 2}q{k}" for k in range(60)] + ["tail"] * (i % 2))) for i in range(40)]
    got = rows(M.link_documents(stage(spark.createDataFrame(docs, "doc_id long, text string"), "t")))
    assert got == sorted(brute.op6(docs))


def test_query(spark, sf_dir):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(M.op6_minhash_paths(spark, sf_dir)) == sorted(brute.op6(docs))


def test_keep_one(spark, odd_docs, odd):
    docs = stage(odd_docs.union(odd_docs.where("doc_id = 13")), "odd")
    kept = M.keep_one(docs, size=4)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == [d for d, _, _, k in sorted(brute.op6(odd)) if k]


def test_empty(spark):
    assert M.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = stage(spark.createDataFrame([(None, "a b c d"), (None, None), (3, "a b c d"), (4, "A B\tC D")], "doc_id long, text string"), "t")
    assert sorted((str(x[0]), x[1], str(x[2]), x[3]) for x in M.link_documents(odd).collect()) == [("3", 1, "3", True), ("4", 1, "3", False), ("None", 0, "None", False), ("None", 1, "None", False)]


def test_template_group(spark, monkeypatch):
    """A group filled from one template, each two just below the threshold, that no branching makes small: its links are found."""
    for name, n in (("LEAF", 10), ("DEPTH", 1), ("TILE", 70)):
        monkeypatch.setattr(M, name, n, raising=False)
    template = [f"t{k}" for k in range(172)]
    docs = [(i, " ".join(template + [f"p{i // 2 if i < 80 and k < 6 else i + 1000}q{k}" for k in range(26)])) for i in range(300)]
    want = sorted(brute.op6(docs))
    assert sum(not k for *_, k in want) == 40
    assert rows(M.link_documents(stage(spark.createDataFrame(docs, "doc_id long, text string"), "t"))) == want


def test_unlucky_signatures(spark):
    """Pairs at exactly 0.8 of whose 64 signature bytes only 36 to 38 agree."""
    docs = [(2 * k + s, " ".join([f"c{k}q{i}" for i in range(43)] + [f"{'xy'[s]}{k}q{i}" for i in range(5)])) for k in (2748, 5440, 6019, 6595, 6854, 8606, 9219, 11709, 12837) for s in (0, 1)]
    want = sorted(brute.op6(docs))
    assert sum(k for *_, k in want) == 9
    assert rows(M.link_documents(stage(spark.createDataFrame(docs, "doc_id long, text string"), "t"))) == want


def test_keep_one_repeated_ids(spark):
    """Rows that share an id but not their text are judged each by its own text, and link no strangers."""
    text = lambda p, own=0: " ".join([f"{p}{k}" for k in range(60)] + ["more"] * own)
    docs = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a", 1)), (3, text("b", 1)), (4, text("c")), (4, text("c", 1)), (0, text("c", 2)), (5, None), (5, None), (None, text("a")), (None, text("a"))]
    kept = M.keep_one(stage(spark.createDataFrame(docs, "doc_id long, text string"), "t"))
    assert sorted(map(str, rows_any(kept))) == sorted(map(str, [(1, text("a")), (1, text("b")), (0, text("c", 2)), (5, None), (None, text("a")), (None, text("a"))]))


def rows_any(df):
    return [tuple(r) for r in df.collect()]
