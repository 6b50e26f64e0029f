"""Every stage of the pipeline against a plain version of what it should keep."""

import brute

import corpus_pipeline as P
from lookupforge.llm import toxicity, viterbi_pieces
from lookupforge.llm.common import stage, table


def test_stages(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, step in P.STAGES:
        before = docs
        docs = stage(step(spark, docs, sf), name)
        kept[name] = (before, docs)
        if name != "piece_encoding":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = kept["toxicity"]
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    scores = toxicity.score_documents(before, toxicity.fit_model(before, table(spark, sf, "labels")), ["doc_id"])
    assert ids(after) == {r.doc_id for r in scores.collect() if r.score < 0.5}
    gone = ids(before) - ids(after)
    assert gone and sum(labels.get(i, 1) == 1 for i in gone) >= 0.9 * len(gone)

    before, after = kept["minhash_near_dedup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == {d for d, _, _, first in brute.op6(rows, 5) if first}
    assert len(rows) > after.count()

    before, after = kept["benchmark_decontamination"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert ids(after) == {d for d, *_, bad in brute.op1(rows, items) if not bad}

    before, after = kept["secret_scans"]
    assert ids(after) == ids(before)
    rows = [tuple(r) for r in after.select("doc_id", "text").collect()]
    assert sum(a + b + c for _, a, b, c, _ in brute.op4(rows)) == 0
    was = {r.doc_id: r.text for r in before.collect()}
    assert all(t == was[d] or "[secret]" in t for d, t in rows)

    before, after = kept["piece_encoding"]
    back = {r.doc_id: r.text for r in viterbi_pieces.decode_documents(after, viterbi_pieces.model_path()).collect()}
    assert back == {r.doc_id: r.text or "" for r in before.collect()}


def test_odd_rows(spark, odd_docs, sf_dir):
    """Nulls, repeated rows and other columns pass through all stages."""
    docs = stage(odd_docs.union(odd_docs.limit(5)), "odd")
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    assert docs.count() > 10
    none = stage(odd_docs.where("doc_id < 0"), "none")
    for name, step in P.STAGES:
        none = stage(step(spark, none, sf_dir), name)
    assert none.count() == 0
