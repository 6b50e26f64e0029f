"""Operators against plain Python versions, on odd documents and on the smallest tables."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lookupforge.llm import common, decontaminate, minhash_paths, secret_ledger, substring_doubling, token_store, toxicity, viterbi_pieces
from lookupforge.llm.common import Words, mix, new_dir, stage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def small(spark, sf_dir, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols).collect()]


@pytest.fixture(scope="module")
def docs(odd_docs):
    return stage(odd_docs, "odd")


def test_decontaminate_odd(spark, docs, odd):
    items = [(7, odd[11][1]), (70, odd[11][1]), (8, "a b c"), (9, None), (10, "  "), (11, "Word"), (12, odd[13][1])]
    index = decontaminate.build_index(docs, new_dir(spark, "t"))
    found = decontaminate.find_phrases(index, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.key: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]))) for r in found.collect()}
    assert got == {d: (a, b, c, e) for d, a, b, c, e, _ in brute.op1(odd, items)}
    for r in found.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_decontaminate_blocks(spark, docs, odd, monkeypatch):
    """A query set sent in several blocks gives the same rows."""
    items = spark.createDataFrame([(i, odd[10 + i][1]) for i in range(4)], "item_id long, text string")
    index = decontaminate.build_index(docs, new_dir(spark, "t"))
    whole = rows(decontaminate.find_phrases(index, items))
    monkeypatch.setattr(decontaminate, "BLOCK_TERMS", 50)
    assert rows(decontaminate.find_phrases(index, items)) == whole


def test_decontaminate_near(spark):
    docs = spark.createDataFrame([(1, "the quick red brown fox"), (2, "fox brown quick"), (3, "quick x x x x x brown fox"), (4, "quick brown"), (5, None)], "doc_id long, text string")
    index = decontaminate.build_index(docs, new_dir(spark, "t"))
    items = spark.createDataFrame([("q", "quick brown fox")], "item_id string, text string")
    assert rows(decontaminate.find_near(index, items, 1)) == [(1, "q", 1, 5), (2, "q", 0, 3)]
    assert rows(decontaminate.find_near(index, items, 0)) == [(2, "q", 0, 3)]


def test_decontaminate_query(spark, sf_dir):
    got = rows(decontaminate.op1_decontaminate(spark, sf_dir))
    assert got == sorted(brute.op1(small(spark, sf_dir, "documents", "doc_id", "text"), small(spark, sf_dir, "benchmark", "item_id", "text")), key=str)


def test_drop_contaminated(spark, docs, odd):
    items = spark.createDataFrame([(1, odd[11][1])], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    bad = {d for d, *_, c in brute.op1(odd, [(1, odd[11][1])]) if c}
    assert bad and kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in odd} - bad


def test_secrets(spark, docs, odd):
    ledger = new_dir(spark, "t")
    found = secret_ledger.scan_versions(docs, ledger, fresh=True)
    assert rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(brute.op4(odd), key=str)
    before = spark.read.parquet(ledger).count()
    more = docs.unionByName(docs.limit(3)).select("doc_id", "text").union(spark.createDataFrame([(99, "token: 'zzzzzzzzzzzzzzz'")], "doc_id long, text string"))
    again = secret_ledger.scan_versions(more, ledger)
    assert again.count() == len(odd) + 4
    assert spark.read.parquet(ledger).count() == before + 1  # only the unseen blob was scanned
    secret_ledger.scan_versions(docs, ledger, rule_version="2")
    assert spark.read.parquet(ledger).where("rule_version = '2'").count() == before


def test_redact(spark, docs, odd):
    out = {r.doc_id: r for r in secret_ledger.redact_documents(docs).collect()}
    assert len(out) == len(odd)
    assert "ZZZZ" not in out[60].text and "[secret]" in out[60].text and out[60].n_chars == len(out[60].text)
    assert out[0].text is None and out[6].text == dict(odd)[6]


def test_secrets_query(spark, sf_dir):
    got = rows(secret_ledger.op4_secret_ledger(spark, sf_dir), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == sorted(brute.op4(small(spark, sf_dir, "documents", "doc_id", "text")), key=str)


@pytest.mark.parametrize("window", [35, 8])
def test_substrings(spark, docs, odd, window):
    found = substring_doubling.remove_repeats(docs, window=window)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op8(odd, window), key=str)
    for r in found.collect():
        assert brute.sha(r.kept) == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substrings_extend(spark):
    r = random.Random(1)
    long_ = " ".join(str(r.random()) for _ in range(100))
    docs = stage(spark.createDataFrame([(1, long_), (2, "start " + long_), (3, "alone")], "doc_id long, text string"), "t")
    found = {x.doc_id: x for x in substring_doubling.remove_repeats(docs, window=10, extend=True).collect()}
    assert found[1].n_removed == 100 and found[2].n_removed == 100 and found[3].n_removed == 0
    assert found[2].spans[0].window == 80


def test_substrings_query(spark, sf_dir):
    got = rows(substring_doubling.op8_substring_doubling(spark, sf_dir))
    assert got == sorted(brute.op8(small(spark, sf_dir, "documents", "doc_id", "text")), key=str)


def test_tokens(spark, docs, odd, monkeypatch):
    out = new_dir(spark, "t")
    token_store.write_tokens(docs, out, BYTE_BPE, shard_ids=500)
    assert rows(token_store.read_documents(spark, out)) == sorted(brute.op9(odd, BYTE_BPE), key=str)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: list(r.ids) for r in token_store.read_keys(spark, out, [0, 13, 16, 17, 55, 12345]).collect()}
    assert got == {i: tok.encode(dict(odd)[i] or "", add_special_tokens=False).ids + [2] for i in (0, 13, 16, 17, 55)}


def test_tokens_null_and_repeated_keys(spark):
    many = [(3, f"w{i} " * (i % 4)) for i in range(60)] + [(None, "x" * (i % 3)) for i in range(40)]
    docs = spark.createDataFrame([(1, None), (5, "last"), *many], "doc_id long, text string").repartition(5)
    out = new_dir(spark, "t")
    token_store.write_tokens(docs, out, BYTE_BPE, shard_ids=20)
    got = token_store.read_documents(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 40 + [1] + [3] * 60 + [5]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    want = sorted(tok.encode(t, add_special_tokens=False).ids + [2] for d, t in many if d == 3)
    assert sorted(list(r.ids) for r in token_store.read_keys(spark, out, [3, 4]).collect()) == want
    assert token_store.read_shards(spark, out).where("least <= 3 and most >= 3").count() > 3


def test_tokens_by_key_reads_pages(spark, docs):
    """The key's range goes to the reader, together with the columns that a lookup needs, and the reader gives one shard."""
    out = new_dir(spark, "t")
    token_store.write_tokens(docs.coalesce(1), out, BYTE_BPE, shard_ids=500)
    near = token_store.read_shards(spark, out).where("least <= 13 and most >= 13").select("payload")
    assert near.count() < token_store.read_shards(spark, out).count() / 3
    found = len(near.collect())
    assert near._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value() == found
    plan = token_store.read_keys(spark, out, [13])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(least,13)" in plan and "GreaterThanOrEqual(most,13)" in plan and "keys" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_tokens_small_word_table(odd):
    """Words that leave the table are encoded again; a tokenizer that cuts otherwise is left to the library."""
    from tokenizers import Tokenizer

    e, tok = token_store.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    e.spaced.most = 40
    texts = [t or "" for _, t in odd] + ["naïve, × 2÷3 don't; end.", "Été: çà! là? a.b c.. d×e f÷g É. ×. w\x85"]
    for _ in range(2):
        for a in range(0, len(texts), 7):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[a : a + 7])] == [tok.encode(t, add_special_tokens=False).ids for t in texts[a : a + 7]]
    assert len(e.spaced.parts[0][0]) <= 40
    e.known = False
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_query(spark, sf_dir):
    assert rows(token_store.op9_token_store(spark, sf_dir)) == sorted(brute.op9(small(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE), key=str)


def whole_search(p, s):
    """The best score of any segmentation, and a best one (the longest last piece first)."""
    best, back = [0.0] + [None] * len(s), [0] * (len(s) + 1)
    for z in range(1, len(s) + 1):
        for a in range(max(0, z - p.longest), z):
            score = p.scores[p.ids[s[a:z]]] if s[a:z] in p.ids else p.low if a == z - 1 else None
            if score is not None and (best[z] is None or best[a] + score > best[z]):
                best[z], back[z] = best[a] + score, a
    out, z = [], len(s)
    while z:
        c = s[back[z] : z]
        out.append([p.ids[c]] if c in p.ids else [p.bytes_at[x] for x in c.encode()])
        z = back[z]
    return best[-1], [i for x in out[::-1] for i in x]


def test_pieces_best_score(odd):
    """The stream over whole texts, in any portions, gives the search's ids; the encoder, which cuts texts and knows words, ids
    of the same score."""
    p = viterbi_pieces.Pieces(viterbi_pieces.model_path())
    texts = [t or "" for _, t in odd] + [" ", "  lead", "trail  ", "▁ x ▁▁y", "x" * 300]
    raw = [t.encode() for t in texts]
    enc = viterbi_pieces.Encoder(p)
    enc.known.most = 50
    for _ in range(2):
        ids, cut = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        s = p.prepare(t)
        best, want = whole_search(p, s)
        one = viterbi_pieces.Stream(p)
        got = one.feed(s) + one.close()
        two, portions = viterbi_pieces.Stream(p), []
        for i in range(0, len(s), 7):
            portions += two.feed(s[i : i + 7])
        assert portions + two.close() == got
        mine = ids[cut[k] : cut[k + 1]].tolist()
        score = lambda x: sum(p.scores[i] for i in x if p.kinds[i] != 6)
        assert mine == got == want or abs(score(mine) - score(want)) < 1e-6 * len(s) and abs(score(got) - score(want)) < 1e-6 * len(s)
        assert p.decode(mine) == t.replace(viterbi_pieces.SPACE, " ")


def test_pieces_stream_is_bounded():
    p = viterbi_pieces.Pieces(viterbi_pieces.model_path())
    s = viterbi_pieces.Stream(p)
    n = sum(len(s.feed("▁some▁words▁in▁a▁row")) for _ in range(500))
    assert s.window < 200 and n > 2000


def test_pieces_round_trip(spark, docs, odd):
    out = viterbi_pieces.encode_documents(docs, viterbi_pieces.model_path())
    assert all(r.round_trip for r in out.collect()) and out.count() == len(odd)
    back = {r.doc_id: r.text for r in viterbi_pieces.decode_documents(out, viterbi_pieces.model_path()).collect()}
    assert back == {i: t or "" for i, t in odd}


def test_toxicity(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in got) / len(got)
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    print("held out", len(got), "accuracy", right, "AUC", auc)
    assert right > 0.95 and auc > 0.95


def test_toxicity_odd(spark, docs, odd):
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, None), (40, 0), (41, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.score_documents(docs, toxicity.fit_model(docs, labels.where("toxic > 5")), ["doc_id"])
    assert none.count() == len(odd) and {r.score for r in none.collect()} == {0.0}


def test_toxicity_plain_scorer(spark, docs, odd):
    """Scores against the weights summed one by one, over words cut by a regular expression; empty texts get the base rate."""
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in odd], "doc_id long, toxic int")
    twice = stage(docs.union(docs.where("doc_id > 30")), "t")
    model = toxicity.fit_model(twice, labels)
    assert model == toxicity.fit_model(docs, labels)
    weights, mask = dict(zip(np.frombuffer(model[0], "<i4").tolist(), np.frombuffer(model[1], "<f8").tolist(), strict=True)), (1 << toxicity.BITS) - 1
    word = lambda b: int(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), np.ones(256, bool), True).hash[0])
    mixed = lambda x: int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0]) & mask
    want = {}
    for i, t in odd:
        raw = [w.encode() for w in brute.ALNUM.findall((t or "").translate(brute.LOWER))][:2000]
        if len(raw) == 2000:
            continue
        h = [word(w) for w in raw]
        f = {mixed(x ^ 1) for x in h} | {mixed(word(w[:n]) ^ n) for w in raw for n in toxicity.STEMS if len(w) > n}
        f |= {mixed(h[k] * 0x9E3779B97F4A7C15 + h[k + gap] + gap) for gap in (1, 2) for k in range(len(h) - gap)}
        want[i] = 1 / (1 + np.exp(-(sum(weights.get(x, 0.0) for x in f) + model[2])))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model, ["doc_id"]).collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in want.items()) and len(want) > 50
    assert got[0] == got[1] == got[2] == want[0]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_words_by_blocks(odd, monkeypatch, block):
    """Hashes don't depend on the blocks in which they are made, nor on where a word stands."""
    monkeypatch.setattr(common, "_BLOCK", block)
    raw = [(t or "")[:3000].encode() for _, t in odd]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), common.ALNUM, True)
    names = [x for t in raw for x in brute.ALNUM.findall(t.decode().translate(brute.LOWER))]
    assert len(names) == len(w) and len(set(names)) == len(set(w.hash.tolist())) == len(set(zip(names, w.hash.tolist())))
    assert len({*zip(zip(names, names[1:], names[2:]), common.grams(w.hash, 3).tolist())}) == len({*zip(names, names[1:], names[2:])})
    assert (w.span(w.start[::-1], w.end[::-1]) == w.hash[::-1]).all()


def test_clashing_names(spark, docs, odd):
    """The stages keep columns of any name."""
    names = ["own", "own_", "__key", "score", "__score", "sha", "spans", "__sha", "key", "component"]
    wide = stage(docs.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)]), "t")
    items = spark.createDataFrame([(1, odd[11][1])], "item_id long, text string")
    labels = spark.createDataFrame([(6, 1), (40, 0), (41, 0)], "doc_id long, toxic int")
    for out in (decontaminate.drop_contaminated(wide, items), toxicity.drop_toxic(wide, labels, 2.0), secret_ledger.redact_documents(wide), minhash_paths.keep_one(wide)):
        assert out.columns == wide.columns and out.select(names).distinct().collect() == [tuple(range(len(names)))]


def test_ledger_appended_twice(spark, docs):
    """Entries that a retried append left twice give each path one row."""
    ledger = new_dir(spark, "t")
    once = rows(secret_ledger.scan_versions(docs, ledger, fresh=True))
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-more")
    spark.read.parquet(f"{ledger}-more").write.mode("append").parquet(ledger)
    assert rows(secret_ledger.scan_versions(docs, ledger)) == once


def test_repeated_rows(spark, odd):
    """Every row of an id and text that repeat gets the same result, like the first."""
    twice = stage(spark.createDataFrame([x for x in odd for _ in range(2)], "doc_id long, text string").repartition(3), "t")
    index = decontaminate.build_index(twice, new_dir(spark, "t"))
    items = [(7, odd[11][1])]
    found = decontaminate.find_phrases(index, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found, "key", "n_words", "n_hit") == sorted((x[:3] for x in brute.op1(odd, items) for _ in range(2)), key=str)
    assert rows(substring_doubling.remove_repeats(twice), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op8([x for x in odd for _ in range(2)]), key=str)
    once = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in viterbi_pieces.encode_documents(twice, viterbi_pieces.model_path()).collect()}
    assert [tuple(r) for r in rows(viterbi_pieces.encode_documents(twice, viterbi_pieces.model_path()), "doc_id", "n_pieces", "ids_crc32")] == sorted(((d, *x) for d, x in once.items() for _ in range(2)), key=str)


@pytest.mark.parametrize("op", ["index", "secrets", "repeats", "tokens", "pieces"])
def test_empty(spark, docs, op):
    none = stage(docs.where("doc_id < 0"), "none")
    out = new_dir(spark, "t")
    if op == "index":
        found = decontaminate.find_phrases(decontaminate.build_index(none, out), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    elif op == "secrets":
        found = secret_ledger.scan_versions(none, out, fresh=True)
    elif op == "repeats":
        found = substring_doubling.remove_repeats(none)
    elif op == "tokens":
        token_store.write_tokens(none, out, BYTE_BPE)
        found = token_store.read_documents(spark, out)
    else:
        found = viterbi_pieces.encode_documents(none, viterbi_pieces.model_path())
    assert found.count() == 0


def test_decontaminate_items_without_id(spark, docs, odd):
    """They mark words and drop documents, but are not named; an item of the same text keeps its id."""
    kind = "item_id long, text string"
    index = decontaminate.build_index(docs, new_dir(spark, "t"))
    want = {d: (a, b, bad) for d, a, b, _, _, bad in brute.op1(odd, [(1, odd[11][1]), (2, "a b c")])}
    for items, names in (([(None, odd[11][1]), (None, "a b c")], set()), ([(None, odd[11][1]), (1, odd[11][1]), (None, "a b c")], {"1"})):
        items = spark.createDataFrame(items, kind)
        found = decontaminate.find_phrases(index, items).withColumn("bad", decontaminate.contaminated()).collect()
        assert {r.key: (r.n_words, r.n_hit, r.bad) for r in found} == want
        assert {i for r in found for i in r["items"]} == names
        assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {d for d, (*_, bad) in want.items() if not bad}
    assert (5, None, 0, 3) in rows(decontaminate.find_near(index, spark.createDataFrame([(None, "a b c")], kind), 0))
