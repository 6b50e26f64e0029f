"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of word shingles, signed by ``COORDS`` minwise tokens. Equal sets are folded into a class first. Each of
``TREES`` independent trees branches every node by ``BRANCH`` coordinates that the node's own hash chooses: the members that
share the chosen token are a child. Small nodes (``LEAF`` classes, ``LEAF_SHINGLES``) are compared exhaustively; larger ones
branch again, to ``DEPTH`` levels. All trees use the same coordinates, so they are not independent: over how many of the 64 agree (binomial),
three trees and the signature screen below miss a pair of similarity 0.8 with probability 1.3e-4 where its nodes are compared
at the first level, and with 8.8e-4 at most however deep they are split.

Only components are asked for, so a pair that is connected already is not compared again. Round 1 compares the small nodes,
and the large ones in blocks that all hold the node's pivot; it contracts groups of near copies, however large, at linear
cost. Round 2 takes only the large nodes that still hold several components: where one component makes up all but ``OTHERS``
of a node, the others meet each block of it; other nodes branch. What is still large and mixed at the last level is compared
whole: cut into blocks of at most about ``TILE`` classes, every two of which meet in a tile, so that no pair of a node is left out.
The work on such nodes (of texts filled from one template, say) grows with the square of their size.

Comparing has two steps. Within a node, signatures (a byte a coordinate) call pairs similar that are less than five standard
deviations below the threshold (a pair of similarity 0.8 is not with probability 4e-6); such pairs make clusters, and a
cluster that several nodes have in common is taken once. Only the members of clusters get their whole sets (48-bit shingle
hashes), on which links are confirmed: pair by pair at first, and where a cluster has many pairs that don't link, by one
product of its members' shared shingles.

No group goes to one task, no pair is sent: tasks return a forest. Defined cases: null texts and texts without words have an
empty set and link with nothing; texts shorter than a shingle are one shingle; rows that share an id are one document;
a null id has a null component and is not kept; a very long text is one set, compared whole; pairs of exactly the threshold
link; an empty table gives an empty result; other columns, whatever their names, are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import NONSPACE, Words, bound_batches, chunks, components, connected, fresh, grams, groups, mix, remove, stage, table, tidy

COORDS, TREES, BRANCH, DEPTH = 64, 3, 2, 5
#: A small node is compared whole: classes, and shingles of all their sets (or so few classes that their sets fit anyhow).
LEAF, LEAF_SHINGLES, FEW = 2000, 1 << 20, 200
#: Others that meet each block of a settled component. Blocks of the nodes that are large at the last level.
OTHERS, TILE, TILE_SHINGLES = 500, 1000, 1 << 20
#: Pairs of a cluster compared one by one, before all are by one product.
SINGLY = 20_000
#: Signature agreements below which a pair is not compared: 5 standard deviations under the threshold.
SLACK = 5.0

_MULTIPLIERS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# ---------------------------------------------------------------- sets and signatures
def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and where each text's begin (one more entry at the end)."""
    w = Words(data, off, NONSPACE, True)
    count, left = np.diff(w.first), w.left()
    at = np.flatnonzero(left >= size)
    doc, h = [w.doc[at]], [grams(w.hash, size)[at]]
    for n in range(1, size):  # a shorter text is one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            doc.append(short)
            h.append(mix(grams(w.hash, n)[w.first[short]] + np.uint64(n)))
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(w.docs + 1))


def signatures(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(text, coordinate) minwise tokens; zeros for empty sets."""
    out = np.zeros((len(cut) - 1, COORDS), np.uint32)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        for i, a in enumerate(_MULTIPLIERS):
            out[full, i] = np.minimum.reduceat(h * a, cut[full]) >> np.uint64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b, data, off in chunks(batches, "text"):
        h, cut = shingles(data, off, size)
        n, sig = np.diff(cut), signatures(h, cut)
        total = lambda x: np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
        k1, k2 = (np.diff(total(x)[cut]).view(np.int64) for x in (mix(h), mix(h ^ np.uint64(0x5BD1E9955BD1E995))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(k1), pa.array(k2), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())], names=["id", "n", "k1", "k2", "sig", "brief"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for b, data, off in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(data[a:z].tobytes()) for a, z in zip(off, off[1:])], pa.binary())], names=["rep", "blob"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rep, set): sorted 48-bit shingle hashes, six bytes each."""
    raw = ((b, zstandard.ZstdDecompressor()) for b in batches)
    for b, press in raw:
        texts = [press.decompress(x.as_py()) for x in b.column(1)]
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            h, cut = shingles(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), size)
            six = (h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(part)), pa.array([six[x:z].tobytes() for x, z in zip(cut, cut[1:])], pa.binary())], names=["rep", "members"])


def _unpack(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# ---------------------------------------------------------------- trees
def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First-level nodes, a row for each child of each tree's root."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint32).reshape(-1, COORDS)
        for t in range(TREES):
            root = np.full(len(b), mix(np.array([t + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))[0])
            for node in _children(root, sig):
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *b.columns[:4]], names=list(_COLUMNS))


def _children(node: np.ndarray, sig: np.ndarray) -> Iterator[np.ndarray]:
    """The children that each member goes to, one for each coordinate its node chooses (all different)."""
    h = mix(node + np.uint64(0x632BE59BD9B4E019))
    first, step = h % np.uint64(COORDS), (h >> np.uint64(16)) % np.uint64(COORDS // 2) * np.uint64(2) + np.uint64(1)
    for k in range(BRANCH):
        c = (first + np.uint64(k) * step) % np.uint64(COORDS)
        yield mix(mix(node * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)) ^ sig[np.arange(len(node)), c.astype(np.int64)].astype(np.uint64))


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint32).reshape(-1, COORDS)
        for node in _children(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), sig):
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *b.columns[1:5]], names=list(_COLUMNS))


_NODE = "node long, rep long, comp long, n long, brief binary"
_COLUMNS = ("node", "rep", "comp", "n", "brief")
#: What a member takes to its node or block.
_MEMBER = ("node", "block", "rep", "comp", "n", "brief")


def _sizes(nodes: DataFrame) -> DataFrame:
    """Nodes with several components: members, pivot, and a fingerprint of the members."""
    x = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("n").alias("s"), F.min("rep").alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("f1"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).cast("string").alias("f2"))
    return x.where((F.col("n") > 1) & (F.col("low") != F.col("high"))).drop("low", "high")


def _shares(level: DataFrame) -> DataFrame:
    """The same with each node's shingles (``s``) for its pivot, and its largest component (``top``: c members of comp);
    members are summed by component first."""
    each = level.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("rep")).alias("f1"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("f2"))
    x = each.groupBy("node").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.max(F.struct("c", "comp")).alias("top"), F.bit_xor("f1").alias("f1"), F.sum("f2").cast("string").alias("f2"))
    return x.where(F.col("top.c") < F.col("n"))


def _is_small() -> Column:
    return (F.col("n") <= LEAF) & ((F.col("s") <= LEAF_SHINGLES) | (F.col("n") <= FEW))


def _parts(n: Column, s: Column, most: int, shingles: int) -> Column:
    return F.ceil(F.greatest(n / most, F.least(s / shingles, n / FEW))).cast("long")


def _small(sizes: DataFrame) -> DataFrame:
    """Small nodes, one of each set of members."""
    return sizes.where(_is_small()).groupBy("n", "f1", "f2").agg(F.min("node").alias("node")).select("node")


def _whole(nodes: DataFrame, small: DataFrame) -> DataFrame:
    return nodes.join(small.hint("merge"), "node").withColumn("block", F.lit(0).cast("long")).select(*_MEMBER)


def _dealt(x: DataFrame, everywhere: Column) -> DataFrame:
    """Members go to a block by hash, those for which ``everywhere`` holds to all blocks of their node."""
    own = F.array(F.pmod(F.xxhash64("node", "rep"), F.col("blocks")))
    blocks = F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)
    return x.withColumn("block", F.explode(blocks)).select(*_MEMBER)


def _blocks(nodes: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large nodes cut into blocks, and the pivot in each block."""
    large = large.select("node", "pivot", _parts(F.col("n"), F.col("s"), TILE, TILE_SHINGLES).alias("blocks"))
    return _dealt(nodes.join(large.hint("merge"), "node"), F.col("rep") == F.col("pivot"))


def _against(nodes: DataFrame, settled: DataFrame) -> DataFrame:
    """Nodes that hold one large component and few others: the others meet each block of the component."""
    x = nodes.join(settled.select("node", F.col("comp").alias("top"), "blocks").hint("merge"), "node")
    return _dealt(x, F.col("comp") != F.col("top"))


def _tiles(nodes: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large nodes cut into blocks, each block with each other one: all pairs of a node meet."""
    large = large.select("node", _parts(F.col("n"), F.col("s"), TILE, TILE_SHINGLES).alias("blocks"))
    x = nodes.join(large.hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node", "rep"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    tile = F.transform(others, lambda j: F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own")))
    return x.withColumn("block", F.explode(tile)).select(*_MEMBER)


# ---------------------------------------------------------------- comparison
def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(f1, f2, rep, comp, brief): within each node or block, the clusters of classes that their signatures (a byte a coordinate) call
    similar and that aren't connected yet. A cluster goes by a hash of its members, so that one met in several nodes is one."""
    p = percent / 100
    least = COORDS * p - SLACK * np.sqrt(COORDS * p * (1 - p))
    for t in groups(batches, 2):
        if len(t) < 2:
            continue
        rep, n = t["rep"].to_numpy(), t["n"].to_numpy()
        own = np.unique(t["comp"].to_numpy(), return_inverse=True)[1]
        if own.max() == 0:
            continue
        brief = np.frombuffer(b"".join(t["brief"].to_pylist()), np.uint8).reshape(-1, COORDS)
        a, z = [], []
        for i in range(len(rep) - 1):
            j = np.flatnonzero((brief[i + 1 :] == brief[i]).sum(axis=1) >= least) + i + 1
            j = j[(own[j] != own[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            a.append(np.full(len(j), i))
            z.append(j)
        a, z = np.concatenate(a), np.concatenate(z)
        if not len(a):
            continue
        some = np.unique(np.concatenate([a, z]))
        root = components(len(rep), a, z)[some]
        of, h = np.unique(root, return_inverse=True)[1], mix(rep[some].view(np.uint64))
        f = []
        for x in (h, mix(h ^ np.uint64(0x5BD1E9955BD1E995))):
            total = np.zeros(of.max() + 1, np.uint64)
            np.add.at(total, of, x)
            f.append(pa.array(total.view(np.int64)[of]))
        own_rows = t.select(["rep", "comp", "brief"]).take(pa.array(some)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*f, *(c.combine_chunks() for c in own_rows.columns)], names=["f1", "f2", "rep", "comp", "brief"])
    tidy()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common."""
    all_, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(all_, kind="stable")
    all_, own = all_[order], own[order]
    first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1]))
    n = np.diff(np.append(first, len(all_)))
    keep = np.repeat(n > 1, n)  # elements of one set alone are shared by none
    own, col = own[keep], np.repeat(np.arange((n > 1).sum()), n[n > 1])
    both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24
    for a in range(0, int((n > 1).sum()), 2048):
        x, z = np.searchsorted(col, [a, a + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[own[x:z], col[x:z] - a] = 1
        both += has @ has.T
    return both


def _link(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Forest edges (u, v) of each cluster, over pairs whose sets are similar and that aren't connected yet."""
    p = percent / 100
    least = COORDS * p - SLACK * np.sqrt(COORDS * p * (1 - p))
    for t in groups(batches, 2):
        rep, comp = t["rep"].to_numpy(), t["comp"].to_numpy()
        brief = np.frombuffer(b"".join(t["brief"].to_pylist()), np.uint8).reshape(-1, COORDS)
        packed = t["members"].to_pylist()
        n = np.array([len(x) // 6 for x in packed])
        sets: dict[int, np.ndarray] = {}
        own = np.unique(comp, return_inverse=True)[1]
        u, v, spent, counts = [], [], 0, None
        for i in range(len(rep) - 1):
            j = np.arange(i + 1, len(rep))
            j = j[own[j] != own[i]]
            j = j[(brief[j] == brief[i]).sum(axis=1) >= least]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            if not len(j):
                continue
            spent += len(j)
            if counts is None and spent > SINGLY:
                sets.clear()
                counts = _shared([_unpack(x) for x in packed])
            if counts is not None:
                both = counts[i, j].astype(np.int64)
            else:
                for k in (i, *j.tolist()):
                    if k not in sets:
                        sets[k] = _unpack(packed[k])
                mine, cut = sets[i], np.cumsum([0, *(len(sets[k]) for k in j.tolist())])
                all_ = np.concatenate([sets[k] for k in j.tolist()])
                hit = mine[np.minimum(np.searchsorted(mine, all_), len(mine) - 1)] == all_
                both = np.diff(np.append(0, np.cumsum(hit))[cut])
            for k in j[100 * both >= percent * (n[i] + n[j] - both)].tolist():
                if own[k] != own[i]:
                    u.append(rep[i])
                    v.append(rep[k])
                    own[own == own[k]] = own[i]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    tidy()


class _Sets:
    """Whole shingle sets of the classes that are asked for, made once."""

    def __init__(self, rows: DataFrame, size: int, scratch: list[str]):
        self.scratch = scratch
        self.blobs = rows.where("id is not null").mapInArrow(_press, "rep long, blob binary")
        self.size, self.made = size, None

    def of(self, members: DataFrame) -> DataFrame:
        need = members.select("rep").distinct()
        if self.made is not None:
            need = stage(need.join(self.made.select("rep"), "rep", "left_anti"), "reps", self.scratch)
        size = self.size
        new = stage(self.blobs.join(need.hint("merge"), "rep", "left_semi").mapInArrow(lambda it: _sets(it, size), "rep long, members binary"), "sets", self.scratch)
        self.made = new if self.made is None else self.made.union(new)
        return self.made


def _compare(members: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Edges within the (node, block) groups of ``members``: signatures choose clusters, whole sets confirm links."""
    met = members.select(*_MEMBER).repartition("node", "block").sortWithinPartitions("node", "block")
    clusters = stage(met.mapInArrow(lambda it: _candidates(it, percent), "f1 long, f2 long, rep long, comp long, brief binary").distinct(), "clusters", sets.scratch)
    full = clusters.join(sets.of(clusters).hint("merge"), "rep").select("f1", "f2", "rep", "comp", "brief", "members")
    return full.repartition("f1", "f2").sortWithinPartitions("f1", "f2").mapInArrow(lambda it: _link(it, percent), "u long, v long")


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: documents whose sets of ``size``-word shingles have at least
    ``percent`` hundredths of their union in common are linked; a component goes by its smallest id."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kept: list[str] = []
    signed = stage(rows.mapInArrow(lambda it: _sign(it, size), "id long, n long, k1 long, k2 long, sig binary, brief binary"), "signatures", kept)
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    classes = signed.where(linked).groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("brief").alias("brief"))
    scratch: list[str] = []
    classes = stage(classes.withColumn("comp", F.col("rep")), "set-classes", scratch)

    # Round 1: the first level of all trees.
    nodes = classes.select("rep", "comp", "n", "brief", "sig").mapInArrow(_roots, _NODE)
    sizes = stage(_sizes(nodes), "nodes-1", scratch)
    large = sizes.where(~_is_small()).select("node", "pivot", "n", "s")
    level = stage(nodes.join(large.select("node").hint("merge"), "node").select(*_COLUMNS), "level-1", scratch)
    members = _whole(nodes, _small(sizes)).union(_blocks(level, large))
    sets = _Sets(rows, size, scratch)
    edges = stage(_compare(members, sets, percent), "edges-1", scratch)
    roots = connected(edges, "documents-1")

    # Round 2: large nodes with several components, level by level.
    if large.limit(1).count():
        now = roots.select(F.col("node").alias("rep"), F.col("root").alias("now"))
        level = level.join(now, "rep", "left").withColumn("comp", F.coalesce("now", "comp")).select(*_COLUMNS)
        found = None
        for depth in range(2, DEPTH + 2):
            level = stage(level, f"level-{depth}", scratch)
            sizes = stage(_shares(level), f"nodes-{depth}", scratch)
            if depth > 2:  # the first level's small nodes have been compared
                leafs = _whole(level, _small(sizes))
                found = leafs if found is None else found.union(leafs)
            large = sizes.where(~_is_small()).groupBy("n", "f1", "f2").agg(F.min(F.struct("node", "s", "top")).alias("x")).select("x.*", "n")
            settled = F.col("n") - F.col("top.c") <= OTHERS
            large = stage(large.select("node", "s", "n", F.col("top.comp").alias("comp"), _parts(F.col("top.c"), F.col("s"), TILE, TILE_SHINGLES).alias("blocks"), settled.alias("settled")), f"large-{depth}", scratch)
            if not large.limit(1).count():
                break
            alone = _against(level, large.where("settled"))
            found = alone if found is None else found.union(alone)
            large = large.where("not settled")
            if depth == DEPTH + 1:
                found = found.union(_tiles(level, large))
                break
            open_ = level.join(large.select("node").hint("merge"), "node").join(classes.select("rep", "sig"), "rep").select(*_COLUMNS, "sig")
            level = open_.mapInArrow(_branch, _NODE)
        if found is not None:
            more = stage(_compare(found, sets, percent), "edges-2", scratch)
            if more.limit(1).count():
                roots = connected(edges.union(more), "documents-2")

    whole = classes.select("k1", "k2", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    # Rows without a set get keys of their own, so that they don't meet in one task.
    alone = ~F.coalesce(linked, F.lit(False))
    own = signed.select("id", "n", alone.alias("alone"), F.when(alone, F.xxhash64(F.lit("none"), "id")).otherwise(F.col("k1")).alias("k1"), F.when(alone, 0).otherwise(F.col("k2")).alias("k2"))
    whole = stage(whole, "roots", kept)
    remove(spark, scratch)
    out = own.join(whole, ["k1", "k2"], "left")
    component = F.when(F.col("alone"), F.col("id")).otherwise(F.col("root"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
    out = stage(out, "components")
    remove(spark, kept)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one of the smallest id, with its own columns. Keys go with the text's hash, so that
    rows that share an id are judged each by its own text; of a key and text that repeats, one row stays. Null ids stay."""
    own = fresh(docs, "own")
    keyed = docs.withColumn(own, F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), F.col(text))))
    pairs = keyed.select(F.col(own).alias("own"), F.col(key).alias("id"), F.col(text).alias("text")).where("own is not null")
    linked = link_documents(pairs, "own", "text", size, percent).groupBy("own").agg(F.min("component_id").alias("component"))
    ids = pairs.groupBy("own").agg(F.min("id").alias("id"))
    first = linked.join(ids, "own").groupBy("component").agg(F.min(F.struct("id", "own")).alias("x"))
    kept = stage(first.select(F.col("x.own").alias(own)), "kept")
    some = keyed.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
    return some.unionByName(docs.where(F.col(key).isNull()))


def op6_minhash_paths(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles."""
    return link_documents(table(spark, sf_dir, "documents"))
