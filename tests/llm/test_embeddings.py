"""Lattice hashing against all pairs."""

import numpy as np
import pytest

from lookupforge.llm import neardup_embeddings as E
from lookupforge.llm.common import connected, stage


def brute(rows, threshold=E.THRESHOLD):
    ok = [i for i, (d, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i in range(len(rows))}, [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], least[find(i)] == rows[i][0]) for i in range(len(rows)))


def vectors():
    r = np.random.default_rng(3)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        rows.append((n, v, label))
        n += 1

    for c in range(6):
        base = r.normal(size=64)
        for k in range(40):
            add((base * (1 + k % 3) + r.normal(size=64) * 0.02 * (k % 12)).astype(np.float32).tolist(), c % 2)
    for _ in range(150):
        add(r.normal(size=64).astype(np.float32).tolist(), 1)
    for _ in range(10):
        add(rows[0][1], 0)
    add(rows[0][1], 1)
    add(rows[0][1], None)
    for v in (None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]):
        add(v, 1)
    return rows


@pytest.mark.parametrize("cell", [512, 16])
def test_links(spark, monkeypatch, cell):
    monkeypatch.setattr(E, "CELL", cell)
    rows = vectors()
    df = stage(spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, label int, cell string, home int"), "t")
    got = sorted(tuple(x) for x in E.link_embeddings(df).collect())
    want = brute(rows)
    missed = sum(b[1] - a[1] for a, b in zip(got, want))
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and missed <= 0.01 * sum(b[1] for b in want)
    assert [x[2:] for x in got] == [x[2:] for x in want]


def test_repeated_ids(spark):
    """Different vectors that share an id link each by itself; the component goes by the smallest id."""
    r = np.random.default_rng(8)
    near, far = r.normal(size=64).astype(np.float32), r.normal(size=64).astype(np.float32)
    rows = [(1, near.tolist(), 0), (1, far.tolist(), 0), (2, (near * 2).tolist(), 0), (0, (far + np.float32(0.001)).tolist(), 0), (3, near.tolist(), 0), (1, near.tolist(), 0)]
    assert sorted(tuple(x) for x in E.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()) == brute(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(x) for x in E.op2_embedding_lattice(spark, sf_dir).collect())
    assert got == brute(rows)


def test_decode():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 8)) * 2
    p = E.decode(x)
    for v in E.neighbours():
        assert (((x - p) ** 2).sum(axis=1) <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.link_embeddings(none).count() == 0


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "u long, v long").repartition(5), "t").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
