"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from octavo.llm import vector_links


def brute(rows, least=0.9):
    ids, unit = [], []
    for i, v in rows:
        x = vector_links.unit(v)
        ids.append(i)
        unit.append(x)
    up = list(range(len(ids)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    links = [0] * len(ids)
    for a in range(len(ids)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if ids[x] > ids[y]:
                    x, y = y, x
                up[y] = x
    return {ids[k]: (links[k], ids[find(k)], find(k) == k) for k in range(len(ids))}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(6)
    made = []
    for _ in range(40):
        c = r.standard_normal(16)
        made += [c + r.standard_normal(16) * s for s in r.choice([0.0, 0.05, 0.2, 0.4], r.integers(1, 12))]
    made += [made[0]] * 30 + [made[0] * 3]
    out = [[float(np.float32(x)) for x in v] for v in made]
    out += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1.0, 1.9], [1.0], [-2.0], [3.0], [1.0] * 17]
    order = r.permutation(len(out))
    return [(int(k), out[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize("leaf,block", [(10_000, 4096), (40, 4096), (60, 8)])
def test_against_all_pairs(spark, rows, monkeypatch, leaf, block):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vector_links.near_vectors(df, leaf=leaf).collect()}
    want = brute(rows)
    found, all_ = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in got)
    assert found >= 0.97 * all_
    if leaf == 10_000:
        assert got == want


@pytest.mark.parametrize("sample", [100, 30])
def test_large_leaves_are_split(spark, monkeypatch, sample):
    monkeypatch.setattr(vector_links, "SAMPLE", sample)
    monkeypatch.setattr(vector_links, "MOST", 120)
    monkeypatch.setattr(vector_links, "REFIT", 100)
    monkeypatch.setattr(vector_links, "BLOCK", 64)
    r = np.random.default_rng(3)
    centres = r.standard_normal((300, 16))
    x = np.repeat(centres, 6, axis=0) + 0.15 * r.standard_normal((1800, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    sizes = []
    compare = vector_links._split_large
    monkeypatch.setattr(vector_links, "_split_large", lambda *a: sizes.append((a[1].agg({"n": "max"}).first()[0], compare(*a))) or sizes[-1][1])
    got = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in vector_links.near_vectors(df, leaf=100).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sizes[0][0] > 120 and sizes[0][1][1].agg({"n": "max"}).first()[0] < sizes[0][0]
    assert all(got[k][0] <= n for k, n in enumerate(want.tolist())) and sum(g[0] for g in got.values()) >= 0.9 * want.sum()


def test_nothing(spark):
    assert vector_links.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_vector_reaches_a_leaf_of_every_tree():
    r = np.random.default_rng(1)
    x = r.standard_normal((500, 8))
    tree = vector_links.fit_tree(x[:200], 20, 3)
    rows, leaves = vector_links.route(x, tree)
    assert set(rows.tolist()) == set(range(500)) and len(set(leaves.tolist())) > 5 and len(rows) > 500
    same = np.ones((50, 8))
    assert vector_links.fit_tree(same, 10, 1) == [None]


@pytest.mark.parametrize("cosine", [0.93, 0.97])
def test_hot_group_of_near_vectors(spark, cosine):
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 64))
    centre = r.standard_normal(64)
    x[:1000] = centre / np.linalg.norm(centre) + np.sqrt((1 - cosine) / cosine / 64) * r.standard_normal((1000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v["vec_id"]: v["n_links"] for v in vector_links.near_vectors(df, leaf=40).collect()}
    assert all(got[k] <= n for k, n in enumerate(want.tolist())) and sum(got.values()) >= 0.9 * want.sum()
