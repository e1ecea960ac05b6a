"""Vantage-point trees against brute force: ties, clusters, several dimensions, odd vectors."""

import numpy as np
import pytest

from codeatlas.llm import ann
from codeatlas.llm.queries import QUERIES


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1, "x") for i, v in rows], "vec_id long, embedding array<double>, qid int, dim string")


def brute(rows, queries, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for i, v in ok:
        if i in queries:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [j for _, j in near[:k]]
    return out


def found(spark, rows, queries, **how):
    t = table(spark, rows)
    got = {}
    for r in sorted(ann.nearest(t, t.filter(f"vec_id in ({', '.join(map(str, queries))})"), **how).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("shard_rows, query_rows", [(8192, 16384), (60, 3)])
def test_ties_go_to_the_smaller_id(spark, shard_rows, query_rows):
    rng = np.random.default_rng(2)
    rows = [(0, [1, 0, 0, 0, 0, 0, 0, 0])] + [(i, [1, *rng.integers(-9, 10, 7)]) for i in range(1, 400)]
    got = found(spark, rows, [0, 5], k=20, factor=1.0, shard_rows=shard_rows, query_rows=query_rows)
    assert got == brute(rows, [0, 5], 20) and got[0] == list(range(1, 21))


def test_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)) * rng.gamma(2, size=(500, 1))
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None]), (904, []), (None, [1.0] * 8), (905, [float("inf")] * 8)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(4)] + rows[20:25]
    queries = [*range(0, 500, 20), 900, 901, 902, 1000]
    assert found(spark, rows, queries, k=5, factor=1.0, shard_rows=90, query_rows=4) == brute(rows, queries, 5)


def test_clusters_are_left_out(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(3000, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = ann.Tree(x, np.arange(len(x)), 1.0, leaf=32)
    best = np.sort(x[::10] @ x.T, axis=1)[:, -20]
    for factor, share, recall in ((0.7, 0.5, 0.9), (1.0, 1.1, 1.0)):
        who, row, score, cost = tree.search(x[::10], 20, factor)
        hits = (score >= best[who] - 1e-12).sum() / (20 * len(x[::10]))
        assert cost < share * len(x) * len(x[::10]) and hits >= recall
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = list(range(0, 3000, 100))
    got, exact = found(spark, rows, queries, factor=0.7, shard_rows=200), brute(rows, queries, 20)
    assert sum(len(set(got[q]) & set(exact[q])) for q in queries) >= 0.9 * 20 * len(queries)


def test_query_reaches_its_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["op7_vp_tree_search"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = brute(rows, [i for i in range(0, 3000, 300)], 20)
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & set(exact[q])) for q in exact) >= 0.9 * 20 * len(exact)


def test_empty_tables(spark):
    assert ann.nearest(table(spark, []), table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(1, [1.0, 2.0])]), table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert found(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])], [1]) == {1: [2]}
