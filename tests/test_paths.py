"""Paths and betweenness against brute force."""

import itertools
import random
from collections import defaultdict

import pytest

from codeatlas.operators import paths as P
from codeatlas.operators.fixpoint import numbered
from codeatlas.sources.tables import COST


def graph(seed, n=9, m=22):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.choice([*COST, "external"])) for _ in range(m)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, conf string")


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def walks(edges, sources, targets, most):
    """All simple paths that stop at the first target, by trying everything."""
    out, nodes = set(), {x for e in edges for x in e[:2]}
    pairs = {e[:2] for e in edges}
    for k in range(1, most + 1):
        for p in itertools.permutations(nodes, k + 1):
            if p[0] in sources and p[-1] in targets and not set(p[1:-1]) & set(targets) and all(q in pairs for q in itertools.pairwise(p)):
                out.add(p)
    return out


@pytest.mark.parametrize("seed", [1, 5])
def test_simple_paths(spark, seed):
    edges, sources, targets = graph(seed, 7, 16), [0, 3], [3, 5]
    want = walks(edges, sources, targets, 4)
    got = [tuple(r.path) for r in P.simple_paths(frame(spark, edges), ids(spark, sources), ids(spark, targets), 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    first = P.best_simple_paths(frame(spark, edges), ids(spark, sources), ids(spark, targets), 4, 2).collect()
    assert [tuple(r.path) for r in first] == sorted(want, key=lambda p: (len(p), p))[:2] and first[0].found == len(want)
    assert P.simple_paths(frame(spark, edges), ids(spark, [77]), ids(spark, targets), 4).count() == 0


def test_cheapest_paths(spark):
    edges = graph(4, 10, 26)
    cost = defaultdict(lambda: 99)
    for a, b, c in edges:
        if c in COST:
            cost[a, b] = min(cost[a, b], COST[c])
    best = {}
    for k in range(1, 10):
        for p in itertools.permutations(range(10), k + 1) if k < 5 else ():
            d = sum(cost[q] for q in itertools.pairwise(p))
            if p[0] in (0, 1) and not {0, 1} & set(p[1:]) and d <= 12:
                best[p[-1]] = min(best.get(p[-1], (99, 9)), (d, k))
    got = P.cheapest_paths(frame(spark, edges), ids(spark, [0, 1]), ids(spark, [0, 4, 5, 6, 7, 8, 9]), alternates=9).collect()
    assert {r.id: (r.distance, r.hops) for r in got} == {i: x for i, x in best.items() if i >= 4} and got
    for r in got:
        assert r.path[0] in (0, 1) and r.path[-1] == r.id and len(r.path) == r.hops + 1 and sum(cost[q] for q in itertools.pairwise(r.path)) == r.distance and r.reached == len(got)
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and [(r.distance, r.hops, r.path) for r in got] == sorted((r.distance, r.hops, r.path) for r in got)


def brandes(edges, sources):
    """Dependencies from all shortest paths, one by one; parallel edges are ways of their own."""
    ways = defaultdict(int)
    for a, b, *_ in edges:
        if a != b:
            ways[a, b] += 1
    score = defaultdict(float)
    for s in sources:
        level, number, far = {s: 1}, {s: 1}, {s: 0}
        order = [dict(level)]
        while level:
            nxt = defaultdict(int)
            for v, k in level.items():
                for (a, b), w in ways.items():
                    if a == v and b not in far:
                        nxt[b] += k * w
            for b in nxt:
                far[b], number[b] = len(order), nxt[b]
            level = dict(nxt)
            order.append(level)
        delta = defaultdict(float)
        for level in reversed(order):
            for w in level:
                for (a, b), k in ways.items():
                    if b == w and a in far and far[a] + 1 == far[w]:
                        delta[a] += number[a] / number[w] * k * (1 + delta[w])
                if w != s:
                    score[w] += delta[w]
    return dict(score)


@pytest.mark.parametrize("rows", [1_000_000, 1])
def test_betweenness(spark, rows):
    edges = graph(6, 12, 34) + [(0, 1, "import"), (0, 1, "import"), (2, 2, "import")]
    sources = range(0, 12, 1 if rows > 1 else 5)
    want = brandes(edges, sources)
    got = {r.id: r.score for r in P.betweenness(frame(spark, edges), ids(spark, sources), rows).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want) and max(want.values()) > 1
    assert P.betweenness(frame(spark, []), ids(spark, [1])).count() == 0


def test_subgraph_and_numbers(spark):
    line = [(i, i + 1, "import") for i in range(30)]
    got = {(r.id, r.depth, r.direction) for r in P.subgraph(frame(spark, line), ids(spark, [4]), 2, "both").collect()}
    assert got == {(4, 0, "downstream"), (5, 1, "downstream"), (6, 2, "downstream"), (4, 0, "upstream"), (3, 1, "upstream"), (2, 2, "upstream")}
    assert P.subgraph(frame(spark, line), ids(spark, [0]), 99).count() == 21
    from pyspark.sql import functions as F

    rows = numbered(ids(spark, [i * 7 % 101 for i in range(101)]), [F.desc("id")]).collect()
    assert {r.i: r.id for r in rows} == {i: 100 - i for i in range(101)}
