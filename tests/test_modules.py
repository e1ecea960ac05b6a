"""Re-exports, specifiers and class hierarchies against brute force."""

import posixpath
import random

from pyspark.sql import functions as F

from codeatlas.operators import modules as M


def test_chains_end_or_run_in_circles(spark):
    rng = random.Random(2)
    nxt = {i: rng.choice([None, *range(60)]) for i in range(60)} | {i: i + 1 for i in range(100, 170)} | {200: 201, 201: 202, 202: 200, 203: 200, 300: 999}
    got = {r.node: (r.end, r.hops, r.cyclic) for r in M.follow(spark.createDataFrame(list(nxt.items()), "node long, next long")).collect()}
    for i in nxt:
        at, hops = i, 0
        while nxt.get(at) is not None and hops < 500:
            at, hops = nxt[at], hops + 1
        assert got[i] == ((None, None, True) if hops == 500 else (at, hops, False))
    assert got[999] == (999, 0, False) and got[100][:2] == (170, 70)


def test_exports(spark):
    rows = [
        ("a", "named", "x", "b", 1), ("b", "star", None, "c", 1), ("b", "star", None, "d", 2), ("c", "star", None, "c2", 1), ("d", "own", "x", None, 1), ("c2", "own", "y", None, 1),
        ("p", "named", "z", "q", 1), ("q", "named", "z", "p", 1), ("r", "star", None, "p", 1), ("e", "own", "x", None, 5), ("e", "named", "x", "a", 1), ("s", "star", None, "s", 1),
        ("t", "named", "x", "far", 9), ("t", "named", "x", "a", 2),
    ]
    wanted = [("a", "x"), ("b", "y"), ("p", "z"), ("r", "z"), ("e", "x"), ("s", "x"), ("nowhere", "x"), ("t", "x"), ("d", "x"), ("d", "none")]
    table = spark.createDataFrame(rows, "module string, kind string, name string, source string, position int")
    got = {(r.module, r.name): (r.definer, r.hops, r.cyclic) for r in M.resolve_exports(table, spark.createDataFrame(wanted, "module string, name string")).collect()}
    assert got == {
        ("a", "x"): ("d", 2, False), ("b", "y"): ("c2", 2, False), ("p", "z"): (None, None, True), ("r", "z"): (None, None, True), ("e", "x"): ("e", 0, False), ("s", "x"): ("s", 0, False),
        ("nowhere", "x"): ("nowhere", 0, False), ("t", "x"): ("d", 3, False), ("d", "x"): ("d", 0, False), ("d", "none"): ("d", 0, False),
    }
    assert M.resolve_exports(table.limit(0), spark.createDataFrame(wanted[:1], "module string, name string")).first().definer == "a"


def test_paths_and_specifiers(spark):
    paths = ["a/b/../c/./d", "a//b", "../x/../y", "a/../../b", "", "./a", "a/b/.."]
    got = [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").select(M.normal_path(F.col("p")).alias("p")).collect()]
    assert got == [posixpath.normpath(p) if posixpath.normpath(p) != "." else "" for p in paths]
    files = ["src/a.ts", "src/b/index.tsx", "src/b.ts", "src/c.js", "src/c.ts", "src/d.test.ts"]
    asked = [("src/x.ts", "./a", "src/a.ts"), ("src/x.ts", "./b", "src/b.ts"), ("src/b/y.ts", "..", None), ("src/x.ts", "./c.js", "src/c.js"), ("src/x.ts", "pkg", None), ("src/b/y.ts", "../c", "src/c.ts"), ("src/x.ts", "./a.js", "src/a.ts"), ("src/x.ts", "./gone", None), ("src/x.ts", "./b/", "src/b.ts")]
    table = spark.createDataFrame([a[:2] for a in asked], "file string, specifier string")
    found = {(r.file, r.specifier): r.target for r in M.resolve_specifiers(table, spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert found == {a[:2]: a[2] for a in asked}


def test_hierarchies(spark):
    rng = random.Random(4)
    inherits = [(i, rng.randrange(i)) for i in range(1, 40)] + [(i, rng.randrange(i)) for i in range(2, 40, 3)] + [(50, 51), (51, 52), (52, 50), (53, 53)]
    up = {}
    for c, p in inherits:
        up.setdefault(c, set()).add(p)

    def above(c):
        depth, front = {}, {c}
        for k in range(1, 50):
            front = {p for x in front for p in up.get(x, ()) if p not in depth and p != c}
            depth |= dict.fromkeys(front, k)
        return depth

    frame = spark.createDataFrame(inherits, "child long, parent long")
    want = {(b, c): k for c in up for b, k in above(c).items()}
    below = M.descendants(frame)
    assert {(r.base, r["sub"]): r.depth for r in below.collect()} == want and max(want.values()) >= 5
    methods = [(f"{c}.{n}", c, n) for c in range(40) for n in "ab" if rng.random() < 0.4]
    own = {(c, n): i for i, c, n in methods}
    calls = [(k, rng.choice([None, *range(45)]), rng.choice("abz")) for k in range(60)]
    expect = set()
    for k, cls, n in calls:
        if cls is None:
            continue
        levels = {0: {cls}}
        for b, d in above(cls).items():
            levels.setdefault(d, set()).add(b)
        nearest = next((found for d in sorted(levels) if (found := {own[c, n] for c in levels[d] if (c, n) in own})), set())
        expect |= {(k, m) for m in nearest if len(nearest) == 1} | {(k, own[c, n]) for (b, c) in want if b == cls and (c, n) in own}
    got = M.dispatch(spark.createDataFrame(calls, "call long, receiver long, name string"), frame, spark.createDataFrame(methods, "id string, cls long, name string"), most=3).collect()
    assert {(r.call, r.callee) for r in got} == expect and {r.basis for r in got} == {"declared-type"}
    loose = M.dispatch(spark.createDataFrame([(1, None, "a")], "call long, receiver long, name string"), frame, spark.createDataFrame(methods, "id string, cls long, name string"), most=99).collect()
    assert {r.callee for r in loose} == {i for i, _, n in methods if n == "a"} and {r.basis for r in loose} == {"name-only"}
