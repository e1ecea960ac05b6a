"""Ancestry and waves against brute force."""

import random

import pytest

from codeatlas.operators import commits as H
from codeatlas.operators import waves as V


def closure(parents, root):
    seen, todo = set(), [root]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents.get(c, ())
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_what_held_as_of_a_commit(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = [(i, max(0, i - rng.choice([1, 1, 1, 2, 5])), 0) for i in range(1, n)] + [(i, rng.randrange(i), 1) for i in range(5, n, 4)] + [(9, 999, 2)]
    parents = {}
    for c, p, _ in rows:
        if p < n:
            parents.setdefault(c, set()).add(p)
    facts = [(k, rng.randrange(n), rng.choice([None, *range(n)])) for k in range(80)] + [(80, 999, None), (81, 3, 999), (82, None, 3)]
    index, links = H.chain_index(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(rows, "id long, parent long, nth int"))
    assert index.count() == n and index.select("chain", "pos").distinct().count() == n
    table = spark.createDataFrame(facts, "memory long, recorded long, invalidated long")
    for root in (0, 17, n - 1):
        one = spark.createDataFrame([(root,)], "id long")
        before = closure(parents, root)
        assert {r.memory for r in H.as_of(table, index, links, one).collect()} == {m for m, a, b in facts if a in before and b not in before}
        after = {c for c in range(n) if c != root and root in closure(parents, c)}
        want = {m: "both" if a in after and b in after else "added" if a in after else "invalidated" for m, a, b in facts if a in after or b in after}
        assert {r.memory: r.change for r in H.changed_since(table, index, links, one).collect()} == want
    roots = spark.createDataFrame([(5,), (40,)], "id long")
    reach = H.ancestors(index, links, roots).join(index, "chain").filter("pos <= upto")
    assert {(r.root, r.id) for r in reach.collect()} == {(x, c) for x in (5, 40) for c in closure(parents, x)}


def schedule(tasks, needs, holds):
    done, left, wave = {}, set(tasks), 0
    while True:
        ready = [t for t in sorted(left) if not any(a == t and b in left for a, b in needs)]
        used, now = set(), []
        for t in ready:
            own = {r for x, r in holds if x == t}
            if not own & used:
                used |= own
                now.append(t)
        if not now:
            return done | dict.fromkeys(left)
        wave += 1
        done |= dict.fromkeys(now, wave)
        left -= set(now)


def test_waves_and_chains(spark):
    rng = random.Random(7)
    tasks = list(range(30))
    needs = [(i, rng.randrange(i)) for i in range(3, 26, 2)] + [(i, rng.randrange(i)) for i in range(5, 26, 3)] + [(26, 27), (27, 28), (28, 26), (29, 28), (4, 77)]
    holds = [(i, rng.randrange(6)) for i in tasks if i % 4] + [(i, rng.randrange(6)) for i in tasks if i % 3 == 0]
    t = spark.createDataFrame([(i, 1 + i * 7 % 5) for i in tasks], "task long, cost long")
    n = spark.createDataFrame(needs, "task long, needs long")
    got = {r.task: r.wave for r in V.waves(t, n, spark.createDataFrame(holds, "task long, resource long")).collect()}
    assert got == schedule(tasks, needs, holds) and got[26] is None and got[29] is None
    best = {}
    for i in range(26):
        options = [(*best[b][:2], -b) for a, b in needs if a == i and b < 26]
        top = max(options, default=(0, 0, None))
        best[i] = (top[0] + 1 + i * 7 % 5, top[1] + 1, None if top[2] is None else -top[2])
    chains = {r.task: (r.total, r.steps, r.after) for r in V.longest_chains(t, n).collect()}
    assert {i: chains[i] for i in best} == best and all(chains[i] == (None, None, None) for i in (26, 27, 28, 29))
    assert V.waves(t.limit(0), n, spark.createDataFrame(holds, "task long, resource long")).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_waves_take_rounds_by_blocks_of_tasks(spark, block, monkeypatch):
    rng = random.Random(11)
    tasks = list(range(0, 180, 2))
    needs = [(t, rng.choice([x for x in tasks if x < t])) for t in tasks[5:] if t % 3] + [(tasks[9], tasks[2]), (tasks[9], tasks[8]), (tasks[4], 77)]
    holds = [(t, "hot") for t in tasks if t % 8] + [(t, f"r{rng.randrange(9)}") for t in tasks] + [(tasks[3], "own"), (tasks[3], "hot"), (tasks[3], "hot")]
    written = []
    write = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, label: written.append(label) or write(df, label))
    monkeypatch.setattr(V, "BLOCK", block)
    t = spark.createDataFrame([(x,) for x in tasks], "task long")
    got = {r.task: r.wave for r in V.waves(t, spark.createDataFrame(needs, "task long, needs long"), spark.createDataFrame([*holds, (0, None)], "task long, resource string")).collect()}
    assert got == schedule(tasks, needs, holds) and max(got.values()) > 60
    assert len(written) < 6 + 3 * -(-len(tasks) // block)
