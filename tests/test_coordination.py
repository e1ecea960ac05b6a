"""Footprints, hazards, escapes, retirement, claims and opened paths, on small cases and against plain Python."""

import heapq
import random

from codeatlas.operators import coordination as K

EDGES = "src long, dst long, conf string"


def graph(spark, edges, n, files=4):
    into = {}
    for a, b, conf in edges:
        if conf != "synthesized":
            into.setdefault(b, set()).add(a)
    rows = [(i, f"f{i % 7}" if i != 1 else None, f"file{i % files}" if i != 2 else None, len(into.get(i, ()))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, file string, fan_in long"), spark.createDataFrame(edges, EDGES), rows


def random_edges(n, m, seed=3):
    r = random.Random(seed)
    kinds = ["import", "type_name", "name_only", "synthesized", "external"]
    return [(r.randrange(n), r.randrange(n), r.choice(kinds)) for _ in range(m)]


def test_footprints_equal_brute_force(spark):
    edges = random_edges(30, 45)
    fans, e, rows = graph(spark, edges, 30)
    tasks = [(1, "3", "append"), (1, "3", None), (1, "nothing", None), (2, "file1", "append"), (3, "f5", "modify"), (None, "3", None), (4, None, None)]
    t = spark.createDataFrame(tasks, "task long, seed string, mode string")
    coupled = spark.createDataFrame([("file3", "file9"), ("file3", "file3"), ("file1", None), (None, "file8")], "file string, other string")
    prints = K.footprints(t, fans, e, coupled, 4, 2)
    got = {(r.task, r.part, r.item, r.file, r.mode) for r in prints.collect()}
    assert len(got) == prints.count()
    bound = sorted(r[3] for r in rows)[min(29, -(-99 * 29 // 100))]
    file = {r[0]: r[2] for r in rows}
    cost = {"import": 1, "type_name": 2, "name_only": 3, "synthesized": 4}
    writes = {1: {3: "modify"}, 2: {r[0]: "append" for r in rows if r[2] == "file1"}, 3: {r[0]: "modify" for r in rows if r[1] == "f5"}}
    want = {(1, "unresolved", "nothing", None, None)}
    for task, w in writes.items():
        want |= {(task, "write", str(i), file[i], m) for i, m in w.items()}
        dist, heap = {}, [(0, i) for i in w]
        while heap:
            k, i = heapq.heappop(heap)
            if i in dist or k > 4:
                continue
            dist[i] = k
            for a, b, conf in edges:
                if a == i and conf in cost:
                    heapq.heappush(heap, (k + cost[conf], b))
        fan = {r[0]: r[3] for r in rows}
        want |= {(task, "ambient" if fan[i] > bound else "read", str(i), file[i], None) for i in dist if i not in w}
        back = set(w)
        for _ in range(2):
            back |= {a for a, b, _ in edges if b in back}
        want |= {(task, "affected", str(i), file[i], None) for i in back - set(w)}
        mine = {file[i] for i in w}
        want |= {(task, "coupled", o, o, None) for f, o in [("file3", "file9"), ("file3", "file3")] if f in mine and o not in mine}
        if "file1" in mine:
            want.add((task, "coupled", None, None, None))
    assert {x for x in got if x[2]} == {x for x in want if x[2]}


def test_hazards_of_pairs_and_crowds(spark):
    held = [(1, "symbol", "a", "modify"), (2, "symbol", "a", "append"), (1, "symbol", "b", "read"), (3, "symbol", "b", "append"), (3, "symbol", "c", "ambient"), (1, "symbol", "c", "append"),
            (2, "symbol", "d", "append"), (3, "symbol", "d", "append"), (2, "file", "x", "own"), (4, "file", "x", "beside"), (4, "symbol", "e", "ambient"), (5, "symbol", "e", "ambient"), (4, "file", "y", "own"), (5, "file", "y", "own")]
    held += [(t, "symbol", "hot", "modify") for t in range(1, 6)]
    h = spark.createDataFrame(held, "task long, space string, item string, role string")
    got = {(r.a, r.b): (r.kind, r.direction, r.n, r.witness) for r in K.interference(K.contacts(h, 4)).collect()}
    assert got == {(1, 2): ("WAW", None, 1, "a"), (1, 3): ("RAW", "bidirectional", 2, "b"), (2, 3): ("shared-append", None, 1, "d"), (2, 4): ("soft-coupling", None, 1, "x"), (4, 5): ("WAR", None, 1, "y")}
    assert [(r.item, r.tasks, r.modify) for r in K.crowds(h, 4).collect()] == [("hot", 5, 5)]
    assert K.interference(K.contacts(h, 5)).filter("kind = 'WAW'").count() == 10
    assert K.interference(K.contacts(h.limit(0), 4)).count() == 0


def test_escapes(spark):
    prints = spark.createDataFrame([(1, "write", "a", "F", "modify"), (1, "read", "b", "G", None), (2, "write", "b", "G", "append"), (2, "write", "c", "F", "append"), (3, "write", "c", "F", "append"), (2, "write", "z", None, "modify")], "task long, part string, item string, file string, mode string")
    did = [(1, "a", "F", "modifies-existing"), (1, "b", "G", "pure-addition"), (1, "c", "F", "added"), (1, "c", "F", None), (1, "q", None, "added"), (2, "c", "F", "added"), (3, "c", "F", "removed"), (None, "c", "F", "added"), (3, None, "F", "added"), (3, "z", "H", "added")]
    got = {(r.task, r.item): (r["class"], r.modify, r.append, r.verdict) for r in K.escapes(prints, spark.createDataFrame(did, "task long, item string, file string, nature string")).collect()}
    assert got == {(1, "b"): ("read-set-intrusion", 0, 1, "merge"), (1, "c"): ("scope-creep-within-file", 0, 2, "WAW"), (1, "q"): ("out-of-scope-write", 0, 0, None), (2, "c"): (None, 0, 1, "merge"), (3, "z"): ("out-of-scope-write", 1, 0, "WAW")}


DECISIONS = [("0000000a", None, "approved"), ("0000000b", "0000000a", "draft"), ("0000000c", "0000000b", None), ("0000000d", "0000000c", "rejected"), ("0000000e", "0000000e", "approved"),
             ("0000000f", "0000001f", "approved"), ("0000001f", "0000000f", "approved"), ("0000002f", "0000000a", "phantom"), ("0000003f", "0000000f", "approved"), (None, None, None)]


def test_retirement_and_stale_references(spark):
    gone = K.retirement(spark.createDataFrame(DECISIONS, "id string, supersedes string, status string"))
    assert {r.id: r.superseded_by for r in gone.collect()} == {"0000000a": "0000000c", "0000000b": "0000000c", "0000000f": "0000001f", "0000001f": "0000000f"}
    texts = [(1, "by 0000000a\n# One\n0000000a and 0000000b\n## Two \n0000000a gave way to 0000000c\n#no heading 0000000b x0000000a"), (2, None), (3, ""), (4, "0000000c 0000000a0")]
    found = K.stale_references(spark.createDataFrame(texts, "id long, text string"), gone)
    assert {(r.id, r.block, r.heading, r.retired) for r in found.collect()} == {(1, 0, "", "0000000a"), (1, 1, "One", "0000000a"), (1, 1, "One", "0000000b")}


def test_claims(spark):
    edges = [(1, 2, "import"), (2, 3, "synthesized"), (3, 4, "type_name"), (4, 1, "import"), (6, 7, "synthesized"), (7, 8, "import"), (9, 9, "import")]
    nodes = [(i, "twin" if i in (5, 6) else f"n{i}") for i in range(1, 11)] + [(11, None)]
    claims = [("a", "calls", "1", "2"), ("b", "calls", "n2", "3"), ("c", "calls", "2", "1"), ("d", "reaches", "1", "n4"), ("e", "reaches", "1", "9"), ("f", "impacts", "4", "1"), ("g", "impacts", "8", "1"),
              ("h", "dead", "2", None), ("i", "dead", "8", None), ("j", "dead", "9", None), ("k", "safe-to-change", "7", None), ("l", "safe-to-change", "10", "x"), ("m", "safe-to-change", "4", None), ("n", "dead", "twin", None),
              ("o", "calls", "1", "twin"), ("p", "reaches", "1", None), ("q", "what", "1", "2"), ("r", "decision-current", "0000000c", None), ("s", "decision-current", "0000000b", None), ("t", "decision-current", "0000000d", None),
              ("u", "decision-current", "no id", None), ("v", "decision-current", "ffffffff", None), ("w", None, None, None), ("x", "reaches", "5", "5")]
    got = K.verify_claims(spark.createDataFrame(claims, "claim string, kind string, subject string, object string"), spark.createDataFrame(nodes, "id long, name string"), spark.createDataFrame(edges, EDGES),
                          spark.createDataFrame([(1,), (6,)], "id long"), spark.createDataFrame(DECISIONS, "id string, supersedes string, status string"))
    y, n, u = "confirmed", "refuted", "unverifiable"
    assert {r.claim: (r.verdict, r.reason, r.hops) for r in got.collect()} == {
        "a": (y, "direct edge", None), "b": (y, "synthesized edge", None), "c": (n, "no edge", None), "d": (y, "path", 3), "e": (n, "no path", None), "f": (y, "path", 3), "g": (n, "no path", None),
        "h": (n, "reached", None), "i": (u, "reached by synthesized edges", None), "j": (y, "unreached", None), "k": (u, "synthesized callers", None), "l": (y, "no callers", None), "m": (n, "callers", None), "n": (u, "subject ambiguous", None),
        "o": (u, "object ambiguous", None), "p": (u, "object not found", None), "q": (u, "unknown kind", None), "r": (y, "current", None), "s": (n, "superseded", None), "t": (n, "rejected", None),
        "u": (u, "not a decision id", None), "v": (u, "not recorded", None), "w": (u, "unknown kind", None), "x": (y, "path", 0)}


def test_certificate(spark):
    old, new = [(1, 2, "import"), (5, 6, "import")], [(1, 2, "import"), (2, 3, "import"), (2, 4, "import"), (3, 9, "import"), (4, 9, "import"), (7, 8, "import")]
    x = K.certificate(spark.createDataFrame(old, EDGES), spark.createDataFrame(new, EDGES), spark.createDataFrame([(9,)], "id long"))
    assert {(r.change, r.src, r.dst): r.path for r in x.collect()} == {("opened", 2, 3): [2, 3, 9], ("opened", 2, 4): [2, 4, 9], ("opened", 3, 9): [3, 9], ("opened", 4, 9): [4, 9], ("added", 7, 8): None, ("removed", 5, 6): None}


def test_meetings_search_from_both_ends(spark, monkeypatch):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)}) + [(100 + i, 101 + i) for i in range(40)] + [(200, 201)]
    asked = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(7, 7), (100, 107), (107, 100), (100, 200), (None, 3)]
    written = []
    write = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, label: written.append(label) or write(df, label))
    p = spark.createDataFrame(pairs, "src long, dst long")
    meet = lambda x: {(r.start, r.goal): r.hops for r in K.meetings(spark.createDataFrame(x, "start long, goal long"), p).collect()}
    want = {}
    for a, b in {x for x in asked if x[0] is not None}:
        far, todo = {a: 0}, [a]
        for n in todo:
            for s, t in pairs:
                if s == n and t not in far:
                    far[t] = far[n] + 1
                    todo.append(t)
        if b in far:
            want[a, b] = far[b]
    assert meet(asked) == want
    written.clear()
    assert meet([(100, 200)]) == {} and len(written) < 12  # nobody calls 200: forty steps from 100 tell no more
