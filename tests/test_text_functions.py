"""Column functions and operators over code, on values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from codeatlas.functions import text as T
from codeatlas.operators import code as C


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, expected", [
    ("parseHTTPResponse x", ["parsehttpresponse", "parse", "http", "response"]), ("snake_case a", ["snake", "case"]), ("", []),
])
def test_tokenize(spark, value, expected):
    assert one(spark, T.tokenize, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("_helper", None), ("__init__", None), ("mixed_Case", None), ("handle", None), ("MAX_RETRIES", None), ("_parse_tree", "snake_case"),
    ("parseTree", "camelCase"), ("ParseTree", "PascalCase"), ("$x", None), ("_", None), ("", None),
])
def test_naming_case(spark, value, expected):
    assert one(spark, T.naming_case, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("https://example.com/Users/{id}/?q=1#x", "/users/:param"), ("/a//b/", "/a/b"), ("/items/<int:id>/:name", "/items/:param/:param"),
    ("`/x/${user.id}`", "/`/x/:param`"), ("", "/"), ("/", "/"), ("http://h", "/"),
])
def test_normalize_url(spark, value, expected):
    assert one(spark, T.normalize_url, value) == expected


def test_candidate_paths(spark):
    assert one(spark, T.candidate_paths, "/api/v1/users") == ["/api/v1/users", "/users", "/v1/users"]
    assert one(spark, T.candidate_paths, "/v2") == ["/v2", "/"]


@pytest.mark.parametrize("value, expected", [("a/b.test.ts", True), ("x/__tests__/y.js", True), ("pkg/test_a.py", True), ("a_test.go", True), ("src/test/x/A.java", True), ("FooSpec.kt", True), ("src/a.ts", False), ("contest.py", False)])
def test_test_files(spark, value, expected):
    assert one(spark, T.is_test_file, value) is expected


@pytest.mark.parametrize("value, expected", [("a.TSX", "TypeScript"), ("m.tf.json", "Terraform"), ("x.bicep", "Bicep"), ("README", "unknown"), ("a.h", "C++"), ("py", "Python")])
def test_languages(spark, value, expected):
    assert one(spark, T.detect_language, value) == expected


def test_complexity(spark):
    assert one(spark, T.cyclomatic, "if (a && b) { for (;;) {} } else while (x || y) {}") == 6
    x = spark.createDataFrame([("if a and b:\n elif c or d:", "Python")], "t string, l string")
    assert x.select(T.cyclomatic(F.col("t"), F.col("l"))).first()[0] == 5


def test_calls_are_resolved_by_the_first_rung_that_fits(spark):
    functions = spark.createDataFrame([(1, "run", "a", "A"), (2, "run", "b", "B"), (3, "only", "c", "C"), (4, "twin", "b", "B"), (5, "twin", "c", "C"), (6, "run", "a", "D")], "id long, name string, file string, cls string")
    imports = spark.createDataFrame([("a", "twin", "b")], "file string, name string, target string")
    calls = spark.createDataFrame([("1", "a", "D", "run", "self"), ("2", "a", "A", "run", "B"), ("3", "a", "A", "twin", None), ("4", "a", "A", "run", None), ("5", "a", "A", "only", None), ("6", "d", "X", "twin", None), ("7", "d", "X", "gone", None)], "call_id string, file string, cls string, name string, receiver string")
    got = {r.call_id: (r.callee, r.basis) for r in C.resolve_calls(calls, functions, imports).collect()}
    assert got == {"1": (6, "self_cls"), "2": (2, "type_name"), "3": (4, "import"), "4": (1, "same_file"), "5": (3, "name_only"), "6": (None, "ambiguous"), "7": (None, "external")}


def test_the_strongest_hazard_wins(spark):
    writes = spark.createDataFrame([(1, 10, "f", "modify"), (2, 10, "f", "append"), (3, 11, "g", "append"), (4, 11, "g", "append"), (5, 12, "h", "modify")], "task long, id long, file string, mode string")
    reads = spark.createDataFrame([(3, 10), (6, 99), (7, 99)], "task long, id long")
    coupled = spark.createDataFrame([(6, "h")], "task long, file string")
    got = {(r.a, r.b): (r.kind, r.n) for r in C.hazards(writes, reads, coupled).collect()}
    assert got == {(1, 2): ("WAW", 1), (1, 3): ("RAW", 1), (2, 3): ("RAW", 1), (3, 4): ("shared-append", 1), (6, 7): ("WAR", 1), (5, 6): ("soft-coupling", 1)}


def test_the_innermost_span_encloses(spark):
    spans = spark.createDataFrame([("f", 1, 0, 500), ("f", 2, 60, 70), ("f", 3, 62, 72), ("g", 4, 0, 9)], "file string, id long, first long, last long")
    sites = spark.createDataFrame([("f", 65), ("f", 71), ("f", 300), ("f", 501), ("g", 9)], "file string, line long")
    assert {(r.file, r.line): r.owner for r in C.enclosing(sites, spans).collect()} == {("f", 65): 2, ("f", 71): 3, ("f", 300): 1, ("f", 501): None, ("g", 9): 4}


def test_tasks_meet_on_an_item_once(spark, monkeypatch):
    """Both write and read one symbol, and both own and are coupled with one file: one witness each, from one row a pair."""
    seen = []
    monkeypatch.setattr(C, "materialize", lambda df, label: seen.append(df) or df)
    writes = spark.createDataFrame([(1, 10, "f", "append"), (2, 10, "f", "append"), (3, 12, "f", "append")], "task long, id long, file string, mode string")
    reads = spark.createDataFrame([(1, 10), (2, 10), (4, 12)], "task long, id long")
    coupled = spark.createDataFrame([(1, "f"), (2, "f"), (5, "f"), (5, "f")], "task long, file string")
    got = {(r.a, r.b): (r.kind, r.n) for r in C.hazards(writes, reads, coupled).collect()}
    assert got == {(1, 2): ("RAW", 1), (1, 3): ("WAR", 1), (2, 3): ("WAR", 1), (3, 4): ("RAW", 1), (1, 5): ("soft-coupling", 1), (2, 5): ("soft-coupling", 1), (3, 5): ("soft-coupling", 1)}
    assert [df.groupBy("task", c).count().filter("count > 1").count() for df, c in zip(seen, ("id", "file"), strict=True)] == [0, 0]


def test_hazards_of_tasks_in_many_blocks(spark):
    """Each two blocks meet in one place, whether an item is held by few or by many; pairs aren't sent on."""
    import itertools
    import random

    rng = random.Random(7)
    some = lambda n: [None, *range(n)]
    writes = list({(t, i): (t, i, f"f{i % 5}" if i is None or i % 7 else None, rng.choice(["modify", "append", None])) for t, i in ((rng.choice(some(40)), rng.choice(range(60))) for _ in range(150))}.values())
    reads = [(rng.choice(some(40)), rng.choice([*some(60), 3, 3, 3])) for _ in range(120)]
    coupled = [(rng.choice(some(40)), rng.choice([None, "f1", "f2", "f9"])) for _ in range(25)]
    did: dict = {}
    for t, i, f, mode in writes:
        did.setdefault((t, "id", i), set()).update({"write", "modify"} if mode == "modify" else {"write"})
        did.setdefault((t, "file", f), set()).add("own")
    for t, i in reads:
        did.setdefault((t, "id", i), set()).add("read")
    for t, f in coupled:
        did.setdefault((t, "file", f), set()).add("beside")
    want: dict = {}
    for (a, s, i), (b, z, j) in itertools.product(did, did):
        if None not in (a, b, i) and a < b and (s, i) == (z, j):
            x, y = did[a, s, i], did[b, z, j]
            write, cross = "write" in x and "write" in y, lambda m, n: (m in x and n in y) or (n in x and m in y)  # noqa: E731, B023
            change = "modify" in x or "modify" in y
            kinds = [write and change, cross("write", "read"), write and not change, cross("read", "read") or cross("own", "own"), cross("own", "beside")]
            for k in (k for k, hit in enumerate(kinds) if hit):
                want.setdefault((a, b), {}).setdefault(k, 0)
                want[a, b][k] += 1
    best = {p: (C.HAZARDS[min(n)], n[min(n)]) for p, n in want.items()}
    w, r, c = spark.createDataFrame(writes, "task long, id long, file string, mode string"), spark.createDataFrame(reads, "task long, id long"), spark.createDataFrame(coupled, "task long, file string")
    for block in (2, 7, 100):
        got = C.hazards(w, r, c, block=block)
        rows = got.collect()
        assert len(rows) == len(best) and {(x.a, x.b): (x.kind, x.n) for x in rows} == best
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
