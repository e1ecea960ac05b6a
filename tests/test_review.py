"""Verdicts on dead code, deletions, changes of nodes, evidence of landmarks."""

from codeatlas.operators import review as R

EDGES = "src long, dst long, conf string"


def test_dead_verdicts(spark):
    rows = [(1, "r", "m", False), (2, "live", "m", False), (3, "dyn", "m", True), (4, "imp", "lib", False), (5, "made", "m", False), (6, "called", "m", False), (7, "unsure", "m", False), (8, "none", "m", False), (9, None, None, None)]
    n = spark.createDataFrame(rows, "id long, name string, file string, dynamic boolean")
    e = spark.createDataFrame([(1, 2, "import"), (8, 5, "synthesized"), (8, 6, "import")], EDGES)
    roots, unsure = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([("unsure",), (None,)], "name string")
    used = spark.createDataFrame([("lib",), ("lib",), (None,)], "file string")
    got = {r.id: (r.confidence, r.reason) for r in R.dead_verdicts(n, e, roots, used, unsure).collect()}
    assert got == {3: ("low", "dynamic language"), 4: ("low", "module imported"), 5: ("low", "synthesized edge"), 6: ("medium", "called by dead code"), 7: ("medium", "named in an ambiguous call"), 8: ("high", "no caller"), 9: ("high", "no caller")}
    assert {r.id: r.confidence for r in R.dead_verdicts(n, e, roots, None, unsure).collect()} == {3: "low", 4: "medium", 5: "low", 6: "medium", 7: "medium", 8: "medium", 9: "medium"}


def test_delete_impact(spark):
    e = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 4, "a"), (1, 4, "a"), (3, 5, "a"), (5, 3, "a"), (9, 6, "a")], EDGES)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert {r.id for r in R.delete_impact(e, ids(1), ids(2)).collect()} == {3, 5}
    assert {r.id for r in R.delete_impact(e, ids(1), ids(1, 4)).collect()} == {2, 3, 5}
    assert {r.id for r in R.delete_impact(e, ids(1), ids(6)).collect()} == set()


def test_node_changes(spark):
    row = "id long, signature string, body string, shape string"
    old = [(1, "s", "b1", "x"), (2, "s", "b2", "x"), (3, "s", "b3", "moved"), (4, "s", "b4", "twin"), (5, "s", "b5", "twin"), (6, "s", "b6", "gone"), (7, "s", "b7", None), (8, "s", "b8", "y"), (9, None, None, None)]
    new = [(1, "t", "b1", "x"), (2, "s", "b2", "x"), (13, "s", "b33", "moved"), (14, "s", "b44", "twin"), (17, "u", "b7", "else"), (8, "s", "b88", "y"), (19, None, None, None)]
    edges = [(2, 1, "a"), (2, 6, "a"), (2, 6, "b"), (8, 1, "a"), (1, 6, "a"), (2, 8, "a")]
    got = {tuple(r) for r in R.node_changes(spark.createDataFrame(old, row), spark.createDataFrame(new, row), spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {("renamed", 7, 17, "body"), ("renamed", 3, 13, "shape"), ("ambiguous", 4, None, None), ("ambiguous", 5, None, None), ("removed", 6, None, None), ("removed", 9, None, None), ("added", 14, None, None), ("added", 19, None, None),
                   ("signature", 1, None, None), ("stale-caller", 2, 1, None), ("stale-caller", 2, 6, None)}


def test_landmark_evidence(spark):
    fans = spark.createDataFrame([(1, "a", 5, 5), (2, None, 0, 0), (3, "b", 1, 1), (4, "b", 0, 1)], "id long, file string, fan_in long, fan_out long")
    got = {tuple(r) for r in R.landmark_evidence(fans, spark.createDataFrame([("b", 12), ("a", 11)], "file string, churn long")).collect()}
    assert got == {(1, "hub", "fan-in 5"), (1, "orchestrator", "fan-out 5"), (1, "chokepoint", "fan-in 5, fan-out 5"), (2, "dead", "no edges"), (3, "volatile", "churn 12"), (4, "volatile", "churn 12"), (4, "entrypoint", "fan-out 1")}


def test_select_tests(spark):
    nodes = [(1, "a", False), (2, "a", False), (3, "b", False), (4, "b", False), (5, "c", False), (10, "t", True), (11, "t", True), (12, "t", True), (13, "t", True), (14, None, True), (15, "t", True), (6, None, None)]
    edges = [(10, 1, "x"), (2, 1, "x"), (11, 2, "x"), (11, 2, "y"), (1, 2, "x"), (12, 11, "x"), (13, 12, "x"), (14, 99, "x")]
    known = [(2, 15), (2, 15), (4, 14), (1, 13), (None, 10), (5, None)]
    got = R.select_tests(spark.createDataFrame(nodes, "id long, file string, is_test boolean"), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1,), (3,), (10,), (6,), (77,)], "id long"), spark.createDataFrame(known, "id long, test long"))
    assert {r.test: (r.confidence, r.source, r.path) for r in got.collect()} == {10: ("high", "call", [10, 1]), 11: ("medium", "call", [11, 2, 1]), 12: ("medium", "call", [12, 11, 2, 1]), 13: ("high", "tested_by", [13, 1]), 14: ("low", "same_file", [14]), 15: ("medium", "tested_by", [15, 2, 1])}
