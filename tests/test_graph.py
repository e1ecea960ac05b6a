"""Graph operators on a fixture worked by hand: one cycle, one parallel edge, one external leaf."""

from codeatlas.operators import graph as G

EDGES = [(1, 2, "import"), (1, 3, "same_file"), (2, 4, "name_only"), (3, 4, "import"), (4, 2, "import"), (1, 2, "import"), (3, 9, "external"), (8, 3, "import"), (2, 5, "synthesized")]


def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long, conf string")


def test_bfs(spark):
    got = {r.id: r.depth for r in G.bfs(edges(spark), spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 9: 2}


def test_shortest_drops_external_edges(spark):
    got = {r.id: (r.distance, r.hops) for r in G.shortest(edges(spark), spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (2, 2), 5: (5, 2)}


def test_strong_components(spark):
    assert {(r.id, r.component) for r in G.strong_components(edges(spark)).collect()} == {(2, 2), (4, 2)}


def test_strong_components_of_many_cycles_in_a_row(spark):
    """Sixty cycles, each with an edge to every later one."""
    rows = [(10 * i, 10 * i + 1) for i in range(60)] + [(10 * i + 1, 10 * i) for i in range(60)] + [(10 * i, 10 * j) for i in range(60) for j in range(i + 1, 60)]
    got = {(r.id, r.component) for r in G.strong_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {(10 * i + k, 10 * i) for i in range(60) for k in (0, 1)}


def test_personalized_pagerank_goes_on_until_it_settles(spark):
    n = 30
    ids = spark.createDataFrame([(i,) for i in range(n)], "id long")
    ring = [(i, (i + 1) % n) for i in range(n)]
    got = {r.id: r["rank"] for r in G.personalized_pagerank(ids, spark.createDataFrame(ring, "src long, dst long"), ids.filter("id = 0")).collect()}
    assert all(abs(got[i] - 0.15 * 0.85**i / (1 - 0.85**n)) < 1e-5 for i in range(n))


def test_labels_go_on_until_none_changes(spark):
    """A graph whose labels settle in the eighth round."""
    pairs = [(0, 1), (0, 6), (0, 10), (0, 11), (0, 13), (1, 2), (1, 5), (1, 7), (2, 3), (2, 9), (3, 4), (3, 6), (3, 9), (4, 5), (5, 6), (6, 7), (6, 9), (6, 10), (7, 8), (7, 12), (7, 13), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13)]
    both = [*pairs, *[(b, a) for a, b in pairs]]
    label = {i: i for i in range(14)}
    for _ in range(15):
        votes = {i: [label[a] for a, b in both if b == i] for i in label}
        label = {i: -max((v.count(x), -x) for x in v)[1] for i, v in votes.items()}
    assert {r.id: r.label for r in G.label_rounds(spark.createDataFrame(pairs, "src long, dst long")).collect()} == label


def test_fan_leaves_out_synthesized(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9)], "id long")
    got = {r.id: (r.fan_in, r.fan_out) for r in G.fan(nodes, edges(spark)).collect()}
    assert got[2] == (2, 1) and got[5] == (0, 0) and got[3] == (2, 2)
