"""Quality rules, vector codes and whitening against brute force, and what they do with odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeatlas.llm import codes, rules, whiten
from codeatlas.llm.queries import QUERIES

CLEAN = "The house by the river is old, and it was built for a family of the town. " * 3 + " ".join(f"Line{i} of the" for i in range(20))


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(grams) < 2000 else set()
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


TEXTS = [
    (1, CLEAN), (2, None), (3, ""), (4, " \n\t \x0b "), (5, "a b c a b c a b c"), (6, "x x x x"), (7, "x x x"), (8, "one word \x1f sep\x1carated 你好😀 é"),
    (9, "same line\nsame line\n\nsame line \n \n#*$%&|<> # other"), (1, CLEAN), (None, "a b a b a"), (10, "THE HOUSE!! " * 80), (11, CLEAN.replace(" ", "### ")), (12, " ".join(f"w{i}" for i in range(60_000))),
    (13, " | ".join(f"zq{i}" for i in range(100))), (14, "\r\nend\r\nend\r"),
]


def test_counts_and_verdicts(spark):
    got = rules.judge(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *measures(t)) for i, t in TEXTS), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) and r.kept == (r.failed == [])
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[12].failed == ["stop_words"] and "capitals" in by[10].failed and "symbols" in by[11].failed and "symbols" in by[13].failed


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#", max_size=60), min_size=1, max_size=12))
def test_counts_of_any_text(spark, texts):
    got = rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: measures(t) for i, t in enumerate(texts)}


def test_rules_use_no_functions_of_the_user_and_any_columns(spark):
    t = spark.createDataFrame([("kept?", 3, CLEAN, 7)], "Kept string, N_WORDS int, text string, doc0_ int")
    out = rules.judge(t, (rules.Rule("long", "n_words", least=10_000),))
    assert out.columns == ["text", "doc0_", *rules.RESULTS]
    row = out.first()
    assert row.failed == ["long"] and not row.kept and not row.base_failed and row.doc0_ == 7
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|ScalaUDF", plan)
    assert rules.judge(t.limit(0)).count() == 0


def lloyd(rows, parts=4, entries=256, rounds=4):
    """(codes, errors, codebooks) of whole-number vectors, in order of id."""
    x = np.floor(1024 * np.array(rows, float)).astype(np.int64).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for turn in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)]
        index = [y.argmin(1) for y in d]
        if turn == rounds:
            return ["".join(f"{i[r]:02x}" for i in index) for r in range(len(x))], [int(sum(y[r, i[r]] for y, i in zip(d, index, strict=True))) for r in range(len(x))], books
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[index[p] == e, p]
                if len(own):
                    books[p][e] = [s // len(own) for s in own.sum(0).tolist()]


@pytest.mark.parametrize("n", [7, 900])
def test_codes_equal_brute_force(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)).round(2 if n > 100 else 0)
    x[n // 2 :: 3] = x[1]
    labels = [None if i % 5 == 0 else i % 3 for i in range(n)]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [(-5, None, 1), (-4, [float("nan")] + [0.0] * 15, 1), (-3, [None] + [0.0] * 15, 1), (-2, [float("inf")] + [0.0] * 15, 1), (-1, [1.0] * 4, 1), (-6, [], 1)]
    spark.createDataFrame(rows[::-1] + odd, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()}
    code, error, books = lloyd(x)
    assert {i: (r.code, r.error) for i, r in got.items()} == {i: (code[i], error[i]) for i in range(n)}
    assert all(got[i].label_error == sum(e for e, k in zip(error, labels, strict=True) if k == labels[i]) for i in range(n))
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()}


def test_codes_of_odd_tables(spark):
    kind = "ID long, embedding array<float>, Code string"
    twice = [(1, [0.5, 0.25, 1.0], "a"), (1, [0.5, 0.25, 1.0], "b"), (None, [9.0, 9.0, 9.0], "c")]
    got = codes.compress(spark.createDataFrame(twice, kind), parts=2, entries=2, rounds=1, id_col="ID", label_col="Code")
    # both first entries are equal: all go to the lower, whose mean moves away, and the other stays
    own = {r.label: (r.vec_id, r.code) for r in got.rows.collect()}
    assert own == {"a": (1, "0101"), "b": (1, "0101"), "c": (None, "0000")}
    assert got.codebooks[0].tolist() == [[3413, 3242], [512, 256]] and {r.error for r in got.rows.filter("vec_id = 1").collect()} == {0}
    assert [b.shape for b in got.codebooks] == [(2, 2), (2, 2)]  # three components, filled to four
    assert codes.compress(spark.createDataFrame([], kind), id_col="ID", label_col=None).rows.count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 4, "a")], kind), id_col="ID", label_col="Code")


def test_tree_search_is_exact_with_ties():
    rng = np.random.default_rng(4)
    for entries in (rng.integers(-3, 4, (256, 4)), np.zeros((40, 4), np.int64), rng.integers(-90, 90, (3, 4))):
        points = rng.integers(-4, 5, (500, 4))
        index, d = codes.KdTree(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (d == every.min(1)).all()
    far = codes.KdTree(np.array([[0, 0], [1 << 26, 0]])).nearest(np.array([[1 << 25, 1], [(1 << 25) + 1, 1]]))
    assert far[0].tolist() == [0, 1] and far[1].tolist() == [(1 << 50) + 1, ((1 << 25) - 1) ** 2 + 1]


def test_whitening_equals_an_eigendecomposition(spark, tmp_path):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(600, 12)) @ rng.normal(size=(12, 12)) * np.geomspace(3, 0.02, 12) + 50
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(0, c[0].tolist()), (None, c[1].tolist())]
    odd = [(900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, [1.0]), (904, [float("-inf")] * 12)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_whitening"](spark, str(tmp_path)).collect()
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    w = centred @ v / np.sqrt(e)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    deviation = {i: int(((n * r - total).astype(object) ** 2).sum()) for i, r in enumerate(x)}
    share = e / np.var(x, axis=0).sum()
    mine = {(r.vec_id, r.component): r for r in got}
    for k in range(8):
        sign = np.sign(mine[5, k + 1].whitened * w[5, k])
        for i in range(2, 600):
            r = mine[i, k + 1]
            assert abs(r.whitened * sign - w[i, k]) < 1e-6 and r.deviation == deviation[i] and abs(r.explained / share[k] - 1) < 1e-9


def test_whitening_of_few_directions(spark):
    kind = "Component long, embedding array<double>, n int"
    run = lambda rows, **kw: whiten.whiten(spark.createDataFrame(rows, kind), id_col="Component", **kw).collect()
    assert run([]) == [] and run([(1, [1.0, 2.0], 0)]) == [] and run([(i, [1.0, 2.0], 0) for i in range(5)]) == [] and run([(1, [], 0)]) == []
    line = run([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(10)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9 and line[0].identity_error < 1e-9
    assert {r.component for r in run([(i, [float(i % 3), float(i % 7), float(i % 5)], 0) for i in range(105)], components=2)} == {1, 2}
