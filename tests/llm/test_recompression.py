"""Recompression against brute force: adversarial words, few different words, repeated ids, long and empty texts."""

import re

import numpy as np
import pytest

from codeatlas.llm import recompress
from codeatlas.llm.queries import QUERIES
from tests.llm.brute import removed

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


def check(spark, rows, **how):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pid int, bucket string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, WORD(r.kept)) for r in recompress.dedup_phrases(table, **how).collect()), key=str)
    assert got == removed(rows, WORD, how.get("width", 13))
    return got


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) & 1] for i in range(n))


def test_words_whose_polynomial_hashes_collide(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    got = check(spark, [(1, f"{thue_morse(1024, 0)} {rest}"), (2, f"{thue_morse(1024, 1)} {rest}"), (3, f"{thue_morse(1024, 0)} {rest}")])
    assert [n for _, _, n, _ in got] == [0, 0, 13]


@pytest.mark.parametrize("letters, rounds, group", [(2, 2, 1 << 20), (3, 2, 600), (6, 2, 400), (6, 1, 900), (40, 3, 700), (400, 2, 500)])
def test_random_words(spark, letters, rounds, group):
    rng = np.random.default_rng(letters + rounds)
    rows = [(int(rng.integers(0, 30)) if k else None, " ".join(f"v{x}" for x in rng.integers(0, letters, int(rng.integers(0, 60))))) for k in range(60)]
    for k in range(40):  # passages of 10 to 30 words, at other places
        words = (rows[k][1] or "").split()
        a = int(rng.integers(0, max(1, len(words))))
        rows.append((int(rng.integers(0, 90)), " ".join([*(f"u{x}" for x in rng.integers(0, 5, 3)), *words[a : a + int(rng.integers(10, 30))], "end"])))
    check(spark, rows, rounds=rounds, group_bytes=group)


def test_nulls_runs_long_texts_and_white_space(spark):
    long = " ".join(f"t{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 30), (5, "b " + "a " * 40 + "c"), (6, "x y " * 20), (7, "q x y" + " x\ty" * 10), (8, long), (9, long[5000:9000]), (None, long[:300]), (None, long[:300]), (10, "a b " * 13), (10, "a b " * 14)]
    check(spark, rows, group_bytes=4096)


def test_empty_table_and_query(spark, tmp_path):
    assert check(spark, []) == []
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "0 one two three four five six seven eight nine ten eleven twelve thirteen 14"), (3, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in QUERIES["op9_recompression_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (13, 0), 2: (15, 13), 3: (2, 0)}
