"""The pipeline and registered queries on planted tables, against what a brute force says of them."""

import numpy as np
import pytest

import corpus_pipeline
from codeatlas.llm.decontam import words_of
from codeatlas.llm.queries import QUERIES
from tests.llm.test_operators import covered

RNG = np.random.default_rng(11)


def prose(n):
    return [f"w{x}" for x in RNG.integers(0, 9000, n)]


ONE, TWO, ITEM = prose(104), prose(104), prose(20)
TEXTS = {
    1: " ".join(ONE), 2: " ".join(ONE[:-20]), 3: " ".join(ONE[:-21]), 4: " ".join(ONE).upper(), 5: " ".join([*prose(40), *ITEM]),
    6: " ".join(TWO) + " password: hunter22abc", 7: None, 8: "", 9: " ".join([*prose(600), *ITEM]),
}
TEXTS[10] = TEXTS[6]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "a", len(t or "")) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TEXTS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline(spark, tables):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, t in TEXTS.items() for w in [(t or "").lower().split()]}
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert similar(1, 2) and not similar(1, 3) and similar(2, 3)  # 80 and 79 of 100 shingles
    left = [i for i in TEXTS if i not in (5,)]
    root = {i: i for i in left}
    for _ in left:
        for a in left:
            for b in left:
                if similar(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    got = [r.doc_id for r in corpus_pipeline.run(spark, tables).collect()]
    assert sorted(got) == sorted(set(root.values())) == [1, 6, 7, 9]


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids = lambda x: sorted(r.doc_id for r in x.collect())
    assert ids(corpus_pipeline.quality_classifier(spark, docs, tables)) == sorted(TEXTS)
    assert ids(corpus_pipeline.simhash_near_dedup(spark, docs.filter("doc_id in (1, 3)"), tables)) == [1, 3]
    assert ids(corpus_pipeline.simhash_near_dedup(spark, docs.filter("doc_id in (1, 2)"), tables)) == [1]
    assert ids(corpus_pipeline.benchmark_decontamination(spark, docs, tables)) == sorted(set(TEXTS) - {5})
    clean = {r.doc_id: r for r in corpus_pipeline.secret_scans(spark, docs, tables).collect()}
    assert "hunter22abc" not in clean[6].text and clean[1].text == TEXTS[1] and clean[6].n_chars == len(clean[6].text)


def test_op6(spark, tables):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op6_decontamination"](spark, tables).collect()}
    assert got == {i: (len(words_of(t)), 20 * (i in (5, 9)), int(i in (5, 9)), i == 5) for i, t in TEXTS.items()}


def test_op9(spark, tables):
    got = {r.doc_id: r.n_removed for r in QUERIES["op9_recompression_dedup"](spark, tables).collect()}
    assert got == {i: n for i, (_, n, _) in covered(list(TEXTS.items()), str.split, 13, tuple).items()}


def test_op1_and_op5_keep_every_row(spark, tables):
    one = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, tables).collect()}
    five = {r.doc_id: r.component_id for r in QUERIES["op5_simhash_dedup"](spark, tables).collect()}
    assert set(one) == set(five) == set(TEXTS) and all(r.keep and not r.toxic for r in one.values())
    assert five[4] == 1 and five[10] == 6 and five[8] == 7
