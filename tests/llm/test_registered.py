"""The registered queries of the classifier, the encoding and the pipeline's last stage, against brute force."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from codeatlas.llm import pieces, quality
from codeatlas.llm.queries import QUERIES, tokenizer_file

TEXTS = [(1, "The old house, by the river."), (2, None), (3, ""), (4, "  two\n\nlines 你好😀\t x  y "), (4, "again"), (None, "no id é"), (7, "word " * 9 + "x" * 300)]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, "n") for i, t in TEXTS], "doc_id long, text string, Decoded string").write.parquet(f"{d}/documents.parquet")
    return d


def best_ids(model, text):
    """The ids of the best cut of a text, over all its substrings; characters without a piece are bytes."""
    score = {p: (i, s) for p, i, s in model.normal}
    least = min(s for _, _, s in model.normal) - 10
    t = "▁" + text.replace(" ", "▁")
    best = [(0.0, 0, [])]
    for j in range(1, len(t) + 1):
        own = [(best[k][0] + score[t[k:j]][1], -k, best[k][2] + [score[t[k:j]][0]]) for k in range(max(0, j - 64), j) if t[k:j] in score]
        if t[j - 1] not in score:
            b = best[j - 1]
            own.append((b[0] + least, -(j - 1), b[2] + [model.pieces.index(f"<0x{x:02X}>") for x in t[j - 1].encode()]))
        best.append(max(own, key=lambda c: (round(c[0], 6), c[1])))
    return best[-1][2]


def test_op10_is_the_optimum_and_reads_back(spark, texts):
    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    found = [r for r in QUERIES["op10_sentencepiece"](spark, texts).collect()]
    assert len(found) == len(TEXTS)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), sha((t or "").encode())) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in found) == want
    got = {r.doc_id: r for r in found if r.doc_id != 4}
    for i, t in TEXTS:
        if i == 4:
            continue
        ids = best_ids(model, t) if t else []
        assert got[i].n_ids == len(ids) and got[i].ids_sha256 == sha(np.array(ids, "<i4").tobytes()), t


def test_pipeline_returns_the_ids(spark, texts):
    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{texts}/documents.parquet")
    surface = model.surface()
    got = {r.doc_id: r for r in corpus_pipeline.sentencepiece_encoding(spark, docs, texts).collect() if r.doc_id != 4}
    for i, t in TEXTS:
        if i != 4:
            ids = np.frombuffer(got[i].ids, "<i4").tolist()
            assert len(ids) == got[i].n_ids and pieces._spoken(b"".join(surface[x] for x in ids)) == (t or "") and hashlib.sha256(got[i].ids).hexdigest() == got[i].ids_sha256


def test_op1_draws_the_same_rows_whatever_repeats(spark):
    rows = [(i, f"text {i % 7} of many words and more " * (1 + i % 3), "h", "p") for i in range(60)] + [(5, "another of the same id", "h", "p"), (5, None, "h", "p")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0)], "doc_id long, quality int")
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    chosen = labels.selectExpr("doc_id AS _id", "CAST(quality AS double) AS _y")
    assert quality._labelled(table, chosen, "doc_id", "text").count() == labels.count()
    a, b = quality.train(table, labels), quality.train(table.repartition(7), labels.repartition(3))
    assert np.array_equal(a, b)
