"""The operators against brute force on small tables: nulls, empty and repeated texts, ties, empty tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from codeatlas.llm import ann, chat, decontam, pieces, quality, recompress, secrets, shard, simhash, suffix
from codeatlas.llm.common import BASES
from codeatlas.llm.queries import tokenizer_file

BASE = " ".join(f"word{i % 37} part{i * 7 % 53}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, "start " + BASE[:400] + " other end"), (4, None), (5, ""), (6, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (7, "x a a a a a a a a a a a a a a a a y"),
    (8, "short"), (9, "ünï " + BASE[100:300]), (10, BASE[:700] + "changed"), (None, BASE[50:500]), (11, "password: hunter22abc AKIA" + "ABCDEFGH12345678 " + "0123456789abcdef" * 2),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def covered(rows, split, width, join):
    first, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, t in order:
        x = split(t or "")
        for k in range(len(x) - width + 1):
            first.setdefault(join(x[k : k + width]), (i is None, i))
    for i, t in order:
        x = split(t or "")
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            a = first[join(x[k : k + width])]
            if a[1] is not None and (i is None or a[1] < i):
                gone[k : k + width] = [True] * width
        out[i] = (len(x), sum(gone), [y for y, g in zip(x, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_suffix(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix.dedup_substrings(docs(spark, rows)).collect()}
    assert got == {k: (a, b, bytes(c)) for k, (a, b, c) in covered(rows, lambda t: list(t.encode()), 50, bytes).items()}


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(1)
    m = rng.integers(1, 3, (300, 12)).astype(np.int16)
    group = np.sort(rng.integers(0, 9, 300))
    order, lcp = suffix.suffix_sort(m, group, BASES[1])
    for g in range(9):
        own = [tuple(m[i]) for i in order if group[i] == g]
        assert own == sorted(own)
    assert (lcp[1:] <= 12).all()


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_recompression(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in recompress.dedup_phrases(docs(spark, rows)).collect()}
    exp = covered(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 13, tuple)
    assert got == {k: (a, b, " ".join(c)) for k, (a, b, c) in exp.items()}


def test_secret_spans(spark):
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(docs(spark))).collect()}
    assert (got[11].n_assign, got[11].n_access, got[11].n_hex) == (1, 1, 1) and got[4].spans == "" and len(got) == len(TEXTS)
    kept = {r.doc_id: r.text for r in secrets.redact(docs(spark)).collect()}
    assert "hunter22abc" not in kept[11] and kept[1] == BASE
    assert secrets.scan(docs(spark, [])).count() == 0


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", " <!|x|> é😀 "), (1, 2, "assistant", None), (None, 0, "assistant", "<<|im_sep|>"), (2, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table, tokenizer_file("byte_bpe_50k.json"))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi <|im_end|>\nassistant\n <!|x|> é😀 \nassistant\n\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(" <!|x|> é😀 "), sha(" <!|x|> é😀 "))
    assert got[None].loss_sha256 == sha("<<|im_sep|>") and got[2].loss_chars == 0


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_simhash_components(spark, bucket_rows):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    fp = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in rows}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows), bucket_rows=bucket_rows).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert fp[8] == sum(1 << b for b in range(64) if xxhash.xxh64_intdigest(b"short", seed=42) >> b & 1)


def test_covering_masks_cover():
    masks = simhash.covering_masks(4, list(range(64)))
    rng = np.random.default_rng(0)
    for _ in range(2000):
        bits = rng.choice(64, 4, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)


def test_keep_one(spark):
    rows = [(1, BASE), (2, BASE), (3, None), (4, ""), (None, "only one here"), (None, "only one here"), (5, BASE)]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs(spark, rows)).collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("group_shingles", [1 << 20, 300])
def test_keep_one_takes_near_copies_from_080(spark, group_shingles):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 104)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-11])), (10 * k + 2, " ".join(words[:-30])), (10 * k + 3, " ".join(words[11:]))]
    rows += [(1000, "a " * 400 + "b c d e f g"), (1001, "a " * 400), (1002, BASE.upper()), (1003, BASE)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id for r in simhash.keep_one(docs(spark, rows), group_shingles=group_shingles).collect()}
    assert got == set(root.values()) and {0, 2, 1000, 1001} <= got and not {1, 3, 1003} & got


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination(spark, block):
    items = spark.createDataFrame([(1, BASE[100:260]), (2, "short"), (3, None), (4, "nothing like it")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs(spark), items, block_windows=block).collect()}
    assert list(got[8]["items"]) == ["2"] and got[8].contaminated and list(got[1]["items"]) == ["1"] and got[4].n_words == 0 and not got[4].contaminated


@pytest.mark.parametrize("rows", [[], [(1, None), (2, " .,! ")]])
def test_decontamination_counts_words_without_a_benchmark(spark, rows):
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontam.contamination(docs(spark), items).collect()}
    assert got == {i: (len(decontam.words_of(t)), 0, [], False) for i, t in TEXTS}


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination_hits_items_without_an_id(spark, block):
    items = spark.createDataFrame([(None, "Short"), (None, BASE[100:260]), (7, BASE[100:260])], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontam.contamination(docs(spark), items, block_windows=block).collect()}
    assert got[8] == (1, [], True) and got[1][0] > 0 and got[1][1] == ["7"] and got[4] == (0, [], False)


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(t, t.filter("vec_id % 20 = 0"), k=5, factor=1.0, shard_rows=200).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 500, 20):
        s = (x * x[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(500), -s)) if i != q][:5]
        assert [got[q][k] for k in range(1, 6)] == order


def test_shards_are_exact(spark):
    named = spark.range(1003).selectExpr("id AS doc", "id AS Slot", "id AS SHARD", "CAST(null AS string) AS doc0_")
    out = shard.shuffle_into_shards(named, 7)
    assert out.columns == ["doc", "doc0_", "shard", "slot"]
    got = out.toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert set(sizes["count"]) == {143, 144} and (sizes["max"] + 1 == sizes["count"]).all() and got.doc.nunique() == 1003
    assert shard.shuffle_into_shards(spark.range(0), 3).count() == 0


def test_pieces_are_optimal_and_round_trip(spark):
    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs(spark, [*TEXTS, (12, "  two\n\nlines 你好😀\t\x1f \x1fa\x1f\x1f x  y ")]), model), model).collect()}
    assert all(got[i].decoded == (t or "") for i, t in [*TEXTS, (12, "  two\n\nlines 你好😀\t\x1f \x1fa\x1f\x1f x  y ")])
    score = {p: (i, s) for p, i, s in model.normal}
    best = [(0.0, 0, [])]
    text = "▁start"
    for j in range(1, len(text) + 1):
        best.append(max(((best[k][0] + score[text[k:j]][1], -k, [*best[k][2], score[text[k:j]][0]]) for k in range(j) if text[k:j] in score), key=lambda c: c[:2]))
    assert np.frombuffer(got[3].packed, np.int32)[: len(best[-1][2])].tolist() == best[-1][2]


def test_quality_shrinks_sites(spark):
    rows = [(i, ("The plain text reads well. " * 6) if i % 2 else "zz### zz%%% " * 9, "a" if i < 40 else "b/x", "en") for i in range(60)] + [(99, None, None, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(t, quality.train(t, labels)).collect()}
    assert len(got) == 61 and got[41].keep and not got[42].keep and 0 < got[99].p_site < 1
    assert quality.score(t.limit(0), quality.train(t, labels.limit(0))).count() == 0


def test_toxic_words_are_caught(spark):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(800):
        own = [words[k] for k in rng.integers(0, 300, 60)]
        if i % 6 == 0:
            own[30] = "Nasty," if i % 4 else "horrid"
        rows.append((i, " ".join(own)))
    rows.append((None, None))
    t = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in quality.score_toxic(t, quality.train_toxic(t, labels)).collect()}
    assert len(got) == 801 and all(got[i] == (i % 6 == 0) for i in range(800)) and not got[None]
    none = quality.train_toxic(t, labels.filter("toxic = 0"))
    assert not any(r.toxic for r in quality.score_toxic(t, none).collect())
    assert quality.score_toxic(t.limit(0), quality.train_toxic(t, labels.limit(0))).count() == 0


def test_near_copies_come_from_simhash(spark, monkeypatch):
    """Candidates are texts of close fingerprints: about 0.151 of the bits differ at 0.8; without close ones nothing goes."""
    rng = np.random.default_rng(8)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, 104)] for _ in range(40)]
    wide = lambda w: simhash.wide_fingerprint(simhash.shingles(" ".join(w), 5)[1]).view(np.uint64)
    away = [int(np.bitwise_count(wide(w) ^ wide(w[:-20])).sum()) for w in texts]
    assert max(away) <= simhash.FAR and abs(np.mean(away) / (64 * simhash.WORDS) - np.arccos(0.8**0.5) / np.pi) < 0.02
    rows = [(2 * k + i, " ".join(t)) for k, w in enumerate(texts) for i, t in enumerate((w, w[:-20]))]
    assert {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()} == set(range(0, 80, 2))
    monkeypatch.setattr(simhash.close_links, "__defaults__", (-1,))
    assert simhash.keep_one(docs(spark, rows)).count() == 80


def test_a_fit_over_many_windows_takes_little_of_the_driver():
    import tracemalloc

    rng = np.random.default_rng(3)
    x = (rng.random((6000, 512)) < 0.2).astype(np.uint8)
    y = (x[:, :8].sum(axis=1) > 1).astype(float)
    tracemalloc.start()
    w = quality.fit(x, y, ridge=10.0, rounds=4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # the sample in numbers of 64 bits is 25 MB
    assert ((w[0] + x @ w[1:] > 0) == (y > 0.5)).mean() > 0.95


def test_links_of_near_copies_become_fewer(spark):
    rows = [(u, v) for v in range(100, 400) for u in (3, 5, 8, 9) if (u + v) % 5] + [(3, 5), (500, 501)]
    links = spark.createDataFrame(rows, "u long, v long")
    few = simhash.fewer(links)
    assert few.count() < 320 < len(rows)
    assert sorted(simhash.components(few).collect()) == sorted(simhash.components(links).collect())


def test_unrelated_texts_are_not_chained_and_leave_no_sets(spark, monkeypatch):
    """Of two million pairs of unrelated fingerprints none is near the bound; sets are written for texts that have others
    close to them alone."""
    rng = np.random.default_rng(12)
    wide = np.array([simhash.wide_fingerprint(rng.integers(1, 1 << 56, 60, np.uint64)) for _ in range(2000)]).view(np.uint64)
    assert min(int(sum(np.bitwise_count(a[i] ^ a[i + 1 :]).astype(int) for a in wide.T).min()) for i in range(len(wide) - 1)) > simhash.FAR + 8
    written = {}
    write = simhash.save
    monkeypatch.setattr(simhash, "save", lambda df, label: written.setdefault(label, write(df, label)) if label in ("sketches", "sets") else write(df, label))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 300))) for i in range(60)]
    rows += [(100, rows[0][1] + " more"), (101, rows[0][1]), (102, rows[0][1].upper())]
    assert {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()} == set(range(60))
    assert written["sets"].count() == 2 and not {"own", "text"} & set(written["sketches"].columns)
