"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

A window (``width`` consecutive item words, or a shorter item as a whole) is a set of shingles at fixed places, and a
document contains it only if it contains every one of them. So a one-shingle prefix is enough: shingles are put in
order of rarity over the whole corpus, and the rarest one of each window is joined. A match at a place of the document
gives the window's start; the window must fit in the document there (length and positional bounds), and is then
compared word by word over its own size.

The benchmark is read in blocks of bounded size, ``block_windows`` windows each; a block's index goes to the tasks as
a broadcast of that bound, and documents pass the blocks one after another, with what is found so far written between
them, so no row is joined with all items and a task holds one block.

Null text has no words. Items without words have no windows. Item ids are text in the results; items that share an
id count once, and the windows of items without an id count as hits only. Documents are rows of their own, whatever
their ids; their columns stay, whatever their names, but for those named like a result, which it replaces. An empty
table gives no rows; without a benchmark nothing is hit. Texts are searched whole; the places of shingles in them are
compared some at a time, so a very long text takes memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import apart, give_back, save

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and anything that isn't ASCII."""
    return (text or "").encode().translate(_LOWER).split()


class Index:
    """One block of benchmark windows, to search documents for."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int, shingle: int):
        self.width, self.shingle = width, shingle
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).update(() if item is None else (item,))
        self.items = [sorted(x) for x in windows.values()]
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.words = np.zeros((len(windows), width), np.int64)
        for row, x in zip(self.words, windows, strict=True):
            row[: len(x)] = x
        self.base = len(self.vocabulary) + 1
        # a window of fewer words than a shingle has one shingle, of its own size
        self.size = np.minimum(self.lengths, shingle)
        self.keys = {k: np.unique(np.concatenate([self._shingles(self.words[self.size == k], k, self.lengths[self.size == k])[0], np.zeros(0, np.int64)])) for k in np.unique(self.size).tolist()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _shingles(self, words: np.ndarray, k: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the shingles of k words, the row and the place of each."""
        n = words.shape[1] - k + 1
        key = np.zeros((len(words), max(n, 0)), np.int64)
        for j in range(k):
            key = key * self.base + words[:, j : j + n]
        row, place = np.nonzero(np.arange(n) < (lengths - k + 1)[:, None])
        return key[row, place], row, place

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Take each window's rarest shingle, given how many documents hold each (size, key)."""
        for k, keys in self.keys.items():
            own = np.flatnonzero(self.size == k)
            key, row, place = self._shingles(self.words[own], k, self.lengths[own])
            held = np.array([counts.get((k, x), 0) for x in keys.tolist()], np.int64)[np.searchsorted(keys, key)]
            best = np.lexsort((place, key, held, row))
            first = np.concatenate([[True], np.diff(row[best]) != 0])
            best = best[first]
            best = best[np.argsort(key[best], kind="stable")]
            prefix, at = np.unique(key[best], return_index=True)
            self.prefix[k] = prefix, np.concatenate([at, [len(best)]]), own[row[best]], place[best]

    def ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The documents' word ids one after another (0: in no window), two zeros between; where each starts."""
        get, out, starts, at = self.vocabulary.get, [], [], 0
        gap = np.zeros(self.width, np.int64)
        for words in docs:
            starts.append(at)
            out += [np.fromiter((get(w, 0) for w in words), np.int64, len(words)), gap]
            at += len(words) + self.width
        return np.concatenate(out or [gap]), np.array(starts, np.int64)

    def document_keys(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where k known words stand in a row, and the keys of those shingles."""
        known = ids > 0
        ok = known[: len(ids) - k + 1].copy()
        for j in range(1, k):
            ok &= known[j : len(ids) - k + 1 + j]
        at = np.flatnonzero(ok)
        key = np.zeros(len(at), np.int64)
        for j in range(k):
            key = key * self.base + ids[at + j]
        return at, key

    def held(self, docs: list[list[bytes]]) -> dict[tuple[int, int], int]:
        """How many of the documents hold each shingle of the block."""
        out: dict[tuple[int, int], int] = {}
        ids, starts = self.ids(docs)
        for k, keys in self.keys.items():
            at, key = self.document_keys(ids, k)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            pair = np.unique((np.searchsorted(starts, at[hit], "right") << 32) + i[hit])
            for j, n in zip(*(x.tolist() for x in np.unique(pair & 0xFFFFFFFF, return_counts=True)), strict=True):
                out[k, int(keys[j])] = n
        return out

    def search(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, set[str]]]:
        """Of each document: starts and ends of the windows in it, and their items."""
        ids, starts = self.ids(docs)
        where, which = [], []
        for k, (prefix, cut, window, place) in self.prefix.items():
            at, key = self.document_keys(ids, k)
            i = np.minimum(np.searchsorted(prefix, key), len(prefix) - 1)
            hit = prefix[i] == key
            at, i = at[hit], i[hit]
            many = cut[i + 1] - cut[i]
            ends = np.cumsum(many)
            step = 1 << 19
            total = int(ends[-1]) if len(ends) else 0
            for a in range(0, total, step):
                j = np.arange(a, min(a + step, total))
                m = np.searchsorted(ends, j, "right")
                c = cut[i[m]] + j - (ends[m] - many[m])
                w = window[c]
                s = at[m] - place[c]
                ok = (s >= 0) & (s + self.lengths[w] <= len(ids))
                s, w = s[ok], w[ok]
                same = np.ones(len(s), bool)
                for t in range(self.width):
                    inside = t < self.lengths[w]
                    same &= ~inside | (ids[np.minimum(s + t, len(ids) - 1)] == self.words[w, t])
                where.append(s[same])
                which.append(w[same])
        s = np.concatenate(where or [np.zeros(0, np.int64)])
        w = np.concatenate(which or [np.zeros(0, np.int64)])
        doc = np.searchsorted(starts, s, "right") - 1
        order = np.argsort(doc, kind="stable")
        s, w, doc = s[order], w[order], doc[order]
        cut = np.searchsorted(doc, np.arange(len(docs) + 1))
        out = []
        for d in range(len(docs)):
            p = slice(cut[d], cut[d + 1])
            out.append((s[p] - starts[d], s[p] - starts[d] + self.lengths[w[p]], {x for y in np.unique(w[p]).tolist() for x in self.items[y]}))
        return out


def blocks(benchmark: DataFrame, width: int, block_windows: int, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in parts of about ``block_windows`` windows: an item counts at most one window for every two of
    its characters."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    n = max(1, int(-(-total // block_windows)))
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, shingle: int = 3, share: int = 20, block_windows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_hit (words inside a window of the benchmark), items (array of the ids found,
    sorted) and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    if not 0 < shingle <= width:
        raise ValueError("shingle must be from 1 to width")
    spark = docs.sparkSession
    away, names, back = apart(docs, ("n_words", "n_hit", "items", "contaminated"))
    text = names[text_col]
    out = away.withColumns({"hits": F.lit(None).cast("binary"), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")})
    searched = False
    parts = blocks(benchmark, width, block_windows, item_col, item_text_col)
    for i, part in enumerate(parts):
        index = Index([(r["item"], words_of(r["text"])) for r in part.toLocalIterator()], width, shingle)
        if not index.items:
            continue

        searched = True
        shared = spark.sparkContext.broadcast(index)

        def rarity(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], int] = {}
            for x in frames:
                for key, n in shared.value.held([words_of(t) for t in x["text"]]).items():
                    total[key] = total.get(key, 0) + n
            give_back()
            yield pd.DataFrame([(k, v, n) for (k, v), n in total.items()], columns=["size", "key", "n"])

        counts = away.select(F.col(text).cast("string").alias("text")).mapInPandas(rarity, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
        index.order({(r["size"], r["key"]): r["n"] for r in counts.toLocalIterator()})  # one row for each shingle of the block
        shared.unpersist()
        shared = spark.sparkContext.broadcast(index)
        schema = out.schema

        def search(frames: Iterator[pd.DataFrame], shared=shared, schema=schema) -> Iterator[pd.DataFrame]:
            for x in frames:
                words = [words_of(t) for t in x[text]]
                hits, items, sizes, counts = [], [], [], []
                for w, old, had, (s, e, found) in zip(words, x["hits"], x["items"], shared.value.search(words), strict=True):
                    sizes.append(len(w))
                    if len(s):
                        depth = np.zeros(len(w) + 1, np.int64)
                        np.add.at(depth, s, 1)
                        np.add.at(depth, e, -1)
                        hit = np.cumsum(depth[:-1]) > 0
                        if old is not None:
                            hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(w)).astype(bool)
                        old = np.packbits(hit).tobytes()
                    hits.append(old)
                    counts.append(0 if old is None else int(np.bitwise_count(np.frombuffer(old, np.uint8)).sum()))
                    items.append(sorted({*had, *found}))
                x["hits"], x["items"], x["n_words"], x["n_hit"] = hits, items, sizes, counts
                del words
                yield x[schema.names]
            give_back()

        out = out.mapInPandas(search, schema)
        if i < len(parts) - 1:
            out = save(out, "blocks")
            shared.unpersist()
    if not searched:

        @F.pandas_udf("long")
        def n_words(text: pd.Series) -> pd.Series:
            return pd.Series([len(words_of(t)) for t in text], dtype="int64")

        out = out.withColumn("n_words", n_words(F.col(text).cast("string")))
    return back(out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))
