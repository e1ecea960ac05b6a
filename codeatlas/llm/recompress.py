"""Substring dedup by recompression: words covered by a window that also starts in a document with a smaller id.

Symbols are named in rounds, and each round is a Spark job. First distinct words get names, then, in every round, runs
of equal symbols and pairs of neighbours of which the first is of one random half of the alphabet and the second of the
other. Documents are packed into groups as they come; a group tells buckets which distinct keys (words; runs and pairs of names) it
holds, and a bucket numbers those that two documents or more hold. So equal names stand for equal words and different
ones for different words, in all documents alike, and what only one document holds has no name.

What a round does to a symbol depends on its neighbours alone, so a window is cut alike wherever it occurs, but for its
edges: at each end a round leaves out the run, and then the symbol if its half says that it may pair with one outside.
What remains is the window's *interior*. A window repeats only if all symbols of its interior have a name: this leaves
few windows. The symbol of the interior that covers the most words (ties: least hash) is the window's anchor. Windows
that share an anchor at a place are told together, as the names of the words about it (a *context*), to the anchor's
bucket; there windows are equal if the names of all their words are, and each gets the smallest document that holds it.
Hashes put keys in order and deal them out, but never decide that two things are equal. A window without an interior (in
a long run, say) is told by itself.

13 words leave an interior after two rounds; longer windows allow more (``rounds``).

Null and empty texts have no words; an empty table gives no rows. A null id counts as larger than all others and comes
back as null. Rows that repeat an id are rows of their own; equal ids are never smaller than each other. Words are
separated by ASCII white space and otherwise unchanged. Other columns aren't read, whatever their names. Groups and
buckets have a bounded volume, but a text isn't split: one longer than a group takes some 300 bytes of memory for each of
its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import BASES, bucket_of, give_back, mix, on_group, on_pair

#: Bytes of text in a group of documents, and for each bucket.
GROUP, BUCKET = 8 << 20, 16 << 20
_U = np.uint64
TOLD = "bucket int, pid long, blob binary"
ANSWER = "pid long, bucket int, level int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each in the fewest bytes that hold it, compressed."""
    parts = []
    for x in arrays:
        kind = np.dtype(np.int64) if len(x) and x.min() < 0 else np.min_scalar_type(int(x.max()) if len(x) else 0)
        parts += [kind.char.encode(), len(x).to_bytes(8, "little"), x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        kind, n = np.dtype(chr(raw[at])), int.from_bytes(raw[at + 1 : at + 9], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 9).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 9 + n * kind.itemsize
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Marks the rows of sorted columns that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _hash(columns) -> np.ndarray:
    h = None
    for x in columns:
        x = x.astype(_U)
        h = mix(x + _U(BASES[0])) if h is None else mix(h * _U(BASES[1]) + x)
    return h


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each class of equal rows, and the class of each row; classes are in an order of their contents."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hash(rows.T)
    order = np.argsort(h, kind="stable")
    new = _firsts(h[order])
    first, inverse = order[new], np.empty(len(rows), np.int64)
    inverse[order] = np.cumsum(new) - 1
    for i in range(0, len(rows), 1 << 16):
        if (rows[i : i + (1 << 16)] != rows[first[inverse[i : i + (1 << 16)]]]).any():  # different rows, equal hashes
            _, first, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            return first, inverse.ravel()
    return first, inverse


def _held(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, sorted; whether two documents hold each; the number of each code's. doc: ascending."""
    order = np.argsort(code, kind="stable")
    c, d = code[order], doc[order]
    new = _firsts(c)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(c))[: len(first)] - 1
    inverse = np.empty(len(c), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return c[first], d[first] != d[last], inverse


def _raw(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string of an array begins in its bytes, and the end; these bytes."""
    _, offsets, data = x.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, np.int32, len(x) + 1, 4 * x.offset).astype(np.int64)
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def _deal(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents in groups as they come, a compressed row for each."""
    held, size = [], 0

    def group() -> pa.RecordBatch:
        x = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: x[c].combine_chunks()
        at, data = _raw(column("text"))
        blob = _pack(column("doc_id").to_numpy(), column("no_id").to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(at))
        blob = len(blob).to_bytes(8, "little") + blob + zstandard.compress(data.tobytes(), 3)
        return pa.RecordBatch.from_pydict({"pid": pa.array([xxhash.xxh64_intdigest(blob) - (1 << 63)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    for x in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(x["text"]).to_numpy().astype(np.int64) + 64)
        while at < len(x):
            before = int(ends[at - 1]) if at else 0
            to = min(len(x), int(np.searchsorted(ends, before + group_bytes - size)) + 1)
            held.append(x.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= group_bytes:
                yield group()
                held, size = [], 0
    if held:
        yield group()
    del held
    give_back()


def _documents(groups: pa.Table) -> pa.Table:
    """The documents of a group (of several, if these are equal)."""
    ids, nulls, sizes, texts = [], [], [], []
    for blob in groups["blob"].to_pylist():
        n = 8 + int.from_bytes(blob[:8], "little")
        for into, x in zip((ids, nulls, sizes), _unpack(blob[8:n]), strict=True):
            into.append(x.astype(np.int64))
        texts.append(zstandard.decompress(blob[n:]))
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    text = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(b"".join(texts))])
    return pa.table({"doc_id": np.concatenate(ids), "no_id": np.concatenate(nulls).astype(bool), "text": text})


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, eight bytes at a time; the few very long ones by themselves."""
    at, raw = _raw(words)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    left, place = np.diff(at), at[:-1].copy()
    h = mix(left.astype(_U) + _U(BASES[0]))
    for i in np.flatnonzero(left > 512).tolist():
        h[i], left[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i + 1]].tobytes()), 0
    own = np.flatnonzero(left > 0)
    while len(own):
        part = np.ascontiguousarray(eight[place[own]]).view(_U).ravel()
        short = left[own] < 8
        part[short] &= (_U(1) << (left[own][short] * 8).astype(_U)) - _U(1)
        h[own] = mix(h[own] * _U(BASES[1]) + part)
        place[own] += 8
        left[own] -= 8
        own = own[left[own] > 0]
    return h


class Words:
    """The words of a group's documents, which are put in one order whatever the shuffle's."""

    def __init__(self, groups: pa.Table):
        docs = _documents(groups).sort_by([("doc_id", "ascending"), ("no_id", "ascending"), ("text", "ascending")])
        column = lambda c: docs[c].combine_chunks()
        self.ids, self.no_id = column("doc_id").to_numpy(), column("no_id").to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(column("text"))
        words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy()
        doc = np.repeat(np.arange(len(counts)), counts)
        real = pc.greater(pc.binary_length(words), 0)
        if not pc.all(real).as_py():
            words, doc = words.filter(real), doc[real.to_numpy(zero_copy_only=False)]
        self.words, self.doc = words.cast(pa.string()), doc

    def keyed(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, sorted by their hashes, these, and the number of each word's."""
        coded = self.words.dictionary_encode()
        h = _word_hashes(coded.dictionary)
        order = np.argsort(h, kind="stable")
        if (h[order][1:] == h[order][:-1]).any():
            own = coded.dictionary.to_pylist()
            order = np.array(sorted(range(len(own)), key=lambda i: (h[i], own[i].encode())), np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), h[order], back[coded.indices.to_numpy()]


def _rows(bucket: np.ndarray, n: int, pid: int, blob) -> pa.Table:
    """A row for each bucket that has keys (bucket: of each key, ascending). blob: of a slice of them."""
    at = np.flatnonzero(_firsts(bucket)) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(bucket))[: len(at)]
    blobs = [blob(slice(a, b)) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
    return pa.table({"bucket": pa.array(bucket[at], pa.int32()), "pid": pa.array([pid] * len(at), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _returned(answer: pa.Table, level: int, bucket: np.ndarray) -> np.ndarray:
    """What the buckets say of each key, in the keys' order."""
    out = np.zeros(len(bucket), np.int64)
    for at, b, blob in zip(answer["level"].to_pylist(), answer["bucket"].to_pylist(), answer["blob"], strict=True):
        if at == level:
            a = int(np.searchsorted(bucket, b))
            (x,) = _unpack(blob.as_py())
            out[a : a + len(x)] = x
    return out


def _answers(rows: pa.Table, level: int, sizes: list[int], values: np.ndarray) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    blobs = [_pack(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table({"pid": rows["pid"], "bucket": rows["bucket"], "level": pa.array([level] * len(rows), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _tell_words(docs: pa.Table, n: int) -> pa.Table:
    words = Words(docs)
    keys, hashes, token = words.keyed()
    low, high = np.full(len(keys), len(words.ids)), np.full(len(keys), -1)
    np.minimum.at(low, token, words.doc)
    np.maximum.at(high, token, words.doc)

    def blob(s: slice) -> bytes:
        own = keys.slice(s.start, s.stop - s.start)
        sizes = pc.binary_length(own).to_numpy()
        return _pack(sizes, np.frombuffer("".join(own.to_numpy(zero_copy_only=False).tolist()).encode(), np.uint8), (low < high)[s].astype(np.uint8))

    return _rows(bucket_of(hashes, n), n, docs["pid"][0].as_py(), blob)


def _state(key, docs: pa.Table, answer: pa.Table, n: int) -> pa.Table:
    """A row that holds a group's documents as names of their words."""
    kinds = pa.schema([("pid", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("blob", pa.binary())])
    if not len(docs):
        return kinds.empty_table()
    words = Words(docs)
    _, hashes, token = words.keyed()
    bucket = bucket_of(hashes, n)
    names = _global(_returned(answer, 0, bucket), bucket, n, 0)[token]
    blob = _pack(words.ids, np.bincount(words.doc, minlength=len(words.ids)), names)
    return pa.table([[docs["pid"][0].as_py()], [-1], [0], [blob]], schema=kinds)


def _name_words(rows: pa.Table, level: int) -> pa.Table:
    """Numbers, from 1, for the words that two documents hold, in the words' order; 0 for the others."""
    parts = [_unpack(x.as_py()) for x in rows["blob"]]
    sizes = np.concatenate([p[0] for p in parts]).astype(np.int64)
    data = b"".join(p[1].tobytes() for p in parts)
    many = np.concatenate([p[2] for p in parts]).astype(bool)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy()
    held = np.bincount(which, minlength=len(coded.dictionary)) + np.bincount(which[many], minlength=len(coded.dictionary))
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    order = order[held[order] > 1]
    name = np.zeros(len(held), np.int64)
    name[order] = np.arange(1, len(order) + 1)
    return _answers(rows, level, [len(p[0]) for p in parts], name[which])


def _name_keys(rows: pa.Table, level: int) -> pa.Table:
    """The same for runs and pairs: (x, times, y, times)."""
    parts = [_unpack(x.as_py()) for x in rows["blob"]]
    x, k, y, m, many = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(5))
    order = np.lexsort((m, y, k, x))
    new = _firsts(x[order], k[order], y[order], m[order])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    held = np.bincount(which) + np.bincount(which, weights=many).astype(np.int64)
    name = np.where(held > 1, np.cumsum(held > 1), 0)
    return _answers(rows, level, [len(p[0]) for p in parts], name[which])


def _global(number: np.ndarray, bucket: np.ndarray, n: int, level: int) -> np.ndarray:
    """A name from a bucket's number; names of different levels, and buckets, differ."""
    return np.where(number > 0, (number * n + bucket) * 8 + level, 0)


class Parse:
    """Symbols of a group as far as the answers go. Of each window that may still repeat: its first word (``at``) and
    its interior, the symbols from ``a`` up to ``b``."""

    def __init__(self, known: pa.Table, width: int, n: int):
        self.known, self.n = known, n
        (state,) = known.filter(pc.equal(known["level"], 0))["blob"].to_pylist()
        self.ids, counts, names = (_signed(x) for x in _unpack(state))
        self.names = self.word_names = names
        self.word_docs = self.doc = np.repeat(np.arange(len(counts)), counts)
        self.start = np.arange(len(names))
        at = np.arange(max(0, len(names) - width + 1))
        at = at[self.doc[at] == self.doc[at + width - 1]] if len(at) else at
        self.at, self.a, self.b = at, at.copy(), at + width
        self._leave()

    def _leave(self) -> None:
        """Windows whose interior holds a symbol without a name are out; symbols in no interior lose theirs."""
        none = np.concatenate([[0], np.cumsum(self.names == 0)])
        a, b = self.a, np.maximum(self.a, self.b)
        keep = none[a] == none[b]
        self.at, self.a, self.b = self.at[keep], self.a[keep], self.b[keep]
        self._fade()

    def _fade(self) -> None:
        deep = self.b > self.a
        depth = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(depth, self.a[deep], 1)
        np.add.at(depth, self.b[deep], -1)
        self.names = np.where(np.cumsum(depth[:-1]) > 0, self.names, 0)

    def cut(self, level: int) -> None:
        """Runs and pairs of the next round, not yet named: ``keys`` (sorted by bucket) and where they stand."""
        new = _firsts(self.names, self.doc) if len(self.names) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        x, doc, start = self.names[first], self.doc[first], self.start[first]
        times = np.where(x > 0, np.diff(np.append(first, len(self.names))), 1)
        deep = np.flatnonzero(self.b > self.a)
        a, b = self.a.copy(), self.a.copy()
        a[deep], b[deep] = run[self.a[deep]] + 1, run[self.b[deep] - 1]
        half = (mix(x.astype(_U) * _U(BASES[0]) + times.astype(_U) * _U(BASES[1]) + _U(level)) >> _U(63)).astype(bool)
        deep = deep[b[deep] > a[deep]]
        a[deep] += ~half[a[deep]]
        deep = deep[b[deep] > a[deep]]
        b[deep] -= half[b[deep] - 1]
        pair = np.zeros(len(x), bool)
        pair[:-1] = half[:-1] & ~half[1:] & (doc[1:] == doc[:-1]) & (x[:-1] > 0) & (x[1:] > 0)
        second = np.concatenate([[False], pair[:-1]])[: len(x)]
        own = np.flatnonzero(~second)
        place = np.append(np.cumsum(~second) - 1, len(own))
        deep = b > a
        self.a, self.b = np.where(deep, place[np.minimum(a, len(x))], 0), np.where(deep, place[np.minimum(b, len(x))], 0)
        follow = np.minimum(own + 1, max(0, len(x) - 1))
        two = pair[own]
        self.names, self.start, self.doc = x[own], start[own], doc[own]
        k, y, m = times[own], np.where(two, x[follow], 0), np.where(two, times[follow], 0)
        self._fade()  # only what is in an interior is named
        self.open = np.flatnonzero((self.names > 0) & (two | (k > 1)))
        columns = [self.names[self.open], k[self.open], y[self.open], m[self.open]]
        h = _hash(columns)
        order = np.argsort(h)
        if ((h[order][1:] == h[order][:-1]) & _firsts(*[c[order] for c in columns])[1:]).any():  # different keys, equal hashes
            order = np.lexsort((*columns[::-1], h))
        new = _firsts(*[c[order] for c in columns])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.keys, self.bucket = [c[order][new] for c in columns], bucket_of(h[order][new], self.n)
        self.level = level

    def told(self) -> np.ndarray:
        """Whether two documents of the group hold each key."""
        return _held(self.which, self.doc[self.open])[1]

    def name(self) -> None:
        """Take the round's names from the answer."""
        self.names[self.open] = _global(_returned(self.known, self.level, self.bucket), self.bucket, self.n, self.level)[self.which]
        self._leave()


def _parsed(known: pa.Table, width: int, n: int, rounds: int) -> Parse:
    p = Parse(known, width, n)
    for level in range(1, rounds + 1):
        p.cut(level)
        p.name()
    return p


def _tell_keys(known: pa.Table, width: int, n: int, level: int) -> pa.Table:
    p = _parsed(known, width, n, level - 1)
    p.cut(level)
    many = p.told()
    return _rows(p.bucket, n, known["pid"][0].as_py(), lambda s: _pack(*[c[s] for c in p.keys], many[s].astype(np.uint8)))


def _least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place of the least of x[a:b] for each pair with a < b."""
    out = np.empty(len(a), np.int64)
    size, y, length = 1, np.arange(len(x)), b - a
    while True:
        now = (length >= size) & (length < 2 * size)
        left, right = y[a[now]], y[b[now] - size]
        out[now] = np.where(x[left] <= x[right], left, right)
        if not (length >= 2 * size).any():
            return out
        left, right = y[:-size], y[size:]
        y = np.where(x[left] <= x[right], left, right)
        size *= 2


def contexts(p: Parse, width: int):
    """Distinct contexts as rows (bit mask of the windows' places, names of the 2 * width - 1 words about the anchor),
    sorted by bucket, with that; and, of each window, its context, its place in it, its document and first word."""
    deep = p.b > p.a
    anchor, alone = p.at.copy(), ~deep
    if deep.any():
        words = np.diff(np.append(p.start, len(p.word_names)))
        rank = (_U(15) - np.minimum(words, 15).astype(_U)) << _U(60) | mix(p.names.astype(_U)) >> _U(4)
        best = _least(rank, p.a[deep], p.b[deep])
        anchor[deep] = p.start[best]
    place = p.at - anchor + width - 1  # of the window's first word in the context
    # windows come in the order of their first words, so those of an anchor may have others between
    code = anchor * 2 + alone
    each, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    mask = np.zeros(len(each), np.int64)
    np.bitwise_or.at(mask, inverse, np.int64(1) << place)
    low, high = np.full(len(each), width), np.zeros(len(each), np.int64)
    np.minimum.at(low, inverse, place)
    np.maximum.at(high, inverse, place + width)
    spread = np.arange(2 * width - 1)
    at = np.clip((each >> 1)[:, None] + spread - (width - 1), 0, max(0, len(p.word_names) - 1))
    rows = np.where((spread >= low[:, None]) & (spread < high[:, None]), p.word_names[at] if len(each) else 0, 0)
    h = np.empty(len(each), _U)
    own = (each & 1).astype(bool)
    h[own] = _hash(rows[own][:, width - 1 :].T) if own.any() else 0
    if deep.any():
        name = np.zeros(len(p.at), np.int64)
        name[deep] = p.names[best]
        h[~own] = mix(name[first[~own]].astype(_U) + _U(BASES[2]))
    rows = np.concatenate([mask[:, None], rows], axis=1)
    one, group = classes(rows)
    bucket = bucket_of(h[one], p.n) if len(one) else np.zeros(0, np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    doc = p.word_docs[p.at]
    context = back[group][inverse]
    least = np.full(len(order), np.iinfo(np.int64).max)
    np.minimum.at(least, context, p.ids[doc])
    return rows[one][order], bucket[order], least, context, place, doc, p.at


def _ask(known: pa.Table, width: int, n: int, rounds: int) -> pa.Table:
    rows, bucket, least, *_ = contexts(_parsed(known, width, n, rounds), width)
    return _rows(bucket, n, known["pid"][0].as_py(), lambda s: _pack(least[s], *rows[s].T))


def _resolve(rows: pa.Table, width: int, level: int) -> pa.Table:
    """For each context: the places (bits) of windows that a document smaller than the context's smallest holds."""
    parts = [_unpack(x.as_py()) for x in rows["blob"]]
    least, mask = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(2))
    names = np.concatenate([np.stack(p[2:], axis=1).astype(np.int64) for p in parts])
    sizes = [len(p[0]) for p in parts]
    del parts
    row, place = np.nonzero(mask[:, None] >> np.arange(width) & 1)
    h = _hash(names[row, place + j] for j in range(width))
    bits = np.zeros(len(mask), np.int64)
    order = np.argsort(h, kind="stable")
    cut = np.append(np.flatnonzero(_firsts(h[order])), len(order)) if len(order) else np.zeros(1, np.int64)
    # windows of equal hashes are compared by the names of their words, some at a time
    step = 1 << 17
    at = 0
    while at < len(cut) - 1:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + step, "right")) - 1)
        own = order[cut[at] : cut[to]]
        windows = names[row[own][:, None], place[own][:, None] + np.arange(width)]
        _, group = classes(windows)
        low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group, least[row[own]])
        hit = low[group] < least[row[own]]
        np.bitwise_or.at(bits, row[own][hit], np.int64(1) << place[own][hit])
        at = to
    return _answers(rows, level, sizes, bits)


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _remove(key, docs: pa.Table, known: pa.Table, width: int, n: int, rounds: int) -> pa.Table:
    if not len(docs):
        return KEPT.empty_table()
    p = _parsed(known, width, n, rounds)
    _, bucket, least, context, place, doc, at = contexts(p, width)
    bits = _returned(known, rounds + 1, bucket)
    gone = (bits[context] >> place & 1).astype(bool) | (p.ids[doc] > least[context])
    del context, place, doc
    words = Words(docs)
    depth = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(depth, at[gone], 1)
    np.add.at(depth, at[gone] + width, -1)
    keep = np.cumsum(depth[:-1]) == 0
    n_docs = len(words.ids)
    total, left = np.bincount(words.doc, minlength=n_docs), np.bincount(words.doc[keep], minlength=n_docs)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), words.words.filter(pa.array(keep)))
    ids = pa.array(words.ids, pa.int64(), mask=words.no_id)
    return pa.table([ids, pa.array(total, pa.int64()), pa.array(total - left, pa.int64()), pc.binary_join(lists, " ")], schema=KEPT)


def dedup_phrases(docs: DataFrame, width: int = 13, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and the words kept, joined by a space, for each row of docs."""
    if not 2 <= width <= 60 or not 1 <= rounds <= 6:
        raise ValueError("width must be from 2 to 60, rounds from 1 to 6")
    light = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    total = int(light.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    groups, n = max(2, -(-total // group_bytes)), max(2, -(-total // BUCKET))
    by_pid = lambda x: x.repartition(groups, "pid")
    how = {"width": width, "n": n}
    deal = light.mapInArrow(lambda batches: _deal(batches, group_bytes), "pid long, blob binary").repartition(groups, "pid")
    told = deal.groupBy("pid").applyInArrow(on_group(_tell_words, n=n), TOLD)
    named = by_pid(told.groupBy("bucket").applyInArrow(on_group(_name_words, level=0), ANSWER))
    known = by_pid(deal.groupBy("pid").cogroup(named.groupBy("pid")).applyInArrow(on_pair(_state, n=n), ANSWER))
    for level in range(1, rounds + 1):
        told = known.groupBy("pid").applyInArrow(on_group(_tell_keys, **how, level=level), TOLD)
        known = known.unionByName(by_pid(told.groupBy("bucket").applyInArrow(on_group(_name_keys, level=level), ANSWER)))
    asked = known.groupBy("pid").applyInArrow(on_group(_ask, **how, rounds=rounds), TOLD)
    known = known.unionByName(by_pid(asked.groupBy("bucket").applyInArrow(on_group(_resolve, width=width, level=rounds + 1), ANSWER)))
    return deal.groupBy("pid").cogroup(known.groupBy("pid")).applyInArrow(on_pair(_remove, **how, rounds=rounds), "doc_id long, n_words long, n_removed long, kept string")


def digests(found: DataFrame) -> DataFrame:
    """The operator's rows with a digest in place of the words kept."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
