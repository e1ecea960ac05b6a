"""Suffix-array dedup: bytes covered by a string that also starts in a document with a smaller id.

Every string of ``width`` bytes holds a *sampled* gram (the least hash among its grams), and equal strings hold the
same one at the same place. So documents first tell buckets which sampled grams they hold; grams held once can't be
in a repeat. The bytes around the remaining grams go to the gram's bucket, where the suffixes that start at the gram,
and the reversed ones that end before it, are sorted by a mergesort whose comparisons find the common extension by
binary search over prefix polynomial hashes; the order found is verified byte by byte, so no hash collision decides.
Runs of the two orders give, for each place of the string around the gram, the smallest document that holds it.

All groups are bounded: documents are dealt into groups of some MB, equal contexts meet within a group before they
are sent, and a bucket gets at most one copy of a context from each group, however many documents share it.

Null text is empty. A null id counts as larger than all others and comes back as null. Rows that repeat an id are
rows of their own; equal ids are never smaller than each other. Texts shorter than ``width`` keep all their bytes; an
empty table gives no rows. Other columns aren't read, whatever their names. A text isn't split: one longer than a group is
a group of its own, which takes some 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import BASES, Powers, bucket_of, chunks, dealt, mix, on_group, on_pair, prefix_hash, runs

CHUNK = 1 << 18
_BIG = np.iinfo(np.int64).max


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each x[i:i+w], for i up to len(x) - w."""
    size, y = 1, x
    while size * 2 <= w:
        y = op(y[: len(y) - size], y[size:])
        size *= 2
    rest = w - size
    return op(y[: len(y) - rest], y[rest:]) if rest else y


def sampled(data: np.ndarray, starts: np.ndarray, width: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the sampled grams. starts: where documents start in data, and its end."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = prefix_hash(data, powers)
    _, down = powers.to(n + 1)
    g = mix((h[gram:] - h[: n - gram + 1]) * down[: n - gram + 1]) | np.uint64(1)
    w = width - gram + 1
    least = _slide(g, w, np.minimum)  # for each string that starts in data
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)  # bytes left in the document
    least[left[: len(least)] < width] = 0
    pad = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), w, np.maximum)  # over the strings that hold the gram
    at = np.flatnonzero(g == most)
    return at, mix(g[at])  # least hashes are small ones: spread them again


def _joined(texts, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    parts = texts[a:b]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _by_id(pdf: pd.DataFrame):
    """The group's documents in one order whatever the shuffle's."""
    texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return pdf["doc_id"].to_numpy()[order], pdf["no_id"].to_numpy()[order], [bytes(texts[i]) for i in order]


def _grams(ids, texts, width, gram):
    """(hash, document, position in the document's chunk, chunk) of every sampled gram of a group."""
    powers, out = Powers(BASES[0]), []
    for a, b in chunks(np.array([len(x) for x in texts]), CHUNK):
        data, starts = _joined(texts, a, b)
        at, g = sampled(data, starts, width, gram, powers)
        out.append((a, b, data, starts, at, g))
    return out


def _codes(found) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the group, sorted, and whether two of its documents hold them."""
    gs = np.concatenate([x[5] for x in found] or [np.zeros(0, np.uint64)])
    ds = np.concatenate([a + np.searchsorted(starts, at, "right") for a, _, _, starts, at, _ in found] or [np.zeros(0, np.int64)])
    order = np.lexsort((ds, gs))
    gs, ds = gs[order], ds[order]
    first = np.flatnonzero(np.concatenate([[True], gs[1:] != gs[:-1]])) if len(gs) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(gs)]]) - 1 if len(gs) else first
    return gs[first], ds[first] != ds[last]


def _tell(pdf: pd.DataFrame, width: int, gram: int, n: int) -> pd.DataFrame:
    ids, _, texts = _by_id(pdf)
    g, _ = _codes(_grams(ids, texts, width, gram))
    low = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = [(k, int(pdf["pid"].iat[0]), low[start:stop].tobytes()) for k, start, stop in runs(bucket_of(g, n))]
    return pd.DataFrame(rows, columns=["bucket", "pid", "blob"])


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each group's codes: is the code also in another group's? One bit each."""
    parts = [np.frombuffer(x, np.uint32) for x in pdf["blob"]]
    codes, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    more, at, rows = counts[inverse] > 1, 0, []
    for k, p, x in zip(pdf["bucket"], pdf["pid"], parts, strict=True):
        rows.append((p, k, np.packbits(more[at : at + len(x)]).tobytes()))
        at += len(x)
    return pd.DataFrame(rows, columns=["pid", "bucket", "blob"])


def _contexts(ids, texts, answer: pd.DataFrame, width: int, gram: int, n: int):
    """Distinct contexts of the grams held by two documents or more. A context: bytes before and after the gram's start,
    zero outside of the document, then how many are inside on either side, as one row of bytes."""
    found = _grams(ids, texts, width, gram)
    g, more = _codes(found)
    b = bucket_of(g, n)
    for k, x in zip(answer["bucket"], answer["blob"], strict=True):
        start, stop = np.searchsorted(b, [k, k + 1]).tolist()
        more[start:stop] |= np.unpackbits(np.frombuffer(x, np.uint8), count=stop - start).astype(bool)
    before = width - gram
    rows, where = [], []
    for a, _, data, starts, at, h in found:
        keep = more[np.searchsorted(g, h)]
        at, h = at[keep], h[keep]
        doc = np.searchsorted(starts, at, "right") - 1
        left = np.minimum(at - starts[doc], before)
        right = np.minimum(starts[doc + 1] - at, width)
        padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(width, np.uint8)])
        for i in range(0, len(at), 50_000):
            s = slice(i, i + 50_000)
            ctx = np.lib.stride_tricks.sliding_window_view(padded, before + width)[at[s]].copy()
            place = np.arange(-before, width)
            ctx[(place < -left[s, None]) | (place >= right[s, None])] = 0
            rows.append(np.concatenate([ctx, left[s, None].astype(np.uint8), right[s, None].astype(np.uint8)], axis=1))
        where.append((a + doc, at - starts[doc], h))
    if not rows:
        return None
    m = np.concatenate(rows)
    doc, pos, h = (np.concatenate(x) for x in zip(*where, strict=True))
    key = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1]))).ravel()
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(first), _BIG)
    np.minimum.at(least, inverse, ids[doc])
    return m[first], h[first], least, inverse, doc, pos


def _ask(key, docs: pd.DataFrame, answer: pd.DataFrame, width: int, gram: int, n: int) -> pd.DataFrame:
    cols = ["bucket", "pid", "ctx", "ids"]
    if not len(docs):
        return pd.DataFrame([], columns=cols)
    ids, _, texts = _by_id(docs)
    got = _contexts(ids, texts, answer, width, gram, n)
    if got is None:
        return pd.DataFrame([], columns=cols)
    m, h, least, *_ = got
    b = bucket_of(h, n)
    order = np.argsort(b, kind="stable")
    rows = []
    for k, start, stop in runs(b[order]):
        o = order[start:stop]
        rows.append((k, int(docs["pid"].iat[0]), m[o].tobytes(), least[o].tobytes()))
    return pd.DataFrame(rows, columns=cols)


def common_extension(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows x and y by binary search over their prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), h.shape[1] - 1)
    for _ in range(int(h.shape[1]).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = h[x, mid] == h[y, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(m: np.ndarray, group: np.ndarray, base: int = BASES[1]) -> tuple[np.ndarray, np.ndarray]:
    """Order rows of m within each run of equal ``group`` (already together), and the common prefix of each with the
    row before it in its group (0 for the first): a bottom-up mergesort over all groups at once, whose comparisons
    take logarithmic time. m holds symbols; 0 stands after a row's end."""
    n, w = m.shape
    order = np.arange(n)
    if not n:
        return order, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    first, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    for attempt in range(4):
        h = np.zeros((n, w + 1), np.uint64)
        b = np.uint64((base + 2 * attempt * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF)
        for j in range(w):
            h[:, j + 1] = h[:, j] * b + m[:, j].astype(np.uint64) + np.uint64(1)
        wide = np.concatenate([m, np.zeros((n, 1), m.dtype)], axis=1)

        def less(x, y, h=h, wide=wide):
            e = common_extension(h, x, y)
            a, c = wide[x, e], wide[y, e]
            return np.where((e == w) | (a == c), x < y, a < c)

        order, size = np.arange(n), 1
        while size < sizes.max():
            at = np.flatnonzero(end - first > size)
            block = (at - first[at]) // size
            other = first[at] + (block ^ 1) * size
            lo = np.minimum(other, end[at])
            hi = np.minimum(other + size, end[at])
            low = lo.copy()
            me = order[at]
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                smaller = np.zeros(len(at), bool)
                smaller[open_] = less(order[mid[open_]], me[open_])
                lo = np.where(open_ & smaller, mid + 1, lo)
                hi = np.where(open_ & ~smaller, mid, hi)
            new = first[at] + (block & ~1) * size + (at - first[at] - block * size) + (lo - low)
            out = order.copy()
            out[new] = me
            order, size = out, size * 2
        # verification: the bytes themselves give the common prefixes, and these must be in order
        s = m[order]
        lcp = np.zeros(n, np.int64)
        if n > 1:
            differ = s[1:] != s[:-1]
            lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), w)
            inside = np.ones(n, bool)
            inside[starts] = False
            i = np.flatnonzero(inside)
            e = np.minimum(lcp[i], w - 1)
            bad = (lcp[i] < w) & (s[i - 1, e] > s[i, e])
            lcp[starts] = 0
            if bad.any():
                continue  # two different strings had equal hashes: sort again by another base
        return order, lcp
    raise ArithmeticError("four bases in a row gave colliding hashes")


def _resolve(pdf: pd.DataFrame, width: int, gram: int) -> pd.DataFrame:
    """For each context asked about: the places (bits) of a string around the gram that occur in a smaller document
    than the smallest one that the asking group has for this context."""
    before = width - gram
    w = before + width + 2
    parts = [np.frombuffer(x, np.uint8).reshape(-1, w) for x in pdf["ctx"]]
    m = np.concatenate(parts)
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    key = np.ascontiguousarray(m).view(np.dtype((np.void, w))).ravel()
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    u = m[first]
    least = np.full(len(u), _BIG)
    np.minimum.at(least, inverse, ids)
    # together by gram
    grams = np.ascontiguousarray(u[:, before : before + gram]).view(np.dtype((np.void, gram))).ravel()
    _, group = np.unique(grams, return_inverse=True)
    order = np.argsort(group, kind="stable")
    u, least, group = u[order], least[order], group[order]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    left, right = u[:, -2].astype(np.int64), u[:, -1].astype(np.int64)
    inside = np.arange(width) < right[:, None]
    ahead = np.where(inside, u[:, before : before + width].astype(np.int16) + 1, 0)
    behind = np.where(np.arange(before) < left[:, None], u[:, :before][:, ::-1].astype(np.int16) + 1, 0)
    count = np.bincount(group)
    many = np.flatnonzero(count[group] > 1)  # a gram with one context has that context's smallest document
    smallest = np.repeat(least[:, None], before + 1, axis=1)
    if len(many):
        o1, l1 = suffix_sort(ahead[many], group[many])
        o2, l2 = suffix_sort(behind[many], group[many])
        start = np.concatenate([[True], np.diff(group[many]) != 0])
        ids_many = least[many]
        for a in range(before + 1):
            c1, c2 = np.empty(len(many), np.int64), np.empty(len(many), np.int64)
            c1[o1] = np.cumsum(start | (l1 < width - a))
            c2[o2] = np.cumsum(start | (l2 < a))
            ok = (left[many] >= a) & (right[many] >= width - a)
            pair = c1 * (len(many) + 1) + c2
            _, inv = np.unique(pair, return_inverse=True)
            low = np.full(inv.max() + 1, _BIG)
            np.minimum.at(low, inv[ok], ids_many[ok])
            smallest[many, a] = np.where(ok, low[inv], _BIG)
    bits = (smallest[back[inverse]] < ids[:, None]) @ (np.uint64(1) << np.arange(before + 1, dtype=np.uint64))
    at, rows = 0, []
    for p, k, x in zip(pdf["pid"], pdf["bucket"], parts, strict=True):
        rows.append((p, k, bits[at : at + len(x)].astype(np.uint64).tobytes()))
        at += len(x)
    return pd.DataFrame(rows, columns=["pid", "bucket", "blob"])


def _remove(key, docs: pd.DataFrame, answer: pd.DataFrame, width: int, gram: int, n: int) -> pd.DataFrame:
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    if not len(docs):
        return pd.DataFrame([], columns=cols)
    ids, no_id, texts = _by_id(docs)
    first = answer[answer["step"] == 0]
    got = _contexts(ids, texts, first, width, gram, n)
    before = width - gram
    hit_doc = hit_at = np.zeros(0, np.int64)
    if got is not None:
        m, h, least, inverse, doc, pos = got
        b = bucket_of(h, n)
        order = np.argsort(b, kind="stable")
        bits = np.zeros(len(m), np.uint64)
        second = answer[answer["step"] == 1]
        for k, x in zip(second["bucket"], second["blob"], strict=True):
            start, stop = np.searchsorted(b[order], [k, k + 1]).tolist()
            bits[order[start:stop]] = np.frombuffer(x, np.uint64)
        left, right = m[:, -2].astype(np.int64)[inverse], m[:, -1].astype(np.int64)[inverse]
        later = ids[doc] > least[inverse]
        docs_, ats = [], []
        for a in range(before + 1):
            hit = (left >= a) & (right >= width - a) & (later | ((bits[inverse] >> np.uint64(a)) & np.uint64(1)).astype(bool))
            docs_.append(doc[hit])
            ats.append(pos[hit] - a)
        hit_doc, hit_at = np.concatenate(docs_), np.concatenate(ats)
        order = np.argsort(hit_doc, kind="stable")
        hit_doc, hit_at = hit_doc[order], hit_at[order]
    cut = np.searchsorted(hit_doc, np.arange(len(texts) + 1))
    rows = []
    for i, t in enumerate(texts):
        at = hit_at[cut[i] : cut[i + 1]]
        spans = []
        if len(at):
            at = np.unique(at)
            breaks = np.flatnonzero(np.diff(at) > width)
            begin = at[np.concatenate([[0], breaks + 1])]
            end = at[np.concatenate([breaks, [len(at) - 1]])] + width
            spans = list(zip(begin.tolist(), end.tolist(), strict=True))
        kept, last = [], 0
        for s, e in spans:
            kept.append(t[last:s])
            last = e
        kept.append(t[last:])
        rows.append((None if no_id[i] else int(ids[i]), len(t), sum(e - s for s, e in spans), len(spans), [[s, e] for s, e in spans], b"".join(kept)))
    out = pd.DataFrame(rows, columns=cols)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary"


def dedup_substrings(docs: DataFrame, width: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans ([start, end) in bytes) and the bytes kept, for each row of docs."""
    if not 0 < gram <= width or width - gram > 63 or width > 255:
        raise ValueError("gram must be at most width, width at most 255 and gram + 63")
    deal, n = dealt(docs, id_col, text_col)
    told = deal.groupBy("pid").applyInPandas(on_group(_tell, width=width, gram=gram, n=n), "bucket int, pid int, blob binary")
    shared = told.groupBy("bucket").applyInPandas(_shared, "pid int, bucket int, blob binary")
    asked = deal.groupBy("pid").cogroup(shared.groupBy("pid")).applyInPandas(on_pair(_ask, width=width, gram=gram, n=n), "bucket int, pid int, ctx binary, ids binary")
    solved = asked.groupBy("bucket").applyInPandas(on_group(_resolve, width=width, gram=gram), "pid int, bucket int, blob binary")
    both = shared.withColumn("step", F.lit(0)).unionByName(solved.withColumn("step", F.lit(1)))
    return deal.groupBy("pid").cogroup(both.groupBy("pid")).applyInPandas(on_pair(_remove, width=width, gram=gram, n=n), OUT)


def digests(found: DataFrame) -> DataFrame:
    """The operator's rows with a digest in place of the bytes kept."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
