"""SimHash near-dedup by covering locality-sensitive hashing, and near-dedup by verified similarity (``keep_one``).

Fingerprints: 64 majority bits over the XXH64 of word shingles. Tables: each of the 2**(r+1) - 1 nonzero vectors v of
r+1 bits makes a mask, the bits i whose own vector c(i) has an odd product with v. The at most r bits in which two
fingerprints differ span r dimensions at most, so some v is at right angles to all their vectors, and its mask leaves
out every one of them: the two fingerprints collide in that table, whatever the bits are.

Work is on distinct fingerprints, each under its smallest document. A table's bucket is searched within one task; a
bucket of more than ``bucket_rows`` fingerprints is split by covering masks over the bits that it leaves open, which
keep about half of them: still no pair is lost, and with so few bits left open a bucket is bounded by their number,
not by the corpus. Within a bucket no pairs are listed: a breadth-first search links each fingerprint once.
Components then come from alternating star contraction over the links, in tables.

Null and empty texts have no words: fingerprint zero, linked like any other. Ids are any 64-bit numbers; a null id counts
as larger than all of them and comes back as null. Rows that repeat an id or a text are rows of their own with the same
component; a component without ids has a null one. An empty table gives no rows. Columns may have any name. A text is
read whole, so a very long one takes memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import apart, give_back, mix, save

_BIG = (1 << 63) - 1


def fingerprint(text: str | None, size: int = 4) -> int:
    """Signed 64-bit fingerprint of a text's shingles of ``size`` words."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length).tolist()
    n = max(1, len(words) - size + 1)
    end = end[-n:].tolist()
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[a:b], 42) for a, b in zip(start, end, strict=False)], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed number."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fp_udf(size: int):
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        out = pd.Series([fingerprint(t, size) for t in text], dtype="int64")
        give_back()
        return out

    return fp


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (null as the largest number), no_id and fp of each row."""

    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_BIG)).alias("doc_id"),
        F.col(id_col).isNull().alias("no_id"),
        _fp_udf(size)(F.col(text_col).cast("string")).alias("fp"),
    )


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit places such that any two words that differ in at most ``radius`` of them agree on one."""
    most = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, most + 1):
        out.append(sum(1 << b for k, b in enumerate(bits) if ((1 + k % most) & v).bit_count() & 1))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index of the first member of each fingerprint's component, by breadth-first search."""
    n = len(fps)
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        seed, left = left[0], left[1:]
        root[seed] = seed
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= radius
            found = left[near]
            if len(found):
                root[found] = seed
                front.extend(found.tolist())
                left = left[~near]
    return root


def _search(radius: int):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket; a bucket may go on in the next frame."""
        rest = None

        def solve(x: pd.DataFrame) -> pd.DataFrame:
            t, key = x["tbl"].to_numpy(), x["key"].to_numpy()
            fp, rep = x["fp"].to_numpy().view(np.uint64), x["rep"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])) if len(t) else np.zeros(0, int)
            size = np.diff(np.concatenate([first, [len(t)]]))
            two = first[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [rep[two]], [rep[two + 1]]
            for s, m in zip(first[size > 2], size[size > 2], strict=True):
                root = _forest(fp[s : s + m], radius)
                own = np.flatnonzero(root != np.arange(m))
                a.append(rep[s + root[own]])
                b.append(rep[s + own])
            return pd.DataFrame({"u": np.concatenate(a), "v": np.concatenate(b)})

        for x in frames:
            if rest is not None:
                x = pd.concat([rest, x], ignore_index=True)
            if not len(x):
                continue
            last = (x["tbl"].to_numpy() == x["tbl"].iat[-1]) & (x["key"].to_numpy() == x["key"].iat[-1])
            cut = int(np.argmax(last))
            rest = x.iloc[cut:]
            if cut:
                yield solve(x.iloc[:cut])
        if rest is not None:
            yield solve(rest)

    return links


def hamming_links(distinct: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Links (u, v) that connect what any two fingerprints within the radius connect. distinct: fp, rep."""
    masks = covering_masks(radius, list(range(64)))
    spread = distinct.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("tbl"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("x")).select("x.tbl", "x.key", "fp", "rep")
    large = save(spread.groupBy("tbl", "key").count().filter(F.col("count") > bucket_rows).select("tbl", "key"), "large-buckets")
    small = spread.join(large, ["tbl", "key"], "left_anti")
    # the bits that table i leaves open, masked again: a constant table of under a thousand rows
    inner = [(i, (i + 1) * 1000 + j, _signed(m | k)) for i, m in enumerate(masks) for j, k in enumerate(covering_masks(radius, [b for b in range(64) if not m >> b & 1]))]
    again = distinct.sparkSession.createDataFrame(inner, "tbl int, part int, mask long")
    split = spread.join(large, ["tbl", "key"], "left_semi").join(F.broadcast(again), "tbl").select(F.col("part").alias("tbl"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
    return small.unionByName(split).repartition("tbl", "key").sortWithinPartitions("tbl", "key", "fp").mapInPandas(_search(radius), "u long, v long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (u, v), by alternating star
    contraction: each node's larger neighbours, then its smaller ones, are tied to its smallest."""
    edges = save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = wide.filter("u <> v").distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = save(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, bucket_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row; a component without ids has a null one."""
    own = save(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = save(own.groupBy("fp").agg(F.min(F.when(~F.col("no_id"), F.col("doc_id"))).alias("low")), "distinct")
    found = components(hamming_links(distinct.select("fp", F.col("fp").alias("rep")), radius, bucket_rows))
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("label"))
    named = named.select("fp", "label").join(named.groupBy("label").agg(F.min("low").alias("component_id")), "label").drop("label")
    return own.join(named, "fp").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


def shingles(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """A key of the text's words (lower-cased A-Z) and the sorted distinct hashes, of 56 bits, of its shingles of ``size``
    words."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    key = xxhash.xxh64_intdigest(joined, 7)
    if not words:
        return key, np.zeros(0, np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length).tolist()
    end = end[-max(1, len(words) - size + 1) :].tolist()
    one = xxhash.xxh64_intdigest
    return key, np.unique(np.array([one(joined[a:b], 42) for a, b in zip(start, end, strict=False)], np.uint64) >> np.uint64(8))


def _key_udf():
    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        out = [_signed(xxhash.xxh64_intdigest(b" ".join((t or "").encode().lower().split()), 7)) for t in text]
        give_back()
        return pd.Series(out, dtype="int64")

    return key


#: SimHash of the shingle sets: WORDS fingerprints of 64 majority bits, and BANDS samples of ROWS of these bits. Sets of
#: similarity 0.8 and equal size differ in 0.151 of the bits (the angle between them over pi): 7 in 10,000 such pairs share
#: no sample, and hardly any differs in more than FAR bits, as unrelated sets do but for two pairs in 10**16. With 128 bits
#: it was one pair in three million: enough, among millions of texts, to chain unrelated ones into one group.
WORDS, BANDS, ROWS, FAR = 4, 48, 12, 64
_FLIP = mix(np.random.default_rng(5).integers(1, 1 << 63, WORDS, np.uint64))
_BITS = np.stack([np.random.default_rng(100 + i).permutation(64 * WORDS)[:ROWS] for i in range(BANDS)])


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of a shingle set, one after the other."""
    return np.array([majority(mix(own ^ f)) for f in _FLIP], np.int64)


def node_of(wide: np.ndarray) -> np.ndarray:
    """A number for each wide fingerprint (rows of WORDS numbers): texts that share all bits are one node of the links."""
    out = np.zeros(len(wide), np.uint64)
    for w in wide.view(np.uint64).T:
        out = mix(out ^ w)
    return out.view(np.int64)


def bands(wide: np.ndarray) -> np.ndarray:
    """The samples of a wide fingerprint, each a number of its own range."""
    bits = np.unpackbits(wide.view(np.uint8), bitorder="little").astype(np.int32)
    return (bits[_BITS] << np.arange(ROWS, dtype=np.int32)).sum(axis=1, dtype=np.int32) + (np.arange(BANDS, dtype=np.int32) << ROWS)


def _wides(raw: pd.Series) -> np.ndarray:
    """Wide fingerprints from their bytes, a row each."""
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, WORDS)


def _packed(own: np.ndarray) -> bytes:
    """Hashes of 56 bits, seven bytes each."""
    return own.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def _sketches(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for i in range(0, len(x), 1000):
                part = x.iloc[i : i + 1000]
                sets = [shingles(t, size) for t in part["text"]]
                wide = np.stack([wide_fingerprint(v) for _, v in sets])
                yield pd.DataFrame({"doc_id": part["doc_id"], "no_id": part["no_id"], "fp": [_signed(k) for k, _ in sets], "n": [len(v) for _, v in sets], "node": node_of(wide), "wide": [w.tobytes() for w in wide]})
            give_back()

    return run


def _sets(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for i in range(0, len(x), 1000):
                sets = [shingles(t, size) for t in x["text"].iloc[i : i + 1000]]
                yield pd.DataFrame({"rep": [_signed(k) for k, _ in sets], "own": [_packed(v) for _, v in sets]})
            give_back()

    return run


def _whole(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by ``key``, cut anew so that none of its groups goes on in the next."""
    rest: list[pd.DataFrame] = []
    for x in frames:
        if not len(x):
            continue
        g = x[key].to_numpy()
        if rest and g[0] == rest[0][key].iat[0] and g[-1] == g[0]:
            rest.append(x)
            continue
        cut = int(np.argmax(g == g[-1]))
        done = pd.concat([*rest, x.iloc[:cut]], ignore_index=True)
        rest = [x.iloc[cut:]]
        if len(done):
            yield done
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _cuts(g: np.ndarray) -> list[int]:
    """Where each group of a sorted array begins, and the end."""
    return [*np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist(), len(g)]


def _close_forest(wide: np.ndarray, far: int) -> np.ndarray:
    """Index of the first member of each wide fingerprint's component; they are linked at ``far`` differing bits or fewer."""
    n = len(wide)
    root, some = np.arange(n), np.zeros(n, bool)
    for i in range(0, n, 256):  # most have nothing near
        near = sum(np.bitwise_count(w[i : i + 256, None] ^ w) for w in wide.T) <= far
        some[i : i + 256] = near.sum(axis=1) > 1
    left = np.flatnonzero(some)
    while len(left):
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(wide[left] ^ wide[front.pop()]).sum(axis=1) <= far
            root[left[near]] = seed
            front.extend(left[near].tolist())
            left = left[~near]
    return root


def _close(far: int):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _whole(frames, "band"):
            cut, wide = _cuts(x["band"].to_numpy()), _wides(x["wide"]).view(np.uint64)
            node = node_of(wide)
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a > 1:
                    root = _close_forest(wide[a:b], far)
                    own = np.flatnonzero(root != np.arange(b - a))
                    u.append(node[a + root[own]])
                    v.append(node[a + own])
            yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})
        give_back()

    return links


def _banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of each wide fingerprint for each of its bands."""
    for x in frames:
        for i in range(0, len(x), 1000):
            part = x["wide"].iloc[i : i + 1000]
            keys = np.concatenate([bands(w) for w in _wides(part)])
            yield pd.DataFrame({"band": keys, "wide": [w for w in part for _ in range(BANDS)]})


def close_links(distinct: DataFrame, far: int = FAR) -> DataFrame:
    """Links (u, v) that connect what any two wide fingerprints of a band with at most ``far`` differing bits connect.
    distinct: node, n, wide; texts without shingles have none."""
    light = distinct.filter("n > 0").groupBy("node").agg(F.first("wide").alias("wide")).select("wide")
    spread = light.mapInPandas(_banded, "band int, wide binary").repartition("band").sortWithinPartitions("band", "wide")
    return fewer(spread.mapInPandas(_close(far), "u long, v long").distinct())


def fewer(links: DataFrame) -> DataFrame:
    """Links that connect the same: each v to its smallest u, and its other u to that one instead. A text has a u for each
    of its bands at most; near copies share most of these, which so become one link each."""
    low = F.min("u").over(Window.partitionBy("v"))
    return links.select(low.alias("u"), F.when(F.col("u") == low, F.col("v")).otherwise(F.col("u")).alias("v")).distinct()


def _similar_forest(sets: list[np.ndarray], share: int, of: int) -> np.ndarray:
    """Index of the first member of each set's component; sets are linked at a Jaccard similarity of share / of."""
    n = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(codes, np.cumsum(n)[:-1])
    mark = np.zeros(int(codes.max()) + 1, bool)
    root, left = np.full(len(sets), -1), np.arange(len(sets))
    while len(left):
        seed, left = left[0], left[1:]
        root[seed] = seed
        front = [seed]
        while front and len(left):
            a = front.pop()
            able = (n[left] * of >= n[a] * share) & (n[a] * of >= n[left] * share)
            if not able.any():
                continue
            mark[parts[a]] = True
            own = left[able]
            both = np.add.reduceat(mark[np.concatenate([parts[b] for b in own])].astype(np.int64), np.concatenate([[0], np.cumsum(n[own])[:-1]]))
            mark[parts[a]] = False
            near = both * of >= (n[a] + n[own] - both) * share
            root[own[near]] = seed
            front.extend(own[near].tolist())
            left = np.setdiff1d(left, own[near], assume_unique=True)
    return root


def _verify(share: int, of: int):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _whole(frames, "grp"):
            cut, rep, raw = _cuts(x["grp"].to_numpy()), x["rep"].to_numpy(), x["own"].to_numpy()
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a > 1:
                    root = _similar_forest([_unpacked(y) for y in raw[a:b]], share, of)
                    own = np.flatnonzero(root != np.arange(b - a))
                    u.append(rep[a + root[own]])
                    v.append(rep[a + own])
            yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})
            give_back()

    return links


def similar_links(light: DataFrame, distinct: DataFrame, size: int = 5, share: int = 4, of: int = 5, group_shingles: int = 1 << 20) -> DataFrame:
    """Links (u, v) that connect what any two texts of close fingerprints with a similarity of share / of connect. light:
    doc_id, no_id, text; distinct: rep (a text's hash), low (its smallest id), n, node, wide. What close fingerprints connect
    is searched together; where that holds more than ``group_shingles``, it is dealt into parts, and each two parts are. Only
    texts that have others close to them get their shingle sets written."""
    near = components(close_links(distinct))
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())  # the least has no row
    shared = distinct.filter("n > 0").groupBy("node").count().filter("count > 1").join(near, "node", "left_anti")
    near = near.unionByName(shared.select("node", F.col("node").alias("component")))  # texts with all bits in common
    spread = save(distinct.filter("n > 0").select("rep", "n", "node").join(near, "node").select("rep", "n", F.col("component").alias("band")), "close")
    total = spread.groupBy("band").agg(F.ceil(F.sum("n") / group_shingles).alias("parts"))
    dealt = spread.join(total, "band").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("rep", "band", "part", other).select("rep", F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("grp"))
    members = save(dealt, "members")
    # of the rows of a text, those with its smallest id, by one narrow key (another row that has it does no harm)
    key = lambda *c: F.xxhash64(*c).alias("key")
    wanted = distinct.join(members.select("rep").distinct(), "rep", "left_semi").select(key("rep", "low.no_id", "low.doc_id"))
    texts = light.withColumn("fp", _key_udf()("text")).select(key("fp", "no_id", "doc_id"), "text").join(wanted, "key", "left_semi")
    sets = save(texts.groupBy("key").agg(F.first("text").alias("text")).select("text").mapInPandas(_sets(size), "rep long, own binary"), "sets")
    return members.join(sets, "rep").repartition("grp").sortWithinPartitions("grp", "rep").mapInPandas(_verify(share, of), "u long, v long").distinct()


def keep_one(docs: DataFrame, size: int = 5, share: int = 4, of: int = 5, id_col: str = "doc_id", text_col: str = "text", group_shingles: int = 1 << 20) -> DataFrame:
    """One row of each component of texts whose shingle sets have a Jaccard similarity of share / of or more: the one
    with the smallest id (any one, of rows that repeat it). Candidates are texts with close SimHash fingerprints (see
    ``WORDS``), and each link is verified over the whole sets."""
    light = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_BIG)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).cast("string").alias("text"))
    own = save(light.mapInPandas(_sketches(size), "doc_id long, no_id boolean, fp long, n long, node long, wide binary"), "sketches")
    low = F.min(F.struct("no_id", "doc_id")).alias("low")
    distinct = save(own.groupBy(F.col("fp").alias("rep")).agg(low, *[F.first(c).alias(c) for c in ("n", "node", "wide")]), "distinct")
    found = components(similar_links(light, distinct, size, share, of, group_shingles))
    label = distinct.select("rep", "low").join(found, F.col("rep") == F.col("node"), "left").select(F.coalesce("component", "rep").alias("label"), "rep", "low")
    first = label.groupBy("label").agg(F.min(F.struct("low", "rep")).alias("x")).select(F.col("x.rep").alias("kept"), F.col("x.low.no_id").alias("kept_no"), F.col("x.low.doc_id").alias("kept_id"))
    # which of these several rows share
    rows = own.select("fp", "no_id", "doc_id").join(first, (F.col("fp") == F.col("kept")) & (F.col("no_id") == F.col("kept_no")) & (F.col("doc_id") == F.col("kept_id")))
    first = save(rows.groupBy("kept", "kept_no", "kept_id").agg((F.count("*") > 1).alias("again")), "first")
    away, names, back = apart(docs)
    key, text = F.col(names[id_col]).cast("long"), F.col(names[text_col]).cast("string")
    marked = away.withColumns({"own": _key_udf()(text), "own_no": key.isNull(), "own_id": F.coalesce(key, F.lit(_BIG))})
    kept = marked.join(first, (F.col("own") == F.col("kept")) & (F.col("own_no") == F.col("kept_no")) & (F.col("own_id") == F.col("kept_id")))
    return back(kept.filter("not again").unionByName(kept.filter("again").dropDuplicates(["kept", "kept_no", "kept_id"])))
