"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into units that no piece reaches across: the escaped space begins one, letters and other characters part
(where the model has no piece that mixes them), and characters that are in no longer piece stand alone. Documents are
packed into compressed blocks of about 8 MB of text, which hold the numbers of their words and the units of each
distinct word, so that a text is split once; a block's distinct units go, once each, to buckets by their hash, so that
each unit of the whole table is encoded once, however many blocks hold it. Substrings of a unit of at most the longest
piece's length are exploded and equi-joined to the piece table (its size is the model's, broadcast); edges are grouped
by unit; and a fold with ``aggregate`` takes, place by place, the best score that ends there (Viterbi), then walks
back. Ties go to the longer last piece. Characters without a piece take one edge of the least score less 10 and become
byte pieces, or the unknown id if the model has none. The ids return to the blocks by the unit's number in its block.

Three exchanges: blocks (read twice), units (a row for each block and bucket), and ids (likewise, compressed). A unit
counts once in a block, so a frequent one isn't hot.

Scores are the table's, and the ids are their exact optimum, whatever way the model was trained: for a BPE model they
are those of its piece table read as a unigram one, not the ids that its merges give.

Null and empty texts have no ids, and an empty table gives no rows. Rows are rows of their own, whatever their ids; a
null id comes back as null. Other columns of docs aren't read, whatever their names. Decoding gives the text back, but
for U+2581 itself, by which the model writes a space: it comes back as one. A very long text is in one block, which then
holds that much more; a very long unit (a run of letters without a space) is exploded and folded in parts.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import give_back, on_pair

SPACE = "▁"
#: Bytes of text in a block of documents, and for each partition of units.
BLOCK_BYTES, UNIT_BYTES = 8 << 20, 2 << 20
MOST_TASKS = 100_000
#: Units up to SHORT characters are folded place by place; longer ones are exploded in parts of PART characters.
SHORT, PART = 64, 256
#: Between units that travel in one row.
SEPARATOR = "\x1f"
_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")


class Model:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.normal = [(p, i, float(sp.get_score(i))) for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.longest = max(len(p) for p, _, _ in self.normal)
        self.least = min(s for _, _, s in self.normal)
        inside = {c for p, _, _ in self.normal if len(p) > 1 for c in p}
        alone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in inside)
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.normal):
            raise ValueError("a piece holds an escaped space after another character")
        letters = sorted(c for c in inside if c.isalpha())
        mixed = any(len({c.isalpha() for c in p.lstrip(SPACE)}) > 1 for p, _, _ in self.normal)
        other = f"[^{SPACE}{alone}{'' if mixed else ''.join(letters)}]+"
        kinds = [other] if mixed or not letters else [f"[{''.join(letters)}]+", other]
        self.pattern = f"{SPACE}+(?:{'|'.join(kinds)})?|{'|'.join(kinds)}" + (f"|[{alone}]" if alone else "")

    def surface(self) -> list[bytes]:
        """What each id stands for, in bytes."""
        out = [p.encode() for p in self.pieces]
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        for i, p in enumerate(self.pieces):
            if i not in self.bytes.values() and p in ("<s>", "</s>", "<pad>"):
                out[i] = b""
        return out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A place of a unit: the best score of a path that ends there, where its last piece begins (negative), and its id.
PLACE = "struct<score:double,back:int,id:int>"


def viterbi(unit: Column, edges: Column, longest: int) -> Column:
    """Array of (start, id) of the best path. edges: array of (stop, start, id, score), none longer than ``longest``.

    A fold copies its state at each step, so long units are folded in blocks of SHORT places: a step's state holds a
    block and the ``longest`` places before it."""
    n = F.length(unit)
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(0).alias("id")))
    whole = _block_of(origin, edges, F.lit(0), n, F.lit(0))
    before = lambda c: F.greatest(c + 1 - longest, F.lit(0))

    def block(best: Column, c: Column) -> Column:
        near = F.filter(edges, lambda e: (e["stop"] > c) & (e["stop"] <= c + SHORT))
        own = _let(near, lambda x: _block_of(F.slice(best, before(c) + 1, c + 1 - before(c)), x, c, F.least(c + SHORT, n), before(c)))
        return F.concat(best, F.slice(own, c + 2 - before(c), SHORT))

    blocks = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(SHORT)), origin, block)
    return _let(F.when(n <= SHORT, whole).otherwise(blocks), lambda best: _path(n, best))


def _block_of(own: Column, edges: Column, first: Column, last: Column, offset: Column) -> Column:
    """``own``, the places from ``offset`` up to ``first``, and those after it up to ``last``."""
    step = lambda x, e: F.struct((F.get(x, e["start"] - offset)["score"] + e["score"]).alias("score"), (-e["start"]).alias("back"), e["id"].alias("id"))
    return F.aggregate(
        F.sequence(first + 1, last), own,
        lambda x, j: F.concat(x, F.array(F.array_max(F.transform(F.filter(edges, lambda e: e["stop"] == j), lambda e: step(x, e))))),
    )


def _path(n: Column, best: Column) -> Column:
    """(start, id) of each piece, from the end back, in blocks as well."""
    nothing = F.array().cast("array<struct<start:int,id:int>>")
    state = lambda at, path: F.struct(at.alias("at"), path.alias("path"))
    back = lambda s: -F.get(best, s["at"])["back"]
    step = lambda s: F.when(s["at"] <= 0, s).otherwise(state(back(s), F.concat(s["path"], F.array(F.struct(back(s).alias("start"), F.get(best, s["at"])["id"].alias("id"))))))
    walk = lambda at: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(SHORT), F.greatest(at, F.lit(1)))), state(at, nothing), lambda s, _: step(s))
    done = F.aggregate(
        F.sequence(F.lit(1), n, F.lit(SHORT)), state(n, nothing),
        lambda s, _: _let(walk(s["at"]), lambda t: state(t["at"], F.concat(s["path"], t["path"]))),
        lambda s: F.reverse(s["path"]),
    )
    return F.when(n <= SHORT, F.reverse(walk(n)["path"])).otherwise(done)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(model.normal, "piece string, id int, score double")


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(bucket, unit, ids) of the distinct (bucket, unit) of a table; keeps its partitioning by bucket. Only one edge of
    a unit carries it; the others carry a digest of it, where that is shorter."""
    table = F.broadcast(piece_table(units.sparkSession, model))  # the model's size
    n = F.length("unit")
    short = n <= SHORT
    # parts first: finding a place in a long text takes time in proportion to it
    parts = units.select("bucket", "unit", F.explode(F.sequence(F.lit(0), n - 1, F.lit(PART))).alias("first"))
    parts = parts.select(
        "bucket", F.when(short, F.col("unit")).otherwise(F.concat(F.lit("#"), F.sha2("unit", 256))).alias("key"), F.when(~short & (F.col("first") == 0), F.col("unit")).alias("long"), "first",
        F.when(short, F.col("unit")).otherwise(F.substring("unit", F.col("first") + 1, F.lit(PART + model.longest - 1))).alias("part"), F.least(F.lit(PART), n - F.col("first")).alias("own"),
    )
    starts = parts.select("bucket", "key", "long", "first", "part", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("part") - F.col("at")))
    starts = starts.select("bucket", "key", F.when(F.col("at") == 0, F.col("long")).alias("long"), "first", "part", "at", F.explode(sizes).alias("size"))
    exploded = starts.select("bucket", "key", F.when(F.col("size") == 1, F.col("long")).alias("long"), (F.col("first") + F.col("at")).alias("start"), "size", F.substring("part", F.col("at") + 1, F.col("size")).alias("piece"))
    edges = exploded.join(table, "piece", "left").filter("id is not null or size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("stop"), "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(model.least - 10)).alias("score"))
    grouped = edges.groupBy("bucket", "key").agg(F.collect_list(edge).alias("edges"), F.max("long").alias("long"))
    grouped = grouped.select("bucket", F.coalesce("long", "key").alias("unit"), "edges")
    path = viterbi(F.col("unit"), F.col("edges"), model.longest)
    if model.bytes:
        ids = F.array(*[F.lit(model.bytes[b]) for b in range(256)])
        raw = lambda s: F.hex(F.encode(F.substring(F.col("unit"), s["start"] + 1, F.lit(1)), "UTF-8"))
        spelt = lambda h: F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda k: F.get(ids, F.conv(F.substring(h, k, F.lit(2)), 16, 10).cast("int")))
        known = F.flatten(F.transform(path, lambda s: F.when(s["id"] >= 0, F.array(s["id"])).otherwise(spelt(raw(s)))))
    else:
        known = F.transform(path, lambda s: F.when(s["id"] >= 0, s["id"]).otherwise(model.unknown))
    return grouped.select("bucket", "unit", known.alias("ids"))


def _words(text: str) -> list[str]:
    """Words of a text, each without the escaped space that begins it; units don't reach across them."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return [w[1:] for w in _SPACED.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of them all, which compresses better."""
    return x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel()


def _edges(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins, and the end."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _gather(flat: np.ndarray, edges: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that index names, one after another, and their edges."""
    lengths = edges[index + 1] - edges[index]
    out = _edges(lengths)
    return flat[np.repeat(edges[index] - out[:-1], lengths) + np.arange(out[-1])], out


def _runs(flat: bytes, edges: np.ndarray) -> list[bytes]:
    at = edges.tolist()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _listed(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


def _units(units: pa.Array, n_buckets: int) -> tuple[bytes, np.ndarray]:
    """A block's units as rows of a bucket, joined by SEPARATOR (a unit that holds it has a row of its own), and the
    place of each unit: the units in the order of their buckets."""
    bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, _listed(units)), np.uint64, len(units)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    buckets = bucket[order].astype(np.int32)
    units = units.take(pa.array(order))
    odd = np.flatnonzero(pc.match_substring(units, SEPARATOR).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.concatenate([[0, len(units)], np.flatnonzero(np.diff(buckets)) + 1, odd, odd + 1]).astype(np.int64))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), units), SEPARATOR)
    sizes = pc.binary_length(joined).to_numpy()
    head = np.concatenate([[len(joined)], cuts, buckets[cuts[:-1]], sizes]).astype(np.int32)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return head.tobytes() + b"".join(_listed(joined.cast(pa.binary()))), place


def _split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each has."""
    words, counts = [], []
    odd = lambda t: t[:1] == " " or "  " in t or SPACE in t
    for strange, own in itertools.groupby(texts, odd):
        if strange:
            lists = pa.array([_words(t) for t in own], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pa.array([t or None for t in own], pa.string()), " ")
        words.append(lists.flatten())
        counts.append(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    return pa.concat_arrays(words), np.concatenate(counts)


def _numbered(x: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct things of x, and the number of each one's."""
    coded = x.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _parts(words: pa.Array, find) -> tuple[pa.Array, np.ndarray]:
    """The units of all words one after another, and how many each word has."""
    listed = _listed(words)
    joined = SPACE.join(["", *listed])
    if joined.count(SPACE) == len(listed) and "" not in listed:
        # every word begins with the escaped space, which is nowhere else: one pass finds the units of them all
        units = pa.array(find(joined), pa.string())
        first = np.flatnonzero(pc.starts_with(units, SPACE).to_numpy(zero_copy_only=False))
        return units, np.diff(first, append=len(units))
    lists = pa.array([find(SPACE + w) for w in listed], pa.list_(pa.string()))
    return lists.flatten(), pc.list_value_length(lists).to_numpy()


def _block(rows: list[tuple[int, bool, bytes]], find, n_buckets: int) -> dict:
    """A block's row: a hash of its contents, and they, compressed: its units; and its documents (id, mark of a null
    id, numbers of their words), with the places of the units of each distinct word."""
    words, lengths = _split([text.decode() for _, _, text in rows])
    words, each = _numbered(words)
    units, parts = _parts(words, find)
    units, flat = _numbered(units)
    told, place = _units(units, n_buckets)
    flat = place[flat]
    head = np.array([len(rows), len(each), len(parts), len(flat), len(place)], np.int64).tobytes()
    ids = np.array([r[0] for r in rows], np.int64).tobytes() + np.array([r[1] for r in rows], np.uint8).tobytes()
    first = zstandard.compress(told, 3)
    packed = len(first).to_bytes(8, "little") + first + zstandard.compress(head + ids + b"".join(map(_planes, (lengths, each, parts, flat))), 3)
    return {"block": [xxhash.xxh64_intdigest(packed) - (1 << 63)], "packed": [packed]}


def _pack(frames: Iterator[pd.DataFrame], pattern: str, n_buckets: int, block_bytes: int) -> Iterator[pd.DataFrame]:
    find = re.compile(pattern).findall
    rows, held = [], 0
    for x in frames:
        for i, null, text in zip(x["doc_id"], x["no_id"], x["text"], strict=True):
            rows.append((i, null, text := bytes(text)))
            held += len(text) + 64
            if held >= block_bytes:
                yield pd.DataFrame(_block(rows, find, n_buckets))
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(_block(rows, find, n_buckets))
        rows = []
    give_back()


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block's units in a bucket, with the place of the first."""
    for x in frames:
        for block, packed in zip(x["block"], x["packed"], strict=True):
            raw = zstandard.decompress(packed[8 : 8 + int.from_bytes(packed[:8], "little")])
            n = int.from_bytes(raw[:4], "little")
            cuts, buckets, sizes = np.split(np.frombuffer(raw, np.int32, 3 * n + 1, 4), [n + 1, 2 * n + 1])
            joined = _runs(raw, 8 + 12 * n + _edges(sizes))
            yield pd.DataFrame({"bucket": buckets, "block": block, "first": cuts[:-1], "units": pd.Series([u.decode() for u in joined], dtype=object), "alone": np.diff(cuts) == 1})
    give_back()


def _answer(key, rows: pa.Table, known: pa.Table, wide: bool) -> pa.Table:
    """(own, found) for each row of a bucket: the block, and the compressed places, lengths and ids of its units."""
    lists = known["ids"]
    lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    kind = np.int32 if wide else np.uint16
    flat = lists.flatten().to_numpy().astype(kind).tobytes()
    size = np.dtype(kind).itemsize
    ends = (np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64) * size).tolist()
    ids = dict(zip(_listed(known["unit"].combine_chunks()), [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
    found = []
    for first, joined, alone in zip(rows["first"].to_pylist(), rows["units"].to_pylist(), rows["alone"].to_pylist(), strict=True):
        own = [ids[u] for u in ([joined] if alone else joined.split(SEPARATOR))]
        head = np.array([first, len(own), *[len(x) // size for x in own]], np.int32)
        found.append(zstandard.compress(head.tobytes() + b"".join(own), 3))
    return pa.table({"own": rows["block"], "found": pa.array(found, pa.binary())})


def _assemble(key, blocks: pa.Table, known: pa.Table, wide: bool, surface: list[bytes] | None, digest: bool) -> pa.Table:
    """Ids of a block's documents. Equal blocks share a key and have the same units; blocks that differ can't pass for
    each other, as the number of units is checked."""
    sizes, flat = {}, {}
    for found in known["found"]:
        raw = zstandard.decompress(found.as_py())
        first, n = np.frombuffer(raw, np.int32, 2).tolist()
        sizes[first] = np.frombuffer(raw, np.int32, n, 8)
        flat[first] = np.frombuffer(raw, np.int32 if wide else np.uint16, -1, 8 + 4 * n).astype(np.int32)
    first = sorted(sizes)
    edges = _edges(np.concatenate([np.zeros(0, np.int32), *[sizes[i] for i in first]]))
    ids = np.concatenate([np.zeros(0, np.int32), *[flat[i] for i in first]])
    del sizes, flat
    if surface:
        letters, at = np.frombuffer(b"".join(surface), np.uint8), _edges([len(x) for x in surface])
    out = {"doc_id": [], "n_units": [], "packed": []} | ({"decoded": []} if surface else {})
    for packed in blocks["packed"]:
        packed = packed.as_py()
        raw = zstandard.decompress(packed[8 + int.from_bytes(packed[:8], "little") :])
        n, n_each, n_words, n_parts, n_units = np.frombuffer(raw, np.int64, 5).tolist()
        if n_units != len(edges) - 1:
            raise ValueError("blocks share a key but not their units")
        nulls = np.frombuffer(raw, np.uint8, n, 40 + 8 * n).tolist()
        out["doc_id"] += [None if null else i for i, null in zip(np.frombuffer(raw, np.int64, n, 40).tolist(), nulls, strict=True)]
        at_doc, places = 40 + 9 * n, []
        for size in (n, n_each, n_words, n_parts):
            places.append(_numbers(raw, at_doc, size))
            at_doc += 4 * size
        del raw
        lengths, each, counts, parts = places
        docs, words = _edges(lengths), _edges(counts)
        total = _edges(counts[each])
        out["n_units"] += (total[docs[1:]] - total[docs[:-1]]).tolist()
        del total
        own, own_edges = _gather(ids, edges, parts)
        of_word = _runs(own.tobytes(), 4 * own_edges[words])
        at_doc = docs.tolist()
        out["packed"] += [b"".join(map(of_word.__getitem__, each[a:b].tolist())) for a, b in zip(at_doc, at_doc[1:], strict=False)]
        if surface:
            spelt, ends = _gather(letters, at, own)
            of_word = _runs(spelt.tobytes(), ends[own_edges[words]])
            del spelt, ends
            texts = (_spoken(b"".join(map(of_word.__getitem__, each[a:b].tolist()))) for a, b in zip(at_doc, at_doc[1:], strict=False))
            out["decoded"] += [hashlib.sha256(t.encode()).hexdigest() for t in texts] if digest else list(texts)
    kinds = {"doc_id": pa.int64(), "n_units": pa.int64(), "packed": pa.binary(), "decoded": pa.string()}
    whole = pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})
    # many small batches, so that nothing holds a block's texts and ids at once on the other side
    return pa.Table.from_batches(whole.to_batches(max_chunksize=128), whole.schema)


def _spoken(raw: bytes) -> str:
    t = raw.decode(errors="replace").replace(SPACE, " ")
    return t[1:] if t.startswith(" ") else t


def _decoded(packed: bytes, surface: list[bytes]) -> str:
    return _spoken(b"".join(map(surface.__getitem__, np.frombuffer(packed, np.int32).tolist())))


def encode(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, digest: bool = False) -> DataFrame:
    """doc_id, n_units and the ids of each row, packed as little-endian 32-bit numbers; and what they decode to, or the
    SHA-256 of that (``decoded_sha256``), if asked for (in the same tasks, which then need one Python worker each instead
    of two)."""
    light = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"),
    )
    total = int(light.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0)
    # groups stay of one size however much there is; beyond a number of tasks, a task has several groups
    n, n_units = (max(2, -(-total // size)) for size in (block_bytes, UNIT_BYTES))
    pattern, wide = model.pattern, len(model.pieces) > 1 << 16
    blocks = light.mapInPandas(lambda frames: _pack(frames, pattern, n_units, block_bytes), "block long, packed binary").repartition(min(MOST_TASKS, n), "block")
    rows = blocks.mapInPandas(_places, "bucket int, block long, first int, units string, alone boolean").repartition(min(MOST_TASKS, n_units), "bucket")
    units = F.when(F.col("alone"), F.array("units")).otherwise(F.split("units", SEPARATOR))
    places = rows.select("bucket", "block", "first", F.posexplode(units).alias("at", "unit")).select("bucket", "block", (F.col("first") + F.col("at")).alias("place"), "unit")
    # reads every column, so that both uses of the places share one exchange
    own = places.groupBy("bucket", "unit").agg(F.min("block").alias("block"), F.min("place").alias("place")).filter("block is not null and place is not null")
    known = encode_units(own.select("bucket", "unit"), model).withColumnRenamed("bucket", "own_bucket")
    found = rows.groupBy("bucket").cogroup(known.groupBy("own_bucket")).applyInArrow(on_pair(_answer, wide=wide), "own long, found binary")
    read = decoded or digest
    schema = "doc_id long, n_units long, packed binary" + ", decoded string" * read
    f = on_pair(_assemble, wide=wide, surface=model.surface() if read else None, digest=digest)
    out = blocks.groupBy("block").cogroup(found.groupBy("own")).applyInArrow(f, schema)
    return out.withColumnRenamed("decoded", "decoded_sha256") if digest else out


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded with ``decoded``: the text that the ids stand for."""
    surface = model.surface()  # the model's size
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x["decoded"] = [_decoded(packed, surface) for packed in x["packed"]]
            yield x

    return encoded.mapInPandas(run, schema)


def digests(encoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_units, n_ids, digests of the ids and of the decoded text; and the columns to keep. encoded: with the
    decoded text or its digest."""
    text = F.col("decoded_sha256") if "decoded_sha256" in encoded.columns else F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return encoded.select("doc_id", "n_units", (F.octet_length("packed") / 4).cast("long").alias("n_ids"), F.sha2("packed", 256).alias("ids_sha256"), text, *keep)
