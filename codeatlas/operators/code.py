"""Joins over code: call resolution, ranges, routes, federation, anchors, hazards. Tables in, tables out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as X

from codeatlas.functions import text as T
from codeatlas.operators.fixpoint import numbered
from codeatlas.session import materialize

SELF = ["self", "cls", "this", "super"]
_RUNGS = ["self_cls", "type_name", "import", "same_file", "name_only"]


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(call_id, callee, basis): each call by the first rung that fits: a method of the caller's class, a method of the
    receiver's type, an imported name, a function of the same file, the only function of that name; else ambiguous, or
    external where the name is unknown. calls: call_id, file, cls, name, receiver; functions: id, name, file, cls;
    imports: file, name, target. What a rung looks up is one row for each key, so common names don't multiply rows."""
    one = lambda *key: functions.groupBy(*key).agg(F.min("id").alias("found"))
    named = lambda df, rung, **names: df.withColumnsRenamed({"found": rung, **names})
    x = calls
    x = x.join(named(one("file", "cls", "name"), "in_class"), ["file", "cls", "name"], "left")
    x = x.join(named(one("cls", "name"), "in_type", cls="receiver"), ["receiver", "name"], "left")
    target = imports.groupBy("file", "name").agg(F.min("target").alias("target"))
    x = x.join(target, ["file", "name"], "left").join(named(one("file", "name"), "imported", file="target"), ["target", "name"], "left")
    x = x.join(named(one("file", "name"), "local"), ["file", "name"], "left")
    count = functions.groupBy("name").agg(F.min("id").alias("only"), F.count("*").alias("n"))
    x = x.join(count, "name", "left")
    plain = F.col("receiver").isNull()
    found = [F.when(F.col("receiver").isin(SELF), F.col("in_class")), F.when(~F.col("receiver").isin(SELF), F.col("in_type")), F.when(plain, F.col("imported")), F.when(plain, F.col("local")), F.when(F.col("n") == 1, F.col("only"))]
    basis = F.lit("external")
    basis = F.when(F.col("n") > 1, "ambiguous").otherwise(basis)
    for rung, f in reversed(list(zip(_RUNGS, found, strict=True))):
        basis = F.when(f.isNotNull(), rung).otherwise(basis)
    return x.select("call_id", F.coalesce(*found).alias("callee"), basis.alias("basis"))


def enclosing(sites: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """sites (file, line, ...) with ``owner``: the id of the shortest span of the file that holds the line (ties: least
    id), if any does. spans: file, id, first, last. A range join by blocks of ``width`` lines: an equi-join of each
    site with the spans that touch its block."""
    blocks = spans.select("file", "id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("block"))
    own = sites.withColumn("_site", F.monotonically_increasing_id())
    keyed = own.select("_site", "file", "line", F.floor(F.col("line") / width).alias("block"))
    hit = keyed.join(blocks, ["file", "block"]).filter("line between first and last")
    best = hit.groupBy("file", "line").agg(F.min_by("id", F.struct(F.col("last") - F.col("first"), "id")).alias("owner"))
    return sites.join(best, ["file", "line"], "left")


def http_edges(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller_file, handler_file, method, path, confidence): calls (file, path, method) meet routes (file, path, method)
    on the path or on what is left without a known prefix, if their methods can be the same; calls without any meet
    routes of as many segments that are equal or parameters. One row for each, with the surest confidence."""
    known = lambda m: F.col(m) != "UNKNOWN"
    c = calls.select(F.col("file").alias("caller_file"), F.col("path").alias("url"), F.col("method").alias("cm")).distinct()
    r = routes.select(F.col("file").alias("handler_file"), "path", F.col("method").alias("rm")).distinct()
    fits = ~known("cm") | ~known("rm") | (F.col("cm") == F.col("rm"))
    direct = c.withColumn("path", F.explode(T.candidate_paths(F.col("url")))).join(r, "path").filter(fits)
    rank = F.when(F.col("path") != F.col("url"), 2).when(known("cm") & known("rm"), 0).otherwise(1)
    method = F.when(known("cm") & known("rm"), F.col("cm")).otherwise(F.col("rm"))
    direct = direct.select("caller_file", "url", "cm", "handler_file", method.alias("method"), "path", rank.alias("rank"))
    rest = c.join(direct.select("caller_file", "url", "cm").distinct(), ["caller_file", "url", "cm"], "left_anti")
    wild = rest.join(wildcard_matches(rest.select("url"), r.select("path")), "url").join(r, "path").filter(fits)
    wild = wild.select("caller_file", "handler_file", F.when(known("cm"), F.col("cm")).otherwise(F.col("rm")).alias("method"), "path", F.lit(2).alias("rank"))
    both = direct.select("caller_file", "handler_file", "method", "path", "rank").unionByName(wild)
    out = both.groupBy("caller_file", "handler_file", "method", "path").agg(F.min("rank").alias("rank"))
    return out.select("caller_file", "handler_file", "method", "path", F.element_at(F.array(F.lit("exact"), F.lit("path"), F.lit("fuzzy")), F.col("rank") + 1).alias("confidence"))


def wildcard_matches(urls: DataFrame, paths: DataFrame) -> DataFrame:
    """(url, path) of as many segments, each equal or a parameter on either side. A path waits under the rarest of its
    segments that are no parameters, and a url asks under each of its own; where the url has a parameter in that place,
    it asks for all that wait there."""
    split = lambda p: F.split(F.regexp_replace(p, ":param", "*"), "/")
    ways = paths.select("path", split(F.col("path")).alias("b")).distinct().withColumn("n", F.size("b"))
    words = ways.select("path", "n", F.posexplode("b").alias("i", "v")).filter("v not in ('*', '')")
    often = words.groupBy("n", "i", "v").agg(F.count("*").alias("often"))
    rarest = words.join(often, ["n", "i", "v"]).groupBy("path").agg(F.min(F.struct("often", "i", "v")).alias("x"))
    ways = ways.join(rarest, "path", "left").select("path", "b", "n", F.coalesce("x.i", F.lit(-1)).alias("i"), F.coalesce("x.v", F.lit("")).alias("v"))
    asked = urls.select("url", split(F.col("url")).alias("a")).distinct().withColumn("n", F.size("a"))
    under = asked.select("url", "a", "n", F.posexplode("a").alias("i", "v")).filter("v <> ''")
    under = under.unionByName(asked.select("url", "a", "n", F.lit(-1).alias("i"), F.lit("").alias("v")))
    met = under.filter("v <> '*'").join(ways, ["n", "i", "v"]).unionByName(under.filter("v = '*'").drop("v").join(ways, ["n", "i"]))
    return met.filter(F.forall(F.zip_with("a", "b", lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda ok: ok)).select("url", "path")


def channel_edges(emits: DataFrame, listens: DataFrame, most: int = 8) -> DataFrame:
    """Distinct (src, dst) of emitters and listeners of a channel; channels with more than ``most`` different listeners
    make none. emits: channel, src; listens: channel, dst."""
    listens = listens.select("channel", "dst").distinct()
    few = listens.groupBy("channel").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("channel")
    return emits.select("channel", "src").distinct().join(listens.join(few, "channel", "left_semi"), "channel").filter("src <> dst").select("src", "dst").distinct()


def federated(published: DataFrame, external: DataFrame, cap: int) -> DataFrame:
    """(name, repo, consumer_repo, caller): external calls of other repositories to published names, at most ``cap`` rows
    of a name and repository, the first by repository and caller. published: repo, name; external: repo, name, caller."""
    x = published.distinct().join(external.withColumnRenamed("repo", "consumer_repo"), "name").filter("repo <> consumer_repo")
    order = Window.partitionBy("name", "repo").orderBy("consumer_repo", "caller")
    return x.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).select("name", "repo", "consumer_repo", "caller")


def anchor_freshness(anchors: DataFrame, nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """(memory, anchor, state): an anchor is found by id, then by stable id, then through the renames; fresh if the
    content is as recorded, else drifted; orphaned if it isn't found. anchors: memory, anchor, stable, hash; nodes: id,
    stable, hash; renames: stable, renamed."""
    unique = nodes.groupBy("stable").agg(F.count("*").alias("n"), F.min("hash").alias("hash")).filter("n = 1")
    x = anchors.join(nodes.select(F.col("id").alias("anchor"), F.col("hash").alias("h1")), "anchor", "left")
    x = x.join(unique.select("stable", F.col("hash").alias("h2")), "stable", "left")
    moved = renames.join(unique.select(F.col("stable").alias("renamed"), F.col("hash").alias("h3")), "renamed")
    x = x.join(moved.select("stable", "h3"), "stable", "left")
    now = F.coalesce("h1", "h2", "h3")
    return x.select("memory", "anchor", F.when(now.isNull(), "orphaned").when(now == F.col("hash"), "fresh").otherwise("drifted").alias("state"))


def map_requirements(requirements: DataFrame, functions: DataFrame, least: float = 0.7, first: int = 2) -> DataFrame:
    """(requirement, id, score): functions whose name is the requirement's (1), holds it or is held by it (0.8), or shares
    words with it (their Jaccard similarity times 0.7): the best ``first`` of at least ``least``. requirements:
    requirement; functions: id, name. Both sides meet on a shared word, or where the first three letters of one occur in
    the other; what has neither letters nor digits meets nothing."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    r = requirements.filter("requirement is not null").select("requirement", flat(F.col("requirement")).alias("rf"), words(F.col("requirement")).alias("rw")).distinct().filter("rf <> ''")
    names = functions.filter("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    n = names.select("id", flat(F.col("name")).alias("nf"), words(F.col("name")).alias("nw")).filter("nf <> ''")
    start = lambda c: F.substring(c, 1, 3).alias("key")
    grams = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*[F.substring(F.col(c), i, F.lit(k)) for k in (1, 2, 3)]))))).alias("key")
    met = r.select("requirement", start("rf")).join(n.select("id", grams("nf")), "key").unionByName(r.select("requirement", grams("rf")).join(n.select("id", start("nf")), "key"))
    met = met.unionByName(r.select("requirement", F.explode("rw").alias("key")).join(n.select("id", F.explode("nw").alias("key")), "key"))
    x = met.select("requirement", "id").distinct().join(r, "requirement").join(n, "id")
    x = x.filter(F.contains("nf", F.col("rf")) | F.contains("rf", F.col("nf")) | F.arrays_overlap("nw", "rw"))
    score = F.when(F.col("nf") == F.col("rf"), 1.0).when(F.contains("nf", F.col("rf")) | F.contains("rf", F.col("nf")), 0.8).otherwise(T.jaccard(F.col("nw"), F.col("rw")) * 0.7)
    order = Window.partitionBy("requirement").orderBy(F.desc("score"), "id")
    return x.select("requirement", "id", F.round(score, 6).alias("score")).filter(F.col("score") >= least).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= first).drop("n")


#: Kinds of hazard between two tasks, the strongest first.
HAZARDS = ["WAW", "RAW", "shared-append", "WAR", "soft-coupling"]


#: What a task does to an item, as bits, and for each kind which two sets of them (one of either task) witness it.
_DOES = {"write": 1, "modify": 2, "read": 4, "own": 8, "beside": 16}


def _witness() -> np.ndarray:
    codes = np.arange(32)
    w, m, r, o, b = ((codes & x > 0) for x in _DOES.values())
    both = lambda x, y: x[:, None] & y | y[:, None] & x
    change = m[:, None] | m
    return np.stack([both(w, w) & change, both(w, r), both(w, w) & ~change, both(r, r) | both(o, o), both(o, b)])


def _side(x: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The tasks of a block, and for each item held the place of its task, the item and what the task does to it."""
    item, bits = (pa.concat_arrays(x[c].chunks) for c in ("item", "bits"))
    return pa.concat_arrays(x["task"].chunks), np.repeat(np.arange(len(item)), pc.list_value_length(item).to_numpy()), item.flatten().to_numpy(), bits.flatten().to_numpy()


def _counts(a: tuple, b: tuple, test: np.ndarray) -> np.ndarray:
    """Witnesses of each kind for each task of a and of b. An item that many hold is a column of a product of matrices,
    the others list the pairs that hold them."""
    (one, ra, ia, ca), (two, rb, ib, cb) = a, b
    size = len(one) * len(two)
    out = np.zeros((len(test), size), np.int32)
    shared = np.intersect1d(ia, ib)
    if not len(shared):
        return out
    va, vb = np.isin(ia, shared), np.isin(ib, shared)
    ra, pa_, ca, rb, pb, cb = ra[va], np.searchsorted(shared, ia[va]), ca[va], rb[vb], np.searchsorted(shared, ib[vb]), cb[vb]
    na, nb = np.bincount(pa_, minlength=len(shared)), np.bincount(pb, minlength=len(shared))
    crowded = na * nb * 256 > size
    many = np.flatnonzero(crowded)
    for at in range(0, len(many), 256):
        sides = []
        for n, r, p, c in ((len(one), ra, pa_, ca), (len(two), rb, pb, cb)):
            x, col = np.zeros((n, min(256, len(many) - at)), np.uint8), np.searchsorted(many, p) - at
            here = crowded[p] & (col >= 0) & (col < x.shape[1])
            x[r[here], col[here]] = c[here]
            sides.append(x)
        for code in np.unique(sides[0]):
            mine = (sides[0] == code).astype(np.float32)
            for k in np.flatnonzero(test[:, code, np.unique(sides[1])].any(axis=1)):
                out[k] += (mine @ test[k, code][sides[1]].astype(np.float32).T).astype(np.int32).ravel()
    la, lb = ~crowded[pa_], ~crowded[pb]
    ra, pa_, ca, order = ra[la], pa_[la], ca[la], np.argsort(pb[lb], kind="stable")
    rb, pb, cb = rb[lb][order], pb[lb][order], cb[lb][order]
    first, n = np.searchsorted(pb, pa_), nb[pa_]
    cut = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 1 << 21), side="left").tolist() if len(n) else []
    for lo, hi in zip(cut, [*cut[1:], len(n)], strict=False):
        k = n[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        j = np.repeat(first[lo:hi] - (np.cumsum(k) - k), k) + np.arange(len(i))
        at = ra[i] * len(two) + rb[j]
        for kind in range(len(test)):
            hit = test[kind][ca[i], cb[j]]
            if hit.any():
                out[kind] += np.bincount(at[hit], minlength=size).astype(np.int32)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by two blocks, each with a task and all it holds: the pairs of a task of either block."""
    test, held = _witness(), []

    def solve() -> Iterator[pa.RecordBatch]:
        x = pa.Table.from_batches(held)
        alone = x["p"][0] == x["q"][0]
        a = _side(x.filter(pc.invert(x["second"]))) if alone or not pc.all(x["second"]).as_py() else None
        b = a if alone else _side(x.filter(x["second"])) if pc.any(x["second"]).as_py() else None
        if a is None or b is None:
            return
        counts = _counts(a, b, test)
        kind, n = np.full(counts.shape[1], -1, np.int8), np.zeros(counts.shape[1], np.int64)
        for k in reversed(range(len(test))):
            hit = counts[k] > 0
            kind[hit], n[hit] = k, counts[k][hit]
        if alone:
            kind[np.tri(len(a[0]), dtype=bool).ravel()] = -1
        found = np.flatnonzero(kind >= 0)
        for at in range(0, len(found), 1 << 16):
            own = found[at : at + (1 << 16)]
            i, j = np.divmod(own, len(b[0]))
            yield pa.RecordBatch.from_arrays([a[0].take(pa.array(i)), b[0].take(pa.array(j)), pa.array(kind[own]), pa.array(n[own])], ["x", "y", "k", "n"])

    for batch in batches:
        p, q = batch["p"].to_numpy(), batch["q"].to_numpy()
        cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), len(p)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and hi > lo and (held[0]["p"][0].as_py(), held[0]["q"][0].as_py()) != (p[lo], q[lo]):
                yield from solve()
                held.clear()
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from solve()


def hazards(writes: DataFrame, reads: DataFrame, coupled: DataFrame, block: int = 2048) -> DataFrame:
    """(a, b, kind, n): the strongest hazard between each two tasks that have one, and its number of witnesses. writes:
    task, id, file, mode (modify or append); reads: task, id; coupled: task, file. A file and a symbol are two witnesses, and
    one by which two tasks meet in both directions is one. Tasks are dealt into blocks of about ``block``; each two blocks
    meet in one place, so a pair is counted where it is made and neither pairs nor witnesses are sent on."""
    # a row for each task and item with all that the task does to it, so that two tasks meet on an item once
    w = writes.groupBy("task", "id").agg(F.max(F.col("mode") == "modify").alias("modify"), F.lit(True).alias("write"))
    held = materialize(w.join(reads.select("task", "id", F.lit(True).alias("read")).distinct(), ["task", "id"], "full").na.fill(False), "held")
    own = writes.filter("file is not null").select("task", "file", F.lit(True).alias("own")).distinct()
    files = materialize(own.join(coupled.select("task", "file", F.lit(True).alias("beside")).distinct(), ["task", "file"], "full").na.fill(False), "files")

    def told(x: DataFrame, key: str) -> DataFrame:
        """Items that several tasks hold, by numbers."""
        several = x.filter(F.col("task").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("tasks")).filter("tasks > 1").select(key)
        bits = sum(F.col(c).cast("int") * _DOES[c] for c in x.columns if c in _DOES)
        return x.join(numbered(several, [F.col(key)], "item"), key).filter("task is not null").select("task", "item", bits.cast("tinyint").alias("bits"))

    rows = told(held, "id").unionByName(told(files, "file").withColumn("item", -1 - F.col("item")))
    tasks, size = held.select("task").unionByName(files.select("task")).agg(F.count_distinct("task"), F.count("*")).first()
    blocks = max(1, -(-tasks // block), -(-size // (1 << 20)))
    packed = rows.groupBy("task").agg(F.collect_list(F.struct("item", "bits")).alias("x")).select("task", F.col("x.item").alias("item"), F.col("x.bits").alias("bits"), F.pmod(F.xxhash64("task"), F.lit(blocks)).alias("block"))
    dealt = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).alias("second"), "task", "item", "bits")
    dealt = dealt.repartition(min(4096, blocks * (blocks + 1) // 2), "p", "q").sortWithinPartitions("p", "q")
    kind = held.schema["task"].dataType
    met = dealt.mapInArrow(_meet, X.StructType([X.StructField("x", kind), X.StructField("y", kind), X.StructField("k", X.ByteType()), X.StructField("n", X.LongType())]))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.get(F.array(*[F.lit(h) for h in HAZARDS]), F.col("k").cast("int")).alias("kind"), "n")
