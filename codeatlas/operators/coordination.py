"""What planned changes touch, how they get in each other's way, whether statements about a graph hold, and what a change
opens. Tables in, tables out; many tasks, claims or texts at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.operators import graph as G
from codeatlas.operators.fixpoint import fixpoint
from codeatlas.operators.modules import follow
from codeatlas.session import materialize
from codeatlas.sources.tables import cost

#: Kinds of hazard between two tasks, the strongest first.
HAZARDS = ["WAW", "RAW", "shared-append", "WAR", "soft-coupling"]


def ambient(fans: DataFrame, percentile: float = 0.99) -> DataFrame:
    """(id) of nodes with a fan_in above the one at the percentile's nearest rank: what everything leans on."""
    counts = fans.groupBy("fan_in").agg(F.count("*").alias("n"))  # a row for each fan-in, which are few
    run = counts.withColumns({"upto": F.sum("n").over(Window.orderBy("fan_in")), "all": F.sum("n").over(Window.partitionBy())})
    at = F.least(F.col("all") - 1, F.ceil(F.lit(percentile) * (F.col("all") - 1)))
    bound = run.filter(F.col("upto") > at).agg(F.min("fan_in").alias("bound"))
    return fans.crossJoin(F.broadcast(bound)).filter("fan_in > bound").select("id")  # one row


def resolve_seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, id): what each seed names: a node's id, else all nodes of a file, else all of that name; null if nothing."""
    named = lambda c, rank: nodes.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("seed"), "id", F.lit(rank).alias("rank"))
    wanted = seeds.select("seed").distinct()
    hits = named("id", 0).unionByName(named("file", 1)).unionByName(named("name", 2)).join(wanted, "seed", "left_semi")
    first = hits.groupBy("seed").agg(F.min("rank").alias("rank"))
    return wanted.join(hits.join(first, ["seed", "rank"]).select("seed", "id"), "seed", "left")


def near(starts: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """(task, id, distance): what each task's nodes (task, id) reach over steps (src, dst, cost of 1 or more) at a distance
    of at most ``most``: a round for each unit of it, in which only what lies at that distance moves on."""
    best = materialize(starts.select("task", "id", F.lit(0).alias("distance")).distinct(), "near")
    for k in range(most):
        on = best.filter(F.col("distance") == k).join(steps, F.col("id") == F.col("src")).select("task", F.col("dst").alias("id"), (F.col("distance") + F.col("cost")).alias("distance")).filter(F.col("distance") <= most)
        best = materialize(best.unionByName(on).groupBy("task", "id").agg(F.min("distance").alias("distance")), "near")
    return best


def footprints(tasks: DataFrame, fans: DataFrame, edges: DataFrame, coupled: DataFrame, distance: int = 6, depth: int = 2) -> DataFrame:
    """(task, part, item, file, mode): what each task touches. ``write``: the nodes that its seeds name (modify, if any seed
    says so); ``read``: what those reach at a call distance of at most ``distance``; ``ambient``: the same, of nodes that
    everything leans on; ``affected``: callers up to ``depth`` calls away; ``coupled``: files that change together with
    written ones; ``unresolved``: seeds that name nothing. tasks: task, seed, mode (null: modify); fans: id, name, file,
    fan_in; edges: src, dst, conf; coupled: file, other. Items are strings; a written node is neither read nor affected."""
    own = tasks.filter("task is not null and seed is not null").select("task", "seed", F.coalesce("mode", F.lit("modify")).alias("mode"))
    found = own.join(resolve_seeds(own, fans), "seed")
    files = fans.select("id", "file")
    write = materialize(found.filter("id is not null").groupBy("task", "id").agg(F.max("mode").alias("mode")).join(files, "id"), "write")
    priced = materialize(edges.withColumn("cost", cost(F.col("conf"))).filter("cost is not null").groupBy("src", "dst").agg(F.min("cost").alias("cost")), "priced")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("cost")).distinct()
    apart = lambda df: df.join(write.select("task", "id"), ["task", "id"], "left_anti").join(files, "id")
    everywhere = ambient(fans).withColumn("part", F.lit("ambient"))
    read = apart(near(write, priced, distance)).join(everywhere, "id", "left").withColumn("part", F.coalesce("part", F.lit("read")))
    affected = apart(near(write, back, depth)).withColumn("part", F.lit("affected"))
    mine = write.select("task", "file").distinct()
    beside = mine.join(coupled.select("file", "other").distinct(), "file").select("task", F.col("other").alias("file")).distinct().join(mine, ["task", "file"], "left_anti")
    none = F.lit(None).cast("string")
    row = lambda df, part, item, file, mode=none: df.select("task", part.alias("part"), item.cast("string").alias("item"), file.alias("file"), mode.alias("mode"))
    out = row(write, F.lit("write"), F.col("id"), F.col("file"), F.col("mode"))
    for df in (read, affected):
        out = out.unionByName(row(df, F.col("part"), F.col("id"), F.col("file")))
    out = out.unionByName(row(beside, F.lit("coupled"), F.col("file"), F.col("file")))
    return out.unionByName(row(found.filter("id is null").select("task", "seed").distinct(), F.lit("unresolved"), F.col("seed"), none))


def touches(prints: DataFrame) -> DataFrame:
    """(task, space, item, role) of footprints: how a task holds each symbol (modify, append, read, ambient) and each file
    (own, beside). A task has one role on an item."""
    p = prints.filter("part in ('write', 'read', 'ambient')")
    symbols = p.select("task", F.lit("symbol").alias("space"), "item", F.coalesce("mode", "part").alias("role"))
    files = prints.filter("part = 'write' and file is not null").select("task", F.lit("file").alias("space"), F.col("file").alias("item"), F.lit("own").alias("role")).distinct()
    beside = prints.filter("part = 'coupled'").select("task", F.lit("file").alias("space"), "item", F.lit("beside").alias("role"))
    return symbols.unionByName(files).unionByName(beside)


def crowds(held: DataFrame, crowd: int = 64) -> DataFrame:
    """(space, item, tasks, modify, append, read, ambient, own, beside): items that more than ``crowd`` tasks hold, with how
    many hold them in each role. Who they are stays in ``held``: a group and its members, not its pairs."""
    roles = ["modify", "append", "read", "ambient", "own", "beside"]
    n = held.groupBy("space", "item").agg(F.count("*").alias("tasks"), *[F.count_if(F.col("role") == r).alias(r) for r in roles])
    return n.filter(F.col("tasks") > crowd)


def contacts(held: DataFrame, crowd: int = 64) -> DataFrame:
    """(a, b, kind, direction, witness): each item by which tasks a < b get in each other's way, with the kind of hazard
    that it makes and, for a read of what the other writes, who goes first. Items that more than ``crowd`` tasks hold
    are told by ``crowds`` and make no pairs, so rows are at most ``crowd`` times what is held."""
    many = crowds(held, crowd).select("space", "item")
    few = held.join(many, ["space", "item"], "left_anti")
    side = lambda t, r: few.select("space", "item", F.col("task").alias(t), F.col("role").alias(r))
    both = side("a", "ra").join(side("b", "rb"), ["space", "item"]).filter("a < b")
    writes, reads = (lambda c: F.col(c).isin("modify", "append")), (lambda c: F.col(c).isin("read", "ambient"))
    kind = F.when(writes("ra") & writes("rb"), F.when((F.col("ra") == "append") & (F.col("rb") == "append"), 2).otherwise(0))
    kind = kind.when((writes("ra") & reads("rb")) | (reads("ra") & writes("rb")), 1)
    kind = kind.when(F.col("ra").isin("read", "own") & (F.col("ra") == F.col("rb")), 3)
    kind = kind.when(F.col("ra").isin("own", "beside") & F.col("rb").isin("own", "beside") & (F.col("ra") != F.col("rb")), 4)
    x = both.withColumn("k", kind).filter("k is not null")
    way = F.when(F.col("k") == 1, F.when(writes("ra"), "b after a").otherwise("a after b"))
    return x.select("a", "b", F.get(F.array(*[F.lit(h) for h in HAZARDS]), F.col("k")).alias("kind"), way.alias("direction"), F.col("item").alias("witness"))


def _strength(kind: str) -> Column:
    return F.array_position(F.array(*[F.lit(h) for h in HAZARDS]), F.col(kind))


def interference(met: DataFrame) -> DataFrame:
    """(a, b, kind, direction, n, witness): of ``contacts``, the strongest hazard of each pair, how many items make it, the
    least of them, and who goes first (both ways, if each reads what the other writes)."""
    each = met.groupBy("a", "b", "kind").agg(F.count("*").alias("n"), F.min("witness").alias("witness"), F.min("direction").alias("d0"), F.max("direction").alias("d1"))
    way = F.when(F.col("d0") != F.col("d1"), "bidirectional").otherwise(F.col("d0"))
    best = each.groupBy("a", "b").agg(F.min(F.struct(_strength("kind").alias("s"), "kind", way.alias("direction"), "n", "witness")).alias("x"))
    return best.select("a", "b", "x.kind", "x.direction", "x.n", "x.witness")


def escapes(prints: DataFrame, actual: DataFrame) -> DataFrame:
    """(task, item, file, nature, class, modify, append, verdict): what each task changed beyond what it declared to write.
    Class: read-set-intrusion if it declared to read it, scope-creep-within-file if it writes to that file, else
    out-of-scope-write. modify, append: how many others declared to write it so. Verdict: WAW if one of them conflicts,
    merge if both sides only add, else null. Rows within scope come out only where they merge with others' additions.
    prints: as ``footprints``; actual: task, item, file, nature (added, pure-addition, removed, modifies-existing; of
    several, modifies-existing stands, else the least). A null nature is modifies-existing."""
    strong = F.coalesce("nature", F.lit("modifies-existing"))
    done = actual.filter("task is not null and item is not null").select("task", F.col("item").cast("string").alias("item"), "file", strong.alias("nature"))
    done = done.groupBy("task", "item").agg(F.min("file").alias("file"), F.when(F.max(F.col("nature") == "modifies-existing"), "modifies-existing").otherwise(F.min("nature")).alias("nature"))
    write = prints.filter("part = 'write'")
    who = write.groupBy("item").agg(F.count_if(F.col("mode") == "modify").alias("modify"), F.count_if(F.col("mode") == "append").alias("append"))
    x = done.join(write.select("task", "item", F.col("mode").alias("own")), ["task", "item"], "left")
    x = x.join(prints.filter("part in ('read', 'ambient')").select("task", "item", F.lit(True).alias("reads")), ["task", "item"], "left")
    x = x.join(write.filter("file is not null").select("task", "file", F.lit(True).alias("inside")).distinct(), ["task", "file"], "left").join(who, "item", "left").na.fill(0, ["modify", "append"])
    out = F.col("own").isNull()
    adds = F.col("nature").isin("added", "pure-addition")
    others = lambda mode: F.col(mode) - F.when(F.col("own") == mode, 1).otherwise(0)
    x = x.withColumns({"modify": others("modify"), "append": others("append")})
    kind = F.when(out, F.when(F.col("reads"), "read-set-intrusion").when(F.col("inside"), "scope-creep-within-file").otherwise("out-of-scope-write"))
    clash = out & ((F.col("modify") > 0) | (~adds & (F.col("append") > 0)))
    verdict = F.when(clash, "WAW").when(adds & (F.col("append") > 0), "merge")
    x = x.select("task", "item", "file", "nature", kind.alias("class"), "modify", "append", verdict.alias("verdict"))
    return x.filter(F.col("class").isNotNull() | F.col("verdict").isNotNull())


def retirement(decisions: DataFrame) -> DataFrame:
    """(id, superseded_by): each decision that another one retires, and the live one at the end of that chain, by pointer
    doubling. decisions: id, supersedes, status. A rejected or phantom decision retires nothing, nor does one itself; of
    several, the least retires. Where the chain runs into a ring, none is live: it is the one that retires it directly."""
    ok = "supersedes is not null and supersedes <> id and coalesce(status, '') not in ('rejected', 'phantom')"
    direct = materialize(decisions.filter(ok).groupBy(F.col("supersedes").alias("node")).agg(F.min("id").alias("next")), "retired")
    ends = follow(direct).select("node", "end", "cyclic")
    return direct.join(ends, "node", "left").select(F.col("node").alias("id"), F.when(F.coalesce("cyclic", F.lit(True)), F.col("next")).otherwise(F.col("end")).alias("superseded_by"))


def stale_references(texts: DataFrame, retired: DataFrame) -> DataFrame:
    """(id, block, heading, retired, superseded_by): each block of a text (from one heading to the next, numbered from 0)
    that names a retired decision, an id of eight hex digits, without the one that replaced it. texts: id, text."""
    blocks = texts.select("id", F.posexplode(F.split("text", r"(?m)^(?=#{1,6}[ \t])")).alias("block", "part"))
    heading = F.trim(F.regexp_extract("part", r"\A#{1,6}[ \t]+([^\n]*)", 1))
    named = blocks.select("id", "block", heading.alias("heading"), F.array_distinct(F.regexp_extract_all("part", F.lit(r"\b[0-9a-f]{8}\b"), F.lit(0))).alias("ids")).filter(F.size("ids") > 0)
    hits = named.withColumn("retired", F.explode("ids")).join(retired.withColumnRenamed("id", "retired"), "retired")
    return hits.filter(~F.array_contains("ids", F.col("superseded_by"))).select("id", "block", "heading", "retired", "superseded_by")


def meetings(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, goal, hops): which of the asked (start, goal) meet over pairs (src, dst), in the fewest steps. Starts go a
    step forward and goals a step back, in turn, so that either goes half the way. What isn't met and has an end that
    finds nothing new has no path, and ends without such pairs go no further."""
    asked = materialize(asked.select("start", "goal").filter("start is not null and goal is not null").distinct(), "asked")
    found = asked.filter("start = goal").withColumn("hops", F.lit(0))
    left, hops = materialize(asked.filter("start <> goal"), "asked"), 0
    steps = {"start": pairs.select(F.col("src").alias("at"), F.col("dst").alias("to")), "goal": pairs.select(F.col("dst").alias("at"), F.col("src").alias("to"))}
    seen = {end: materialize(left.select(end, F.col(end).alias("id")).distinct(), "met") for end in steps}
    front = dict(seen)
    while not left.isEmpty():
        end, other = ("goal", "start") if hops % 2 else ("start", "goal")
        on = front[end].join(left.select(end).distinct(), end, "left_semi").join(steps[end], F.col("id") == F.col("at")).select(end, F.col("to").alias("id")).distinct()
        front[end] = materialize(on.join(seen[end], [end, "id"], "left_anti"), "met")
        seen[end], hops = seen[end].unionByName(front[end]), hops + 1
        # a shortest path of so many steps has a node that is just so far from either end
        hit = left.join(front[end], end).join(front[other], [other, "id"]).select("start", "goal").distinct()
        hit = materialize(hit.withColumn("hops", F.lit(hops)), "met")
        found = found.unionByName(hit)
        left = left.join(hit, ["start", "goal"], "left_anti").join(front[end].select(end).distinct(), end, "left_semi")
        left = materialize(left.select("start", "goal"), "asked")
        if hops % 8 == 0:
            seen, found = {k: materialize(v, "met") for k, v in seen.items()}, materialize(found, "met")
    return found


def verify_claims(claims: DataFrame, nodes: DataFrame, edges: DataFrame, roots: DataFrame, decisions: DataFrame) -> DataFrame:
    """(claim, verdict, reason, hops): whether each statement is confirmed, refuted or unverifiable. Kinds: calls (an edge
    from subject to object), reaches and impacts (a path from one to the other, or back; hops tells its length), dead (no
    root reaches the subject; unverifiable if only synthesized edges do), safe-to-change (nobody calls it; unverifiable
    if synthesized calls do), decision-current (recorded, not retired, not rejected). A subject or object is an id, or a
    name that one node has; otherwise the claim is unverifiable, as is a kind not known. claims: claim, kind, subject,
    object; nodes: id, name; edges: src, dst, conf; roots: id; decisions: id, supersedes, status."""
    c = claims.select("claim", "kind", F.col("subject").cast("string").alias("subject"), F.col("object").cast("string").alias("object"))
    wanted = c.select(F.col("subject").alias("name")).unionByName(c.select(F.col("object").alias("name"))).filter("name is not null").distinct()
    by_id = nodes.select(F.col("id").cast("string").alias("name"), "id", F.lit(0).alias("rank"))
    hits = by_id.unionByName(nodes.filter("name is not null").select("name", "id", F.lit(1).alias("rank"))).join(wanted, "name", "left_semi")
    known = hits.groupBy("name", "rank").agg(F.count("*").alias("n"), F.min("id").alias("id")).groupBy("name").agg(F.min(F.struct("rank", "n", "id")).alias("x")).select("name", "x.n", "x.id")
    end = lambda which, n, i: known.select(F.col("name").alias(which), F.col("n").alias(n), F.when(F.col("n") == 1, F.col("id")).alias(i))
    x = materialize(c.join(end("subject", "sn", "sid"), "subject", "left").join(end("object", "on", "oid"), "object", "left"), "claims")

    asked = x.filter("kind = 'calls' and sid is not null and oid is not null").select(F.col("sid").alias("src"), F.col("oid").alias("dst")).distinct()
    direct = asked.join(edges, ["src", "dst"]).groupBy(F.col("src").alias("sid"), F.col("dst").alias("oid")).agg(F.max(F.col("conf") != "synthesized").alias("direct"))
    reach = x.filter("kind in ('reaches', 'impacts') and sid is not null and oid is not null")
    forth = F.col("kind") == "reaches"
    reach = reach.select("claim", F.when(forth, F.col("sid")).otherwise(F.col("oid")).alias("start"), F.when(forth, F.col("oid")).otherwise(F.col("sid")).alias("goal"))
    pairs = materialize(edges.select("src", "dst").distinct(), "pairs")
    met = reach.join(meetings(reach, pairs), ["start", "goal"]).select("claim", "hops")
    sure = G.bfs(edges.filter("conf <> 'synthesized'"), roots).select("id")
    live = G.bfs(pairs, sure).select(F.col("id").alias("sid"), F.lit(True).alias("live"))  # what synthesized edges add
    surely = sure.select(F.col("id").alias("sid"), F.lit(True).alias("surely"))
    callers = edges.groupBy(F.col("dst").alias("sid")).agg(F.count_if(F.col("conf") != "synthesized").alias("callers"), F.count_if(F.col("conf") == "synthesized").alias("made"))
    said = decisions.groupBy(F.col("id").alias("subject")).agg(F.min("status").alias("status"), F.lit(True).alias("recorded"))
    gone = retirement(decisions).select(F.col("id").alias("subject"), "superseded_by")
    x = x.join(direct, ["sid", "oid"], "left").join(met, "claim", "left").join(live, "sid", "left").join(surely, "sid", "left").join(callers, "sid", "left").join(said, "subject", "left").join(gone, "subject", "left")

    k, two = F.col("kind"), F.col("kind").isin("calls", "reaches", "impacts")
    reason = F.when(k == "decision-current", F.when(~F.coalesce(F.col("subject").rlike(r"\A[0-9a-f]{8}\z"), F.lit(False)), "not a decision id").when(F.col("recorded").isNull(), "not recorded").when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("status") == "rejected", "rejected").otherwise("current"))
    reason = reason.when(~F.coalesce(two | k.isin("dead", "safe-to-change"), F.lit(False)), "unknown kind")
    reason = reason.when(F.col("sn") > 1, "subject ambiguous").when(F.col("sid").isNull(), "subject not found")
    reason = reason.when(two & (F.col("on") > 1), "object ambiguous").when(two & F.col("oid").isNull(), "object not found")
    reason = reason.when(k == "calls", F.when(F.col("direct"), "direct edge").when(~F.col("direct"), "synthesized edge").otherwise("no edge"))
    reason = reason.when(two, F.when(F.col("hops").isNotNull(), "path").otherwise("no path"))
    reason = reason.when(k == "dead", F.when(F.col("surely"), "reached").when(F.col("live"), "reached by synthesized edges").otherwise("unreached"))
    reason = reason.otherwise(F.when(F.col("made") > 0, "synthesized callers").when(F.col("callers") > 0, "callers").otherwise("no callers"))
    yes = ["current", "direct edge", "synthesized edge", "path", "unreached", "no callers"]
    no = ["superseded", "rejected", "no edge", "no path", "reached", "callers"]
    x = x.withColumn("reason", reason)
    return x.select("claim", F.when(F.col("reason").isin(yes), "confirmed").when(F.col("reason").isin(no), "refuted").otherwise("unverifiable").alias("verdict"), "reason", F.when(two, F.col("hops")).alias("hops"))


def ways_to(surface: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, path): the shortest path from each node to a node of ``surface`` (id), by edges (src, dst), of at most so many
    (null: any); of equal ones that whose nodes come first. Level by level, each node taking the least of its
    successors' paths."""
    pairs = materialize(edges.select("src", "dst").distinct(), "pairs")

    def step(front):
        on = front.join(pairs, F.col("id") == F.col("dst")).groupBy("src").agg(F.min("path").alias("path"))
        return on.select(F.col("src").alias("id"), F.concat(F.array("src"), "path").alias("path"))

    return fixpoint(surface.select("id").distinct().withColumn("path", F.array("id")), ["id"], step, "ways", rounds)


def opened_paths(old: DataFrame, new: DataFrame, surface: DataFrame) -> DataFrame:
    """(src, dst, path): added edges by which a node comes to reach the surface that didn't before, with the whole path."""
    pairs = lambda x: x.select("src", "dst").distinct()
    added = pairs(new).join(pairs(old), ["src", "dst"], "left_anti")
    before = G.bfs(G.reversed_edges(old), surface).select(F.col("id").alias("src"))
    ways = ways_to(surface, new).select(F.col("id").alias("dst"), "path")
    return added.join(before, "src", "left_anti").join(ways, "dst").select("src", "dst", F.concat(F.array("src"), "path").alias("path"))


def certificate(old: DataFrame, new: DataFrame, surface: DataFrame) -> DataFrame:
    """(change, src, dst, path): what a change does to the graph: edges added and removed, and those that open a way into
    the surface, with that way. The rows of a certificate; an edge that opens one comes out once, as opened."""
    pairs = lambda x: x.select("src", "dst").distinct()
    opened = materialize(opened_paths(old, new, surface), "opened")
    none = F.lit(None).cast(opened.schema["path"].dataType)
    row = lambda df, change, path: df.select(F.lit(change).alias("change"), "src", "dst", path.alias("path"))
    added = pairs(new).join(pairs(old), ["src", "dst"], "left_anti").join(opened, ["src", "dst"], "left_anti")
    gone = pairs(old).join(pairs(new), ["src", "dst"], "left_anti")
    return row(opened, "opened", F.col("path")).unionByName(row(added, "added", none)).unionByName(row(gone, "removed", none))
