"""Names across modules and classes: re-export chains, import specifiers, class hierarchies. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.fixpoint import fixpoint
from codeatlas.session import materialize

# fixed values: extensions that a specifier may leave out, in the order they are tried
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
#: Name-only dispatch gives up where more methods than this share the name.
MOST_TARGETS = 8


def follow(pointers: DataFrame) -> DataFrame:
    """(node, end, hops, cyclic) of a table (node, next) in which each node points to one other, or to null: where the
    chain from it ends. Chains that run into a cycle have no end. By doubling: a round makes all steps twice as long, so
    there are about as many rounds as the longest chain has binary digits. A round in which no chain ends leaves only
    those that never will: of any longer chain, some node would have got to the end in it."""
    nodes = pointers.select("node", "next")
    ends = nodes.select(F.col("next").alias("node")).filter("node is not null").distinct().join(nodes.select("node"), "node", "left_anti")
    rows = nodes.unionByName(ends.withColumn("next", F.lit(None).cast(nodes.schema["next"].dataType)))
    now = materialize(rows.select("node", F.coalesce("next", "node").alias("at"), F.col("next").isNotNull().cast("long").alias("hops"), F.col("next").isNull().alias("done")), "chain")
    ended = now.filter("done").count()
    while True:
        step = now.select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"), F.col("done").alias("there"))
        now = materialize(now.join(step, "at").select("node", F.col("then").alias("at"), (F.col("hops") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("hops"), F.col("there").alias("done")), "chain")
        count = now.filter("done").count()
        if count == ended:
            break
        ended = count
    return now.select("node", F.when(F.col("done"), F.col("at")).alias("end"), F.when(F.col("done"), F.col("hops")).alias("hops"), (~F.col("done")).alias("cyclic"))


def resolve_exports(exports: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (module, name) with ``definer``, ``hops`` and ``cyclic``: the module that really defines what a module
    exports under a name. exports: module, kind (own, named or star), name (null for star), source (null for own),
    position. An own export ends the chain; else the first re-export of the name goes on in its source; else the first
    starred source that has the name, itself or through others. A name that a module doesn't have is taken to be its own.
    Chains that come back on themselves have no definer."""
    exports = materialize(exports.select("module", "kind", "name", "source", "position"), "exports")
    stars = exports.filter("kind = 'star'").select("module", "source", "position").distinct()
    has = exports.filter("kind <> 'star'").select("module", "name").distinct()
    up = stars.select(F.col("module").alias("barrel"), F.col("source").alias("module")).distinct()
    shown = fixpoint(has, ["module", "name"], lambda front: front.join(up, "module").select(F.col("barrel").alias("module"), "name").distinct(), "shown")
    own = exports.filter("kind = 'own'").select("module", "name").distinct()
    named = exports.filter("kind = 'named'").select("module", "name", F.struct(F.lit(0).alias("kind"), "position", "source").alias("via"))
    starred = stars.join(shown.withColumnRenamed("module", "source"), "source").select("module", "name", F.struct(F.lit(1).alias("kind"), "position", "source").alias("via"))
    onward = named.unionByName(starred).join(own, ["module", "name"], "left_anti").groupBy("module", "name").agg(F.min("via").alias("via"))
    key = lambda module: F.struct(F.col(module).alias("module"), "name")
    chain = follow(onward.select(key("module").alias("node"), F.struct(F.col("via.source").alias("module"), "name").alias("next")))
    found = chain.select("node.module", "node.name", F.col("end.module").alias("definer"), "hops", "cyclic")
    out = wanted.select("module", "name").distinct().join(found, ["module", "name"], "left")
    none = F.col("cyclic").isNull()
    return out.select("module", "name", F.when(none, F.col("module")).otherwise(F.col("definer")).alias("definer"), F.coalesce("hops", F.when(none, F.lit(0))).cast("long").alias("hops"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def normal_path(path: Column) -> Column:
    """A path without `.` and `..` (as far as there is something to go up from)."""

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, specifier) with ``target``: the file that a relative specifier means, or null: the path itself, the
    path with another or a missing extension, or a folder's index. files: path."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    base = normal_path(F.concat(folder, F.col("specifier")))
    bare = F.regexp_replace(base, r"\.[^./]*$", "")
    candidates = F.array(base, *[F.concat(bare, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS])
    one = imports.select("file", "specifier").distinct()
    relative = one.filter(F.col("specifier").startswith(".")).select("file", "specifier", F.posexplode(candidates).alias("i", "path"))
    hit = relative.join(files.select("path").distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", "i").alias("target"))
    return one.join(hit, ["file", "specifier"], "left")


def descendants(inherits: DataFrame) -> DataFrame:
    """(base, sub, depth) of all classes below each class, by the shortest of their ways. inherits: child, parent. A class
    that is its own ancestor by a cycle isn't below itself."""
    up = materialize(inherits.select("child", "parent").filter("child <> parent").distinct(), "inherits")
    seed = up.select(F.col("parent").alias("base"), F.col("child").alias("sub"), F.lit(1).alias("depth"))
    step = lambda front: front.join(up, F.col("sub") == F.col("parent")).filter("base <> child").groupBy("base", F.col("child").alias("sub")).agg((F.min("depth") + 1).alias("depth"))
    return fixpoint(seed, ["base", "sub"], step, "below")


def override_edges(below: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): from each method to the methods of that name in the classes below. methods: id, cls, name."""
    base = methods.select(F.col("id").alias("src"), F.col("cls").alias("base"), "name")
    sub = methods.select(F.col("id").alias("dst"), F.col("cls").alias("sub"), "name")
    return base.join(below.select("base", "sub"), "base").join(sub, ["sub", "name"]).select("src", "dst").distinct()


def inherited_methods(below: DataFrame, methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (cls, name) with ``id``: the class's own method of the name, or that of the nearest class above it. Where
    several are equally near (a diamond), none is taken to be meant, unless it is the same method."""
    lines = below.select(F.col("sub").alias("cls"), F.col("base").alias("at"), "depth")
    one = wanted.select("cls", "name").distinct()
    path = one.select("cls", "name", F.col("cls").alias("at"), F.lit(0).alias("depth")).unionByName(one.join(lines, "cls").select("cls", "name", "at", "depth"))
    found = path.join(methods.select(F.col("cls").alias("at"), "name", "id"), ["at", "name"]).groupBy("cls", "name", "depth").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    nearest = found.groupBy("cls", "name").agg(F.min(F.struct("depth", "id", "other")).alias("x"))
    return nearest.filter("x.id = x.other").select("cls", "name", F.col("x.id").alias("id"))


def dispatch(calls: DataFrame, inherits: DataFrame, methods: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """(call, callee, basis) of virtual calls (call, receiver, name): with a receiver's class, the method it has or
    inherits and those that override it below (declared-type); without one, all methods of the name, if there are no more
    than ``most`` (name-only). A receiver that is no class of the table, or a name that it doesn't have, gives none."""
    below = descendants(inherits)
    calls = materialize(calls.select("call", "receiver", "name").distinct(), "calls")
    typed = calls.filter("receiver is not null")
    wanted = typed.select(F.col("receiver").alias("cls"), "name")
    own = inherited_methods(below, methods, wanted)
    under = wanted.distinct().join(below.select(F.col("base").alias("cls"), F.col("sub").alias("at")), "cls").join(methods.select(F.col("cls").alias("at"), "name", "id"), ["at", "name"]).select("cls", "name", "id")
    declared = typed.join(own.unionByName(under).distinct().withColumnRenamed("cls", "receiver"), ["receiver", "name"]).select("call", F.col("id").alias("callee"), F.lit("declared-type").alias("basis"))
    few = methods.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("name")
    loose = calls.filter("receiver is null").join(few, "name", "left_semi").join(methods.select("name", "id"), "name").select("call", F.col("id").alias("callee"), F.lit("name-only").alias("basis"))
    return declared.unionByName(loose).distinct()
