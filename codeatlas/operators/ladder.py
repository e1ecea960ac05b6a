"""The whole ladder by which a call finds its function. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.fixpoint import fixpoint
from codeatlas.session import materialize

# fixed values: languages whose capitalized receivers name a type, and those with functions assigned to members
TYPED = ["Swift", "C++", "Java"]
DOTTED = ["TypeScript", "JavaScript"]
OWN, SUPER = ["self", "cls", "this"], "super"


def ancestors(parents: DataFrame) -> DataFrame:
    """(cls, at, level): each class with itself (level 0) and all it inherits from, by the nearest way. parents: cls, parent."""
    up = materialize(parents.select("cls", "parent").filter("cls is not null and parent is not null").distinct(), "parents")
    every = up.select("cls").unionByName(up.select(F.col("parent").alias("cls"))).distinct()
    seed = every.select("cls", F.col("cls").alias("at"), F.lit(0).alias("level"))
    step = lambda front: front.join(up.withColumnRenamed("cls", "at"), "at").groupBy("cls", F.col("parent").alias("at")).agg((F.min("level") + 1).alias("level"))
    return fixpoint(seed, ["cls", "at"], step, "ancestors")


def _members(x: DataFrame, methods: DataFrame, local: DataFrame, imported: DataFrame) -> DataFrame:
    """x (file, at, name, ...) with what a class at has by that name: ``found``, the one of x's own file, else of the file
    that the class is imported from, else the only one; and ``n``, how many there are. Each lookup has a row for a key."""
    x = x.join(methods.withColumnRenamed("cls", "at"), ["at", "name"], "left")
    x = x.join(local.withColumnsRenamed({"cls": "at", "id": "own"}), ["at", "name", "file"], "left")
    x = x.join(imported.select("file", F.col("name").alias("at"), "target"), ["file", "at"], "left")
    x = x.join(local.select(F.col("cls").alias("at"), "name", F.col("file").alias("target"), F.col("id").alias("there")), ["at", "name", "target"], "left")
    found = F.coalesce("own", "there", F.when(F.col("n") == 1, F.col("only")))
    return x.withColumn("found", found).drop("target", "own", "there", "only")


def climb(calls: DataFrame, functions: DataFrame, imports: DataFrame, parents: DataFrame, variables: DataFrame) -> DataFrame:
    """(call_id, callee, basis, rung, candidates): each call by the first rung that fits:

    1. self_cls: a receiver self, cls or this: a method of the caller's class or the nearest it inherits from; super:
       the same without the class itself. Of several methods: that of the caller's file, else of the file the class is
       imported from, else the only one; else the call is ambiguous.
    2. type_name: a capitalized receiver in a language of TYPED: a method of that type, chosen likewise.
    3. same_file: a function of the file that is named ``receiver.name``, in a language of DOTTED.
    4. type_inference: a method of the receiver's inferred type (the least, of several).
    5. import, or re_export if the name came through a chain: the name, or else the receiver, is imported.
    6. without a receiver, same_file: the narrowest function of that name inside the caller, else the caller itself, else
       the first of the file.
    7. without a receiver, name_only: the only function of that name; ambiguous if there are several.

    Else external. Ambiguous calls tell the rung at which they are, and how many candidates there were; they have no
    callee. Calls whose caller isn't known give no row; a call without a name is external. calls: call_id, caller, name,
    receiver; functions: id, name, file, cls, lang, first, last; imports: file, name, target, chained; variables: caller,
    variable, type; parents: cls, parent."""
    f = functions.select("id", "name", "file", "cls", "lang", "first", "last")
    own = f.select(F.col("id").alias("caller"), "file", "cls", "lang", "first", "last")
    x = materialize(calls.select("call_id", "caller", "name", "receiver").join(own, "caller"), "calls")
    methods = f.filter("cls is not null").groupBy("cls", "name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    local = f.filter("cls is not null").groupBy("cls", "name", "file").agg(F.min("id").alias("id"))
    link = imports.groupBy("file", "name").agg(F.min(F.struct("target", "chained")).alias("x")).select("file", "name", "x.target", "x.chained")
    bare = F.col("receiver").isNull()
    lookup = lambda key, rung: f.groupBy(*key).agg(F.min("id").alias(rung))

    asked = x.filter(F.col("receiver").isin(*OWN, SUPER) & F.col("cls").isNotNull()).select("name", "file", "cls", (F.col("receiver") == SUPER).alias("above")).distinct()
    levels = ancestors(parents)
    alone = asked.select("cls").distinct().join(levels.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("at"), F.lit(0).alias("level"))
    up = asked.join(levels.unionByName(alone), "cls").filter(~F.col("above") | (F.col("level") > 0))
    hit = _members(up, methods, local, link).filter("n is not null")
    # the nearest class that has the method; of two equally near, one that decides
    nearest = hit.groupBy("name", "file", "cls", "above").agg(F.min(F.struct("level", F.col("found").isNull().alias("open"), "found", "n")).alias("s"))
    x = x.withColumn("above", F.col("receiver") == SUPER)
    x = x.join(nearest, ["name", "file", "cls", "above"], "left")
    self_ = F.col("receiver").isin(*OWN, SUPER)
    x = x.withColumns({"c1": F.when(self_, F.col("s.found")), "n1": F.when(self_, F.col("s.n"))}).drop("s", "above")

    typed = F.col("lang").isin(TYPED) & F.coalesce(F.col("receiver").rlike(r"\A[A-Z]"), F.lit(False))
    named = _members(x.filter(typed).select("file", F.col("receiver").alias("at"), "name").distinct(), methods, local, link).filter("n is not null")
    x = x.join(named.select("file", F.col("at").alias("receiver"), "name", F.col("found").alias("f2"), F.col("n").alias("m2")), ["file", "receiver", "name"], "left")
    x = x.withColumns({"c2": F.when(typed, F.col("f2")), "n2": F.when(typed, F.col("m2"))}).drop("f2", "m2")

    x = x.withColumn("dotted", F.when(F.col("lang").isin(DOTTED), F.concat("receiver", F.lit("."), "name")))
    x = x.join(lookup(["file", "name"], "c3").withColumnRenamed("name", "dotted"), ["file", "dotted"], "left")
    types = variables.groupBy("caller", F.col("variable").alias("receiver")).agg(F.min("type").alias("type"))
    x = x.join(types, ["caller", "receiver"], "left").join(methods.select(F.col("cls").alias("type"), "name", F.col("only").alias("c4")), ["type", "name"], "left")
    x = x.join(link.select("file", "name", F.col("target").alias("t1"), "chained"), ["file", "name"], "left").join(link.select("file", F.col("name").alias("receiver"), F.col("target").alias("t2")), ["file", "receiver"], "left")
    x = x.withColumn("target", F.coalesce("t1", "t2")).join(lookup(["file", "name"], "c5").withColumnRenamed("file", "target"), ["target", "name"], "left")

    homonyms = f.select("file", "name", "id", F.col("first").alias("lo"), F.col("last").alias("hi"))
    inside = x.filter(bare).select("caller", "file", "name", "first", "last").distinct().join(homonyms, ["file", "name"]).filter("id <> caller and lo >= first and hi <= last")
    inside = inside.groupBy("caller", "name").agg(F.min_by("id", F.struct(F.col("hi") - F.col("lo"), "id")).alias("nested"))
    x = x.join(inside, ["caller", "name"], "left").join(lookup(["file", "name"], "first_one"), ["file", "name"], "left")
    x = x.join(f.select(F.col("id").alias("caller"), F.col("name").alias("called")), "caller", "left")
    x = x.withColumn("c6", F.when(bare, F.coalesce("nested", F.when(F.col("called") == F.col("name"), F.col("caller")), "first_one")))
    count = f.groupBy("name").agg(F.count("*").alias("n7"), F.min("id").alias("sole"))
    x = x.join(count, "name", "left").withColumns({"n7": F.when(bare, F.col("n7")), "c7": F.when(bare & (F.col("n7") == 1), F.col("sole"))})

    def pick(of: list[Column], other: Column) -> Column:
        """By the first rung that decides: found, or ambiguous where nothing after it may decide."""
        c = [F.col("c1").isNotNull(), F.col("n1").isNotNull(), F.col("c2").isNotNull(), F.col("n2").isNotNull(), *[F.col(f"c{i}").isNotNull() for i in range(3, 8)], F.col("n7") > 1]
        out = F.when(c[0], of[0])
        for test, value in zip(c[1:], of[1:], strict=True):
            out = out.when(test, value)
        return out.otherwise(other)

    none, word = F.lit(None), F.lit
    callee = pick([F.col("c1"), none, F.col("c2"), none, *[F.col(f"c{i}") for i in range(3, 8)], none], none)
    by = F.when(F.col("t1").isNotNull() & F.col("chained"), "re_export").otherwise("import")
    basis = pick([word("self_cls"), word("ambiguous"), word("type_name"), word("ambiguous"), word("same_file"), word("type_inference"), by, word("same_file"), word("name_only"), word("ambiguous")], word("external"))
    rung = pick([none, word("self_cls"), none, word("type_name"), none, none, none, none, none, word("name_only")], none)
    candidates = pick([none, F.col("n1"), none, F.col("n2"), none, none, none, none, none, F.col("n7")], none)
    return x.select("call_id", callee.alias("callee"), basis.alias("basis"), rung.alias("rung"), candidates.alias("candidates"))
