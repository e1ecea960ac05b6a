"""Call resolution, a case for each rung and its neighbours."""

from codeatlas.operators import ladder as L


def test_every_rung(spark):
    functions = [
        (1, "run", "a", "A", "Java", 1, 50), (2, "help", "a", "A", "Java", 60, 70), (3, "help", "b", "A", "Java", 1, 9), (4, "base", "b", "Root", "Java", 10, 20), (5, "base", "c", "Far", "Java", 1, 2),
        (6, "make", "b", "T", "Java", 30, 40), (7, "make", "c", "T", "Java", 30, 40), (8, "app.go", "a", None, "TypeScript", 80, 85), (9, "main", "a", None, "TypeScript", 90, 99), (10, "visit", "a", None, "Java", 5, 20),
        (11, "visit", "a", None, "Java", 6, 10), (12, "visit", "a", None, "Java", 200, 210), (13, "sole", "z", None, "Java", 1, 2), (14, "both", "y", None, "Java", 1, 2), (15, "both", "z", None, "Java", 3, 4), (16, "run", "q", "Lone", "Java", 1, 5),
        (17, "help", "z", "Lone", "Java", 1, 5), (18, "deep", "z", "Mid", "Java", 6, 7), (19, "deep", "z", "Root", "Java", 8, 9), (20, "twice", "y", "Root", "Java", 1, 2), (21, "twice", "z", "Root", "Java", 1, 2), (22, None, None, None, None, None, None)]
    calls = [
        ("own", 1, "help", "self"), ("up", 1, "base", "this"), ("super", 1, "help", "super"), ("near", 1, "deep", "cls"), ("lone", 16, "help", "this"), ("split", 1, "twice", "super"),
        ("type", 1, "make", "T"), ("imported", 10, "make", "T"), ("lower", 1, "make", "t"), ("dotted", 9, "go", "app"), ("java", 1, "go", "app"), ("infer", 1, "make", "x"), ("chain", 13, "main", None), ("direct", 13, "go2", "lib"),
        ("nested", 1, "visit", None), ("recursive", 11, "visit", None), ("first", 2, "visit", None), ("sole", 1, "sole", None), ("both", 1, "both", None), ("out", 1, "printf", None), ("typed", 1, "sole", "thing"), ("null", 1, None, None), ("lost", 99, "sole", None), ("nobody", 22, "sole", "self")]
    imports = [("a", "T", "c", False), ("z", "main", "a", True), ("z", "lib", "y", False), (None, "x", "y", None)]
    got = L.climb(spark.createDataFrame(calls, "call_id string, caller long, name string, receiver string"), spark.createDataFrame(functions, "id long, name string, file string, cls string, lang string, first long, last long"),
                  spark.createDataFrame(imports, "file string, name string, target string, chained boolean"), spark.createDataFrame([("A", "Mid"), ("Mid", "Root"), ("A", "Far"), ("Far", "Root"), ("Root", "A"), (None, "A")], "cls string, parent string"),
                  spark.createDataFrame([(1, "x", "T"), (1, None, "T")], "caller long, variable string, type string"))
    got = {r.call_id: (r.callee, r.basis, r.rung, r.candidates) for r in got.collect()}
    out = (None, "external", None, None)
    plain = lambda i, basis: (i, basis, None, None)
    # a ring of classes makes A its own ancestor at level 0 alone, so super finds nothing by that name above it
    assert got == {"own": plain(2, "self_cls"), "up": plain(5, "self_cls"), "super": out, "near": plain(18, "self_cls"), "lone": plain(17, "self_cls"), "split": (None, "ambiguous", "self_cls", 2),
                   "type": plain(7, "type_name"), "imported": plain(7, "type_name"), "lower": out, "dotted": plain(8, "same_file"), "java": out, "infer": plain(6, "type_inference"), "chain": plain(9, "re_export"), "direct": out,
                   "nested": plain(11, "same_file"), "recursive": plain(11, "same_file"), "first": plain(10, "same_file"), "sole": plain(13, "name_only"), "both": (None, "ambiguous", "name_only", 2), "out": out, "typed": out, "null": out, "nobody": out}


def test_wildcards_equal_brute_force(spark):
    from itertools import product

    from codeatlas.operators.code import wildcard_matches

    parts = ["a", "b", ":param", "c"]
    paths = ["/" + "/".join(p) for n in (1, 2, 3) for p in product(parts, repeat=n)] + ["/", "/a//b"]
    urls = paths[::2] + [None]
    split = lambda p: p.replace(":param", "*").split("/")
    fits = lambda u, p: len(split(u)) == len(split(p)) and all(x == y or "*" in (x, y) for x, y in zip(split(u), split(p), strict=True))
    got = [tuple(r) for r in wildcard_matches(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(p,) for p in paths + [None]], "path string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(u, p) for u in urls if u for p in paths if fits(u, p)}
