"""Upkeep of tables by batches of file versions against a full rebuild."""

import random

from codeatlas.streaming.upkeep import Upkeep, follow_versions, resolve

KIND = "path string, version long, hash string, deleted boolean, functions array<string>, calls array<struct<caller:string,callee:string>>"


def versions(seed, n=60):
    rng = random.Random(seed)
    out = []
    for v in range(1, n + 1):
        functions = sorted({f"n{rng.randrange(9)}" for _ in range(rng.randrange(3))})
        calls = sorted({("c", f"n{rng.randrange(11)}") for _ in range(3)})
        out.append((f"p{rng.randrange(12)}", v, f"h{rng.randrange(1000)}", rng.random() < 0.15, functions, calls))
    return out


def rebuilt(spark, rows):
    last = {r[0]: r for r in sorted(rows, key=lambda r: r[1])}
    live = [r for r in last.values() if not r[3]]
    calls = spark.createDataFrame([(r[0], *c) for r in live for c in r[5]], "path string, caller string, callee string")
    return edges(resolve(calls, spark.createDataFrame([(r[0], f) for r in live for f in r[4]], "path string, name string")))


def edges(df):
    return sorted(map(str, df.select("path", "caller", "callee", "target", "basis").collect()))


def test_batches_in_any_order_end_like_a_rebuild(spark, tmp_path):
    rows = versions(3)
    random.Random(1).shuffle(rows)
    up = Upkeep(spark, f"file://{tmp_path}/a", 3, budget=2)
    for i in range(0, 60, 15):
        up.apply(spark.createDataFrame(rows[i : i + 15], KIND), i)
    stale = up.read("stale").count()
    up.apply(spark.createDataFrame(rows[30:45], KIND), 30)  # a batch that comes again
    assert up.read("stale").count() <= stale
    up.drain()
    assert edges(up.read("edges")) == rebuilt(spark, rows) and up.read("stale").count() == 0 and up.read("files").count() == len({r[0] for r in rows})


def test_a_batch_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    rows = versions(5)
    up = Upkeep(spark, f"file://{tmp_path}/b", 2)
    up.apply(spark.createDataFrame(rows[:30], KIND))
    whole, left = Upkeep._replace, ["calls", "functions"]

    def breaks(self, name, gone, new):
        if name == "edges":
            raise OSError("lost")
        whole(self, name, gone, new)
        left.remove(name) if name in left else None

    monkeypatch.setattr(Upkeep, "_replace", breaks)
    try:
        up.apply(spark.createDataFrame(rows[30:], KIND))
        raise AssertionError("should have broken off")
    except OSError:
        assert not left
    monkeypatch.undo()
    up.apply(spark.createDataFrame(rows[30:], KIND))
    up.drain()
    assert edges(up.read("edges")) == rebuilt(spark, rows)


def test_a_stream_of_versions(spark, tmp_path):
    rows = versions(8, 24)
    for i in range(3):
        spark.createDataFrame(rows[8 * i : 8 * i + 8], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(spark.createDataFrame([], KIND).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    up = Upkeep(spark, f"file://{tmp_path}/c", 2)
    follow_versions(stream, up)
    up.drain()
    assert edges(up.read("edges")) == rebuilt(spark, rows)
