"""The session machine on values worked out by hand; the stream against the batch."""

import pytest

from codeatlas.plans.stream_queries import freshness_state, freshness_state_stream
from codeatlas.streaming.machine import Session, density, next_level, oscillation, settled

MIN = 60_000


@pytest.mark.parametrize("modules, dense, swing", [
    ([], 0, 0), (["a", None, "a", "b"], 1 / 15, 0), (["a", "b"] * 4, 7 / 15, 1), (["a", "b", "c", "d"], 3 / 15, 0), (["a", "b", None, "a", "c"], 3 / 15, 0.5),
])
def test_density_and_oscillation(modules, dense, swing):
    assert (density(modules), oscillation(modules)) == (pytest.approx(dense), pytest.approx(swing))


def test_load_age_and_density():
    s = Session(0)
    for i in range(29):
        s.call(i, 1, None)
    assert (s.state, s.load) == ("fresh", 29)
    s.call(30, 1, None)
    assert s.state == "degraded"
    s.call(30 * MIN, 1, None)
    assert (s.state, s.depth, s.load) == ("stale", 1, 31)
    s.call(30 * MIN, 8, None)  # a heavy call of a stale session
    assert (s.depth, s.load) == (3, 31)
    s.orient(31 * MIN)
    assert (s.state, s.depth, s.load) == ("fresh", 0, 0)


def test_switches_are_damped_and_dense_sessions_pay_once_a_minute():
    s = Session(0)
    for i, m in enumerate("abab"):
        s.call(10_000 + i * 2_000, 1, m)
    assert (s.load, s.state) == (4 + 5, "degraded")  # of three changes within 4 seconds one counts; 3/15 is dense
    s.call(100_000, 1, "a")
    assert s.load == 9 + 1 + 5
    s.call(200_000, 1, "b")
    assert (s.load, s.state, s.depth) == (15 + 1 + 5 + 15, "stale", 1)


def test_hysteresis():
    assert [next_level(0, x, 0) for x in (29, 30)] == [0, 1] and next_level(1, 20, 0) == 1 and next_level(1, 19, 0) == 0
    assert next_level(3, 95, 2) == 3 and next_level(3, 95, 3) == 4 and next_level(0, 0, 3) == 2 and next_level(2, 0, 2) == 1
    assert [settled(4, x) for x in (80, 79, 59, 39, 19)] == [4, 3, 2, 1, 0]


def test_decay_carries_what_is_left():
    s = Session(0, score=50, decayed=1)
    for i in range(1, 7):
        s.call(i * 10_000, 1, "m" if i % 3 else None, suppressed=True)
    assert s.score == 50 - 4 - 6 * 3  # 60 seconds are four whole points of 12 and a rest; each quiet call recovers 3


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    batch = rows(freshness_state(spark, d))
    assert batch == rows(freshness_state_stream(spark, d)) and len({r[3] for r in batch}) == 3


def test_new_starts_lower_panic_and_hold_it_off():
    s = Session(0, score=90, level=4, decayed=1)
    s.orient(10_000)
    assert (s.score, s.level, s.quiet) == (50, 3, 55_000)
    s.orient(60_000)
    assert (s.score, s.level, s.quiet) == (35, 2, 105_000)
    s.orient(100_000)  # the third within two minutes of the one before
    assert (s.score, s.quiet) == (35, 105_000)
    s.orient(220_000)
    assert s.score == 0 and s.orients == 1
    s = Session(0, quiet=50_000)
    for i in range(20):
        s.call(1000 * i, 1, "ab"[i % 2])
    assert s.score == 0
    s.call(50_000, 1, "a")
    assert s.score == 15 + 10 + 25 - 3  # a burst, an oscillation and depth, once they count again; and three points of decay


def test_time_alone_lowers_the_level_and_ends_the_session():
    s = Session(0, score=100, level=4, decayed=1, seen=1)
    times = []
    while s.level:
        times.append((s.next_change() - 1) // 1000)
        assert s.settle(s.next_change())
    assert times == [252, 492, 732, 972]  # 80, 60, 40 and 20 undercut, at 5 a minute
    assert s.next_change() == 1 + 30 * MIN and not s.settle(1 + 30 * MIN)


def test_the_watch_replays_the_stream_over_batches(spark, tmp_path):
    """Six files with some rows out of order, the last also with rows that are too late."""
    import random

    from pyspark.sql import functions as F

    from codeatlas.streaming import events as S

    rng = random.Random(9)
    at, rows = 0, []
    for i in range(600):
        at += rng.choice([1, 2, 5, 20, 90])
        rows.append((i, 1_700_000_000_000_000 + at * 1_000_000, i % 3, rng.choice(["click", "view", "error", "signup"] if i % 5 == 0 else ["click", "view"]), float(rng.randrange(9))))
    rows += [(600 + i, rows[-1][1] + (4000 + i) * 1_000_000, 9, "click", 1.0) for i in range(2)]  # time goes on
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 200) * 1_000_000)
    schema = "event_id long, us long, user_id long, event_type string, value double"
    table = lambda x: spark.createDataFrame(x, schema).withColumn("ts", F.timestamp_micros("us")).drop("us")
    late = [(900, rows[0][1], 1, "error", 8.0)]
    parts = [order[i : i + 101] for i in range(0, len(order), 101)] + [late]
    for i, part in enumerate(parts):
        table(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = spark.readStream.schema(table(rows).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = sorted(map(str, S.run_once(S.watch_stream(files)).collect()))
    want = sorted(map(str, S.watch_batch(table(rows), max(r[1] for r in rows) // 1000 - 600_000).collect()))
    assert got == want and any("settled" in r for r in got) and any("ended" in r for r in got) and any("level=2" in r for r in got)


def test_hourly_stream_has_the_last_hours(spark):
    from codeatlas.plans.history_queries import hourly_events
    from codeatlas.plans.stream_queries import stream_hourly_events

    d = "/root/testdata/sf0.001"
    rows = lambda x: sorted((r.started, r.event_type, r.n) for r in x.collect())
    assert rows(stream_hourly_events(spark, d)) == rows(hourly_events(spark, d))
