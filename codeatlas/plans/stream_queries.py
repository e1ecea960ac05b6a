"""Streaming queries, run over what is there; each equals its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeatlas.plans.history_queries import tool_rollup
from codeatlas.session import shared_dir
from codeatlas.sources.tables import table
from codeatlas.streaming import events as S
from codeatlas.streaming.upkeep import Upkeep

QUERIES, ORACLE_SQL = {}, {}


def _stream(s, d):
    return S.stream(s, f"{d}/events.parque[t]", table(s, d, "events").schema)


def stream_tool_stats(s, d):
    return S.run_once(tool_rollup(_stream(s, d)), "complete")


def stream_hourly_events(s, d):
    """All hours, those that the watermark hasn't passed included: the stream's whole result after its last batch."""
    return S.run_once(S.windowed(_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n"), "complete")


def freshness_state(s, d):
    return S.freshness_batch(table(s, d, "events"))


def freshness_state_stream(s, d):
    return S.run_once(S.freshness_stream(_stream(s, d)))


#: Time runs this many times faster in the queries on sessions, so that a user's events are minutes apart.
FASTER = 200
_START = 1_704_067_200_000_000


def _dense(events):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("ts", F.timestamp_micros(F.lit(_START) + F.floor((us - _START) / FASTER)))


def session_watch(s, d):
    """Panic by event time, replayed: calls, new starts, falls of the level by time alone, ends of sessions."""
    x = _dense(table(s, d, "events"))
    last = x.agg(F.max(F.unix_micros("ts")).alias("us")).first()["us"]
    return S.watch_batch(x, (last or 0) // 1000 - 600_000)


def session_watch_stream(s, d):
    """The same from a stream, with timers."""
    return S.run_once(S.watch_stream(_dense(_stream(s, d))))


def _typed(events):
    return events.select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def _plain(out):
    return out.select("kind", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "n", "bulk")


def debounced(s, d):
    """Work batches: events of a type less than ten minutes apart, cut at half an hour."""
    return _plain(S.debounced(_typed(table(s, d, "events")), "kind", "10 minutes", 1_800_000, 4))


def debounced_stream(s, d):
    """The same from a stream, as far as the watermark has passed."""
    return _plain(S.run_once(S.debounced(_typed(_stream(s, d)), "kind", "10 minutes", 1_800_000, 4)))


def _versions(s, d):
    """Three batches of file versions, of parts: all; a fifth with other functions and calls; an eleventh deleted."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    p = table(s, d, "part").withColumn("path", F.concat(F.lit("f"), text(k)))
    called = lambda *names: F.array(*[F.struct(F.lit("main").alias("caller"), n.alias("callee")) for n in names])
    name = lambda mark, c: F.concat(F.lit(mark), text(c))
    row = lambda df, v, gone, functions, calls: df.select("path", F.lit(v).cast("long").alias("version"), F.concat(F.lit(f"v{v}:"), text(k)).alias("hash"), F.lit(gone).alias("deleted"), functions.alias("functions"), calls.alias("calls"))
    one = row(p, 1, False, F.array(name("f", k % 700), name("g", k * 7 % 1500)), called(name("f", F.col("p_size") * 13 % 900), name("g", k * 3 % 1600)))
    two = row(p.filter(k % 5 == 0), 2, False, F.array(name("h", k % 300)), called(name("f", k % 700), name("h", k % 400)))
    none = F.array().cast("array<string>")
    return [one, two, row(p.filter(k % 11 == 0), 3, True, none, F.array().cast("array<struct<caller:string,callee:string>>"))]


def incremental_refresh(s, d):
    """Edges after three batches of file versions, each with what was left stale by its budget, and the rest after them."""
    upkeep = Upkeep(s, f"{shared_dir(s)}/codeatlas-upkeep-{uuid.uuid4().hex}", 8)
    for i, batch in enumerate(_versions(s, d)):
        upkeep.apply(batch, i)
    upkeep.drain()
    return upkeep.read("edges").drop("bucket")


for f in (incremental_refresh, stream_tool_stats, stream_hourly_events, freshness_state, freshness_state_stream, session_watch, session_watch_stream, debounced, debounced_stream):
    QUERIES[f.__name__] = f
ORACLE_SQL["stream_tool_stats"] = "SELECT event_type AS tool, count(*) AS calls, floor(avg(value) + 0.5)::BIGINT AS avg_ms, max(value) AS max_ms FROM events GROUP BY event_type"
ORACLE_SQL["stream_hourly_events"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2"
_SESSIONS = """WITH RECURSIVE e AS (SELECT event_type AS kind, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events),
  s AS (SELECT kind, ts, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 10 MINUTE) OVER (PARTITION BY kind ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM e),
  c(kind, session, started) AS (SELECT kind, session, min(ts) FROM s GROUP BY ALL UNION ALL SELECT c.kind, c.session, min(s.ts) FROM c JOIN s ON s.kind = c.kind AND s.session = c.session AND s.ts - c.started >= INTERVAL 30 MINUTE GROUP BY c.kind, c.session, c.started),
  p AS (SELECT kind, session, started, lead(started) OVER (PARTITION BY kind, session ORDER BY started) AS until FROM c)
  SELECT p.kind, started, max(s.ts) AS ended, count(*)::INT AS n, count(*) >= 4 AS bulk FROM p JOIN s ON s.kind = p.kind AND s.session = p.session AND s.ts >= started AND (until IS NULL OR s.ts < until) GROUP BY p.kind, p.session, started"""
ORACLE_SQL["debounced"] = _SESSIONS
ORACLE_SQL["debounced_stream"] = _SESSIONS.replace("GROUP BY p.kind, p.session, started", "JOIN (SELECT kind, session, max(ts) AS last FROM s GROUP BY ALL) z ON z.kind = p.kind AND z.session = p.session WHERE z.last + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY p.kind, p.session, started")
ORACLE_SQL["incremental_refresh"] = """WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey AS path, p_size FROM part WHERE p_partkey % 11 <> 0),
  fn AS (SELECT path, unnest(CASE WHEN k % 5 = 0 THEN ['h' || (k % 300)] ELSE ['f' || (k % 700), 'g' || (k * 7 % 1500)] END) AS name FROM p),
  c AS (SELECT path, 'main' AS caller, unnest(CASE WHEN k % 5 = 0 THEN ['f' || (k % 700), 'h' || (k % 400)] ELSE ['f' || (p_size * 13 % 900), 'g' || (k * 3 % 1600)] END) AS callee FROM p),
  u AS (SELECT name, min(path) AS sole, count(DISTINCT path) AS n FROM fn GROUP BY name)
  SELECT DISTINCT c.path, caller, callee, CASE WHEN o.path IS NOT NULL THEN c.path WHEN n = 1 THEN sole END AS target, CASE WHEN o.path IS NOT NULL THEN 'same_file' WHEN n = 1 THEN 'name_only' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS basis
  FROM c LEFT JOIN fn o ON c.path = o.path AND callee = o.name LEFT JOIN u ON callee = u.name"""
