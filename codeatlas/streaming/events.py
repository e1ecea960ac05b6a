"""Streaming twins of the event rollups: files as they come, watermarks, windows, and a keyed state machine."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from codeatlas.session import shared_dir
from codeatlas.streaming.machine import Session

#: Load of each event type; a signup begins a session anew.
LOAD = {"click": 1, "view": 2, "purchase": 5, "error": 8}


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder or file pattern, all at once if asked to run once."""
    return spark.readStream.schema(schema).parquet(path)


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table of the shared folder, and read that."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    base = f"{shared_dir(spark)}/codeatlas-stream-{name}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{base}-state").option("path", base).outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda x, _: x.write.mode("overwrite").parquet(base)).option("checkpointLocation", f"{base}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(base)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def debounced(events: DataFrame, key: str, idle: str = "30 seconds", ceiling_ms: int = 120_000, bulk: int = 25, late: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n, bulk): events of a key that follow one another within ``idle`` are one batch of work,
    cut wherever ``ceiling`` has passed since its start; bulk if there are many. In a stream, sessions come out, and their
    state goes, once the watermark has passed them."""
    us = F.unix_micros("ts")
    s = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", idle).alias("w")).agg(F.sort_array(F.collect_list(us)).alias("us"))

    def cut(a, x):
        last = F.element_at(a, -1)
        more = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["first"].alias("first"), x.alias("last"), (last["n"] + 1).alias("n"))))
        new = F.concat(a, F.array(F.struct(x.alias("first"), x.alias("last"), F.lit(1).alias("n"))))
        return F.when((F.size(a) > 0) & (x - F.element_at(a, -1)["first"] < ceiling_ms * 1000), more).otherwise(new)

    none = F.array().cast("array<struct<first:bigint,last:bigint,n:int>>")
    parts = s.select(key, F.explode(F.aggregate("us", none, cut)).alias("p"))
    return parts.select(key, F.timestamp_micros("p.first").alias("started"), F.timestamp_micros("p.last").alias("ended"), F.col("p.n").alias("n"), (F.col("p.n") >= bulk).alias("bulk"))


def _follow(session: Session | None, ts_us: list[int], kinds: list[str], modules: list[str | None]) -> tuple[Session | None, list[tuple]]:
    """The session after some calls in order, and (load, state, depth, score, level) after each."""
    out = []
    for us, kind, module in zip(ts_us, kinds, modules, strict=True):
        at = us // 1000
        session = session or Session(at)
        if kind == "signup":
            session.orient(at)
        else:
            session.call(at, LOAD.get(kind, 1), module)
        out.append((session.load, session.state, session.depth, float(session.score), session.level))
    return session, out


STATES = "user_id long, event_id long, load long, state string, depth int, score double, level int"
_KEYS = ["user_id", "event_id", "load", "state", "depth", "score", "level"]


def calls(events: DataFrame) -> DataFrame:
    """(user_id, us, event_id, event_type, module) of events; those of a small value touch no module."""
    module = F.when(F.col("value") > 3, F.col("event_type")).alias("module")
    return events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type", module)


def freshness_batch(events: DataFrame) -> DataFrame:
    """Each session's freshness and panic after each event, in order: rows of a user pass one after another, so a user of
    any size takes bounded memory."""
    order = calls(events).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, session = None, None
        for x in frames:
            rows: list[tuple] = []
            for u, own in x.groupby("user_id", sort=False):
                session = session if u == user else None
                user = u
                modules = [None if pd.isna(m) else m for m in own["module"]]
                session, out = _follow(session, own["us"].tolist(), own["event_type"].tolist(), modules)
                rows += [(u, e, *o) for e, o in zip(own["event_id"].tolist(), out, strict=True)]
            yield pd.DataFrame(rows, columns=_KEYS)

    return order.mapInPandas(run, STATES)


def freshness_stream(events: DataFrame) -> DataFrame:
    """The same for a stream: the session is the state of its user. Events of a batch are put in order; a later batch
    goes on from there."""

    def run(key, frames, state):
        session = pickle.loads(state.get[0]) if state.exists else None
        x = pd.concat(list(frames)).sort_values(["us", "event_id"])  # a batch's events of one user
        modules = [None if pd.isna(m) else m for m in x["module"]]
        session, out = _follow(session, x["us"].tolist(), x["event_type"].tolist(), modules)
        state.update((pickle.dumps(session),))
        yield pd.DataFrame([(key[0], e, *o) for e, o in zip(x["event_id"].tolist(), out, strict=True)], columns=_KEYS)

    return calls(events).groupBy("user_id").applyInPandasWithState(run, STATES, "session binary", "append", "NoTimeout")


WATCH = "user_id long, at_ms long, event_id long, kind string, load long, state string, depth int, score double, level int"
_WATCH = ["user_id", "at_ms", "event_id", "kind", "load", "state", "depth", "score", "level"]


def _told(user: int, at: int, event, kind: str, s: Session) -> tuple:
    return (user, at, event, kind, s.load, s.state, s.depth, float(s.score), s.level)


def _until(user: int, session: Session | None, at: int) -> tuple[Session | None, list[tuple]]:
    """What time alone does to a session before ``at``: a row for each fall of its level, and one for its end."""
    rows: list[tuple] = []
    while session is not None and (then := session.next_change()) < at:
        if session.settle(then):
            rows.append(_told(user, then, None, "settled", session))
        else:
            rows.append(_told(user, then, None, "ended", session))
            session = None
    return session, rows


def _through(user: int, session: Session | None, events) -> tuple[Session | None, list[tuple]]:
    """A session after (at, id, type, module) in order, and its rows."""
    rows: list[tuple] = []
    for at, event, kind, module in events:
        session, out = _until(user, session, at)
        rows += out
        session = session or Session(at, seen=at)
        if kind == "signup":
            session.orient(at)
        else:
            session.call(at, LOAD.get(kind, 1), module)
        rows.append(_told(user, at, event, "orient" if kind == "signup" else "call", session))
    return session, rows


def watch_batch(events: DataFrame, until_ms: int) -> DataFrame:
    """Sessions by event time: a row for each event up to a time, each fall of the panic level that time alone brings,
    and each end of a session that had no event for half an hour. Replays what ``watch_stream`` says."""
    own = calls(events).filter(F.col("us") <= until_ms * 1000)
    order = own.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, session = None, None
        for x in frames:
            rows: list[tuple] = []
            for u, part in x.groupby("user_id", sort=False):
                if u != user and user is not None:
                    rows += _until(user, session, until_ms + 1)[1]
                session = session if u == user else None
                user = u
                modules = [None if pd.isna(m) else m for m in part["module"]]
                session, out = _through(u, session, zip((part["us"] // 1000).tolist(), part["event_id"].tolist(), part["event_type"].tolist(), modules, strict=True))
                rows += out
            yield pd.DataFrame(rows, columns=_WATCH)
        if user is not None:
            yield pd.DataFrame(_until(user, session, until_ms + 1)[1], columns=_WATCH)

    return order.mapInPandas(run, WATCH)


class Watch(StatefulProcessor):
    """Events of a user wait until the watermark has passed them, so that they are taken in order however they came; a
    timer wakes the user for the first that waits, or for the next fall of the level, or for the session's end, when the
    state goes."""

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "packed binary")
        self.waiting = handle.getListState("waiting", "us long, event_id long, event_type string, module string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for x in rows:
            values = zip(x["us"].tolist(), x["event_id"].tolist(), x["event_type"].tolist(), [None if pd.isna(m) else m for m in x["module"]], strict=True)
            self.waiting.appendList(list(values))
        first = min(v[0] // 1000 for v in self.waiting.get())
        self._wake(first)
        yield pd.DataFrame([], columns=_WATCH)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(v) for v in self.waiting.get()] if self.waiting.exists() else []
        session = pickle.loads(self.session.get()[0]) if self.session.exists() else None
        due = sorted(v for v in waiting if v[0] // 1000 <= now)
        left = [v for v in waiting if v[0] // 1000 > now]
        session, rows = _through(key[0], session, ((us // 1000, e, kind, module) for us, e, kind, module in due))
        session, more = _until(key[0], session, now + 1)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        if session is None:
            self.session.clear()
        else:
            self.session.update((pickle.dumps(session),))
        wake = [v[0] // 1000 for v in left] + ([session.next_change()] if session else [])
        if wake:
            self._wake(min(wake), now)
        yield pd.DataFrame(rows + more, columns=_WATCH)

    def _wake(self, at: int, now: int = -1) -> None:
        timers = [t for t in self.handle.listTimers() if t > now]  # the one that has just expired is still listed
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def watch_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sessions by event time, with timers; events later than ``late`` are dropped."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    module = F.when(F.col("value") > 3, F.col("event_type")).alias("module")
    keyed = own.select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "event_type", module)
    return keyed.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Watch(), outputStructType=WATCH, outputMode="Append", timeMode="EventTime")
