"""Streams in event time: rows that come out of order, watermarks that close windows, sessions and intervals, and rows too
late for them.

A feed is a table whose rows carry the step in which they arrive.  `run_feed` appends the rows of one step after another
to a source folder and each time lets the stream run to its end from the same checkpoint, so state survives as many
restarts as there are steps.  The watermark is the latest event time seen so far, less the allowed delay; rows that the
watermark has passed when their step begins are dropped by the engine, and the same rows are told by `late_rows` for a
side table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lineage import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_feed(spark: SparkSession, feed: DataFrame, transform: Callable[[Callable[[], DataFrame]], DataFrame], step: str = "step", keep: Callable[[DataFrame, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(result, late): what transform makes of the stream in append mode, and the rows that came too late.

    transform gets a function that opens the source as a stream (once for each side of a join).  keep(rows, watermark)
    says of a row whether the watermark, as it stood before the row's step, lets it in; without it no row is late."""
    source, sink, checkpoint, late = (scratch(spark) for _ in range(4))
    rows = feed.drop(step)
    steps = sorted(r[0] for r in feed.select(step).distinct().collect())  # the steps of the feed, not its rows
    watermark, late_parts = None, []
    for k in steps:
        part = feed.where(F.col(step) == k).drop(step)
        part.write.mode("append").parquet(source)
        if watermark is not None and keep is not None:
            missed = part.where(~keep(part, F.lit(watermark).cast("timestamp"))).withColumn(step, F.lit(k))
            missed.write.mode("append").parquet(late)
            late_parts.append(late)
        made = transform(lambda: spark.readStream.schema(rows.schema).parquet(source))
        query = made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        watermark = _watermark(query) or watermark
    result = spark.read.schema(made.schema).parquet(sink)
    missed = spark.read.schema(rows.withColumn(step, F.lit(0)).schema).parquet(late) if late_parts else rows.withColumn(step, F.lit(0)).where("false")
    return result, missed


def _watermark(query) -> datetime | None:
    """The watermark that the last micro-batch used."""
    for p in reversed(query.recentProgress):
        at = (p if isinstance(p, dict) else json.loads(p.json)).get("eventTime", {}).get("watermark")
        if at and not at.startswith("1970"):
            return datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(UTC)
    return None


def closed_windows(events: DataFrame, delay: str, length: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """(keys..., window_start, n, value): tumbling or sliding windows, each sent once, when the watermark closes it."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))
    return g.select(*keys, F.col("w.start").alias("window_start"), "n", "value")


def closed_sessions(events: DataFrame, delay: str, gap: str = "30 minutes", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(keys..., session_start, session_end, n): sessions, each sent once, when the watermark has passed its end."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, delay: str, within: str, ts: str = "ts") -> DataFrame:
    """Pairs of rows of two streams with equal keys, the right one up to `within` after the left one; columns get the
    prefixes l_ and r_.  Both sides keep only what the watermark still lets meet a row of the other."""
    a = left.withWatermark(ts, delay).select(*(F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns))
    b = right.withWatermark(ts, delay).select(*(F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns))
    near = (F.col(f"r_{ts}") >= F.col(f"l_{ts}")) & (F.col(f"r_{ts}") <= F.col(f"l_{ts}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & near)


SERIES = "metric string, step long, value double, kind string, raw string"


class SeriesState(StatefulProcessor):
    """The last value of each step of a metric, kept until the watermark passes the end of the step's bucket.

    A key is a metric and a bucket of consecutive steps, so the state of a metric is spread over tasks and each piece of
    it ends.  Of the values of a step the latest wins, by event time, then by `seq`.  What is no number is sent at once
    as an error row.  When a bucket's timer fires its series is sent and its state removed."""

    def __init__(self, ends: Callable[[int], int]):
        self.ends = ends  # bucket -> its end in milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "step long", "ts long, seq long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        metric, bucket = key
        for part in rows:
            numbers = pd.to_numeric(part["raw"], errors="coerce")
            wrong = part[numbers.isna()]
            if len(wrong):
                yield pd.DataFrame({"metric": metric, "step": wrong["step"], "value": float("nan"), "kind": "error", "raw": wrong["raw"]})
            good = part.assign(value=numbers, micros=part["ts"].astype("datetime64[us]").astype("int64"))[numbers.notna()]
            best = good.sort_values(["micros", "seq"]).groupby("step").last()
            for step, r in best.iterrows():
                old = self.last.getValue((int(step),)) if self.last.containsKey((int(step),)) else None
                if old is None or (old[0], old[1]) < (int(r["micros"]), int(r["seq"])):
                    self.last.updateValue((int(step),), (int(r["micros"]), int(r["seq"]), float(r["value"])))
        end = self.ends(int(bucket))
        if end not in set(_timers(self.handle)):
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted((k[0], v[2]) for k, v in self.last.iterator())
        self.last.clear()
        if held:
            yield pd.DataFrame({"metric": key[0], "step": [s for s, _ in held], "value": [v for _, v in held], "kind": "series", "raw": None})

    def close(self) -> None:
        pass


def _timers(handle) -> list[int]:
    return [t[0] if isinstance(t, (tuple, Row)) else int(t) for t in handle.listTimers()]


def last_values(events: DataFrame, delay: str, per_bucket: int, bucket_ms: int, origin_ms: int = 0) -> DataFrame:
    """(metric, step, value, kind, raw) of a stream (metric, step, seq, ts, raw): closed buckets' series, and errors.

    Bucket b holds the steps b * per_bucket and following, and ends at origin_ms + (b + 1) * bucket_ms.  Needs the
    RocksDB state store (`keyed_state`)."""
    keyed = events.withWatermark("ts", delay).withColumn("bucket", F.floor(F.col("step") / per_bucket).cast("long"))
    processor = SeriesState(lambda b: origin_ms + (b + 1) * bucket_ms)
    return keyed.groupBy("metric", "bucket").transformWithStateInPandas(processor, SERIES, "Append", "eventtime")


class keyed_state:  # noqa: N801
    """Within it the session's streams keep their state in RocksDB; the setting that was there comes back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        self.spark.conf.unset(PROVIDER) if self.before is None else self.spark.conf.set(PROVIDER, self.before)
