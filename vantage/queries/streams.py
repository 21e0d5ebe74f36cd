"""Event streams: the tracker, windows and sessions, each equal to its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import eventtime as et
from ..streaming import tracker as tk
from .base import registrar, table

ALL, query = registrar()

SCALARS = {"click": "clicks", "view": "views"}
DICTS = {"purchase": {"k": "purchase_k"}}


def _events(df):
    """The events table as training events: some scalar, some maps, some that are no numbers."""
    is_dict = F.col("event_type") == "purchase"
    value = F.when(is_dict, F.col("props")).when(F.col("event_id") % 17 == 0, F.lit("oops")).otherwise(F.round("value", 3).cast("string"))
    return df.select(F.col("event_type").alias("name"), F.when(is_dict, "dict").otherwise("scalar").alias("write_type"), F.col("event_id").alias("step"), value.alias("event"))


TRACKED = """SELECT CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' ELSE 'purchase_k' END AS metric, event_id AS step,
CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k')::DOUBLE ELSE round(value, 3) END AS value
FROM events WHERE event_type IN ('click', 'view', 'purchase') AND (event_type = 'purchase' OR event_id % 17 <> 0)"""


@query(TRACKED)
def tracked_series(spark, sf_dir):
    """Z1, Z2, X19 as a batch."""
    return tk.track(_events(table(spark, sf_dir, "events")), SCALARS, DICTS)


def _stream(spark, sf_dir, transform, mode="append"):
    schema = table(spark, sf_dir, "events").schema
    name = f"vantage_{uuid.uuid4().hex}"
    # a file source reads a folder: the glob names the one file
    return tk.stream_table(spark, f"{sf_dir}/events.parquet*", schema, transform, name, mode)


@query(TRACKED)
def tracked_series_streamed(spark, sf_dir):
    """Z1, Z2, K9 as a stream over the same files."""
    return _stream(spark, sf_dir, lambda s: tk.track(_events(s), SCALARS, DICTS))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    """Tumbling windows."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = tk.windowed_counts(e)
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 3).alias("value"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts_streamed(spark, sf_dir):
    """The same windows on a stream, all of them at its end."""
    w = _stream(spark, sf_dir, lambda s: tk.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query("""WITH l AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    """Sessions with a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = tk.sessions(e)
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, CASE WHEN event_id + 1 > 100 THEN 'late' ELSE 'early' END AS phase FROM events")
def controller_phases(spark, sf_dir):
    """Z3."""
    return table(spark, sf_dir, "events").select("event_id", tk.controller_phase("event_id", 100).alias("phase"))


#: Rows arrive up to two days late, one in ten up to 16 days; they are fed in four steps of twelve days.
DELAY_DAYS, STEPS = 2, 4
FEED = f"""f AS (SELECT *, least((date_diff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN event_id * 37 % 100 < 90 THEN event_id * 37 % 100 % 3 ELSE event_id * 37 % 100 % 17 END) // 12, {STEPS - 1})::INT AS step FROM events),
m AS (SELECT step, max(max(ts)) OVER (ORDER BY step) - INTERVAL {DELAY_DAYS} DAY AS after FROM f GROUP BY step),
wm AS (SELECT step, lag(date_trunc('millisecond', after), 1, TIMESTAMP '1970-01-01') OVER (ORDER BY step) AS before, date_trunc('millisecond', after) AS after FROM m),
x AS (SELECT f.*, before, after FROM f JOIN wm USING (step)), final AS (SELECT max(after) AS closed FROM wm)"""


def _feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = F.col("event_id") * 37 % 100
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + F.when(d < 90, d % 3).otherwise(d % 17)
    return e.withColumn("step", F.least(F.floor(day / 12), F.lit(STEPS - 1)).cast("int"))


def _in_hour(_, watermark):
    return F.window("ts", "1 hour")["end"] > watermark


@query(f"""WITH {FEED}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS value
FROM x, final WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > before AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= closed GROUP BY ALL""")
def closed_hours_streamed(spark, sf_dir):
    """Windows of a stream that comes out of order, each sent once, when the watermark closes it; late rows dropped."""
    w, _ = et.run_feed(spark, _feed(spark, sf_dir), lambda src: et.closed_windows(src(), f"{DELAY_DAYS} days"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 3).alias("value"))


@query(f"""WITH {FEED}
SELECT step, event_type, count(*) AS n FROM x WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= before GROUP BY ALL""")
def late_events_streamed(spark, sf_dir):
    """The rows that the same stream drops, counted by step and kind."""
    _, late = et.run_feed(spark, _feed(spark, sf_dir), lambda src: et.closed_windows(src(), f"{DELAY_DAYS} days"), keep=_in_hour)
    return late.groupBy("step", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _session_step(k: int) -> str:
    """Open sessions before step k and its rows, merged; those whose end the watermark has passed are sent."""
    return f"""
i{k} AS (SELECT user_id, a, b, n FROM o{k - 1} UNION ALL
  SELECT user_id, ts, ts + INTERVAL 6 HOUR, 1 FROM x WHERE step = {k} AND ts + INTERVAL 6 HOUR > before),
g{k} AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i{k})),
s{k} AS (SELECT user_id, min(a) AS a, max(b) AS b, sum(n) AS n FROM g{k} GROUP BY user_id, s),
o{k} AS (SELECT user_id, a, b, n FROM s{k} WHERE b > coalesce((SELECT max(after) FROM wm WHERE step <= {k}), TIMESTAMP '1970-01-01')),
e{k} AS (SELECT user_id, a, b, n FROM s{k} WHERE b <= coalesce((SELECT max(after) FROM wm WHERE step <= {k}), TIMESTAMP '1970-01-01'))"""


@query(f"""WITH {FEED}, o_none AS (SELECT user_id, ts AS a, ts AS b, 0 AS n FROM events WHERE false), {", ".join(_session_step(k) for k in range(STEPS)).replace("FROM o-1 ", "FROM o_none ")}
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS finish, n::BIGINT AS n
FROM ({" UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(STEPS))})""")
def closed_sessions_streamed(spark, sf_dir):
    """Sessions of a stream that comes out of order; a session that was sent is not opened again."""
    s, _ = et.run_feed(spark, _feed(spark, sf_dir), lambda src: et.closed_sessions(src(), f"{DELAY_DAYS} days", "6 hours"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return s.select("user_id", stamp("session_start").alias("start"), stamp("session_end").alias("finish"), "n")


@query(f"""WITH {FEED.replace("m AS (SELECT step, max(max(ts)) OVER (ORDER BY step)", "m AS (SELECT step, max(min(ts)) OVER (ORDER BY step)").replace("AS after FROM f GROUP BY step", "AS after FROM (SELECT step, kind, max(ts) AS ts FROM (SELECT a.step, b.event_type AS kind, b.ts FROM (SELECT DISTINCT step FROM f) a JOIN f b ON b.step <= a.step WHERE b.event_type IN ('click', 'purchase')) GROUP BY step, kind) GROUP BY step HAVING count(*) = 2")}
SELECT l.event_id AS click, r.event_id AS purchase FROM x l JOIN x r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 12 HOUR
WHERE l.event_type = 'click' AND r.event_type = 'purchase' AND l.ts > l.before AND r.ts > r.before""")
def clicks_before_purchases_streamed(spark, sf_dir):
    """Interval join of two streams: purchases up to 12 hours after a click of the same user."""

    def pairs(src):
        kind = lambda k: src().where(F.col("event_type") == k).select("event_id", "user_id", "ts")
        return et.interval_join(kind("click"), kind("purchase"), "user_id", f"{DELAY_DAYS} days", "12 hours")

    found, _ = et.run_feed(spark, _feed(spark, sf_dir), pairs)
    return found.select(F.col("l_event_id").alias("click"), F.col("r_event_id").alias("purchase"))


#: Milliseconds of 2024-01-01, and of a day.
ORIGIN, DAY = 1_704_067_200_000, 86_400_000


@query(f"""WITH {FEED}, h AS (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts) AS s, CASE WHEN event_id % 17 = 0 THEN 'oops' ELSE round(value, 3)::VARCHAR END AS raw FROM x WHERE ts > before),
g AS (SELECT event_type, s, arg_max(raw, (ts, event_id)) AS raw FROM h, final WHERE raw <> 'oops' AND (ts::DATE + 1)::TIMESTAMP <= closed GROUP BY event_type, s)
SELECT event_type AS metric, s::BIGINT AS step, raw::DOUBLE AS value, 'series' AS kind, NULL AS raw FROM g
UNION ALL SELECT event_type, s::BIGINT, NULL, 'error', raw FROM h WHERE raw = 'oops'""")
def last_values_streamed(spark, sf_dir):
    """Keyed state with timers; the last value of a step wins, errors go to rows of their own, a day's
    steps are sent and forgotten when the watermark has passed the day."""
    raw = F.when(F.col("event_id") % 17 == 0, F.lit("oops")).otherwise(F.round("value", 3).cast("string"))
    hour = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 24 + F.hour("ts")
    feed = _feed(spark, sf_dir).select("step", F.col("event_type").alias("metric"), hour.cast("long").alias("at"), F.col("event_id").alias("seq"), "ts", raw.alias("raw"))
    with et.keyed_state(spark):
        made, _ = et.run_feed(spark, feed, lambda src: et.last_values(src().withColumnRenamed("at", "step"), f"{DELAY_DAYS} days", 24, DAY, ORIGIN))
    return made.select("metric", "step", F.nanvl("value", F.lit(None).cast("double")).alias("value"), "kind", "raw")
