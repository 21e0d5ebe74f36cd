"""Event-time streams fed step by step: lateness, closing, keyed state over restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vantage.streaming import eventtime as et

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def test_windows_close_once_and_late_rows_are_told(spark):
    rows = [(0, at(0.1), "a", 1.0), (0, at(5.5), "a", 2.0), (1, at(0.2), "a", 4.0), (1, at(5.6), "a", 8.0), (1, at(9.5), "b", 16.0), (2, at(5.7), "a", 32.0), (2, at(9.6), "b", 64.0)]
    feed = spark.createDataFrame(rows, "step int, ts timestamp, event_type string, value double")
    keep = lambda _, w: F.window("ts", "1 hour")["end"] > w
    made, late = et.run_feed(spark, feed, lambda src: et.closed_windows(src(), "2 hours"), keep=keep)
    # after step 0 the watermark is 3.5: the row of 0.2 is late; after step 1 it is 7.5: the row of 5.7 is
    assert sorted((r["event_type"], r["window_start"], r["n"], r["value"]) for r in made.collect()) == [("a", at(0), 1, 1.0), ("a", at(5), 2, 10.0)]
    assert sorted((r["step"], r["value"]) for r in late.collect()) == [(1, 4.0), (2, 32.0)]
    none, late = et.run_feed(spark, feed.where("step = 0"), lambda src: et.closed_windows(src(), "30 days"), keep=keep)
    assert none.count() == 0 and late.count() == 0 and late.columns == ["ts", "event_type", "value", "step"]


def test_last_value_of_a_step_wins_over_restarts(spark):
    rows = [(0, "loss", 0, 1, at(1), "1.5"), (0, "loss", 0, 2, at(1), "2.5"), (0, "loss", 1, 3, at(2), "nope"), (1, "loss", 0, 0, at(1.5), "3.5"), (1, "loss", 1, 9, at(0.5), "7"), (1, "acc", 24, 1, at(30), "9"), (1, "loss", 24, 1, at(60), "1"), (2, "loss", 1, 99, at(3), "100")]
    feed = spark.createDataFrame(rows, "step int, metric string, at long, seq long, ts timestamp, raw string")
    day = 86_400_000
    with et.keyed_state(spark):
        made, _ = et.run_feed(spark, feed, lambda src: et.last_values(src().withColumnRenamed("at", "step"), "2 hours", 24, day, 1_704_067_200_000))
    got = sorted((r["metric"], r["step"], r["kind"], r["value"] if r["kind"] == "series" else r["raw"]) for r in made.collect())
    # the last row comes when the watermark (58 hours) has passed its day
    assert got == [("acc", 24, "series", 9.0), ("loss", 0, "series", 3.5), ("loss", 1, "error", "nope"), ("loss", 1, "series", 7.0), ("loss", 24, "series", 1.0)]
