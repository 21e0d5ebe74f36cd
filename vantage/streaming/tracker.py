"""Training events as a stream: filter, flatten, append as time series; batch and streaming share one transformation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch

EVENT = "name string, write_type string, step long, event string"


def track(events: DataFrame, scalars: dict[str, str], dicts: dict[str, dict[str, str]]) -> DataFrame:
    """(metric, step, value) of events (name, write_type, step, event).

    A scalar event is a number, a dict event a JSON map; values that are no numbers and unknown names are left out.
    It keeps no state, so it runs alike on a batch and on a stream."""
    names = [(n, "", m) for n, m in scalars.items()] + [(n, k, m) for n, ks in dicts.items() for k, m in ks.items()]
    metric = F.create_map(*(F.lit(x) for n, k, m in names for x in (f"{n}\0{k}", m))) if names else F.create_map().cast("map<string,string>")
    is_dict = F.lower("write_type") == "dict"
    values = F.when(is_dict, F.from_json("event", "map<string,string>")).when(F.lower("write_type") == "scalar", F.create_map(F.lit(""), F.col("event")))
    rows = events.select("name", "step", F.explode(values).alias("key", "raw"))
    rows = rows.select(metric[F.concat_ws("\0", "name", "key")].alias("metric"), "step", F.expr("try_cast(raw AS DOUBLE)").alias("value"))
    return rows.where("metric IS NOT NULL AND value IS NOT NULL")


def run_tracker(spark: SparkSession, source: str, sink: str, checkpoint: str, scalars: dict, dicts: dict) -> None:
    """Reads what is new in source (JSON events), appends series to sink by metric, and stops (incremental ingestion)."""
    stream = spark.readStream.schema(EVENT).json(source)
    query = track(stream, scalars, dicts).writeStream.format("parquet").partitionBy("metric").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_table(spark: SparkSession, source: str, schema: str, transform, name: str, mode: str = "append") -> DataFrame:
    """Drives a stream over Parquet files to its end into Parquet files in the shared folder, and reads them.

    In append mode the file sink is written.  Other modes rewrite the result with each micro-batch; the last stands."""
    path, checkpoint = scratch(spark), scratch(spark)
    made = transform(spark.readStream.schema(schema).parquet(source))
    writer = made.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value): tumbling windows in event time; with a watermark on streams."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): events of a user no more than gap apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def controller_phase(step, switch_at: int):
    """Whether parameters switch at this step: step + 1 > switch_at."""
    return F.when(F.col(step) + 1 > switch_at, F.lit("late")).otherwise(F.lit("early"))
