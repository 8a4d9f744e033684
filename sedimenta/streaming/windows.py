"""Event-time windows, latest state and incremental index maintenance over streams; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, column: str = "created_at") -> DataFrame:
    """Watermarks need a zoned timestamp; zone-free ones are read in the session's zone (UTC)."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str, slide: str | None = None, *, late: str = "10 minutes", by: str = "tool_name") -> DataFrame:
    w = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    rows = timed(events)
    rows = rows.withWatermark("created_at", late) if rows.isStreaming else rows
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "latency")


def sessions(events: DataFrame, gap: str, *, late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    rows = timed(events)
    rows = rows.withWatermark("created_at", late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window("created_at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def ingest(stream: DataFrame, table, keys: list[str], order: list[str], checkpoint: str):
    """Applies a change stream to a versioned table: op 'delete' removes a key, else the key's last change replaces it.

    Each micro-batch is one merge, so a batch that runs again after a failure gives the same version's rows.
    """
    from sedimenta.operators.maintain import latest

    def apply(batch: DataFrame, _: int) -> None:
        last = latest(batch, keys[0], order).persist()
        try:
            kept = last.where("op <> 'delete'").drop("op")
            old = table.read()
            if old is None:
                table.write(kept)
            else:
                table.write(old.join(last.select(*keys), keys, "left_anti").unionByName(kept.select(*old.columns)))
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker(events: DataFrame, failures: int = 5) -> DataFrame:
    """Per tool, whether a circuit breaker is open after each event: `failures` or more failures in a row up to there.

    Events are ordered within tool and day. A day is summed up as the failures that end it and whether it has a success, and begins
    with the failures that end the days before it, so that a busy tool is dealt over its days.
    """
    from pyspark.sql import Window

    rows = events.withColumn("day", F.date_trunc("day", "created_at")).withColumn("bad", (~F.col("success")).cast("int"))
    day = Window.partitionBy("tool_name", "day").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(F.col("success").cast("int")).over(day)).withColumn("so_far", F.sum("bad").over(day))
    # failures since the day's last success, or its beginning
    since = F.col("so_far") - F.coalesce(F.max(F.when(F.col("success"), F.col("so_far"))).over(day), F.lit(0))
    rows = rows.withColumn("k", since)
    days = rows.groupBy("tool_name", "day").agg(F.max_by("k", F.struct("created_at", "id")).alias("ends"), F.max(F.col("success").cast("int")).alias("mended"))
    over = Window.partitionBy("tool_name").orderBy("day")  # a row per day
    days = days.withColumn("part", F.sum("mended").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("open", F.sum("ends").over(Window.partitionBy("tool_name", "part").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    days = days.select("tool_name", "day", F.coalesce(F.lag("open").over(over), F.lit(0)).alias("before"))
    out = rows.join(days, ["tool_name", "day"]).withColumn("n", F.col("k") + F.when(F.col("run") == 0, F.col("before")).otherwise(0))
    return out.select("id", "tool_name", F.col("n").alias("failures_in_row"), (F.col("n") >= failures).alias("open"))


def progress(spark, query) -> DataFrame:
    """(rows_read) of a query's batches so far, from its own progress reports."""
    return spark.createDataFrame([(sum(int(p["numInputRows"]) for p in query.recentProgress),)], "rows_read long")
