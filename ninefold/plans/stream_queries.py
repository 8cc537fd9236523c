"""Cell density over event time: as a table, and as a stream over the same files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ninefold.streaming.density import stream_density

from .sql import PLANAR, planar_sql, shared_folder, table, walk_sql


def _points(df):
    x, y = (e.format(d="D") for e in PLANAR["events"])
    return df.selectExpr("CAST(ts AS TIMESTAMP) AS ts", f"{x} AS x", f"{y} AS y", "'021' AS c2")


def _plain(counted):
    return counted.select(F.col("start").cast("timestamp_ntz").alias("start"), "path", "n")


def g1_event_density(spark, sf_dir):
    return _plain(stream_density(_points(table(spark, sf_dir, "events")), 3, "1 day"))


G1E = walk_sql(planar_sql("events", ("ts",)), 3, ("ts",)) + "SELECT date_trunc('day', ts) AS start, path, count(*) AS n FROM cells WHERE lvl = 3 GROUP BY ALL"


def g1_event_density_stream(spark, sf_dir):
    """The same by Structured Streaming. Each batch writes the counts that it changed; of each window
    and cell the last batch that wrote it counts, so windows that are still open are there too."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    counted = stream_density(_points(events), 3, "1 day")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch-{number}")

    run = counted.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("start TIMESTAMP, path STRING, n LONG, batch LONG").parquet(f"{root}/out/batch-*")
    return _plain(rows.groupBy("start", "path").agg(F.max_by("n", "batch").alias("n")))


QUERIES = {"g1_event_density": g1_event_density, "g1_event_density_stream": g1_event_density_stream}
ORACLE_SQL = {"g1_event_density": G1E, "g1_event_density_stream": G1E}
