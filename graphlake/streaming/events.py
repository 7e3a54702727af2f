"""An extension for streams: windowed counts with late data, and online assignment of arriving nodes."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions.hashing import bucket
from graphlake.functions.store import delete, shared_folder


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; events(ts, event_type, value) later than ``late`` are left out of closed windows."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def assign_online(events: DataFrame, k: int) -> DataFrame:
    """Events with the part of their user: stateless, so it needs no order and no memory of users."""
    return events.withColumn("part", bucket(F.col("user_id"), k))


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source holds now and returns what it wrote.  Output and state go when the process ends."""
    root = f"{shared_folder(spark)}/graphlake/stream-{name}"
    atexit.register(delete, spark, root)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
