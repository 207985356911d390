"""Soft state over streams of events: expiry, liveness, newest news, duplicates, rates.

Each function takes a streaming DataFrame of events (event_id, ts, user_id, event_type, value) and returns one; run()
drains what is there into a table of the shared folder, as a trigger availableNow does on a schedule.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringspark.operators.tables import shared_dir

DEAD_AFTER = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Drains the stream and returns what it wrote: appended rows, or the newest table of a complete or update output."""
    spark = stream.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{top}/out")
    else:
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{top}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def rate(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n, total of value by tumbling window."""
    timed = stream.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return timed.select(F.col("window.start").alias("start"), "n", "total")


def newest(stream: DataFrame) -> DataFrame:
    """user_id and what was heard of it last."""
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return stream.groupBy("user_id").agg(best.alias("best"), F.max("ts").alias("heard")).select("user_id", "heard", "best.event_id", "best.event_type")


def unique(stream: DataFrame, late: str = "3650 days") -> DataFrame:
    """The first row of each (user_id, event_type); later ones within the watermark go."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def lifetimes(stream: DataFrame, seconds: int) -> DataFrame:
    """user_id, expires: each user's entry lives so long after it was last written."""
    return stream.groupBy("user_id").agg((F.unix_timestamp(F.max("ts")) + seconds).alias("expires"), F.count("*").alias("writes"))


def sessions(stream: DataFrame, idle: str = "1200 seconds", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n: runs of events without a pause of `idle`; a session is reaped that long after its last event."""
    timed = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("n"))
    return timed.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def liveness(stream: DataFrame) -> DataFrame:
    """user_id, alive, losses, seen: an error is a loss, all else clears them; after more than four in a row a node is dead.

    Rows of one trigger are taken in order of (ts, event_id); the state is two numbers a user. Of a user's rows in a
    trigger only the moments of errors after the last good row are held.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        losses, seen = state.get if state.exists else (0, 0)
        good, after = None, pd.DataFrame()
        for rows in parts:
            seen += len(rows)
            fine = rows[rows["event_type"] != "error"]
            if len(fine):
                last = fine.sort_values(["ts", "event_id"]).iloc[-1]
                last = (last["ts"], last["event_id"])
                good = last if good is None else max(good, last)
            bad = rows.loc[rows["event_type"] == "error", ["ts", "event_id"]]
            after = pd.concat([after, bad]) if len(after) else bad
            if good is not None:
                after = after[(after["ts"] > good[0]) | ((after["ts"] == good[0]) & (after["event_id"] > good[1]))]
        losses = len(after) + (losses if good is None else 0)
        state.update((losses, seen))
        yield pd.DataFrame({"user_id": [key[0]], "alive": [losses <= DEAD_AFTER], "losses": [losses], "seen": [seen]})

    picked = stream.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return picked.applyInPandasWithState(update, "user_id long, alive boolean, losses long, seen long", "losses long, seen long", "update", GroupStateTimeout.NoTimeout)
