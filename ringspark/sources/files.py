"""Readers and writers of the engine's own file formats.

Text formats are read as whole files (they are small, one a node) and taken apart by built-in functions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 24  # bytes of an id and a 32-bit number, both big-endian


def read_key_aux(spark: SparkSession, path: str) -> DataFrame:
    """path, recno, id, aux of fixed-width files: a 20-byte id and 4 bytes of auxiliary data a record."""
    files = spark.read.format("binaryFile").load(path).select("path", F.hex("content").alias("h"))
    n = F.floor(F.length("h") / (2 * RECORD)).cast("int")
    rows = files.where(n > 0).select("path", "h", F.explode(F.sequence(F.lit(0), n - 1)).alias("recno"))
    at = F.col("recno") * 2 * RECORD
    return rows.select("path", F.col("recno").cast("long").alias("recno"), F.lower(F.substring("h", at + 1, F.lit(40))).alias("id"), F.conv(F.substring("h", at + 41, F.lit(8)), 16, 10).cast("long").alias("aux"))


def write_key_aux(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (node, id, aux) as one file a node and task; returns path, records. A task writes aside and renames."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    dealt = rows.select("node", "id", "aux").repartition("node").sortWithinPartitions("node", "id")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        part, out, now, done = TaskContext.get().partitionId(), None, None, []

        def close() -> None:
            out[0].close()
            system.move(out[1], f"{root}/{now}-{part:05d}.kdb")
            done.append((f"{root}/{now}-{part:05d}.kdb", out[2]))

        for b in batches:
            for node, group in b.groupby("node", sort=False):
                if node != now:
                    if out:
                        close()
                    name = f"{root}/.{uuid.uuid4().hex}"
                    now, out = node, [system.open_output_stream(name), name, 0]
                out[0].write(b"".join(bytes.fromhex(i) + int(a).to_bytes(4, "big") for i, a in zip(group["id"], group["aux"], strict=True)))
                out[2] += len(group)
        if out:
            close()
        yield pd.DataFrame(done, columns=["path", "records"])

    return dealt.mapInPandas(put, "path string, records long")


def lines_of(files: DataFrame) -> DataFrame:
    """path, at, line of whole files (path, value)."""
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def config(files: DataFrame) -> DataFrame:
    """path, key, value, number: lines of two or more words; # begins a comment, the last definition of a key wins."""
    words = F.split(F.trim(F.regexp_replace("line", "#.*", "")), r"\s+")
    rows = lines_of(files).withColumn("w", words).where(F.size("w") >= 2)
    last = rows.groupBy("path", F.col("w")[0].alias("key")).agg(F.max_by(F.col("w")[1], "at").alias("value"))
    return last.withColumn("number", F.when(F.col("value").rlike(r"^-?\d+$"), F.col("value").cast("long")))


def finger_file(files: DataFrame) -> DataFrame:
    """path, id, neighbour, latency: pairs of lines, an id and then its neighbours as id|latency."""
    rows = lines_of(files).where(F.trim("line") != "")
    pair = rows.withColumn("n", F.floor((F.row_number().over(_by_line()) - 1) / 2)).groupBy("path", "n")
    both = pair.agg(F.min_by("line", "at").alias("id"), F.max_by("line", "at").alias("list"), F.count("*").alias("c")).where("c = 2")
    each = both.select("path", F.trim("id").alias("id"), F.explode(F.split(F.trim("list"), r"\s+")).alias("e"))
    return each.select("path", "id", F.split("e", r"\|")[0].alias("neighbour"), F.split("e", r"\|")[1].cast("double").alias("latency"))


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("at")


def monitor_feed(files: DataFrame) -> DataFrame:
    """path, host, n, t, body: the STATS blocks that follow each HELO line."""
    from pyspark.sql import Window

    rows = lines_of(files).withColumn("helo", F.regexp_extract("line", r"^HELO (\S+) (\d+)", 0)).withColumn("stats", F.regexp_extract("line", r"^STATS (\S+)", 1))
    run = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("who", F.last(F.when(F.col("helo") != "", F.col("helo")), ignorenulls=True).over(run))
    rows = rows.withColumn("block", F.sum((F.col("stats") != "").cast("long")).over(run)).withColumn("ended", F.sum((F.col("line") == "ENDSTATS").cast("long")).over(run))
    body = rows.where("block > ended and helo = '' ").groupBy("path", "who", "block")
    out = body.agg(F.max("stats").alias("t"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("stats") == "", F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("body"))
    return out.select("path", F.split("who", " ")[1].alias("host"), F.split("who", " ")[2].cast("long").alias("n"), "t", "body")


def ring_log(files: DataFrame) -> DataFrame:
    """path, id, kind (succ, pred, finger), i, start, target: what nodes say of their neighbours in their logs."""
    from pyspark.sql import Window

    rows = lines_of(files)
    run = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.nullif(F.regexp_extract("line", r"^myID is ([0-9a-f]+)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^===== ([0-9a-f]+)", 1), F.lit("")))
    rows = rows.withColumn("id", F.last(own, ignorenulls=True).over(run))
    succ, finger, pred = r"^succ (\d+) : ([0-9a-f]+)", r"^finger: (\d+) : ([0-9a-f]+) : succ ([0-9a-f]+)", r"^pred :\s+([0-9a-f]+)"
    get = lambda p, k: F.regexp_extract("line", p, k)
    kind = F.when(F.col("line").rlike(succ), "succ").when(F.col("line").rlike(finger), "finger").when(F.col("line").rlike(pred), "pred")
    rows = rows.withColumn("kind", kind).where("kind is not null and id is not null")
    i = F.when(F.col("kind") == "succ", get(succ, 1)).when(F.col("kind") == "finger", get(finger, 1)).cast("int")
    target = F.when(F.col("kind") == "succ", get(succ, 2)).when(F.col("kind") == "finger", get(finger, 3)).otherwise(get(pred, 1))
    return rows.select("path", "id", "kind", i.alias("i"), F.when(F.col("kind") == "finger", get(finger, 2)).alias("start"), target.alias("target"))
