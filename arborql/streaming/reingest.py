"""An addition, not of the reference: keep merged definitions up to date as symbol files arrive.

Each micro-batch is merged by key with what is stored, the first seen wins, and the result replaces the stored
table by a new version, so that a batch that runs again gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborql.operators.ordered import first_wins, values_in_order
from arborql.tables import hadoop_path


def merge_batch(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """(usr, ord, name, kind, availability): the head by ord; availabilities of all copies, in order, each once."""
    every = batch if stored is None else stored.unionByName(batch)
    head = first_wins(every, ["usr"], ["ord"]).drop("availability")
    values = values_in_order(every, ["usr"], "availability", "ord", "availability")
    return head.join(values, "usr", "left").withColumn("availability", F.coalesce("availability", F.array().cast("array<string>"))).select(every.columns)


def _versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = hadoop_path(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(hadoop_path(spark, f"{path}/{n}/_SUCCESS")[0]))


def _base(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The version that batch 0 of this checkpoint makes: one after what was stored when the checkpoint was begun, kept
    as the name of an empty folder beside its batches, so that a run after a stop goes on with the same numbers."""
    at, fs = hadoop_path(spark, f"{checkpoint}/base")
    if fs.exists(at):
        return int(fs.listStatus(at)[0].getPath().getName())
    base = max(_versions(spark, path), default=-1) + 1
    fs.mkdirs(hadoop_path(spark, f"{checkpoint}/base/{base}")[0])
    return base


def reingest(spark: SparkSession, source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run once over what has arrived; versions are path/v=<n>, each the one before merged with a batch. A fresh
    checkpoint goes on from the last version stored."""
    base = _base(spark, path, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        now = base + number
        old = spark.read.parquet(f"{path}/v={now - 1}") if now else None
        merge_batch(old, batch).write.mode("overwrite").parquet(f"{path}/v={now}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/batches").trigger(availableNow=True).start()


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of event types by tumbling window, late rows within the watermark included."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n")
