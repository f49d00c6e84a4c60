"""Structured Streaming: append without duplicates, live rollups, the bounded log, and a job's life."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup, rollup


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they come, one at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def append_archive(stream: DataFrame, archive: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Appends each batch's new records to an archive of Parquet files. Duplicates are by address and by text, which one keyed state can't
    hold, so each batch is settled against the keys of the archive. A batch has a folder of its own, so repeating one after a failure replaces it."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(archive)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        have = [s.getPath().toString() for s in fs.listStatus(root)] if fs.exists(root) else []
        known = [p for p in have if p.rsplit("=", 1)[-1].isdigit() and int(p.rsplit("=", 1)[-1]) < number]
        keys = spark.read.schema(batch.schema).parquet(*known).select("canonical_url", "text_sha256") if known else None
        decided = dedup.append(batch, order, known=keys)
        decided.where("stored").select(*batch.columns).write.mode("overwrite").parquet(os.path.join(archive, f"batch={number}"))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_rollup(stream: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """The site table of an event stream, kept whole in memory under `name`."""
    w = rollup.site_rollup(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).trigger(availableNow=True).start()


def ring(spark: SparkSession, name: str, most: int = 500) -> DataFrame:
    return rollup.log_ring(spark.table(name), "seq", most)


def windowed(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts of events by time window, with late rows up to a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))


class Job:
    """One streaming query's life: idle, running, then done, stopped or error."""

    def __init__(self):
        self.query: StreamingQuery | None = None
        self.asked = False

    def start(self, begin) -> None:
        if self.state() == "running":
            raise RuntimeError("a job is running")
        self.asked, self.query = False, begin()

    def stop(self) -> None:
        self.asked = True
        if self.query is not None:
            self.query.stop()

    def state(self) -> str:
        if self.query is None:
            return "idle"
        if self.query.isActive:
            return "running"
        return "error" if self.query.exception() is not None else "stopped" if self.asked else "done"
