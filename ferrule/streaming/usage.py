"""Usage analytics as streams: tumbling and sliding windows, transitions by session, changed files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrule.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The event log at ``path`` as a stream, with ``ts`` as a timestamp that a watermark can hold."""
    schema = spark.read.parquet(path).schema
    at = path if path.endswith("/") else f"{path[:-1]}[{path[-1]}]"  # a pattern may also name a single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(at)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type; a window is final when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin_at"), "event_type", "n")


def sliding_throughput(events: DataFrame, width: str = "30 minutes", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("begin_at"), "n", "mean_value")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin_at"), F.col("w.end").alias("end_at"), "n")


def transitions(events: DataFrame, gap_s: float, late: str = "1 hour") -> DataFrame:
    """``user_id, from_type, to_type, at`` of consecutive events of a user at most ``gap_s`` apart.

    The state of a user is the last event; it is dropped once the watermark is more than the gap past it,
    when nothing can follow any more. A batch is put in order by (ts, event_id).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last_type, last_us = state.get if state.exists else (None, None)
        out = []
        for kind, at in zip(rows["event_type"], rows["ts"]):
            us = int(at.value // 1000) if hasattr(at, "value") else int(pd.Timestamp(at).value // 1000)
            if last_us is not None and 0 <= us - last_us <= gap_s * 1e6:
                out.append((key[0], last_type, kind, at))
            last_type, last_us = kind, us
        state.update((last_type, last_us))
        state.setTimeoutTimestamp(max(last_us // 1000 + int(gap_s * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["user_id", "from_type", "to_type", "at"])

    rows = events.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, from_type string, to_type string, at timestamp", "kind string, us long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream yields for the input at hand, as a table written beside the checkpoints."""
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/{epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=0)
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{last}")


def on_changed_files(spark: SparkSession, folder: str, process: Callable[[DataFrame], None], glob: str = "*"):
    """Calls ``process`` with the last version of each file that appeared or changed since the last batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        process(df.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length", "content"), "modificationTime").alias("x")).select("path", "x.*"))

    root = f"{ensure_checkpoint_dir(spark)}/watch/{uuid.uuid4().hex}"
    rows = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(folder).schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", root)
