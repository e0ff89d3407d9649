"""Streamed usage analytics; each gives the rows of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.plans.registry import Registry
from ferrule.plans.usage import GAP_S, NEXT
from ferrule.streaming import usage

R = Registry()


@R.query("stream_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS begin_at, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = usage.drained(usage.tumbling_counts(usage.event_stream(spark, f"{d}/events.parquet")), "complete")
    return rows.withColumn("begin_at", F.col("begin_at").cast("timestamp_ntz"))


@R.query("stream_transitions", f"WITH {NEXT} SELECT event_type AS from_type, to_type, count(*) AS n FROM nxt WHERE to_ts IS NOT NULL AND epoch_us(to_ts) - epoch_us(ts) <= {GAP_S}000000 GROUP BY 1, 2")
def stream_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = usage.drained(usage.transitions(usage.event_stream(spark, f"{d}/events.parquet"), GAP_S))
    return rows.groupBy("from_type", "to_type").agg(F.count("*").alias("n"))
