"""Per-key results without the imbalance of heavy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTIAL = "key_field string, key_value string, run int, n long, total long, first_us long, last_us long, gap_us long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of the key runs of one sorted partition, batch by batch.

    A run that goes on in the next batch yields a state in each; the stitch treats both boundaries
    (of batches and of partitions) alike, so a task holds one batch at a time.
    """
    run = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        field = b.column(0).to_numpy(zero_copy_only=False)
        value = b.column(1).to_numpy(zero_copy_only=False)
        size = b.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = b.column(3).cast(pa.int64())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False)
        n = len(field)
        new = np.ones(n, bool)
        new[1:] = (field[1:] != field[:-1]) | (value[1:] != value[:-1])
        start = np.flatnonzero(new)
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        gap = np.full(n, -1, np.int64)
        both = known[1:] & known[:-1] & ~new[1:]
        gap[1:][both] = (at[1:] - at[:-1])[both]
        first = np.minimum.reduceat(np.where(known, at, high), start)
        last = np.maximum.reduceat(np.where(known, at, low), start)
        widest = np.maximum.reduceat(gap, start)
        none = np.logical_not(np.logical_or.reduceat(known, start))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(field[start], pa.string()),
                pa.array(value[start], pa.string()),
                pa.array(np.arange(run, run + len(start)), pa.int32()),
                pa.array(np.diff(np.append(start, n)), pa.int64()),
                pa.array(np.add.reduceat(size, start), pa.int64()),
                pa.array(first, pa.int64(), mask=none),
                pa.array(last, pa.int64(), mask=none),
                pa.array(widest, pa.int64(), mask=widest < 0),
            ],
            names=["key_field", "key_value", "run", "n", "total", "first_us", "last_us", "gap_us"],
        )
        run += len(start)


def keyed_totals(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Count, size, first and last time and widest gap in time of each key, whatever the skew.

    ``rows`` has ``key_field, key_value, size, at, tie``. Rows are range partitioned on the key *and*
    the secondary order (``at``, ``tie``) by sampled quantiles, so that a key with most rows is cut into
    as many partitions as its share asks for. Every sorted partition leaves one partial state for each
    run of a key; the states, a few for each key and partition, are stitched in order: sums add up and
    the gap across a boundary is the next run's first time less the greatest time before it.

    Null keys form a key of their own (``key_value`` null). Rows without time count, but give no time
    and no gap; null sizes count as 0. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["key_field", "key_value", "at", "tie"]
    parts = (
        rows.select("key_field", "key_value", F.col("size").cast("long"), F.col("at").cast("timestamp_ntz"), "tie")
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_runs, _PARTIAL)
    )
    w = Window.partitionBy("key_field", "key_value").orderBy(F.col("first_us").asc_nulls_first(), "last_us", "n")
    before = F.max("last_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stitched = parts.withColumn("step", F.col("first_us") - before)
    return stitched.groupBy("key_field", "key_value").agg(
        F.sum("n").alias("n_rows"),
        F.sum("total").alias("total_size"),
        F.timestamp_micros(F.min("first_us")).cast("timestamp_ntz").alias("first_at"),
        F.timestamp_micros(F.max("last_us")).cast("timestamp_ntz").alias("last_at"),
        F.greatest(F.max("gap_us"), F.max("step")).alias("widest_gap_us"),
    )


def rows_by_key(df: DataFrame, keys: list[str], size, at: str, tie: str) -> DataFrame:
    """Narrow rows for :func:`keyed_totals`: one for each row and key column."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_value")) for k in keys])
    return df.select(F.explode(pairs).alias("k"), size.alias("size"), F.col(at).alias("at"), F.col(tie).alias("tie")).select(
        "k.key_field", "k.key_value", "size", "at", "tie"
    )


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """Keys whose rows are more than ``share`` of all rows of their key column."""
    whole = totals.groupBy("key_field").agg(F.sum("n_rows").alias("all_rows"))
    return totals.join(whole, "key_field").where(F.col("n_rows") > F.col("all_rows") * F.lit(share))
