"""Clusters of vectors: centroids, soft memberships, affinities and coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centroids(rows: DataFrame) -> DataFrame:
    """``label, centroid``: mean vector of each label of ``id, vec, label``; partial sums before the shuffle."""
    parts = rows.select("label", F.posexplode("vec").alias("pos", "value")).groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centroid"))


def memberships(rows: DataFrame) -> DataFrame:
    """``id, label, w``: positive cosines of each vector to all centroids, normalised to a sum of 1.

    There are few centroids; they travel as one array beside each vector. Vectors with no positive
    cosine have no row.
    """
    cen = centroids(rows).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("cens"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    cos = F.transform("cens", lambda c: F.struct(c["label"].alias("label"), F.greatest(F.coalesce(F.try_divide(dot(F.col("vec"), c["centroid"]), F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(c["centroid"], c["centroid"]))), F.lit(0.0)), F.lit(0.0)).alias("s")))
    scored = rows.select("id", "vec").join(F.broadcast(cen)).select("id", cos.alias("m")).withColumn("total", F.aggregate("m", F.lit(0.0), lambda a, x: a + x["s"]))
    return scored.where("total > 0").select("id", "total", F.explode("m").alias("x")).select("id", "x.label", (F.col("x.s") / F.col("total")).alias("w"))


def affinities(m: DataFrame) -> DataFrame:
    """``a, b, affinity``: W'W of memberships, pairs of labels within each row."""
    per = m.groupBy("id").agg(F.collect_list(F.struct("label", "w")).alias("ms"))  # as many as there are labels
    pairs = F.flatten(F.transform("ms", lambda x: F.transform("ms", lambda y: F.struct(x["label"].alias("a"), y["label"].alias("b"), (x["w"] * y["w"]).alias("p")))))
    return per.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.p").alias("affinity"))


def _unit(values: list) -> np.ndarray:
    v = np.asarray(values, np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def coordinates(rows: DataFrame, dims: int) -> DataFrame:
    """``id, c1.., `` principal coordinates. The components come from the moments of all rows, 64 x 64 numbers."""
    n = len(rows.first()["vec"]) if not rows.isEmpty() else 1

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q, k = np.zeros(n), np.zeros((n, n)), 0
        for b in batches:
            v = _unit(b.column(0).to_pylist()) if b.num_rows else np.zeros((0, n))
            s, q, k = s + v.sum(axis=0), q + v.T @ v, k + len(v)
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.concatenate([s, q.ravel()]).tolist()])], names=["k", "m"])

    parts = rows.select("vec").mapInArrow(moments, "k long, m array<double>").toPandas()
    k, m = int(parts["k"].sum()), np.sum([np.asarray(x) for x in parts["m"]], axis=0)
    mean = m[:n] / max(1, k)
    cov = m[n:].reshape(n, n) / max(1, k) - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :dims]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(dims)])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = (_unit(b.column(1).to_pylist()) - mean) @ axes if b.num_rows else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, i]) for i in range(dims)]], names=["id", *[f"c{i + 1}" for i in range(dims)]])

    return rows.select("id", "vec").mapInArrow(project, "id long" + "".join(f", c{i + 1} double" for i in range(dims)))


def spherical_kmeans(rows: DataFrame, k: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """``id, cluster, similarity``: Lloyd's rounds over all rows; a round brings k sums of vectors from each task."""
    from ferrule.session import cut

    rows = cut(rows.select("id", "vec"))
    first = list(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).toPandas()["vec"])
    c = _unit(first) if first else np.zeros((0, 1))

    def sums(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros_like(c)
            for b in batches:
                if b.num_rows:
                    v = _unit(b.column(0).to_pylist())
                    np.add.at(s, (v @ c.T).argmax(axis=1), v)
            yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        return run

    for _ in range(rounds if len(c) else 0):
        parts = rows.select("vec").mapInArrow(sums(c), "s array<double>").toPandas()["s"]
        s = np.sum([np.asarray(x) for x in parts], axis=0).reshape(c.shape)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        before, c = c, np.where(norm > 1e-12, s / np.maximum(norm, 1e-12), c)
        if np.allclose(before, c, rtol=0, atol=1e-12):
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _unit(b.column(1).to_pylist()) @ c.T if b.num_rows else np.zeros((0, len(c)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.argmax(axis=1) if len(s) else [], pa.int32()), pa.array(s.max(axis=1) if len(s) else [], pa.float64())], names=["id", "cluster", "similarity"])

    return rows.select("id", "vec").mapInArrow(assign, "id long, cluster int, similarity double")
