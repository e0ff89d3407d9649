"""Text and vector retrieval: BM25, fuzzy terms, proximity, wildcards, exact neighbours, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import tokens

K1, B = 1.2, 0.75
RRF_K = 60
#: Longer fields aren't indexed as a whole, so no pattern on the whole field finds them.
KEYWORD_LIMIT = 8191


def bm25(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``key, score`` of the rows that have a term in ``text``: BM25 with k1 1.2 and b 0.75."""
    return best_fields(df, key, {text: 1.0}, terms)


def best_fields(df: DataFrame, key: str, fields: dict[str, float], terms: list[str]) -> DataFrame:
    """``key, score`` of the rows that have a term: the greatest of the fields' boosted BM25 scores.

    Term counts of all fields are taken row by row in one pass; only one row of counts is aggregated for
    the whole table. Null and empty texts are no documents of their field.
    """
    lists = df.select(F.col(key), *[tokens(F.col(f)).alias(f"ts{j}") for j, f in enumerate(fields)])
    n = range(len(fields))
    counted = lists.select(
        key, *[F.when(F.size(f"ts{j}") > 0, F.size(f"ts{j}")).alias(f"dl{j}") for j in n], *[F.coalesce(F.size(F.filter(f"ts{j}", _equals(t))), F.lit(0)).alias(f"tf{j}_{i}") for j in n for i, t in enumerate(terms)]
    )
    whole = counted.agg(*[F.count(f"dl{j}").alias(f"n{j}") for j in n], *[F.avg(f"dl{j}").alias(f"avgdl{j}") for j in n], *[F.count_if(F.col(f"tf{j}_{i}") > 0).alias(f"df{j}_{i}") for j in n for i in range(len(terms))])
    scores = []
    for j, boost in enumerate(fields.values()):
        score = F.lit(0.0)
        for i in range(len(terms)):
            tf, found = F.col(f"tf{j}_{i}"), F.col(f"df{j}_{i}")
            idf = F.ln(1 + (F.col(f"n{j}") - found + 0.5) / (found + 0.5))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"dl{j}") / F.col(f"avgdl{j}")))
        some = F.greatest(*[F.col(f"tf{j}_{i}") for i in range(len(terms))], F.lit(0)) > 0
        scores.append(F.when(some, score * boost))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return counted.join(F.broadcast(whole)).select(key, best.alias("score")).where(F.col("score").isNotNull())  # one row is broadcast


def _equals(t: str):
    return lambda x: x == F.lit(t)


def fuzzy_terms(df: DataFrame, text: str, term: str) -> DataFrame:
    """``token, n``: tokens of the table within the edits that a term of its length allows (0 to 2, 3 to 5: 1, else 2)."""
    most = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    words = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.where(F.abs(F.length("token") - len(term)) <= most).where(F.levenshtein("token", F.lit(term)) <= most)


def proximity(text: Column, terms: list[str], slop: int) -> Column:
    """Whether the terms stand in order within ``slop`` moved places: max(p_i - i) - min(p_i - i) <= slop."""
    ts = tokens(text)
    spots = [F.array_compact(F.transform(ts, _place(t, k))) for k, t in enumerate(terms)]

    def all_near(p: Column) -> Column:
        out = F.lit(True)
        for s in spots:
            out = out & F.exists(s, _within(p, slop))
        return out

    return F.exists(F.flatten(F.array(*spots)), all_near)


def _place(t: str, k: int):
    return lambda x, i: F.when(x == F.lit(t), i - k)


def _within(p: Column, slop: int):
    return lambda q: (q >= p) & (q <= p + slop)


def wildcard(text: Column, pattern: str) -> Column:
    """Case-insensitive match of the whole field; ``*`` is any text, ``?`` any character."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return text.ilike(escaped) & (F.length(text) <= KEYWORD_LIMIT)


def glob(path: Column, pattern: str) -> Column:
    """Case-sensitive; ``*`` crosses slashes, ``**`` is the same, and a plain name is looked for in any folder."""
    if "*" not in pattern and "?" not in pattern:
        pattern = f"*/{pattern}"
    while "**" in pattern:
        pattern = pattern.replace("**", "*")
    return path.like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for empty, unequal or zero vectors."""
    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(good, F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def exact_topk(queries: DataFrame, collection: DataFrame, k: int, least: float, block: int = 1024) -> DataFrame:
    """``query_id, id, score, place``: the ``k`` most similar of ``collection`` for each row of ``queries``.

    Both have ``id, vec`` (unique ids, vectors of one length, neither null nor zero). Queries are grouped
    into blocks of about ``block`` vectors; every task scores its part of the collection against each
    block by one matrix product and passes on at most ``k`` rows a query.
    """
    n_blocks = max(1, -(-queries.count() // block))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("block").agg(F.collect_list("id").alias("qids"), F.collect_list("vec").alias("qvecs"))
    parts = 8 * collection.sparkSession.sparkContext.defaultParallelism
    lots = collection.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.spark_partition_id().alias("lot")).agg(F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs"))
    pairs = lots.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")).join(blocks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q, c = np.asarray(r["qvecs"], np.float64), np.asarray(r["vecs"], np.float64)
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                c /= np.linalg.norm(c, axis=1, keepdims=True)
                s = q @ c.T
                ids, qids = np.asarray(r["ids"]), np.asarray(r["qids"])
                s[qids[:, None] == ids[None, :]] = -2
                kk = min(k, s.shape[1])
                top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
                score = np.take_along_axis(s, top, axis=1)
                keep = score >= max(least, -1)
                rows = np.repeat(np.arange(len(qids)), kk).reshape(-1, kk)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows], pa.int64()), pa.array(ids[top[keep]], pa.int64()), pa.array(score[keep])], names=["query_id", "id", "score"])

    found = pairs.select("qids", "qvecs", "ids", "vecs").mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def fused(signals: list[DataFrame], key: list[str], within: list[str], k: int = RRF_K) -> DataFrame:
    """``key, rrf``: reciprocal-rank fusion of signals with ``key, score``; ties rank by key."""
    parts = []
    for s in signals:
        w = Window.partitionBy(*within).orderBy(F.col("score").desc(), *key)
        parts.append(s.select(*key, (1.0 / (k + F.row_number().over(w))).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.sum("part").alias("rrf"))
