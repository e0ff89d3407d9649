"""Usage analytics over an event log: a user is a session, an event type a tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.plans.registry import Registry
from ferrule.sources.tables import table

R = Registry()
GAP_S = 3600
NEXT = "nxt AS (SELECT user_id, event_id, event_type, ts, lead(event_type) OVER w AS to_type, lead(ts) OVER w AS to_ts, lead(event_id) OVER w AS to_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def followed(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "ts").withColumns({"to_type": F.lead("event_type").over(w), "to_ts": F.lead("ts").over(w), "to_id": F.lead("event_id").over(w)})


def seconds(a: str, b: str):
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / F.lit(1e6)


@R.query("tool_counts", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM events GROUP BY 1")
def tool_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@R.query("tool_durations", "SELECT event_type, round(sum(value), 4) AS total, count(value) AS n, round(avg(value), 1) AS mean, round(max(value), 6) AS longest FROM events GROUP BY 1")
def tool_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("value").alias("n"), F.round(F.avg("value"), 1).alias("mean"), F.round(F.max("value"), 6).alias("longest"))


@R.query("transitions_gap", f"WITH {NEXT} SELECT event_type AS from_type, to_type, count(*) AS n FROM nxt WHERE to_ts IS NOT NULL AND epoch_us(to_ts) - epoch_us(ts) <= {GAP_S}000000 GROUP BY 1, 2")
def transitions_gap(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d).where(seconds("ts", "to_ts") <= GAP_S).groupBy(F.col("event_type").alias("from_type"), "to_type").agg(F.count("*").alias("n"))


@R.query("transition_share", f"WITH {NEXT}, t AS (SELECT event_type AS from_type, to_type, count(*) AS n FROM nxt WHERE to_type IS NOT NULL GROUP BY 1, 2) SELECT from_type, to_type, n, round(100.0 * n / sum(n) OVER (PARTITION BY from_type), 4) AS share_pct FROM t")
def transition_share(spark: SparkSession, d: str) -> DataFrame:
    t = followed(spark, d).where(F.col("to_type").isNotNull()).groupBy(F.col("event_type").alias("from_type"), "to_type").agg(F.count("*").alias("n"))
    return t.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("from_type")), 4))


@R.query("top_transitions", f"WITH {NEXT} SELECT event_type AS from_type, to_type, count(*) AS n FROM nxt WHERE to_type IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def top_transitions(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d).where(F.col("to_type").isNotNull()).groupBy(F.col("event_type").alias("from_type"), "to_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "from_type", "to_type").limit(10)


@R.query("daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@R.query("daily_transitions", f"WITH {NEXT} SELECT CAST(to_ts AS DATE) AS day, event_type AS from_type, to_type, count(*) AS n FROM nxt WHERE to_ts IS NOT NULL AND epoch_us(to_ts) - epoch_us(ts) <= {GAP_S}000000 GROUP BY 1, 2, 3")
def daily_transitions(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d).where(seconds("ts", "to_ts") <= GAP_S).groupBy(F.to_date("to_ts").alias("day"), F.col("event_type").alias("from_type"), "to_type").agg(F.count("*").alias("n"))


@R.query("activity_history", "SELECT CAST(d AS DATE) AS day, count(e.event_id) AS n FROM (SELECT unnest(generate_series(CAST(max(ts) AS DATE) - INTERVAL 13 DAY, CAST(max(ts) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events) LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d AS DATE) GROUP BY 1")
def activity_history(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    days = events.agg(F.to_date(F.max("ts")).alias("last")).select(F.explode(F.expr("sequence(date_sub(last, 13), last)")).alias("day"))
    n = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@R.query("session_gap", f"""WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= {GAP_S}000000 THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS begin_at, max(ts) AS end_at FROM s GROUP BY 1, 2""")
def session_gap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = table(spark, d, "events").select("user_id", "ts", "event_id").withColumn("before", F.lag("ts").over(w)).withColumn("fresh", F.when(seconds("before", "ts") <= GAP_S, 0).otherwise(1))
    return g.withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begin_at"), F.max("ts").alias("end_at"))


@R.query("causal_link", f"""WITH k AS (SELECT event_id, user_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
 p AS (SELECT b.event_id, a.event_id AS cause_id, a.event_type AS cause_type, b.event_type, row_number() OVER (PARTITION BY b.event_id ORDER BY a.ts DESC, a.event_id DESC) AS place FROM k b JOIN k a ON a.user_id = b.user_id AND a.k = b.k AND (a.ts < b.ts) AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000)
 SELECT event_id, cause_id, cause_type, event_type FROM p WHERE place = 1""")
def causal_link(spark: SparkSession, d: str) -> DataFrame:
    """Latest earlier event of the session within a day whose output feeds this one's input (equal keys)."""
    k = F.get_json_object("props", "$.k").cast("long")
    w = Window.partitionBy("user_id", "k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, -1)
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", k.alias("k")).where(F.col("k").isNotNull())
    cause = F.max(F.struct("ts", "event_id", "event_type")).over(w)
    return rows.withColumn("cause", cause).where(F.col("cause").isNotNull()).select("event_id", F.col("cause.event_id").alias("cause_id"), F.col("cause.event_type").alias("cause_type"), "event_type")


@R.query("causal_pairs", R.sql["causal_link"].replace("SELECT event_id, cause_id, cause_type, event_type FROM p WHERE place = 1", "SELECT cause_type, event_type, count(*) AS n FROM p WHERE place = 1 GROUP BY 1, 2"))
def causal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return causal_link(spark, d).groupBy("cause_type", "event_type").agg(F.count("*").alias("n"))


@R.query("transition_comparison", f"""WITH {NEXT}, t AS (SELECT event_type AS from_type, to_type, count(*) AS n FROM nxt WHERE to_type IS NOT NULL GROUP BY 1, 2), c AS ({R.sql["causal_pairs"]})
 SELECT t.from_type, t.to_type, t.n, coalesce(c.n, 0) AS n_caused, round(100.0 * coalesce(c.n, 0) / t.n, 4) AS rate_pct FROM t LEFT JOIN c ON c.cause_type = t.from_type AND c.event_type = t.to_type""")
def transition_comparison(spark: SparkSession, d: str) -> DataFrame:
    t = followed(spark, d).where(F.col("to_type").isNotNull()).groupBy(F.col("event_type").alias("from_type"), "to_type").agg(F.count("*").alias("n"))
    c = causal_pairs(spark, d).select(F.col("cause_type").alias("from_type"), F.col("event_type").alias("to_type"), F.col("n").alias("caused"))
    n = F.coalesce("caused", F.lit(0))
    return t.join(c, ["from_type", "to_type"], "left").select("from_type", "to_type", "n", n.alias("n_caused"), F.round(100.0 * n / F.col("n"), 4).alias("rate_pct"))


@R.query("recent_calls", "SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(30)


@R.query("throughput_sliding", "SELECT begin_at, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT value, unnest([time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts)]) AS begin_at FROM events) GROUP BY 1")
def throughput_sliding(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "30 minutes", "10 minutes")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").cast("timestamp_ntz").alias("begin_at"), "n", "mean_value")


@R.query("throughput_by_level", "WITH l AS (SELECT CAST(floor(value / 10) AS BIGINT) AS level, value FROM events), g AS (SELECT level, count(*) AS n, avg(value) AS mean FROM l GROUP BY 1 HAVING count(*) >= 5) SELECT level, n, round(mean, 6) AS mean_value, level = first_value(level) OVER (ORDER BY mean, level) AS is_peak FROM g")
def throughput_by_level(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("level")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where("n >= 5")
    best = F.first("level").over(Window.partitionBy().orderBy("mean", "level"))
    return g.withColumn("is_peak", F.col("level") == best).select("level", "n", F.round("mean", 6).alias("mean_value"), "is_peak")
