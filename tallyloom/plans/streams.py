"""Streams over the events table, drained and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.sources import folders
from tallyloom.sources import views as V
from tallyloom.streaming import queues as Q

from .registry import query

_OPS = "SELECT user_id % 8 AS key, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'get' WHEN 'signup' THEN 'sync' WHEN 'click' THEN 'get' ELSE 'put' END AS op, event_id AS sample FROM events"


def _ops(spark, d):
    op = F.when(F.col("event_type").isin("purchase", "click"), "get").when(F.col("event_type") == "signup", "sync").otherwise("put")
    rows = V.table(spark, d, "events").select((F.col("user_id") % 8).cast("long").alias("key"), F.col("event_id").cast("long").alias("seq"), op.alias("op"), F.col("event_id").cast("long").alias("sample"))
    path = folders.fresh_path(spark, "ops")
    Q.feed(rows, "seq", path)
    return Q.arriving(spark, path, rows)


_QUEUE = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn, sum((op = 'put')::INT) OVER (PARTITION BY key ORDER BY seq) AS puts FROM ({_OPS})),
    q(key, rn, op, seq, size, consumed, dropped, stale) AS (SELECT DISTINCT key, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o UNION ALL
    SELECT o.key, o.rn, o.op, o.seq, CASE o.op WHEN 'put' THEN least(q.size + 1, 16) WHEN 'get' THEN greatest(q.size - 1, 0) ELSE q.size END, q.consumed + (o.op = 'get' AND q.size > 0)::INT, q.dropped + (o.op = 'put' AND q.size = 16)::INT,
    CASE o.op WHEN 'put' THEN q.stale + 1 WHEN 'sync' THEN 0 ELSE q.stale END FROM q JOIN o ON o.key = q.key AND o.rn = q.rn + 1)"""


@query("t01_bounded_queue", f"""{_QUEUE} SELECT q.key, q.seq, q.op, CASE WHEN q.op = 'put' THEN q.seq WHEN q.op = 'get' AND q.consumed > p.consumed THEN g.sample END AS sample, CASE q.op WHEN 'put' THEN q.dropped = p.dropped WHEN 'get' THEN q.consumed > p.consumed ELSE true END AS accepted, q.size
    FROM q JOIN q p ON p.key = q.key AND p.rn = q.rn - 1 LEFT JOIN o g ON g.key = q.key AND g.op = 'put' AND g.puts = q.consumed + q.dropped AND q.op = 'get'""")
def t01_t02_t16(spark, d):
    return Q.drained(Q.queue(_ops(spark, d), "key", capacity=16), "queue").select("key", "seq", "op", "sample", "accepted", "size")


@query("t03_queue_statistics", f"{_QUEUE} SELECT q.key, count(*) FILTER (q.op = 'put') AS produced, max(q.consumed) AS consumed, max(q.dropped) AS dropped, arg_max(q.size, q.rn) AS size, count(*) FILTER (q.size >= 16 OR q.stale >= 40) AS paused FROM q WHERE q.rn > 0 GROUP BY q.key")
def t03_t04(spark, d):
    out = Q.drained(Q.queue(_ops(spark, d), "key", capacity=16, most_stale=40), "queue")
    return out.groupBy("key").agg(F.max("produced").alias("produced"), F.max("consumed").alias("consumed"), F.max("dropped").alias("dropped"), F.max_by("size", "seq").alias("size"), F.count_if("paused").alias("paused"))


@query("t07_count_windows", "SELECT event_type AS key, b AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(sum(value), 4) AS total FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 20 AS b FROM events) GROUP BY event_type, b HAVING count(*) = 20")
def t07(spark, d):
    events = V.table(spark, d, "events").select("event_id", "event_type", "value")
    path = folders.fresh_path(spark, "events")
    Q.feed(events, "event_id", path)
    return Q.drained(Q.count_windows(Q.arriving(spark, path, events), "event_type", "event_id", "value", 20), "windows").withColumn("total", F.round("total", 4))


@query("t08_batch_staleness", "SELECT b, count(*) AS n, round(avg(user_id % 5), 6) AS stale_mean, max(user_id % 5) AS stale_max, round(avg((user_id % 5 > 0)::INT), 6) AS partial_ratio FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS b FROM events) GROUP BY b")
def t08(spark, d):
    rows = Q.ranked(V.table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("span")), "event_id").withColumn("b", F.floor(F.col("place") / 64))
    return rows.groupBy("b").agg(F.count("*").alias("n"), F.avg("span").alias("stale_mean"), F.max("span").alias("stale_max"), F.avg((F.col("span") > 0).cast("double")).alias("partial_ratio"))


@query("t05_sample_feeder", "SELECT item_id, epoch, 'sample_' || epoch || '_' || (epoch * n + r) AS sample FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark), range(3) t(epoch)")
def t05(spark, d):
    return Q.feeder_ids(V.table(spark, d, "benchmark").select("item_id"), "item_id", 3)


@query("t09_metrics_by_sync", "SELECT key, w, count(*) FILTER (op = 'put') AS puts, count(*) FILTER (op = 'get') AS gets FROM (SELECT *, sum((op = 'sync')::INT) OVER (PARTITION BY key ORDER BY seq) AS w FROM (" + _OPS + ")) GROUP BY key, w")
def t09(spark, d):
    from pyspark.sql import Window

    op = F.when(F.col("event_type").isin("purchase", "click"), "get").when(F.col("event_type") == "signup", "sync").otherwise("put")
    rows = V.table(spark, d, "events").select((F.col("user_id") % 8).alias("key"), "event_id", op.alias("op"))
    w = F.sum((F.col("op") == "sync").cast("long")).over(Window.partitionBy("key").orderBy("event_id"))
    return rows.withColumn("w", w).groupBy("key", "w").agg(F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "get").alias("gets"))


@query("t10_accumulate", """WITH g AS (SELECT run_name, checkpoint_step, prompt_id, stddev_pop(acc::INT) > 0 AS k FROM v_rollouts GROUP BY ALL), r AS (SELECT run_name, checkpoint_step, count(*) FILTER (k) AS kept FROM g GROUP BY ALL),
    c AS (SELECT *, row_number() OVER w AS round, sum(kept) OVER w AS total FROM r WINDOW w AS (PARTITION BY run_name ORDER BY checkpoint_step))
    SELECT run_name, checkpoint_step, round, kept, total::BIGINT AS total, CASE WHEN total >= 20 THEN 'done' WHEN round = 4 THEN 'failed' ELSE 'more' END AS state FROM c WHERE total - kept < 20 AND round <= 4""")
def t10(spark, d):
    from pyspark.sql import Window

    r = V.rollouts(spark, d)
    varies = r.withColumn("k", F.stddev_pop(F.col("acc").cast("double")).over(Window.partitionBy("run_name", "checkpoint_step", "prompt_id")) > 0)
    return Q.accumulated(varies, "run_name", "checkpoint_step", "prompt_id", "k", 20, 4)


@query("t12_log_tail", "SELECT run, step, round(avg(score), 6) AS score FROM (SELECT o_orderstatus AS run, o_orderkey AS step, o_custkey / 8.0 AS score FROM orders WHERE o_orderkey < 400 AND o_orderkey % 2 = 0) GROUP BY ALL UNION ALL SELECT DISTINCT o_orderstatus, -1, NULL FROM orders WHERE o_orderkey % 97 = 0")
def t12_s23(spark, d):
    orders = V.table(spark, d, "orders")
    dump = F.concat(F.lit("step:"), F.col("o_orderkey").cast("string"), F.lit(" - score:"), (F.col("o_custkey") / 8).cast("string"))
    line = lambda rows, text: rows.select("o_orderkey", F.col("o_orderstatus").alias("run"), text.alias("value"))
    rows = line(orders, dump).unionByName(line(orders, dump))  # every dump is written twice
    rows = rows.unionByName(line(orders.where("o_orderkey % 97 = 0"), F.lit("Traceback (most recent call last):")))
    path = folders.fresh_path(spark, "log")
    Q.feed(rows, "o_orderkey", path)
    return Q.drained(Q.log_steps(Q.arriving(spark, path, rows), list(range(0, 400, 2)), ["score"]), "tail").select("run", "step", "score")


@query("t14_growing_dataset", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def t14(spark, d):
    events = V.table(spark, d, "events").select("event_id", "event_type", "value")
    base = folders.fresh_path(spark, "growing")
    Q.feed(events, "event_id", f"{base}/in")
    Q.grown(Q.arriving(spark, f"{base}/in", events), f"{base}/data", f"{base}/checkpoint", lambda batch: batch.where("value > 50"))
    return spark.read.schema(events.schema).parquet(f"{base}/data").groupBy("event_type").agg(F.count("*").alias("n"))
