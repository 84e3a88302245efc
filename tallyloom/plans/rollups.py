"""Roll-ups from samples to prompts, runs and tables that the other modules don't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import answers as N
from tallyloom.functions import texts as X
from tallyloom.sources import views as V

from .registry import query


def _n(family: str, column: str = "response") -> str:
    """The SQL of a marker family's count."""
    return "(" + " + ".join("len(regexp_extract_all(" + column + ", '" + p.replace("'", "''") + "'))" for p in X.MARKERS[family]) + ")"


_PIECES = "len(list_filter(regexp_split_to_array(response, '\\s+'), lambda x: x <> ''))"
_MATH = f"""SELECT prompt_id, count(*) AS n, avg(coalesce(acc, false)::INT) AS acc, avg((acc IS NULL)::INT) AS failure, {', '.join(f"avg({_n(f)} * 100.0 / greatest({_PIECES}, 1)) AS {f}" for f in X.MARKERS)}, avg(length(response)) AS len_mean, stddev_pop(length(response)) AS len_std FROM v_responses GROUP BY prompt_id"""
_COLUMNS = ("acc", "failure", *X.MARKERS, "len_mean", "len_std")


def _by_prompt(spark, d):
    r = V.responses(spark, d)
    counts, pieces, n = X.marker_counts(F.col("response")), F.size(X.pieces(F.col("response"))), F.length("response")
    return r.groupBy("prompt_id").agg(
        F.count("*").alias("n"), F.avg(F.coalesce("acc", F.lit(False)).cast("double")).alias("acc"), F.avg(F.col("acc").isNull().cast("double")).alias("failure"),
        *[F.avg(X.density(counts[f], pieces)).alias(f) for f in X.MARKERS], F.avg(n).alias("len_mean"), F.stddev_pop(n).alias("len_std"),
    )


@query("a02_prompt_math", f"SELECT prompt_id, n, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS)} FROM ({_MATH})")
def a02(spark, d):
    return _by_prompt(spark, d)


@query("a04_run_math", f"SELECT count(*) AS num_prompts, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _COLUMNS)} FROM ({_MATH})")
def a04(spark, d):
    return _by_prompt(spark, d).agg(F.count("*").alias("num_prompts"), *[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in _COLUMNS])


_FIRST = "array_to_string(list_filter(regexp_split_to_array(response, '\\s+'), lambda x: x <> '')[1:8], ' ')"


@query("a03_prompt_instructions", f"SELECT prompt_id, count(*) AS n, round(avg(coalesce(acc, false)::INT), 6) AS strict, round(avg({_PIECES}), 6) AS pieces, arg_min({_FIRST}, sample_id) AS prefix FROM v_responses GROUP BY prompt_id")
def a03(spark, d):
    r = V.responses(spark, d)
    return r.groupBy("prompt_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("acc", F.lit(False)).cast("double")).alias("strict"), F.avg(F.size(X.pieces(F.col("response")))).alias("pieces"), F.min_by(X.prefix(F.col("response")), "sample_id").alias("prefix"))


@query("a05_run_instructions", "SELECT run_name, count(*) AS num_prompts, round(avg(m), 6) AS mean, round(avg(b), 6) AS best, round(avg(w), 6) AS worst, round(avg(l), 6) AS length, round(avg(s), 6) AS std FROM (SELECT run_name, prompt_id, avg(score) AS m, max(score) AS b, min(score) AS w, avg(length) AS l, stddev_samp(score) AS s FROM v_rollouts GROUP BY ALL) GROUP BY run_name")
def a05(spark, d):
    own = V.rollouts(spark, d).groupBy("run_name", "prompt_id").agg(F.avg("score").alias("m"), F.max("score").alias("b"), F.min("score").alias("w"), F.avg("length").alias("l"), F.stddev_samp("score").alias("s"))
    return own.groupBy("run_name").agg(F.count("*").alias("num_prompts"), *[F.avg(a).alias(b) for a, b in (("m", "mean"), ("b", "best"), ("w", "worst"), ("l", "length"), ("s", "std"))])


@query("a09_running_average", "SELECT run_name, round(list_reduce(list(m ORDER BY family), lambda x, y: (x + y) / 2), 6) AS value FROM (SELECT run_name, family, avg(score) AS m FROM v_rollouts GROUP BY ALL) GROUP BY run_name")
def a09(spark, d):
    m = V.rollouts(spark, d).groupBy("run_name", "family").agg(F.avg("score").alias("m")).groupBy("run_name").agg(F.array_sort(F.collect_list(F.struct("family", "m"))).alias("x"))
    rest = F.slice("x", 2, F.size("x"))
    return m.select("run_name", F.aggregate(rest, F.col("x")[0]["m"], lambda a, y: (a + y["m"]) / 2).alias("value"))


@query("a14_prompt_strict", "SELECT run_name, prompt_id, count(*) AS n, count(*) FILTER (acc) AS n_strict, round(avg(score), 6) AS mean, round(max(score), 6) AS max, arg_min(family, sample_id) AS first_family FROM v_rollouts GROUP BY run_name, prompt_id")
def a14(spark, d):
    return V.rollouts(spark, d).groupBy("run_name", "prompt_id").agg(F.count("*").alias("n"), F.count_if("acc").alias("n_strict"), F.avg("score").alias("mean"), F.max("score").alias("max"), F.min_by("family", "sample_id").alias("first_family"))


@query("a31_skip_decomposition", "SELECT family, grouping(family)::BIGINT AS total, count(*) AS n, round(avg(bypass::INT), 6) AS skip_rate, round(avg(acc::INT) FILTER (bypass), 6) AS acc_skip, round(avg(acc::INT) FILTER (NOT bypass), 6) AS acc_kept, round(avg(score) FILTER (NOT bypass), 6) AS follow_kept FROM v_rollouts GROUP BY ROLLUP (family)")
def a30_a31(spark, d):
    a, b = F.col("acc").cast("double"), F.col("bypass")
    return V.rollouts(spark, d).rollup("family").agg(F.grouping("family").alias("total"), F.count("*").alias("n"), F.avg(b.cast("double")).alias("skip_rate"), F.avg(F.when(b, a)).alias("acc_skip"), F.avg(F.when(~b, a)).alias("acc_kept"), F.avg(F.when(~b, F.col("score"))).alias("follow_kept"))


@query("a45_opportunity_gap", "SELECT family, run_name, count(*) AS n_prompts, round(avg(m), 6) AS mean, round(avg(b), 6) AS best, round(avg(b) - avg(m), 6) AS gap FROM (SELECT family, run_name, prompt_id, avg(acc::INT) AS m, max(acc::INT) AS b FROM v_rollouts GROUP BY ALL) GROUP BY ALL")
def a45(spark, d):
    a = F.col("acc").cast("double")
    own = V.rollouts(spark, d).groupBy("family", "run_name", "prompt_id").agg(F.avg(a).alias("m"), F.max(a).alias("b"))
    return own.groupBy("family", "run_name").agg(F.count("*").alias("n_prompts"), F.avg("m").alias("mean"), F.avg("b").alias("best"), (F.avg("b") - F.avg("m")).alias("gap"))


@query("a62_probability_gap", "SELECT round(max(abs(a - b)), 6) AS diff_max, round(avg(abs(a - b)), 6) AS diff_mean, round(stddev_samp(abs(a - b)), 6) AS diff_std, round(corr(a, b), 6) AS pearson FROM (SELECT exp(logp_a) AS a, exp(logp_b) AS b FROM v_tokens WHERE mask)")
def a62(spark, d):
    t = V.tokens(spark, d).where("mask").select(F.exp("logp_a").alias("a"), F.exp("logp_b").alias("b")).withColumn("x", F.abs(F.col("a") - F.col("b")))
    return t.agg(F.max("x").alias("diff_max"), F.avg("x").alias("diff_mean"), F.stddev_samp("x").alias("diff_std"), F.corr("a", "b").alias("pearson"))


_TOP = "SELECT vec_id, list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'neg': -embedding[i]::DOUBLE, 'id': i - 1}))[1:10], lambda x: x) AS top FROM embeddings"


@query("a63_topk_advantages", f"""WITH v AS ({_TOP}), p AS (SELECT b.vec_id, b.top AS tb, r.top AS tr FROM v b JOIN v r ON r.vec_id = b.vec_id + 1),
    s AS (SELECT vec_id, x.id AS id, -x.neg AS l, 0 AS own FROM p, unnest(tb) u(x) UNION ALL SELECT vec_id, x.id, -x.neg, 1 FROM p, unnest(tr) u(x)),
    j AS (SELECT vec_id, id, max(l) FILTER (own = 0) AS lb, max(l) FILTER (own = 1) AS lr FROM s GROUP BY vec_id, id)
    SELECT vec_id // 64 AS chunk, count(DISTINCT vec_id) AS positions, round(count(*) FILTER (lb IS NOT NULL AND lr IS NOT NULL)::DOUBLE / count(lb), 6) AS overlap, round(avg(lb - lr), 6) AS both_mean, round(avg(lr) FILTER (lb IS NULL), 6) AS student_mean, round(avg(lb) FILTER (lr IS NULL), 6) AS teacher_mean FROM j GROUP BY GROUPING SETS ((vec_id // 64), ())""")
def a63(spark, d):
    k = V.top_k(spark, d)
    one = lambda ids, logits, name: k.select("vec_id", F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(logits).alias("l"))).alias("x")).select("vec_id", "x.id", F.col("x.l").alias(name))
    j = one("ids_b", "logits_b", "lb").join(one("ids_rl", "logits_rl", "lr"), ["vec_id", "id"], "full").withColumn("chunk", F.floor(F.col("vec_id") / 64))
    both = F.col("lb").isNotNull() & F.col("lr").isNotNull()
    measures = [F.count_distinct("vec_id").alias("positions"), (F.count_if(both) / F.count("lb")).alias("overlap"), F.avg(F.col("lb") - F.col("lr")).alias("both_mean"), F.avg(F.when(F.col("lb").isNull(), F.col("lr"))).alias("student_mean"), F.avg(F.when(F.col("lr").isNull(), F.col("lb"))).alias("teacher_mean")]
    return j.rollup("chunk").agg(*measures)


@query("a74_class_mass", "SELECT vec_id, round(ln(list_sum(list_transform(range(1, 9), lambda i: exp(embedding[i]::DOUBLE)))), 6) AS dri, round(ln(list_sum(list_transform(range(9, 17), lambda i: exp(embedding[i]::DOUBLE)))), 6) AS dai FROM embeddings")
def a74(spark, d):
    mass = lambda a, b: F.log(F.aggregate(F.transform(F.slice("embedding", a, b - a), lambda x: F.exp(x.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return V.table(spark, d, "embeddings").select("vec_id", mass(1, 9).alias("dri"), mass(9, 17).alias("dai"))


@query("a48_offline_stats", "SELECT run_name, checkpoint_step, count(*) AS n, round(avg(acc::INT), 6) AS mean, round(stddev_samp(acc::INT) / sqrt(count(*)), 6) AS stderr, round(avg(length), 6) AS length, round(avg((length >= 50)::INT), 6) AS truncated FROM v_rollouts GROUP BY ALL")
def a48_a49(spark, d):
    a = F.col("acc").cast("double")
    return V.rollouts(spark, d).groupBy("run_name", "checkpoint_step").agg(F.count("*").alias("n"), F.avg(a).alias("mean"), (F.stddev_samp(a) / F.sqrt(F.count("*"))).alias("stderr"), F.avg("length").alias("length"), F.avg((F.col("length") >= 50).cast("double")).alias("truncated"))


@query("a50_prompt_support", "SELECT run_name, checkpoint_step, round(avg((s = 0)::INT), 6) AS all_wrong, round(avg((s = n)::INT), 6) AS all_right, round(avg((s > 0 AND s < n)::INT), 6) AS mixed FROM (SELECT run_name, checkpoint_step, prompt_id, count(*) AS n, count(*) FILTER (acc) AS s FROM v_rollouts GROUP BY ALL) GROUP BY ALL")
def a50_a34(spark, d):
    own = V.rollouts(spark, d).groupBy("run_name", "checkpoint_step", "prompt_id").agg(F.count("*").alias("n"), F.count_if("acc").alias("s"))
    share = lambda c: F.avg(c.cast("double"))
    return own.groupBy("run_name", "checkpoint_step").agg(share(F.col("s") == 0).alias("all_wrong"), share(F.col("s") == F.col("n")).alias("all_right"), share((F.col("s") > 0) & (F.col("s") < F.col("n"))).alias("mixed"))


@query("a65_length_imbalance", "SELECT checkpoint_step, min(s) AS min, max(s) AS max, max(s) - min(s) AS spread, round(avg(s), 6) AS mean FROM (SELECT checkpoint_step, prompt_id % 4 AS rank, sum(length)::BIGINT AS s FROM v_rollouts GROUP BY ALL) GROUP BY checkpoint_step")
def a65(spark, d):
    s = V.rollouts(spark, d).groupBy("checkpoint_step", (F.col("prompt_id") % 4).alias("rank")).agg(F.sum("length").alias("s"))
    return s.groupBy("checkpoint_step").agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))


@query("a70_wide_summary", "SELECT * FROM (PIVOT (SELECT run_name, family, round(avg(score), 6) AS v FROM v_rollouts GROUP BY ALL) ON family IN ('A', 'N', 'R') USING first(v) GROUP BY run_name)")
def a70(spark, d):
    return V.rollouts(spark, d).groupBy("run_name").pivot("family", ["A", "N", "R"]).agg(F.avg("score"))


@query("j04_token_join", "SELECT a.sequence, a.t, round(a.logp_a, 6) AS logp_a, round(b.logp_b, 6) AS logp_b FROM v_tokens a JOIN (SELECT sequence, t, logp_b FROM v_tokens WHERE mask) b ON a.sequence = b.sequence AND a.t = b.t")
def j04(spark, d):
    t = V.tokens(spark, d)
    return t.select("sequence", "t", "logp_a").join(t.where("mask").select("sequence", "t", "logp_b"), ["sequence", "t"])


@query("j13_unique_lookup", "SELECT s_suppkey, CASE WHEN n = 1 THEN v END AS v FROM supplier LEFT JOIN (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS v FROM customer GROUP BY c_nationkey) ON c_nationkey = s_nationkey")
def j13(spark, d):
    c = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("v"))
    return V.table(spark, d, "supplier").join(c, "s_nationkey", "left").select("s_suppkey", F.when(F.col("n") == 1, F.col("v")).alias("v"))


@query("w01_running_ordinal", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_id FROM documents")
def w01(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return V.table(spark, d, "documents").select("doc_id", (F.row_number().over(w) - 1).alias("sample_id"))


@query("w09_first_last", "SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS change FROM events GROUP BY user_id")
def w09(spark, d):
    g = V.table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"))
    return g.withColumn("change", F.col("last") - F.col("first"))


@query("w10_share_in_group", "SELECT run_name, family, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY run_name), 6) AS share FROM v_rollouts GROUP BY run_name, family")
def w10(spark, d):
    g = V.rollouts(spark, d).groupBy("run_name", "family").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("run_name")))


@query("w11_variance_fraction", "SELECT source, k, round(sum(v) OVER (PARTITION BY source ORDER BY k) / sum(v) OVER (PARTITION BY source), 6) AS fraction FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k, pow(n_chars, 2) AS v FROM documents)")
def w11(spark, d):
    rows = V.table(spark, d, "documents").select("source", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("k"), F.pow("n_chars", F.lit(2)).alias("v"))
    w = Window.partitionBy("source")
    return rows.select("source", "k", (F.sum("v").over(w.orderBy("k")) / F.sum("v").over(w)).alias("fraction"))


@query("w12_average_ranks", "SELECT doc_id, rank() OVER (PARTITION BY source ORDER BY n_chars // 500) + (count(*) OVER (PARTITION BY source, n_chars // 500) - 1) / 2.0 AS r FROM documents")
def w12(spark, d):
    b = F.floor(F.col("n_chars") / 500)
    t = V.table(spark, d, "documents").withColumn("b", b)
    return t.select("doc_id", (F.rank().over(Window.partitionBy("source").orderBy("b")) + (F.count("*").over(Window.partitionBy("source", "b")) - 1) / 2).cast("double").alias("r"))


@query("o01_ordered_categories", "SELECT family, run_name, row_number() OVER (ORDER BY CASE run_name WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, family DESC) AS place FROM (SELECT DISTINCT family, run_name FROM v_rollouts)")
def o01(spark, d):
    keys = V.rollouts(spark, d).select("family", "run_name").distinct()
    order = F.when(F.col("run_name") == "O", 0).when(F.col("run_name") == "P", 1).otherwise(2)
    return keys.select("family", "run_name", F.row_number().over(Window.orderBy(order, F.desc("family"))).alias("place"))


@query("u06_distinct_prompts", "SELECT md5(text) AS prompt_id, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text)")
def u06(spark, d):
    return V.table(spark, d, "documents").groupBy(F.md5("text").alias("prompt_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("g18_group_labels", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS label FROM documents")
def g18(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source")
    names = docs.groupBy("source").count().select("source", (F.dense_rank().over(Window.orderBy("source")) - 1).alias("label"))
    return docs.join(F.broadcast(names), "source").select("doc_id", "label")


@query("x06_conversation_reward", "SELECT run_name, prompt_id, round(sum(v), 6) AS reward FROM (SELECT run_name, prompt_id, family, avg(score) * CASE family WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.25 END AS v FROM v_rollouts GROUP BY run_name, prompt_id, family) GROUP BY run_name, prompt_id")
def x06(spark, d):
    weight = F.when(F.col("family") == "A", 1.0).when(F.col("family") == "N", 0.5).otherwise(0.25)
    own = V.rollouts(spark, d).groupBy("run_name", "prompt_id", "family").agg(F.avg("score").alias("v"))
    return own.groupBy("run_name", "prompt_id").agg(F.sum(F.col("v") * weight).alias("reward"))


@query("x07_token_amount", "SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) FILTER (turn > 0)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def x07(spark, d):
    m = V.messages(spark, d)
    rest = F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0)))
    sizes = F.transform(rest, lambda x: F.size(X.pieces(x["content"])).cast("long"))
    return m.select("conv_id", F.when(F.size(rest) > 0, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens"))


@query("x16_best_of_n_weights", "SELECT prompt_id, sample_id, round(n * pow((SELECT count(*) FROM v_rollouts o WHERE o.prompt_id = r.prompt_id AND o.score <= r.score)::DOUBLE / n, n - 1), 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n FROM v_rollouts) r")
def x16(spark, d):
    w = Window.partitionBy("prompt_id")
    r = V.rollouts(spark, d).select("prompt_id", "sample_id", F.count("*").over(w).alias("n"), F.cume_dist().over(w.orderBy("score")).alias("f"))
    return r.select("prompt_id", "sample_id", (F.col("n") * F.pow("f", F.col("n") - 1)).alias("weight"))


@query("x17_shard_merge", "SELECT p_partkey % 50 AS path, max(p_partkey % 4)::BIGINT AS shard, arg_max(p_name, (p_partkey % 4, p_partkey)) AS name FROM part GROUP BY p_partkey % 50")
def x17(spark, d):
    p = V.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("path"), (F.col("p_partkey") % 4).alias("shard"), "p_partkey", "p_name")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("shard"), F.desc("p_partkey")))
    return p.withColumn("r", last).where("r = 1").select("path", "shard", F.col("p_name").alias("name"))
