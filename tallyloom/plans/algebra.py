"""Batch algebra, losses and converters as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import losses as L
from tallyloom.functions import texts as X
from tallyloom.operators import batches as B
from tallyloom.operators import permute as E
from tallyloom.sources import views as V
from tallyloom.streaming import queues as Q

from .registry import query


def _batch(spark, d):
    return V.table(spark, d, "part").select((F.col("p_partkey")).cast("long").alias("i"), "p_name", F.col("p_size").cast("long").alias("n"))


@query("m04_pop", "SELECT p_partkey AS i, p_name, CAST(p_size AS BIGINT) + 1 AS n FROM part")
def m01_m04_m05(spark, d):
    sizes, rest = B.pop(_batch(spark, d), ["n"], ["i"])
    return rest.join(sizes.withColumnsRenamed({"n": "m"}).select("i", (F.col("m") + 1).alias("n")), "i")


@query("m11_reorder", "SELECT (SELECT count(*) FROM part) - 1 - p_partkey AS i, p_name FROM part")
def m11_m23(spark, d):
    rows = _batch(spark, d).select("i", "p_name")
    total = rows.agg(F.count("*").alias("t"))
    turned = rows.join(F.broadcast(total), how="cross").select((F.col("t") - 1 - F.col("i")).alias("place"), F.col("i").alias("source"))
    return B.reorder(rows, "i", B.inverse(B.inverse(turned)))


def _turned(x: str, r: int, key: str) -> str:
    first = f"(({x} * 1597334677 + {key} + {r * 374761393}) % 2147483647)"
    return f"((xor({first}, {first} >> 13) * 48271 + {r}) % 2147483647)"


#: One pass of four rounds over the digits l (of a) and r (of b), for rows with columns n, a, b and key.
def _pass(source: str, x: str) -> str:
    out = f"SELECT *, {x} // b AS l, {x} % b AS r FROM {source}"
    for k in range(4):
        out = f"SELECT * REPLACE ((l + {_turned('r', 1, f'(key + {2 * k})')}) % a AS l) FROM ({out})"
        out = f"SELECT * REPLACE ((r + {_turned('l', 2, f'(key + {2 * k + 1})')}) % b AS r) FROM ({out})"
    return f"SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS x) FROM ({out})"


_PLACES = f"""WITH RECURSIVE s AS (SELECT i, i AS x, epoch, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b, epoch * 7919 + 7 AS key
    FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), range(3) e(epoch)),
    w AS (({_pass('s', 'x')}) UNION ALL ({_pass('(SELECT * FROM w WHERE x >= n)', 'x')}))"""


@query("m07_epochs", f"{_PLACES} SELECT epoch, x // 10 AS batch, count(*) AS n, min(i) AS first, max(i) AS last, sum(i * (x + 1))::BIGINT AS signature FROM w WHERE x < n GROUP BY ALL")
def m07(spark, d):
    rows = _batch(spark, d)
    placed = E.epochs(rows, "i", rows.count(), 10, 3, 7)
    return placed.groupBy("epoch", "batch").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"), F.sum(F.col("i") * (F.col("place") + 1)).alias("signature"))


@query("o10_samplers", f"{_PLACES} SELECT i, max(x) FILTER (epoch = 0) AS random, i AS sequential FROM w WHERE x < n GROUP BY i")
def o10(spark, d):
    rows = _batch(spark, d)
    n = rows.count()
    return rows.select("i", E.place(F.col("i"), n, F.lit(7)).alias("random"), F.col("i").alias("sequential"))


@query("m15_fold", "SELECT (p_partkey - (SELECT min(p_partkey) FROM part)) // 10 AS \"group\", list(p_size ORDER BY p_partkey)[1] AS first, list(p_size ORDER BY p_partkey)[-1] AS last, count(*) AS n FROM part GROUP BY 1")
def m15_m16(spark, d):
    """Ten rows a group, however many rows there are."""
    rows = _batch(spark, d)
    total = rows.count()
    folded = B.fold(rows, "i", total // 10, total, ["n", "p_name"])
    return folded.select("group", F.element_at("n", 1).alias("first"), F.element_at("n", -1).alias("last"), F.size("p_name").alias("n"))


_ITEMS = f"SELECT l_suppkey AS g, l_quantity::BIGINT AS len, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {', '.join(V.LINE_ORDER)}) - 1 AS i FROM lineitem"


def _supplied(spark, d):
    """The lines of a supplier as a batch: i counts them from 0."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", *V.LINE_ORDER)
    return V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").cast("long").alias("len"), (F.row_number().over(w) - 1).cast("long").alias("i"))


def _parts(rows):
    """What a cut comes to: it can't be another one with the same figures but by chance."""
    return rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("len").alias("tokens"), F.min("i").alias("first"), F.sum((F.col("i") + 1) * (F.col("i") + 1)).alias("signature"))


@query("m21_least_loaded", f"""WITH RECURSIVE items AS ({_ITEMS}), s AS (SELECT DISTINCT g, -1::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS p, 0::BIGINT AS len FROM items
    UNION ALL SELECT t.g, items.i, list_transform(t.loads, lambda x, j: x + CASE WHEN j = t.q THEN items.len ELSE 0 END), t.q, items.len FROM (SELECT *, list_position(loads, list_min(loads))::BIGINT AS q FROM s) t JOIN items ON items.g = t.g AND items.i = t.i + 1)
    SELECT g, p - 1 AS part, count(*) AS n, sum(len)::BIGINT AS tokens, min(i) AS first, sum((i + 1) * (i + 1))::BIGINT AS signature FROM s WHERE i >= 0 GROUP BY ALL""")
def m21(spark, d):
    return _parts(B.partitioned(_supplied(spark, d), "g", "len", "i", lambda lengths: B.least_loaded(lengths, 4)))


@query("m20_balanced_parts")
def m20(spark, d):
    """Held against a slow version of the rule in the tests, as SQL can't merge states."""
    return _parts(B.balance(_supplied(spark, d), "g", "len", "i", 4))


@query("m19_budget_batches")
def m19(spark, d):
    return _parts(B.partitioned(_supplied(spark, d), "g", "len", "i", lambda lengths: B.budget_batches(lengths, 400)))


@query("m22_rank_order")
def m22(spark, d):
    """Each batch for four ranks, or two or one where it can't be dealt evenly."""
    ranks = lambda n: next(k for k in (4, 2, 1) if n % k == 0)
    rows = B.placed(_supplied(spark, d), "g", "len", "i", lambda lengths: B.rank_order(lengths, ranks(len(lengths))))
    return rows.select("g", "i", "len", "place")


@query("m24_fitted", "SELECT vec_id, how, CASE how WHEN 'left' THEN len(embedding) - 12 ELSE 0 END AS first, CASE how WHEN 'right' THEN 11 ELSE len(embedding) - 1 END AS last, 12 AS n FROM embeddings, (VALUES ('left'), ('right'), ('middle')) h(how)")
def m24_m26(spark, d):
    v = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: i.cast("long")).alias("v"))
    out = None
    for how in ("left", "right", "middle"):
        x = v.select("vec_id", F.lit(how).alias("how"), B.fitted(F.col("v"), 12, F.lit(0).cast("long"), how).alias("x"))
        out = x if out is None else out.unionByName(x)
    return out.select("vec_id", "how", F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"), F.size("x").alias("n"))


@query("m25_loss_mask", "SELECT p_partkey, p_size % 7 + 1 AS teaches, p_size - 1 AS first FROM part WHERE p_size >= 1")
def m25(spark, d):
    n = F.col("p_size")
    m = V.table(spark, d, "part").where("p_size >= 1").select("p_partkey", B.loss_mask(n, n % 7 + 1, n + n % 7 + 3).alias("m"))
    return m.select("p_partkey", F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("teaches"), (F.array_position("m", F.lit(1)) - 1).alias("first"))


_T = "SELECT *, logp_a - logp_b AS d, reward - 0.05 AS a FROM v_tokens"


@query("f57_rejections", f"""SELECT sequence, count(*) FILTER (mask AND exp(d) BETWEEN 0.8 AND 1.25) AS by_token, count(*) FILTER (mask AND exp(least(greatest(s, -20), 20)) BETWEEN 0.5 AND 2) AS by_sequence, count(*) FILTER (mask AND exp(m) BETWEEN 0.9 AND 1.1) AS by_mean,
    coalesce(bool_or(lo < ln(0.5)), false) AS vetoed FROM (SELECT *, sum(d) FILTER (mask) OVER w AS s, avg(d) FILTER (mask) OVER w AS m, min(d) FILTER (mask) OVER w AS lo FROM ({_T}) WINDOW w AS (PARTITION BY sequence)) GROUP BY sequence""")
def f57_f58(spark, d):
    w, x, m = Window.partitionBy("sequence"), F.col("logp_a") - F.col("logp_b"), F.col("mask")
    t = V.tokens(spark, d).select("sequence", L.rejection(x, m, w, "token", 1.25, 0.8).alias("a"), L.rejection(x, m, w, "sequence", 2.0, 0.5).alias("b"), L.rejection(x, m, w, "geometric", 1.1, 0.9).alias("c"), L.vetoed(x, m, w, 0.5).alias("v"))
    return t.groupBy("sequence").agg(F.count_if("a").alias("by_token"), F.count_if("b").alias("by_sequence"), F.count_if("c").alias("by_mean"), F.bool_or("v").alias("vetoed"))


@query("f59_loss_variants", f"""SELECT sequence, round(avg(greatest(-a * r, -a * least(greatest(r, 0.8), 1.2))) FILTER (mask), 6) AS gspo, round(avg(-logp_a * a) FILTER (mask), 6) AS gpg, round(avg(-a * exp(g)) FILTER (mask), 6) AS geo_mean, round(avg(greatest(-a * exp(d), -a * least(greatest(exp(d), 0.8), 1.2)) + 0.1 * abs(d)) FILTER (mask), 6) AS kl_cov
    FROM (SELECT *, exp(avg(d) FILTER (mask) OVER w) AS r, avg(CASE WHEN a > 0 THEN least(d, least(greatest(d, -0.4), 0.4)) WHEN a < 0 THEN greatest(d, least(greatest(d, -0.4), 0.4)) ELSE 0 END) FILTER (mask) OVER w AS g FROM ({_T}) WINDOW w AS (PARTITION BY sequence)) GROUP BY sequence""")
def f59_variants(spark, d):
    w, a = Window.partitionBy("sequence"), F.col("reward") - 0.05
    t = V.tokens(spark, d).select("sequence", "mask", L.clipped(L.sequence_ratio("logp_a", "logp_b", "mask", w), a, 0.2, 0.2).alias("gspo"), (-F.col("logp_a") * a).alias("gpg"), L.geometric_policy_loss("logp_a", "logp_b", a, "mask", w).alias("geo_mean"),
        (L.clipped(L.bounded_ratio(F.col("logp_a"), F.col("logp_b")), a, 0.2, 0.2) + 0.1 * F.abs(F.col("logp_a") - F.col("logp_b"))).alias("kl_cov"))
    return t.groupBy("sequence").agg(*[F.avg(F.when(F.col("mask"), F.col(c))).alias(c) for c in ("gspo", "gpg", "geo_mean", "kl_cov")])


@query("f59_covariance_clip", f"""WITH t AS ({_T}), m AS (SELECT avg(logp_a) FILTER (mask) AS x, avg(a) FILTER (mask) AS y FROM t) SELECT sequence, count(*) FILTER (mask AND c > 0.0001 AND c < 0.01) AS clipped, round(avg(CASE WHEN c > 0.0001 AND c < 0.01 THEN 0 ELSE greatest(-a * exp(d), -a * least(greatest(exp(d), 0.8), 1.2)) END) FILTER (mask), 6) AS loss
    FROM (SELECT t.*, (logp_a - x) * (a - y) AS c FROM t, m) GROUP BY sequence""")
def f59_cov(spark, d):
    t = V.tokens(spark, d).withColumn("a", F.col("reward") - 0.05)
    c = L.covariance_clipped(t, "logp_a", "logp_b", "a", "mask", low=0.0001, high=0.01)
    return c.groupBy("sequence").agg(F.count_if(F.col("mask") & (F.col("cov") > 0.0001) & (F.col("cov") < 0.01)).alias("clipped"), F.avg("loss").alias("loss"))


@query("f61_entropy", "SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) - list_sum(list_transform(embedding, lambda x: x::DOUBLE * exp(x::DOUBLE))) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS entropy FROM embeddings")
def f61_entropy(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", L.entropy(F.transform("embedding", lambda x: x.cast("double"))).alias("entropy"))


@query("f54_adaptive_kl", "SELECT run_name, round(list_reduce(list_prepend(0.2, list(k ORDER BY checkpoint_step)), lambda b, k: b * (1 + least(greatest(k / 0.5 - 1, -0.2), 0.2) * 64 / 1000.0)), 6) AS coefficient FROM (SELECT run_name, checkpoint_step, avg(score) AS k FROM v_rollouts GROUP BY ALL) GROUP BY run_name")
def f54(spark, d):
    k = V.rollouts(spark, d).groupBy("run_name", "checkpoint_step").agg(F.avg("score").alias("k")).groupBy("run_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("checkpoint_step", "k"))), lambda x: x["k"]).alias("k"))
    return k.select("run_name", L.adaptive_coefficient(F.col("k"), 0.2, 0.5, 1000.0, F.lit(64)).alias("coefficient"))


_PAIR = "SELECT a.vec_id, list_sum(a.embedding)::DOUBLE AS c, list_sum(b.embedding)::DOUBLE AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, d):
    s = V.table(spark, d, "embeddings").select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("c"))
    return s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("c").alias("r")), "vec_id")


@query("x04_preference_losses", f"SELECT vec_id, round(0.9 * ln(1 + exp(-0.1 * (c - r))) + 0.1 * ln(1 + exp(0.1 * (c - r))), 4) AS sigmoid, round(pow(c - r - 5, 2), 3) AS ipo FROM ({_PAIR})")
def x04(spark, d):
    p = _pairs(spark, d)
    return p.select("vec_id", F.round(L.preference_loss(F.col("c"), F.col("r"), 0.1, smoothing=0.1), 4).alias("sigmoid"), F.round(L.preference_loss(F.col("c"), F.col("r"), 0.1, "ipo"), 3).alias("ipo"))


@query("x02_sppo", "SELECT round(avg(pow(s - 2 * r, 2)), 5) AS loss, count(*) AS n FROM (SELECT sequence, sum(logp_a - logp_b) AS s, sum(reward) AS r FROM v_tokens WHERE mask GROUP BY sequence)")
def x02(spark, d):
    own = V.tokens(spark, d).where("mask").groupBy("sequence").agg(F.sum(F.col("logp_a") - F.col("logp_b")).alias("s"), F.sum("reward").alias("r"))
    return own.agg(F.round(F.avg(F.pow(F.col("s") - 2 * F.col("r"), F.lit(2))), 5).alias("loss"), F.count("*").alias("n"))


#: Converters by name: rows of a source to id, prompt, gold and metadata. They are looked up, as a plug-in would be.
CONVERTERS = {}


def converter(f):
    CONVERTERS[f.__name__] = f
    return f


def _numbered(df, name: str, order: str):
    return Q.ranked(df, order).withColumn("id", F.format_string(f"{name}_%04d", "place")).drop("place")


@converter
def math500(rows):
    """question, gold: the request to think step by step at the end goes; ids by place."""
    prompt = F.regexp_replace("question", r"(?s)\s*Let's think step by step.*$", "")
    return _numbered(rows.withColumn("prompt", prompt), "math500", "k").select("id", "prompt", "gold")


@converter
def aime(rows):
    """raw_problem before question, answer before gold; the newer set where the origin says 25."""
    return rows.select(F.coalesce("raw_problem", "question").alias("prompt"), F.coalesce("answer", "gold").alias("gold"), F.when(F.contains("origin", F.lit("25")), "aime25").otherwise("aime24").alias("benchmark"), "k")


@converter
def gsm8k(rows):
    """The gold is what follows ####, else the last number, else all of the answer."""
    marked = F.nullif(F.regexp_extract("answer", r"#### (.+)", 1), F.lit(""))
    number = F.try_element_at(F.regexp_extract_all("answer", F.lit(r"-?\d[\d,]*(?:\.\d+)?"), 0), F.lit(-1))
    return rows.select("k", F.col("question").alias("prompt"), F.trim(F.coalesce(marked, number, F.col("answer"))).alias("gold"))


@converter
def ifeval(rows):
    """ids and kwargs (a map each): null arguments go, types are what stands before the colon."""
    return rows.select("k", F.transform("ids", lambda x: F.split(x, ":")[0]).alias("types"), F.transform("kwargs", lambda m: F.map_filter(m, lambda _, v: v.isNotNull())).alias("kwargs"))


@converter
def mathif(rows):
    """The prompt is the question and its instruction; the answer is a number only for gsm8k."""
    question = F.coalesce(F.nullif("question", F.lit("")), F.nullif("prompt", F.lit("")), F.lit(""))
    return rows.select("k", F.concat(question, F.lit("\n\nInstruction: "), F.concat_ws(" ", "instruction")).alias("prompt"), F.when(F.col("source") == "gsm8k", "numeric").otherwise("text").alias("answer_type"))


@query("p02_math500", "SELECT printf('math500_%04d', row_number() OVER (ORDER BY item_id) - 1) AS id, text AS prompt, 'g' || item_id AS gold FROM benchmark")
def p02_p24(spark, d):
    rows = V.table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.concat("text", F.lit("\nLet's think step by step and\nanswer.")).alias("question"), F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("gold"))
    return CONVERTERS["math500"](rows)


@query("p03_aime", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'q ' || text END AS prompt, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'g' END || item_id AS gold, CASE WHEN item_id % 5 = 0 THEN 'aime25' ELSE 'aime24' END AS benchmark FROM benchmark")
def p03(spark, d):
    i, text = F.col("item_id"), F.col("item_id").cast("string")
    rows = V.table(spark, d, "benchmark").select(i.alias("k"), F.when(i % 2 == 0, F.col("text")).alias("raw_problem"), F.concat(F.lit("q "), "text").alias("question"), F.when(i % 3 == 0, F.concat(F.lit("a"), text)).alias("answer"), F.concat(F.lit("g"), text).alias("gold"), F.when(i % 5 == 0, "aime_2025").otherwise("aime_I").alias("origin"))
    return CONVERTERS["aime"](rows).withColumnRenamed("k", "item_id")


@query("p04_gsm8k", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' ELSE p_name END AS gold FROM part")
def p04(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    answer = F.when(k == 0, F.concat(F.lit("3 + 4 = 7\n#### "), n, F.lit(" "))).when(k == 1, F.concat(F.lit("first 12, then "), n, F.lit(".5 apples"))).otherwise(F.col("p_name"))
    return CONVERTERS["gsm8k"](V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("question"), answer.alias("answer"))).select(F.col("k").alias("p_partkey"), "gold")


@query("p05_ifeval", "SELECT p_partkey, 'keywords,punctuation' AS types, CASE WHEN p_size % 2 = 0 THEN 'n,size' ELSE 'n' END AS args FROM part")
def p05_p22(spark, d):
    kwargs = F.array(F.create_map(F.lit("n"), F.lit("1"), F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))))
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array(F.lit("keywords:existence"), F.lit("punctuation:no_comma")).alias("ids"), kwargs.alias("kwargs"))
    out = CONVERTERS["ifeval"](rows)
    return out.select(F.col("k").alias("p_partkey"), F.array_join("types", ",").alias("types"), F.array_join(F.array_sort(F.map_keys(F.col("kwargs")[0])), ",").alias("args"))


@query("p07_mathif", "SELECT p_partkey, p_name || chr(10) || chr(10) || 'Instruction: be brief and ' || p_size AS prompt, CASE WHEN p_partkey % 2 = 0 THEN 'numeric' ELSE 'text' END AS answer_type FROM part")
def p07_p08(spark, d):
    empty = F.col("p_partkey") % 3 == 0
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(empty, "").otherwise(F.col("p_name")).alias("question"), F.when(empty, F.col("p_name")).alias("prompt"), F.array(F.lit("be brief"), F.concat(F.lit("and "), F.col("p_size").cast("string"))).alias("instruction"), F.when(F.col("p_partkey") % 2 == 0, "gsm8k").otherwise("math").alias("source"))
    return CONVERTERS["mathif"](rows).withColumnRenamed("k", "p_partkey")


@query("p09_restamp", "SELECT printf('alias_%04d', row_number() OVER (ORDER BY item_id) - 1) AS id, text, 'alias' AS benchmark FROM benchmark")
def p09_p21(spark, d):
    return _numbered(V.table(spark, d, "benchmark").withColumn("benchmark", F.lit("alias")), "alias", "item_id").select("id", "text", "benchmark")


@query("p23_clean_text", "SELECT p_partkey, p_name || '. then ' || p_size AS text FROM part WHERE p_size % 5 > 0")
def p23(spark, d):
    t = F.concat("p_name", F.lit(" [title]then  [step 1]"), F.col("p_size").cast("string"))
    t = F.trim(F.replace(F.regexp_replace(F.replace(t, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" ")))
    return V.table(spark, d, "part").where(F.length(F.when(F.col("p_size") % 5 > 0, "0").otherwise("")) > 0).select("p_partkey", t.alias("text"))


@query("x08_collapse", "SELECT conv_id, count(*) + 1 AS n_messages, 'system' AS first_role, count(*) AS turns FROM conversations GROUP BY conv_id")
def x08(spark, d):
    m = V.messages(spark, d).withColumn("turns", F.size("messages"))
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit("Be helpful.").alias("content")))
    out = m.select("conv_id", F.concat(system, "messages").alias("prompt"), F.struct(*[c for c in m.columns if c != "messages"]).alias("extra_info"))
    return out.select("conv_id", F.size("prompt").alias("n_messages"), F.col("prompt")[0]["role"].alias("first_role"), "extra_info.turns")


@query("x14_shuffled_choices", "SELECT p_partkey, 4 AS n, true AS held, 'ABCD' AS letters FROM part")
def x14(spark, d):
    i = F.col("p_partkey")
    wrong = F.transform(F.array(*[F.lit(f"wrong {k}") for k in range(3)]), lambda x: F.struct(F.xxhash64(i, x).alias("h"), x.alias("x")))
    mixed = F.transform(F.array_sort(wrong), lambda s: s["x"])
    place = (F.pmod(F.xxhash64(i), F.lit(4)) + 1).cast("int")
    rows = V.table(spark, d, "part").select("p_partkey", "p_name", place.alias("place"), F.array_insert(mixed, place, F.col("p_name")).alias("choices"))
    letter = F.substring(F.lit("ABCD"), F.col("place"), F.lit(1))
    return rows.select("p_partkey", F.size("choices").alias("n"), (F.element_at("choices", F.position(letter, F.lit("ABCD"))) == F.col("p_name")).alias("held"), F.lit("ABCD").alias("letters"))


@query("x15_built_sets", "SELECT 'en' AS split, row_number() OVER (ORDER BY item_id) - 1 AS index, text AS prompt FROM benchmark UNION ALL SELECT 'zh', row_number() OVER (ORDER BY item_id) - 1, 'zh ' || text FROM benchmark")
def x15(spark, d):
    b = Q.ranked(V.table(spark, d, "benchmark").select("item_id", "text"), "item_id", "index")
    return b.select(F.lit("en").alias("split"), "index", F.col("text").alias("prompt")).unionByName(b.select(F.lit("zh").alias("split"), "index", F.concat(F.lit("zh "), "text").alias("prompt")))


@query("f40_first_tokens", "SELECT doc_id, round(len(list_intersect(x, y))::DOUBLE / greatest(len(list_distinct(x || y)), 1), 6) AS jaccard FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(response, '\\s+'), lambda z: z <> '')[1:5]) AS x, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')[1:5]) AS y FROM v_responses JOIN documents USING (doc_id))")
def f40(spark, d):
    first = lambda c: F.array_distinct(F.slice(X.pieces(F.col(c)), 1, 5))
    r = V.responses(spark, d).join(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", first("response").alias("x"), first("text").alias("y"))
    return r.select("doc_id", (F.size(F.array_intersect("x", "y")) / F.greatest(F.size(F.array_union("x", "y")), F.lit(1))).alias("jaccard"))
