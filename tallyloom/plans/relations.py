"""Joins, samples, sets, batches, converters and scans as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import texts as X
from tallyloom.operators import batches as B
from tallyloom.operators import joins as J
from tallyloom.operators import sampling as S
from tallyloom.sources import views as V

from .registry import query


@query("j01_metadata_lookup", "WITH m AS (SELECT run_name, arg_max(family, (prompt_id, sample_id)) AS fam FROM v_rollouts GROUP BY run_name) SELECT o_orderkey, o_orderstatus AS run_name, fam FROM orders LEFT JOIN m ON o_orderstatus = run_name AND true")
def j01_j02_j03_j09_j11_j14(spark, d):
    r = V.rollouts(spark, d).select("run_name", F.col("family").alias("fam"), "prompt_id", "sample_id")
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("run_name"))
    return J.lookup(o, r, "run_name", ["prompt_id", "sample_id"]).select("o_orderkey", "run_name", "fam")


@query("j06_resume_left_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s06_j_anti_p12(spark, d):
    return V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j08_first_keys", "SELECT sequence, t FROM v_tokens WHERE sequence IN (SELECT DISTINCT sequence FROM v_tokens ORDER BY sequence LIMIT 50)")
def j08_j10(spark, d):
    t = V.tokens(spark, d)
    first = t.select("sequence").distinct().orderBy("sequence").limit(50)
    return t.join(F.broadcast(first), "sequence", "left_semi").select("sequence", "t")


@query("j12_anchor_jaccard", """WITH a AS (SELECT source, arg_min(text, doc_id) AS t FROM documents GROUP BY source), p AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5]) AS x, list_distinct(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')[1:5]) AS y FROM documents d JOIN a ON d.source = a.source)
    SELECT doc_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)), 6) AS jaccard FROM p""")
def j12_f40(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source", F.array_distinct(F.slice(X.pieces(F.col("text")), 1, 5)).alias("x"))
    j = J.anchored(docs, docs, "source", "doc_id", ["x"])
    union = F.size(F.array_union("x", "anchor_x"))
    return j.select("doc_id", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "anchor_x")) / union).alias("jaccard"))


@query("j15_coverage", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'extra' ELSE 'shared' END AS status FROM (SELECT doc_id FROM labels) a FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'en') b ON a.doc_id = b.doc_id")
def j15_u03_s33(spark, d):
    return J.coverage(V.table(spark, d, "labels"), V.table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("j16_override", "SELECT coalesce(u.doc_id, b.doc_id) AS doc_id, coalesce(u.v, b.v) AS v FROM (SELECT doc_id, n_chars AS v FROM documents) b FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS v FROM labels) u ON b.doc_id = u.doc_id")
def j16_s22(spark, d):
    return J.override(V.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v")), V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id")


@query("j17_zip_columns", "SELECT doc_id, source, n_chars, lang FROM documents")
def j17_m06(spark, d):
    t = V.table(spark, d, "documents")
    return J.zip_columns(t.select("doc_id", "source", "n_chars"), t.select("doc_id", "n_chars", "lang"), "doc_id")


@query("j18_paired_arrays", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def j18_x06(spark, d):
    c = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    z = F.arrays_zip(F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))
    return c.select("conv_id", F.explode(z).alias("z")).select("conv_id", "z.turn", "z.role", F.length("z.text").cast("long").alias("n"))


@query("j19_baseline_delta", "WITH m AS (SELECT run_name, family, avg(score) AS score FROM v_rollouts GROUP BY run_name, family) SELECT m.run_name, m.family, round(m.score, 6) AS score, round(m.score - b.score, 6) AS score_delta FROM m LEFT JOIN m b ON b.run_name = 'F' AND b.family = m.family")
def j19(spark, d):
    m = V.rollouts(spark, d).groupBy("run_name", "family").agg(F.avg("score").alias("score"))
    return J.against_baseline(m, "run_name", "F", ["score"], ["family"])


@query("j20_pair_order", """WITH r AS (SELECT prompt_id, sample_id, acc::INT AS a, score AS s FROM v_rollouts), p AS (SELECT x.prompt_id, sum(abs(x.a - y.a) * (sign(x.a - y.a) = sign(x.s - y.s))::INT) / sum(abs(x.a - y.a)) AS v FROM r x JOIN r y ON x.prompt_id = y.prompt_id AND x.sample_id < y.sample_id AND x.a <> y.a GROUP BY x.prompt_id)
    SELECT k.prompt_id, round(coalesce(v, 0.5), 6) AS agreement FROM (SELECT DISTINCT prompt_id FROM r) k LEFT JOIN p ON k.prompt_id = p.prompt_id""")
def j20(spark, d):
    r = V.rollouts(spark, d).select("prompt_id", "sample_id", F.col("acc").cast("double").alias("a"), "score")
    return J.pair_order(r, "prompt_id", "sample_id", "a", "score")


@query("j21_competitors", """WITH r AS (SELECT prompt_id, sample_id, acc::INT AS a, score AS s FROM v_rollouts) SELECT x.prompt_id, x.sample_id, round(avg(CASE WHEN y.a < x.a THEN y.s END), 6) AS lower_mean, round(avg(CASE WHEN y.a > x.a THEN y.s END), 6) AS higher_mean FROM r x JOIN r y ON x.prompt_id = y.prompt_id GROUP BY x.prompt_id, x.sample_id""")
def j21_x16(spark, d):
    low, high = J.competitors("prompt_id", "acc", "score")
    return V.rollouts(spark, d).select("prompt_id", "sample_id", low.alias("lower_mean"), high.alias("higher_mean"))


@query("w02_cap_samples", "SELECT prompt_id, sample_id FROM v_rollouts WHERE sample_id < 2")
def w01_w02(spark, d):
    return S.per_group(V.rollouts(spark, d), ["prompt_id"], ["sample_id"], 2).select("prompt_id", "sample_id")


@query("w03_first_prompts", "SELECT run_name, prompt_id, sample_id FROM (SELECT *, dense_rank() OVER (PARTITION BY run_name ORDER BY prompt_id) AS r FROM v_rollouts) WHERE r <= 5")
def w03_w12(spark, d):
    w = Window.partitionBy("run_name").orderBy("prompt_id")
    return V.rollouts(spark, d).withColumn("r", F.dense_rank().over(w)).where("r <= 5").select("run_name", "prompt_id", "sample_id")


@query("w08_response_mask", "SELECT sequence, t, (t <= coalesce(min(CASE WHEN value >= 0.07 THEN t END) OVER (PARTITION BY sequence), t))::INT::BIGINT AS m FROM v_tokens")
def w08(spark, d):
    t = V.tokens(spark, d).groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("x"))
    ids = F.transform("x", lambda v: (v["value"] >= 0.07).cast("int"))
    return t.select("sequence", F.posexplode(B.response_mask(ids, [1])).alias("t", "m")).withColumn("t", F.col("t") + 1)


@query("o02_shortest_correct", "SELECT prompt_id, sample_id, length FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY length, sample_id) AS r FROM v_rollouts WHERE acc) WHERE r = 1")
def o02_p16_p17_u06(spark, d):
    return S.per_group(V.rollouts(spark, d).where("acc"), ["prompt_id"], ["length", "sample_id"], 1).select("prompt_id", "sample_id", "length")


@query("o03_backfill", "SELECT prompt_id FROM (SELECT prompt_id FROM v_rollouts WHERE acc AND sample_id = 0 AND length > 49 UNION SELECT prompt_id FROM v_rollouts WHERE sample_id = 1 AND length > 48) ORDER BY prompt_id LIMIT 100")
def o03(spark, d):
    r = V.rollouts(spark, d)
    return S.backfill(r.where("acc and sample_id = 0 and length > 49").select("prompt_id"), r.where("sample_id = 1 and length > 48").select("prompt_id"), "prompt_id", 100)


@query("o04_top_k", "SELECT vec_id, round(list_reverse_sort(embedding)[10]::DOUBLE, 6) AS tenth FROM embeddings WHERE vec_id < (SELECT max(vec_id) FROM embeddings)")
def o04(spark, d):
    return V.top_k(spark, d).select("vec_id", F.get("logits_b", F.lit(9)).alias("tenth"))


@query("o05_seeded_take", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|' || '42'), doc_id LIMIT 100")
def o05_o09_s24(spark, d):
    return S.take(V.table(spark, d, "documents").select("doc_id"), 100, ["doc_id"], seed=42)


_ALLOCATED = "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT *, n * 77.0 / sum(n) OVER () AS x FROM c), q AS (SELECT source, n, least(n, floor(x) + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source DESC) <= 77 - sum(floor(x)) OVER ())::INT) AS quota FROM e)"


@query("o06_largest_remainder", _ALLOCATED + " SELECT source, n, CAST(quota AS BIGINT) AS quota FROM q")
def o06(spark, d):
    return S.allocate(V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", 0, 77)


@query("o06_stratified_sample", _ALLOCATED + ", r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|' || '0'), doc_id) AS r FROM documents) SELECT doc_id, r.source FROM r JOIN q ON r.source = q.source WHERE r <= quota")
def o06s_o08(spark, d):
    return S.stratified(V.table(spark, d, "documents").select("doc_id", "source"), "source", 77, ["doc_id"])


@query("o07_fixed_strata", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|' || '0'), doc_id) AS r FROM documents) WHERE (source = 'src1' AND r <= 11) OR (source = 'src2' AND r <= 23)")
def o07(spark, d):
    return S.fixed_strata(V.table(spark, d, "documents").select("doc_id", "source"), "source", {"src1": 11, "src2": 23}, ["doc_id"])


@query("o11_weighted_resample", "SELECT count(*) AS n FROM lineitem")
def o11(spark, d):
    r = S.resample(V.rollouts(spark, d), F.col("score"), ["prompt_id", "sample_id"], seed=7)
    return r.agg(F.sum("draws").alias("n"))


@query("o13_hash_shard", "SELECT prompt_id, sample_id, ('0x' || substr(md5(prompt_id || '|' || sample_id), 1, 8))::BIGINT % 8 AS shard FROM v_rollouts")
def o13_x17(spark, d):
    return V.rollouts(spark, d).select("prompt_id", "sample_id", S.shard(["prompt_id", "sample_id"], 8).alias("shard"))


@query("u01_union_by_name", "SELECT doc_id, source, NULL::BIGINT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def u01_u05_m10_s20(spark, d):
    a, b = V.table(spark, d, "documents").select("doc_id", "source"), V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_keep_first", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def u02_u06(spark, d):
    return V.table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("m03_slice", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE o >= 10 AND o < 500 AND (o - 10) % 7 = 0")
def m02_m03(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("o"))
    return B.slice_rows(rows, "o", 10, 500, 7).select("doc_id")


@query("m09_chunk", "SELECT c AS chunk, count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY doc_id) - 1 AS c FROM documents) GROUP BY c")
def m07_m09_m15(spark, d):
    rows = V.table(spark, d, "documents")
    n = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("chunk", B.chunk(F.col("doc_id"), F.col("_n"), 7)).groupBy("chunk").agg(F.count("*").alias("n"))


@query("m12_repeat", "SELECT doc_id, (SELECT count(*) FROM documents) * c + doc_id AS o FROM documents, (SELECT unnest([0, 1, 2]) AS c)")
def m12(spark, d):
    return B.repeat(V.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("o")), "o", 3, interleave=False).select("doc_id", "o")


@query("m12_repeat_interleaved", "SELECT doc_id, doc_id * 3 + c AS o FROM documents, (SELECT unnest([0, 1, 2]) AS c)")
def m12i(spark, d):
    return B.repeat(V.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("o")), "o", 3).select("doc_id", "o")


@query("m14_repeat_by", "SELECT doc_id, c - 1 AS copy FROM (SELECT doc_id, unnest(range(1, doc_id % 4 + 1)) AS c FROM documents)")
def m14(spark, d):
    return B.repeat_by(V.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("k")), "k").select("doc_id", "copy")


@query("m08_pad_to_multiple", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, doc_id AS o, false AS padding FROM documents UNION ALL SELECT doc_id, doc_id + n, true FROM documents, n WHERE doc_id < (64 - n % 64) % 64")
def m08(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("o"))
    return B.pad_to_multiple(rows, "o", 64, rows.count())


@query("m13_unfold", "SELECT vec_id, p AS piece, round(list_sum(embedding[p * 16 + 1:p * 16 + 16]::DOUBLE[]), 4) AS s FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS p)")
def m13(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return B.unfold(e, ["embedding"], 4).select("vec_id", "piece", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("m19_micro_batches", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(least(count(*), ceil(sum(n_chars) / 20000.0)) AS BIGINT) AS parts FROM documents GROUP BY source")
def m19_a65(spark, d):
    return B.token_budget_parts(V.table(spark, d, "documents"), "source", "n_chars", 20000)


@query("m24_pad_vectors", "SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def m24_m25_m26(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    padded = B.pad_vector(F.col("e"), 100, 0.0)
    return e.select("vec_id", (F.size(padded) - 36).alias("n"), F.get(padded, F.lit(0)).alias("first"))


@query("p01_benchmark_router", "SELECT source, sum(CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END)::BIGINT AS licensed, count(*) AS n FROM documents GROUP BY source")
def p01(spark, d):
    route = F.when(F.instr("text", "License") > 0, "licensed").otherwise("other")
    return V.table(spark, d, "documents").groupBy("source").agg(F.count_if(route == "licensed").alias("licensed"), F.count("*").alias("n"))


@query("p05_constraint_types", "SELECT doc_id, split_part(source || ':' || lang, ':', 1) AS kind FROM documents")
def p05_p22(spark, d):
    ids = F.array(F.concat_ws(":", "source", "lang"))
    return V.table(spark, d, "documents").select("doc_id", F.get(F.transform(ids, lambda x: F.split(x, ":")[0]), F.lit(0)).alias("kind"))


@query("p10_template", "SELECT doc_id, 'Solve: ' || text || ' Put {x} in a box.' AS prompt FROM documents")
def p02_p10_p24(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.replace(F.lit("Solve: {problem} Put {x} in a box."), F.lit("{problem}"), F.col("text")).alias("prompt"))


@query("p11_role_prompt", "SELECT conv_id, string_agg(role || chr(10) || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def p11_x07_x08(spark, d):
    m = V.messages(spark, d)
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\n"), x["content"])), "\n").alias("prompt"))


@query("p13_strip_chat", "SELECT doc_id, trim(text) AS prompt FROM documents")
def p13_p14(spark, d):
    envelope = F.concat(F.lit("system\nBe brief.\nuser\n"), F.col("text"), F.lit("\nassistant\n"))
    return V.table(spark, d, "documents").select("doc_id", X.strip_chat(envelope).alias("prompt"))


@query("p12_job_expansion", "SELECT doc_id, k AS sample_id, 42 + k AS seed FROM documents, (SELECT unnest(range(4)) AS k) WHERE (doc_id, k) NOT IN (SELECT doc_id, quality FROM labels)")
def p12(spark, d):
    jobs = V.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sample_id")).withColumn("seed", 42 + F.col("sample_id"))
    done = V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("sample_id"))
    return jobs.join(done, ["doc_id", "sample_id"], "left_anti")


@query("p15_overlong_filter", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 200")
def p15(spark, d):
    return V.table(spark, d, "documents").where(F.size(X.pieces(F.col("text"))) <= 200).select("doc_id")


@query("p20_condition_position", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 1 END AS position FROM documents")
def p20_p28_p29_p30(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("force_pos"), F.col("doc_id").cast("string")))
    name = F.coalesce(name, F.lit("free"))
    return V.table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.regexp_extract(F.concat(F.lit("x_"), F.regexp_replace(name, "force_", "")), r"_pos(\d+)$", 1), F.lit("")).try_cast("long"), F.lit(1)).alias("position"))


@query("p25_unpivot_pairs", "SELECT doc_id, 'chosen' AS side, source AS text FROM documents UNION ALL SELECT doc_id, 'rejected', lang FROM documents")
def p25_s26(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.col("source").alias("chosen"), F.col("lang").alias("rejected")).unpivot("doc_id", ["chosen", "rejected"], "side", "text")


@query("p26_head_tail_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 0.75 * count(*) OVER () THEN 'train' ELSE 'test' END AS split FROM documents")
def p26(spark, d):
    return S.head_tail(V.table(spark, d, "documents").select("doc_id"), "doc_id", 3, 4, "train", "test", "split")


@query("p27_accuracy_band", "SELECT prompt_id, sample_id FROM (SELECT *, avg(acc::INT) OVER (PARTITION BY prompt_id) AS a, max(length) OVER (PARTITION BY prompt_id) AS m FROM v_rollouts) WHERE a BETWEEN 0.2 AND 0.8 AND m < 50")
def p27(spark, d):
    w = Window.partitionBy("prompt_id")
    r = V.rollouts(spark, d).withColumns({"a": F.avg(F.col("acc").cast("double")).over(w), "m": F.max("length").over(w)})
    return r.where("a between 0.2 and 0.8 and m < 50").select("prompt_id", "sample_id")


@query("x01_softmean", "SELECT round(ln(avg(exp(2.0 * (score - m)))) / 2.0 + m, 6) AS softmean FROM (SELECT score, max(score) OVER () AS m FROM v_rollouts) GROUP BY m")
def x01_x02(spark, d):
    r = V.rollouts(spark, d)
    top = F.broadcast(r.agg(F.max("score").alias("m")))
    return r.crossJoin(top).groupBy("m").agg((F.log(F.avg(F.exp(2.0 * (F.col("score") - F.col("m"))))) / 2.0 + F.col("m")).alias("softmean")).select("softmean")


@query("x03_preference_mask", "SELECT prompt_id, sample_id, row_number() OVER (PARTITION BY prompt_id, sample_id // 2 ORDER BY score DESC, sample_id) = 1 AS chosen FROM v_rollouts")
def x03_x04(spark, d):
    w = Window.partitionBy("prompt_id", F.floor(F.col("sample_id") / 2)).orderBy(F.desc("score"), "sample_id")
    return V.rollouts(spark, d).select("prompt_id", "sample_id", (F.row_number().over(w) == 1).alias("chosen"))


@query("x12_tool_score", "SELECT prompt_id, sample_id, round(CASE WHEN acc THEN 1.0 ELSE least(-0.6, -1.0 + (length % 7 - 2) / 2.0 * 0.1) END, 6) AS score FROM v_rollouts")
def x12(spark, d):
    return V.rollouts(spark, d).select("prompt_id", "sample_id", F.when(F.col("acc"), 1.0).otherwise(F.least(F.lit(-0.6), -1.0 + (F.col("length") % 7 - 2) / 2.0 * 0.1)).alias("score"))


@query("x18_mean_logprob", "SELECT sequence, round(avg(logp_a), 6) AS mean_logp, count(*) AS n FROM v_tokens GROUP BY sequence")
def x18(spark, d):
    return V.tokens(spark, d).groupBy("sequence").agg(F.avg("logp_a").alias("mean_logp"), F.count("*").alias("n"))
