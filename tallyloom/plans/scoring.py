"""Scorers, parsers and rewards as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import answers as N
from tallyloom.functions import scorers as S
from tallyloom.functions import texts as X
from tallyloom.sources import views as V

from .registry import query


@query("f02_undecorated", r"SELECT p_partkey, '(' || p_size || ' cm)*\frac{1}{' || p_size || '}' || p_name || '%$' AS x FROM part")
def f02(spark, d):
    t = F.concat(F.lit(r"\left("), F.col("p_size").cast("string"), F.lit(r"\text{ cm}\!\right)\cdot\dfrac{1}{"), F.col("p_size").cast("string"), F.lit("}"), "p_name", F.lit(r"\%\$"))
    return V.table(spark, d, "part").select("p_partkey", S.undecorated(t).alias("x"))


@query("f04_numbers", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS x, CASE WHEN p_partkey % 1500 <= 999 THEN p_partkey % 1500 END AS answer FROM part")
def f03_f04_f05(spark, d):
    t = F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(" dollars."))
    return V.table(spark, d, "part").select("p_partkey", N.normalize_number(t).alias("x"), N.as_int(F.format_string(" %d ", F.col("p_partkey") % 1500)).alias("answer"))


@query("f10_strict_box", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 AND CAST(doc_id % 5 AS VARCHAR) = gold THEN 1.0::DOUBLE ELSE -1 END AS score, CASE WHEN doc_id % 6 = 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS pred FROM v_responses")
def f10(spark, d):
    s = S.strict_box_score(F.col("response"), F.col("gold"))
    return V.responses(spark, d).select("doc_id", s["score"].alias("score"), s["pred"].alias("pred"))


@query("f11_math_score", r"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\frac{' || p_size % 9 || '}{7}' WHEN 1 THEN '\frac{' || p_size || '}{12}' WHEN 2 THEN '\sqrt{' || p_size % 10 || '}+1' ELSE CASE WHEN p_size = 5 THEN '\frac{1}{2}' ELSE '0.' || p_size END END AS x, 1.0::DOUBLE AS score FROM part")
def f11_f16(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = F.when(k == 0, text(r"\dfrac", n % 9, "7")).when(k == 1, text(n, "/12")).when(k == 2, text(r"x=\sqrt", n % 10, r" +1\text{ cm}")).otherwise(text(".", n, r"\%"))
    gold = F.when(k == 0, text(r"\frac{", n % 9, "}{7}")).when(k == 1, text(r"\frac{", n, "}{12}")).when(k == 2, text(r"\sqrt{", n % 10, "}+1")).otherwise(text("0.", n))
    response = F.concat(F.lit("So we get \\boxed{3} or rather \\boxed{"), said, F.lit("}."))
    return V.table(spark, d, "part").select("p_partkey", S.math_string(said).alias("x"), S.reward("math", response, gold).alias("score"))


@query("f14_geometry_score", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.1 ELSE 0 END AS score FROM part")
def f14(spark, d):
    n = F.col("p_size").cast("string")
    said = F.concat(F.when(F.col("p_partkey") % 3 == 0, "<think>a\nb</think> ").otherwise(""), F.lit("\\boxed{ "), n, F.when(F.col("p_partkey") % 2 == 0, "").otherwise("1"), F.lit("}"))
    return V.table(spark, d, "part").select("p_partkey", S.reward("geometry", said, n).alias("score"))


@query("f15_choice", "SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN substr('ABCD', (doc_id % 6 + 1)::INT, 1) END AS choice FROM documents")
def f15(spark, d):
    said = F.concat("text", F.lit("\nanswer : $"), F.substring(F.lit("ABCDEF"), (F.col("doc_id") % 6 + 1).cast("int"), F.lit(1)))
    return V.table(spark, d, "documents").select("doc_id", N.choice(said).alias("choice"))


@query("f20_routed_rewards", "SELECT doc_id, CASE WHEN source = 'src1' THEN 1.0::DOUBLE WHEN doc_id % 6 = 0 AND CAST(doc_id % 5 AS VARCHAR) = gold THEN 1 ELSE 0 END AS score, CASE WHEN source = 'src1' THEN true ELSE doc_id % 6 = 0 AND CAST(doc_id % 5 AS VARCHAR) = gold END AS acc, CASE WHEN source = 'src1' THEN 'if' ELSE 'math' END AS kind FROM v_responses JOIN documents USING (doc_id)")
def f19_f20_d02_d03(spark, d):
    r = V.responses(spark, d)
    out = S.routed(F.col("prompt_id"), ["src1"], F.lit(1.0), S.reward("math", F.col("response"), F.col("gold")))
    return r.select("doc_id", out.alias("r")).select("doc_id", "r.*")


@query("f22_reward_placement", "SELECT sequence, count(*) AS n, max(t) FILTER (mask) - 1 AS at, CASE WHEN bool_or(mask) THEN 1.5 ELSE 0 END AS total FROM v_tokens GROUP BY sequence")
def f22(spark, d):
    s = V.tokens(spark, d).groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "mask"))), lambda x: x["mask"]).alias("mask"))
    v = s.select("sequence", S.placed_at_end(F.lit(1.5), F.size("mask"), F.col("mask")).alias("v"))
    return v.select("sequence", F.size("v").alias("n"), F.nullif(F.array_position("v", F.lit(1.5)) - 1, F.lit(-1)).alias("at"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("f24_first_sentence", r"SELECT doc_id, left(trim(regexp_extract(trim(text, chr(10) || chr(9) || ' '), '(?s)^(.*?)(?:([.!?])\s|\n|$)', 1) || regexp_extract(trim(text, chr(10) || chr(9) || ' '), '(?s)^(.*?)(?:([.!?])\s|\n|$)', 2)), 500) AS first FROM documents")
def f24(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.first_sentence(F.regexp_replace("text", r"^[\n\t ]+|[\n\t ]+$", "")).alias("first"))


@query("f41_split_answer", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text || ' ' ELSE text END AS reasoning, CASE doc_id % 3 WHEN 0 THEN 'so ' || doc_id WHEN 1 THEN 'open ' || doc_id ELSE '' END AS answer FROM documents")
def f41(spark, d):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    said = F.when(k == 0, F.concat("text", F.lit(" <answer>so "), i, F.lit("</answer> end"))).when(k == 1, F.concat("text", F.lit(" <answer>open "), i)).otherwise(F.col("text"))
    a, b = X.split_answer(said)
    return V.table(spark, d, "documents").select("doc_id", a.alias("reasoning"), b.alias("answer"))


@query("f46_coerced", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name END AS first, CASE WHEN p_partkey % 3 = 2 THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def f46_f50(spark, d):
    k = F.col("p_partkey") % 3
    listed = F.when(k == 0, F.to_json(F.array(F.col("p_size").cast("string"), F.col("p_name")))).when(k == 1, F.col("p_name"))
    mapped = F.when(k == 2, F.concat(F.lit("["), F.to_json(F.struct(F.col("p_size").cast("string").alias("size"))), F.lit("]"))).otherwise(F.col("p_name"))
    x = S.as_list(listed)
    return V.table(spark, d, "part").select("p_partkey", F.size(x).alias("n"), F.get(x, F.lit(0)).alias("first"), F.try_element_at(S.as_map(mapped), F.lit("size")).alias("size"))


@query("f47_constraint_parts", "SELECT p_partkey, 2 AS n_terms, p_size AS least, p_size + 9 AS most, 'length' AS kind FROM part")
def f47(spark, d):
    n = F.col("p_size").cast("string")
    t = F.concat(F.lit('Use "'), "p_name", F.lit('", "x" and "X" in at least '), n, F.lit(" and at most "), (F.col("p_size") + 9).cast("string"), F.lit(" words"))
    own = S.limits(t)
    return V.table(spark, d, "part").select("p_partkey", F.size(S.quoted(t)).alias("n_terms"), own["least"].alias("least"), own["most"].alias("most"), S.constraint_kind(t).alias("kind"))


@query("f48_labels", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN split_part('DRI,DAI,OTHER', ',', (p_partkey % 4 + 1)::INT) END AS label, left(repeat(p_name, 40), 400) AS reason FROM part")
def f48(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("dri", "DAI", " other ", "none")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    said = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(name.alias("label"), F.repeat("p_name", F.lit(40)).alias("reason"))), F.lit("\n```"))
    x = S.label(said, ["DRI", "DAI", "OTHER"])
    return V.table(spark, d, "part").select("p_partkey", x["label"].alias("label"), x["reason"].alias("reason"))


@query("f49_json_in_text", "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def f49_x09(spark, d):
    k, j = F.col("p_partkey") % 5, F.to_json(F.struct("p_size", "p_name"))
    said = F.when(k == 0, j).when(k == 1, F.concat(F.lit("as asked:\n```json\n"), j, F.lit("\n```\nbye"))).when(k == 2, F.concat(F.lit("it is "), j, F.lit(" there"))).when(k == 3, F.concat(F.lit("  "), j, F.lit("\n"))).otherwise(F.concat(F.lit("{broken "), j))
    return V.table(spark, d, "part").select("p_partkey", F.get_json_object(S.json_block(said), "$.p_size").alias("size"))


@query("r09_free_constraints", "SELECT doc_id, doc_id % 4 AS k, CASE doc_id % 4 WHEN 0 THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 200 WHEN 1 THEN contains(lower(text), 'the') WHEN 2 THEN NOT contains(lower(text), 'token') ELSE starts_with(lower(text), 'a') END AS kept FROM documents")
def r08_r09(spark, d):
    asked = F.element_at(F.array(*[F.lit(x) for x in ("Write at least 200 words.", 'Mention "the" somewhere.', 'Do not say "Token" at all.', 'Start with "A".')]), (F.col("doc_id") % 4 + 1).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("k"), S.satisfied(asked, F.col("text")).alias("kept"))


@query("r10_constraint_lists", "SELECT source, k AS place, 'n' || k AS name, 'every' AS description FROM (SELECT DISTINCT source FROM documents), range(3) t(k)")
def r10(spark, d):
    c = S.constraint_columns(F.array(*[F.lit(f"n{k}") for k in range(3)]), F.array(F.lit("every")), F.array().cast("array<string>"))
    rows = V.table(spark, d, "documents").select("source").distinct().select("source", F.posexplode(c).alias("place", "c"))
    return rows.select("source", "place", "c.name", "c.description")


@query("r11_first_violation", "SELECT sequence, min(t) FILTER (NOT mask) - 1 AS step, CASE floor((min(t) FILTER (NOT mask) - 1) * 3.0 / count(*)) WHEN 0 THEN 'early' WHEN 1 THEN 'middle' WHEN 2 THEN 'late' END AS phase FROM v_tokens GROUP BY sequence")
def r11(spark, d):
    s = V.tokens(spark, d).groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "mask"))), lambda x: x["mask"]).alias("v"))
    return s.select("sequence", S.first_violation(F.col("v")).alias("x")).select("sequence", "x.step", "x.phase")


@query("r12_joint_scores", "SELECT run_name, round(avg(acc::INT), 6) AS acc, round(avg((NOT bypass)::INT), 6) AS strict, round(avg((acc AND NOT bypass)::INT), 6) AS joint FROM v_rollouts GROUP BY run_name")
def r12(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    return V.rollouts(spark, d).groupBy("run_name").agg(share(F.col("acc")).alias("acc"), share(~F.col("bypass")).alias("strict"), share(F.col("acc") & ~F.col("bypass")).alias("joint"))


@query("x05_char_count", "SELECT p_partkey, len(p_name) - len(replace(p_name, 'a', '')) AS n, 1.0::DOUBLE AS score FROM part")
def x05(spark, d):
    n = F.length("p_name") - F.length(F.replace("p_name", F.lit("a"), F.lit("")))
    said = F.concat(F.lit("counted: \\boxed{"), n.cast("string"), F.lit("}"))
    return V.table(spark, d, "part").select("p_partkey", n.alias("n"), S.math_score(said, n.cast("string")).alias("score"))


@query("x10_point_reward", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.2 ELSE 0.0 END AS reward FROM part")
def x10(spark, d):
    k = F.col("p_partkey") % 4
    points = F.when(k == 0, "[[5, 5]]").when(k == 1, "[[50, 5], [1, 2]]").when(k == 2, "[[1, 1], [2, 2], [3, 3]]").otherwise("click here")
    return V.table(spark, d, "part").select("p_partkey", S.point_reward(points, F.array(*[F.lit(float(x)) for x in (0, 0, 10, 10)])).alias("reward"))


@query("x11_tagged_messages", "SELECT p_partkey, place, role, content FROM (SELECT p_partkey, unnest([{'place': 0, 'role': 'assistant', 'content': 'think ' || p_name}, {'place': 1, 'role': 'assistant', 'content': 'print(' || p_size || ')'}, {'place': 2, 'role': 'tool', 'content': CAST(p_size AS VARCHAR)}, {'place': 3, 'role': 'assistant', 'content': 'it is' || chr(10) || p_size}], recursive := true) FROM part)")
def x11(spark, d):
    n = F.col("p_size").cast("string")
    said = F.concat(F.lit("think "), "p_name", F.lit(" <code>print("), n, F.lit(")</code>\n<interpreter>"), n, F.lit("</interpreter> <answer>it is\n"), n, F.lit("</answer>"))
    rows = V.table(spark, d, "part").select("p_partkey", F.posexplode(S.tagged_messages(said)).alias("place", "m"))
    return rows.select("p_partkey", "place", "m.role", "m.content")
