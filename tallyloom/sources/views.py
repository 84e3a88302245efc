"""Views of the plain tables that stand for rollout logs, token tables and responses.

Each is a DataFrame function and, for checks, the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns that order the lines of an order totally.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many parts as there are cores, where a table comes in fewer: for expressions that cost more than a shuffle of a small table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a part of a large table, and of a small one that comes in as many parts as there are cores.
PART_ROWS, LEAST_ROWS = 250_000, 20_000


def parted(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The rows by a key, in parts that are no larger where there are more rows, whatever the session's number of shuffle partitions."""
    return df.repartition(n or parts_of(df), key)


def parts_of(df: DataFrame) -> int:
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism  # of Parquet, counts come from the files' footers
    return max(1, -(-rows // PART_ROWS), min(cores, -(-rows // LEAST_ROWS)))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sampled response: run, step, prompt, sample, acc, score, pred, gold, length, family, bypass."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = parts_of(lines)
    lines, orders = parted(lines, "l_orderkey", n), parted(orders, "o_orderkey", n)
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("run_name"),
        F.year("o_orderdate").cast("long").alias("checkpoint_step"),
        F.col("l_orderkey").alias("prompt_id"),
        (F.row_number().over(w) - 1).cast("long").alias("sample_id"),
        (F.col("l_discount") >= 0.08).alias("acc"),
        (F.col("l_tax") * 12.5).alias("score"),
        F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("a"), (F.col("l_suppkey") % 3).cast("string"))).alias("pred"),
        F.concat(F.lit("a"), (F.col("l_orderkey") % 3).cast("string")).alias("gold"),
        F.col("l_quantity").cast("long").alias("length"),
        F.col("l_returnflag").alias("family"),
        (F.col("l_linestatus") == "O").alias("bypass"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a token: sequence, t from 1, js, logp_a, logp_b, reward, value, mask."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return parted(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("sequence"),
        F.row_number().over(w).cast("long").alias("t"),
        F.col("l_tax").alias("js"),
        (-F.col("l_discount") * 10).alias("logp_a"),
        (-F.col("l_tax") * 10).alias("logp_b"),
        F.col("l_discount").alias("reward"),
        F.col("l_tax").alias("value"),
        (F.col("l_returnflag") != "R").alias("mask"),
    )


def user_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tokens, but with long sequences: one a user, in the order of events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return parted(table(spark, sf_dir, "events"), "user_id").select(F.col("user_id").alias("sequence"), F.row_number().over(w).cast("long").alias("t"), (F.col("value") / 1000).alias("js"), F.col("event_type").alias("mode"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a response text, decorated with answers in several forms; acc is null without a label."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    t, a = F.col("text"), (F.col("doc_id") % 5).cast("string")
    form = F.col("doc_id") % 6
    said = (
        F.when(form == 0, F.concat(F.lit("Step 1: "), t, F.lit(" \\boxed{"), a, F.lit("}")))
        .when(form == 1, F.concat(F.lit("The answer is "), a, F.lit(". "), t))
        .when(form == 2, F.concat(t, F.lit("\nAnswer: "), a))
        .when(form == 3, F.concat(F.lit("[placeholder] "), t))
        .when(form == 4, F.concat(t, F.lit(" #### "), a))
        .otherwise(t)
    )
    w = Window.partitionBy("source").orderBy("doc_id")
    return d.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("prompt_id"), (F.row_number().over(w) - 1).cast("long").alias("sample_id"), (F.col("quality") == 1).alias("acc"),
        (F.col("doc_id") % 7).cast("string").alias("gold"), said.alias("response"),
    )


FAMILIES = ("length_constraint_checkers", "keywords", "language", "punctuation", "change_case", "detectable_format", "combination", "startend", "odd_one")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an evaluated response: model, source, dataset, mode, acc, follow, bypass, length, and constraints judged in reasoning and response."""
    r = rollouts(spark, sf_dir)
    of = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    told = lambda family, k, supported, passed: F.struct(family.alias("family"), F.concat(F.lit("i"), k.cast("string")).alias("name"), supported.alias("supported"), passed.alias("passed"))
    p, s, n = F.col("prompt_id"), F.col("sample_id"), F.col("length")
    reasoning = F.array(told(of(FAMILIES, p), p % 5, n % 7 != 0, F.col("score") >= 0.5), told(of(FAMILIES, p * 3 + s), p % 4, F.lit(True), F.when(n % 5 != 0, F.col("acc"))))
    response = F.array(told(of(FAMILIES, p), p % 5, n % 7 != 0, n % 2 == 0))
    return r.select(
        F.col("run_name").alias("model"), F.col("family").alias("source"), F.when(F.col("checkpoint_step") % 2 == 0, "mathif").otherwise("reasonif").alias("dataset"), "prompt_id", "sample_id", "acc", "score", "length", "bypass", "pred", "gold",
        of(("DRI", "DAI", "CSI", "Other"), n).alias("mode"), F.when(n % 3 != 0, F.col("score") >= 0.5).alias("follow"), F.when(n % 3 != 0, F.col("acc") & (F.col("score") >= 0.5)).alias("joint"), (n % 2 == 0).alias("response_follow"), reasoning.alias("reasoning"), response.alias("response"),
    )


#: Ends of responses with answers in many forms, what is right, and the kind of answer.
CLAIMS = (
    (r" so \boxed{42}.", "42", ""), (r" so \boxed {42}", "42.0", "numeric"), (r" thus \boxed{\frac{3}{7}}", r"\dfrac{3}{7}", ""), (r" \boxed{\$70,000}", "70000", "numeric"), (r" \boxed{1,234,567} or so", "1234567", "numeric"),
    (r" \boxed{18 dollars}", "18", "numeric"), (r" \boxed{25\%}", "25", "numeric"), ("\nANSWER: 7.", "7", "integer_0_999"), ("\n Answer :  x = 5 km  \nand more", "5", ""), ("\nAnswer: 007", "7", "integer_0_999"),
    (". So the answer is 3.5 metres", "3.5 metres", ""), (". The answer is obviously unknown", "unknown", ""), (". The final answer: -12.", "-12", "integer_0_999"), (". Final answer {1,2}", "1,2", ""), (" we get 1/2", "0.5", ""),
    (" it costs 1,234", "234", "numeric"), (r" so $\frac{1}{2}$", r"\frac{1}{2}", ""), (r" so \sqrt{2} it is", r"\sqrt{2}", ""), ("\nAnswer: 12,000", "12000", ""), (r"\nAnswer: \frac12", r"\frac{1}{2}", ""),
    ("\nAnswer: 0.5000001", "0.5", "numeric"), ("\nAnswer: 541", "540", "integer_0_999"), (r" \boxed{\text{ YES } }", "yes", ""), (r" \boxed{}", "", ""), ("\nAnswer: $1_000$", "1000", "numeric"), (" nothing", "4", ""),
)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document whose text ends with one of CLAIMS: response, gold and kind."""
    k = F.col("doc_id") % len(CLAIMS) + 1
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CLAIMS]), k.cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", pick(0)).alias("response"), pick(1).alias("gold"), pick(2).alias("kind"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation: messages, an array of (role, content) in turn order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def top_k(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """One row a token position: ids and logits of the k largest entries for a pair of neighbouring vectors."""

    def largest(c: Column) -> Column:
        ranked = F.array_sort(F.transform(c, lambda x, i: F.struct((-x).cast("double").alias("neg"), i.cast("long").alias("id"))))
        return F.slice(ranked, 1, k)

    v = table(spark, sf_dir, "embeddings").select("vec_id", largest(F.col("embedding")).alias("top"))
    ids, logits = (lambda c: F.transform(c, lambda x: x["id"])), (lambda c: F.transform(c, lambda x: -x["neg"]))
    a = v.select("vec_id", ids("top").alias("ids_b"), logits("top").alias("logits_b"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), ids("top").alias("ids_rl"), logits("top").alias("logits_rl"))
    return a.join(b, "vec_id")


_ORDER = ", ".join(LINE_ORDER)
def _listed(i: int) -> str:
    return "[" + ", ".join("'" + c[i].replace("'", "''") + "'" for c in CLAIMS) + f"][doc_id % {len(CLAIMS)} + 1]"


SQL_VIEWS = {
    "v_claims": f"SELECT doc_id, text || {_listed(0)} AS response, {_listed(1)} AS gold, {_listed(2)} AS kind FROM documents",
    "v_rollouts": f"""SELECT o_orderstatus AS run_name, CAST(year(o_orderdate) AS BIGINT) AS checkpoint_step, l_orderkey AS prompt_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS BIGINT) AS sample_id, l_discount >= 0.08 AS acc, l_tax * 12.5 AS score,
        CASE WHEN l_suppkey % 5 <> 0 THEN 'a' || CAST(l_suppkey % 3 AS VARCHAR) END AS pred, 'a' || CAST(l_orderkey % 3 AS VARCHAR) AS gold,
        CAST(l_quantity AS BIGINT) AS length, l_returnflag AS family, l_linestatus = 'O' AS bypass
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_tokens": f"""SELECT l_orderkey AS sequence, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT) AS t, l_tax AS js,
        -l_discount * 10 AS logp_a, -l_tax * 10 AS logp_b, l_discount AS reward, l_tax AS value, l_returnflag <> 'R' AS mask FROM lineitem""",
    "v_user_tokens": """SELECT user_id AS sequence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS t, value / 1000 AS js, event_type AS mode FROM events""",
    "v_responses": """SELECT d.doc_id, source AS prompt_id, CAST(row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS BIGINT) AS sample_id, quality = 1 AS acc,
        CAST(d.doc_id % 7 AS VARCHAR) AS gold, CASE d.doc_id % 6 WHEN 0 THEN 'Step 1: ' || text || ' \\boxed{' || CAST(d.doc_id % 5 AS VARCHAR) || '}'
        WHEN 1 THEN 'The answer is ' || CAST(d.doc_id % 5 AS VARCHAR) || '. ' || text WHEN 2 THEN text || chr(10) || 'Answer: ' || CAST(d.doc_id % 5 AS VARCHAR)
        WHEN 3 THEN '[placeholder] ' || text WHEN 4 THEN text || ' #### ' || CAST(d.doc_id % 5 AS VARCHAR) ELSE text END AS response
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_evaluations": f"""SELECT run_name AS model, family AS source, CASE WHEN checkpoint_step % 2 = 0 THEN 'mathif' ELSE 'reasonif' END AS dataset, prompt_id, sample_id, acc, score, length, bypass, pred, gold,
        ['DRI', 'DAI', 'CSI', 'Other'][length % 4 + 1] AS mode, CASE WHEN length % 3 <> 0 THEN score >= 0.5 END AS follow, CASE WHEN length % 3 <> 0 THEN acc AND score >= 0.5 END AS joint, length % 2 = 0 AS response_follow,
        [{{'family': {list(FAMILIES)}[prompt_id % 9 + 1], 'name': 'i' || prompt_id % 5, 'supported': length % 7 <> 0, 'passed': score >= 0.5}},
         {{'family': {list(FAMILIES)}[(prompt_id * 3 + sample_id) % 9 + 1], 'name': 'i' || prompt_id % 4, 'supported': true, 'passed': CASE WHEN length % 5 <> 0 THEN acc END}}] AS reasoning,
        [length % 2 = 0] AS response_passed FROM v_rollouts""",
}
