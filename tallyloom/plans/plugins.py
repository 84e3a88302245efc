"""Queries on growing logs, generators that are table functions, tolerant JSON and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import tolerant as J
from tallyloom.operators import generators as G
from tallyloom.operators import language as L
from tallyloom.sources import folders, tail
from tallyloom.sources import views as V

from .registry import query

_STEPS = (0, 25, 50, 75, 100)


def _logs(spark, d, path):
    """A log a run, written in two parts: metric dumps, some of them twice, lines that only look like one, and crashes."""
    o = V.table(spark, d, "orders")
    step, value = (F.col("o_orderkey") % 120).cast("string"), (F.col("o_custkey") % 1000 / 1000).cast("string")
    dump = F.concat(F.lit("(worker) step:"), step, F.lit(" - val-core/set"), (F.col("o_custkey") % 3).cast("string"), F.lit("/acc/mean@16:"), value, F.lit(" - val-core/set9/score/best@16/mean:-"), value, F.lit(" - timing:1"))
    other = F.concat(F.lit("step:"), step, F.lit(" val-core/set1/acc/mean@16:0.5"))
    crash = F.concat(F.lit("Traceback: AssertionError at "), F.col("o_orderkey").cast("string"))
    line = F.when(F.col("o_orderkey") % 97 == 0, crash).when(F.col("o_orderkey") % 7 == 0, other).otherwise(dump)
    rows = o.select(F.concat(F.lit("run_"), "o_orderstatus").alias("run"), line.alias("line"), (F.col("o_orderkey") % 2).alias("half"))
    for half in (0, 1):
        rows.where(F.col("half") == half).select("run", "line").write.mode("append").partitionBy("run").text(path)
        yield half


def _followed(spark, d, make, kind):
    """What a stream over the logs gives, started anew from its checkpoint after each part."""
    path = folders.fresh_path(spark, kind)
    for _ in _logs(spark, d, f"{path}/logs"):
        stream = make(tail.tail(spark, f"{path}/logs"))
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _run():
    return F.regexp_extract("path", "run=run_([A-Z])", 1)


@query("s23_log_dumps", """WITH d AS (SELECT o_orderstatus AS run, o_orderkey % 120 AS step, o_custkey % 3 AS k FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 120 IN (0, 25, 50, 75, 100))
    SELECT DISTINCT run, step, 'set' || k AS dataset, 'acc_mean@16' AS metric, 1 AS n FROM d UNION SELECT DISTINCT run, step, 'set9', 'score_best@16', 1 FROM d""")
def s23_t12(spark, d):
    got = _followed(spark, d, lambda lines: tail.metric_dumps(lines, _run(), list(_STEPS)), "dumps")
    return got.groupBy("run", "step", "dataset", "metric").agg(F.count("value").alias("n"))


@query("s23_log_crashes", "SELECT o_orderstatus AS run, 'Traceback: AssertionError at ' || o_orderkey AS line FROM orders WHERE o_orderkey % 97 = 0")
def s23_crashes(spark, d):
    return _followed(spark, d, lambda lines: tail.crashes(lines, _run(), ["AssertionError", "OutOfMemoryError"]), "crashes").select("run", "line")


@query("s23_log_lines", "SELECT o_orderstatus AS run, count(*) AS n FROM orders GROUP BY 1")
def s23_batch(spark, d):
    path = folders.fresh_path(spark, "lines")
    list(_logs(spark, d, path))
    return tail.tail(spark, path, stream=False).groupBy(_run().alias("run")).agg(F.count("*").alias("n"))


@query("d08_first_again", "SELECT conv_id, turn, role, text, false AS generated FROM conversations UNION ALL SELECT conv_id, turn, role, text, true FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def d08(spark, d):
    G.register(spark, "first_again", G.FirstAgain, partition=["conv_id"], order=["turn"])
    return G.generate(V.table(spark, d, "conversations"), "first_again")


class Gaps(G.Generator):
    """An empty row for each number that is missing between two rows of a partition."""

    def __init__(self, number: str):
        self.number, self.last = number, None

    def row(self, row: dict):
        missing = [] if self.last is None else [{self.number: k} for k in range(self.last + 1, row[self.number])]
        self.last = row[self.number]
        return missing


@query("d08_filled_gaps", """SELECT l_orderkey, l_partkey, false AS generated FROM (SELECT DISTINCT l_orderkey % 50 AS l_orderkey, l_partkey FROM lineitem) UNION ALL
    SELECT NULL, unnest(range(p + 1, l_partkey)), true FROM (SELECT l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS p FROM (SELECT DISTINCT l_orderkey % 50 AS l_orderkey, l_partkey FROM lineitem)) WHERE p IS NOT NULL""")
def d08_gaps(spark, d):
    G.register(spark, "filled_gaps", lambda: Gaps("l_partkey"), partition=["l_orderkey"], order=["l_partkey"])
    rows = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("l_orderkey"), "l_partkey").distinct()
    return G.generate(rows, "filled_gaps")


#: One object in several spellings; the last one is cut off.
_SPELLED = (
    '{"a": %d, "b": "%s", "c": [1, 2, 3]}', "{'a': %d, 'b': '%s', 'c': [1, 2, 3,],}", "Sure! ```json\n{a: +%d, b: \"%s\", c: [1 2, 3]}\n``` That's it.", '{"a" %d "b": \'\'\'%s\'\'\', "c": [1,, 2, 3}', 'so {"a": %d, "b": "%s", "c": [1, 2, 3',
)


@query("x09_tolerant_json", "SELECT p_partkey, p_size AS a, p_name || CASE WHEN p_partkey % 5 IN (1, 3) THEN chr(10) ELSE '' END || ' {x' AS b, 3 AS n FROM part")
def x09(spark, d):
    k = (F.col("p_partkey") % len(_SPELLED)).cast("int")
    name = F.concat("p_name", F.when(k.isin(1, 3), "\n").otherwise(""), F.lit(" {x"))
    said = F.element_at(F.array(*[F.format_string(s, "p_size", name) for s in _SPELLED]), k + 1)
    got = J.tolerant_json(V.table(spark, d, "part").select("p_partkey", said.alias("said")), "said", "json")
    return got.select("p_partkey", J.field(F.col("json"), "a").cast("int").alias("a"), J.field(F.col("json"), "b").alias("b"), F.json_array_length(J.field(F.col("json"), "c")).alias("n"))


_GRAMS = r"""t AS (SELECT doc_id, lang, regexp_replace(' ' || regexp_replace(lower(coalesce(text, '')), '\P{L}+', ' ', 'g') || ' ', ' +', ' ', 'g') AS s FROM documents),
    g AS (SELECT doc_id, lang, gram, count(*) AS c FROM (SELECT doc_id, lang, unnest(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substr(s, i, 3))) AS gram FROM t) GROUP BY ALL)"""
_LANGUAGE = f"""WITH {_GRAMS}, k AS (SELECT lang AS language, gram, sum(c) AS c FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
    n AS (SELECT language, ln(0.5 / (sum(c) + 0.5 * (count(*) + 1))) AS base FROM k GROUP BY language),
    p AS (SELECT *, ln(c + 0.5) - ln(0.5) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY c DESC, gram) AS r FROM k) WHERE r <= 2000),
    q AS (SELECT doc_id, gram, c FROM g WHERE regexp_matches(gram, '\\p{{L}}')), z AS (SELECT doc_id, sum(c) AS n FROM q GROUP BY doc_id),
    w AS (SELECT doc_id, language, sum(q.c * weight) AS gain FROM q JOIN p USING (gram) GROUP BY ALL),
    b AS (SELECT doc_id, any_value(z.n) AS n, arg_max(language, coalesce(gain, 0) + z.n * base) AS language FROM z CROSS JOIN n LEFT JOIN w USING (doc_id, language) GROUP BY doc_id)"""


@query("v05_languages", f"{_LANGUAGE} SELECT d.doc_id, d.doc_id % 5 = 0 AS held_out, language, coalesce(n, 0) AS n FROM documents d LEFT JOIN b USING (doc_id)")
def v05_c03(spark, d):
    """Learnt from four fifths of the rows, told of all."""
    docs = V.spread(V.table(spark, d, "documents").select("doc_id", "text", "lang"))
    profile = L.profiles(docs.where("doc_id % 5 <> 0"), "text", "lang")
    return L.languages(docs, "doc_id", "text", profile).withColumn("held_out", F.col("doc_id") % 5 == 0)
