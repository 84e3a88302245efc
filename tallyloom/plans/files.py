"""Readers and sinks as queries: tables are written to the shared folder in the files' formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.sources import folders
from tallyloom.sources import records as R
from tallyloom.sources import views as V

from .registry import query

CONVERSATION = "conv_id bigint, turn bigint, role string, text string"
DOCUMENT = "doc_id bigint, text string, lang string, source string"


def _conversations(spark, d):
    return V.table(spark, d, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")


@query("s01_jsonl_strict", "SELECT conv_id, turn, role, text FROM conversations")
def s01_s03(spark, d):
    path = folders.fresh_path(spark, "lines") + ".jsonl"
    assert R.write_jsonl(_conversations(spark, d), path) >= 0
    return R.read_records(spark, path, CONVERSATION)


@query("s02_jsonl_tolerant", "SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 3")
def s02(spark, d):
    path = folders.fresh_path(spark, "lines")
    line = F.to_json(F.struct("doc_id", "text", "lang", "source"))
    docs = V.table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value"))
    docs.write.text(path)
    return R.read_jsonl_tolerant(spark, path, DOCUMENT).select("doc_id", "lang", "source")


@query("s04_append_log", "SELECT doc_id, quality FROM labels")
def s04(spark, d):
    path, labels = folders.fresh_path(spark, "log"), V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long"))
    for rows in (labels.where("quality = 1"), labels.where("quality <> 1 OR quality IS NULL")):
        R.write_jsonl(rows, path, append=True)
    return R.read_jsonl(spark, path, "doc_id bigint, quality bigint")


@query("s05_atomic_json", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s05(spark, d):
    path = folders.fresh_path(spark, "summary") + ".json"
    R.write_json(spark, path, {"records": []})
    counts = V.table(spark, d, "documents").groupBy("lang").count().collect()  # a row a language
    R.write_json(spark, path, {"records": [{"lang": r.lang, "n": r["count"]} for r in counts]})
    return R.read_records(spark, path, "lang string, n bigint")


@query("s06_resume", "SELECT doc_id, s AS sample_id FROM documents, range(2) t(s) WHERE NOT (doc_id % 4 = 1 AND s = 1)")
def s06_t13(spark, d):
    path = folders.fresh_path(spark, "sink")
    jobs = V.table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("sample_id"))
    done = jobs.where("doc_id % 4 = 1 AND sample_id = 1")
    R.write_jsonl(done.unionByName(spark.createDataFrame([(None, 0)], "doc_id bigint, sample_id bigint")), path, append=True)
    return R.undone(jobs, R.read_jsonl(spark, path, "doc_id bigint, sample_id bigint"), ["doc_id", "sample_id"])


@query("s08_fallback_sources", "SELECT item_id, text FROM benchmark")
def s08_s12(spark, d):
    base = folders.fresh_path(spark, "sources")
    R.write_jsonl(V.table(spark, d, "benchmark").select("item_id", "text"), f"{base}/processed/benchmark.jsonl")
    return R.read_first(spark, [f"{base}/raw.parquet", f"{base}/raw.json", f"{base}/processed/benchmark.jsonl"], V.table(spark, d, "benchmark").select("item_id", "text").schema)


@query("s09_read_by_suffix", "SELECT kind, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('tsv'), ('jsonl'), ('json'), ('parquet')) k(kind)")
def s07_s09(spark, d):
    nations = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name")
    base, out = folders.fresh_path(spark, "kinds"), None
    for kind in ("csv", "tsv", "jsonl", "json", "parquet"):
        path = f"{base}/nation.{kind}"
        if kind in ("csv", "tsv"):
            nations.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
        elif kind == "json":
            R.write_json(spark, path, {"examples": [r.asDict() for r in nations.collect()]})
        elif kind == "jsonl":
            R.write_jsonl(nations, path)
        else:
            nations.write.parquet(path)
        rows = R.read_records(spark, path, "n_nationkey bigint, n_name string").select(F.lit(kind).alias("kind"), "n_nationkey", "n_name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s10_concatenated_objects", "SELECT printf('reasonif_%04d', row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) AS id, p_partkey, p_name, p_size FROM part")
def s10(spark, d):
    """A file a size, each of objects that follow each other."""
    path = folders.fresh_path(spark, "objects")
    parts = V.table(spark, d, "part").select("p_size", "p_partkey", "p_name")
    R.write_concatenated(parts, path, "p_size", "p_partkey")
    return R.read_concatenated(spark, f"{path}/*/part-*", "p_partkey bigint, p_name string, p_size bigint")


MARKER = "building"
ROLLOUT = "prompt string, acc boolean, score double, sample_id bigint"
_LINES = "SELECT run_name, checkpoint_step AS step, 'prompt ' || (prompt_id % 50) || CASE WHEN prompt_id % 2 = 0 THEN ' building' ELSE '' END AS prompt, acc, score, sample_id FROM v_rollouts"
_FILES = f"SELECT * FROM ({_LINES}) WHERE run_name = 'F'"
_written: dict[tuple[str, str], str] = {}


def _runs(spark, d):
    """Step files of all runs, a folder a run, with a file of another name among them; lines are about a kilobyte long, and files compressed. A session writes them once."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        path = folders.fresh_path(spark, "runs")
        p = F.concat(F.lit("prompt "), (F.col("prompt_id") % 50).cast("string"), F.when(F.col("prompt_id") % 2 == 0, f" {MARKER}").otherwise(""))
        response = F.repeat(F.md5(F.concat_ws("-", "prompt_id", "sample_id")), 30)
        rows = V.rollouts(spark, d).select("run_name", F.col("checkpoint_step").alias("step"), "prompt_id", "acc", F.col("score").cast("double"), "sample_id")
        # sorted as the sink wants it before rows are a kilobyte long
        rows = rows.sortWithinPartitions("run_name", "step").select("run_name", "step", p.alias("prompt"), "acc", "score", "sample_id", response.alias("response"))
        R.write_steps(rows, path, "step", run="run_name", compression="gzip")
        folders.write_text(spark, f"{path}/F/notes.jsonl", "not a step file\n")
        _written[key] = path
    return {run: f"{_written[key]}/{run}" for run in ("F", "O", "P")}


def _steps(spark, d):
    return _runs(spark, d)["F"]


def _all_files(spark, d):
    return [p for path in _runs(spark, d).values() for _, p in R.step_files(spark, path)]


@query("s13_light_index", f"SELECT step || '.jsonl' AS file, CASE WHEN contains(prompt, '{MARKER}') THEN 'aime' ELSE 'ifeval' END AS benchmark, count(*) AS rows, -1 AS unique_prompts, -1.0::DOUBLE AS samples_per_prompt FROM ({_LINES}) GROUP BY ALL")
def s13_s15_p01(spark, d):
    return R.light_index(spark, _all_files(spark, d), MARKER)


@query("s14_full_index", f"SELECT step || '.jsonl' AS file, CASE WHEN contains(prompt, '{MARKER}') THEN 'aime' ELSE 'ifeval' END AS benchmark, count(*) AS rows, count(DISTINCT prompt) AS unique_prompts, round(count(*)::DOUBLE / count(DISTINCT prompt), 2) AS samples_per_prompt FROM ({_LINES}) GROUP BY ALL")
def s14(spark, d):
    return R.full_index(spark, _all_files(spark, d), MARKER, ROLLOUT, "prompt")


@query("s17_load_run", f"SELECT step, prompt, acc, round(score, 6) AS score, sample_id FROM ({_FILES}) WHERE step IN (1994, 1996)")
def s16_s17(spark, d):
    return R.load_run(spark, {"F": _steps(spark, d)}, "F", ROLLOUT, steps=[1994, 1996])


@query("s18_shards", "SELECT doc_id, 'math' || CASE WHEN lang = 'en' THEN '__shard0.parquet' ELSE '__shard1.parquet' END AS shard FROM documents")
def s18(spark, d):
    base, docs = folders.fresh_path(spark, "shards"), V.table(spark, d, "documents").select("doc_id", "lang")
    for k, rows in enumerate((docs.where("lang = 'en'"), docs.where("lang <> 'en' OR lang IS NULL"))):
        rows.write.parquet(f"{base}/math__shard{k}.parquet")
    folder = F.element_at(F.split("path", "/"), -2)
    return spark.read.parquet(*folders.listed(spark, f"{base}/math__shard*.parquet")).select("doc_id", F.col("_metadata.file_path").alias("path")).select("doc_id", folder.alias("shard"))


@query("s19_kept_result", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def s19_t15(spark, d):
    path = folders.fresh_path(spark, "kept")
    make = lambda: V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    R.kept_table(spark, path, make)
    return R.kept_table(spark, path, lambda: spark.createDataFrame([], "source string, n bigint, chars bigint"))


@query("s21_csv_union", "SELECT 's' || s_suppkey AS model_id, round(s_acctbal, 6) AS a, NULL::DOUBLE AS b FROM supplier UNION ALL SELECT 'c' || c_custkey, NULL, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal, 6) END FROM customer")
def s20_s21(spark, d):
    path = folders.fresh_path(spark, "summary")
    s = V.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("model_id"), F.col("s_acctbal").cast("string").alias("a"))
    c = V.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("model_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("b"))
    R.write_csv_union([s, c], path, ["model_id"])
    return R.read_csv_numbers(spark, path, ["model_id"])


@query("s22_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'old' ELSE 'new' END AS origin, CASE WHEN doc_id % 3 > 0 THEN n_chars ELSE n_chars + 1 END AS mean FROM documents")
def s22(spark, d):
    docs = V.table(spark, d, "documents")
    old = docs.select("doc_id", F.lit("old").alias("origin"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars").cast("long")).alias("mean"))
    new = docs.select("doc_id", F.lit("new").alias("origin"), (F.col("n_chars").cast("long") + 1).alias("mean"))
    return R.upsert(old, new, ["doc_id"], "mean")


@query("s25_nested_paths", "SELECT conv_id, role, text FROM conversations WHERE turn = 0")
def s25(spark, d):
    rows = V.table(spark, d, "conversations").where("turn = 0").select("conv_id", F.array(F.struct(F.struct("role", "text").alias("message"))).alias("extra"))
    return rows.select("conv_id", R.nested(rows, "extra", ["message", "role"]).alias("role"), R.nested(rows, "extra", ["message", "text"]).alias("text"))


@query("s27_multi_turn", "SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def s27(spark, d):
    path = folders.fresh_path(spark, "turns") + ".parquet"
    V.messages(spark, d).write.parquet(path)
    m = R.read_records(spark, path, "conv_id bigint, messages array<struct<role:string,content:string>>")
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, x: n + F.length(x["content"]))
    return m.select("conv_id", F.size("messages").alias("n_messages"), chars.alias("chars"), F.element_at("messages", -1)["role"].alias("last_role"))


@query("s28_dump_steps", "SELECT checkpoint_step AS step, count(*) AS n, count(pred) AS n_pred FROM v_rollouts GROUP BY checkpoint_step")
def s28(spark, d):
    path = folders.fresh_path(spark, "dump")
    R.write_steps(V.rollouts(spark, d).select(F.col("checkpoint_step").alias("step"), "prompt_id", "pred", "score"), path, "step")
    rows = R.load_run(spark, {"dump": path}, "dump", "prompt_id bigint, pred string, score double")
    return rows.groupBy("step").agg(F.count("*").alias("n"), F.count("pred").alias("n_pred"))


@query("s32_metric_log", "SELECT checkpoint_step AS step, key, round(CASE key WHEN 'score' THEN s ELSE l END, 6) AS value FROM (SELECT checkpoint_step, avg(score) AS s, avg(length) AS l FROM v_rollouts GROUP BY checkpoint_step), (VALUES ('score'), ('length')) k(key)")
def s32(spark, d):
    path = folders.fresh_path(spark, "metrics")
    m = V.rollouts(spark, d).groupBy(F.col("checkpoint_step").alias("step")).agg(F.avg("score").alias("score"), F.avg("length").alias("length"))
    R.write_jsonl(m.unpivot(["step"], ["score", "length"], "key", "value"), path, append=True)
    return R.read_jsonl(spark, path, "step bigint, key string, value double")


@query("s33_manifest_diff", "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'extra' ELSE 'changed' END AS status FROM documents WHERE doc_id % 5 < 3 AND text IS NOT NULL")
def s33(spark, d):
    docs = V.table(spark, d, "documents").where("text IS NOT NULL").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    listed = docs.where("doc_id % 5 <> 1").select("path", F.sha2("text", 256).alias("sha256"))
    found = docs.where("doc_id % 5 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return R.manifest_diff(listed, found)


@query("s34_leak_scan", r"SELECT doc_id, regexp_matches(text, '(?i)(api_?key|secret|token)\s*[:=]') AS secret, regexp_matches(text, '/(home|Users|root)/[A-Za-z0-9_.-]+') AS private_path, regexp_matches(text, '<<<<<<<|>>>>>>>|TODO|FIXME') AS marker FROM documents")
def s34(spark, d):
    t = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", t.rlike(r"(?i)(api_?key|secret|token)\s*[:=]").alias("secret"), t.rlike("/(home|Users|root)/[A-Za-z0-9_.-]+").alias("private_path"), t.rlike("<<<<<<<|>>>>>>>|TODO|FIXME").alias("marker"))


@query("s35_table_cells", r"SELECT p_partkey, replace(replace(replace(replace(replace(p_name || ' & 5% of #' || p_partkey || '_$', '&', '\&'), '%', '\%'), '_', '\_'), '#', '\#'), '$', '\$') AS cell, CASE WHEN p_partkey % 7 = 0 THEN '--' ELSE printf('%.1f', p_size * 100.0 / 63) || '\%' END AS share FROM part")
def s35(spark, d):
    p = V.table(spark, d, "part")
    name = F.concat("p_name", F.lit(" & 5% of #"), F.col("p_partkey").cast("string"), F.lit("_$"))
    return p.select("p_partkey", R.latex(name).alias("cell"), R.percent(F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 63)).alias("share"))
