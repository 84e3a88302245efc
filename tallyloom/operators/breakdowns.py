"""Tables of evaluation runs: per step, per prompt, by opening, by constraint and by genuine following."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import majority, rate

# What kind of constraint each family is; others are "other".
MACROS = {
    "length_constraint_checkers": "length",
    "keywords": "lexical",
    "language": "lexical",
    "punctuation": "lexical",
    "change_case": "format",
    "detectable_format": "format",
    "combination": "format",
    "startend": "affix",
}


def over_samples(df: DataFrame, keys: list[str], *, answer: str, acc: str, order: str, gold: str) -> DataFrame:
    """Per prompt: k, pass@1, best@k, maj@k and their distances, entropy of the answers in bits and its share, how many differ.

    maj@k is whether the most frequent answer that isn't empty, the first on ties, is the gold one. A single answer
    has entropy and share 0, no answer too.
    """
    valid = df.withColumn(answer, F.nullif(F.col(answer), F.lit("")))
    first_gold = valid.groupBy(*keys).agg(F.count("*").alias("k"), rate(acc).alias("pass_at_1"), F.max(F.col(acc).cast("double")).alias("best_at_k"), F.min_by(gold, order).alias("_gold"))
    modal = majority(valid, keys, answer=answer, acc=acc, order=order).select(*[F.col(c).alias(f"_{c}") for c in keys], "modal", "entropy", "entropy_share", "n_unique")
    on = [first_gold[c].eqNullSafe(modal[f"_{c}"]) for c in keys]
    maj = F.coalesce((F.col("modal") == F.col("_gold")) & (F.col("_gold") != ""), F.lit(False)).cast("double")
    several = F.col("n_unique") > 1
    return first_gold.join(modal, on).select(
        *keys, "k", "pass_at_1", "best_at_k", maj.alias("maj_at_k"), (F.col("best_at_k") - F.col("pass_at_1")).alias("best_minus_pass"), (maj - F.col("pass_at_1")).alias("maj_minus_pass"),
        F.when(several, F.col("entropy")).otherwise(0.0).alias("answer_entropy"), F.when(several, F.col("entropy_share")).otherwise(0.0).alias("normalized_answer_entropy"), "n_unique",
    )


def instruction_steps(df: DataFrame, keys: list[str], prompt: str, *, score: str, length: str) -> DataFrame:
    """Per step of instruction following: means over prompts of the mean and greatest score, and of scores of 1 or more; the length is a mean over rows."""
    strict = (F.col(score) >= 1).cast("double")
    own = df.groupBy(*keys, prompt).agg(F.avg(score).alias("m"), F.max(score).alias("b"), F.avg(strict).alias("sm"), F.max(strict).alias("sb"), F.count("*").alias("n"), F.sum(length).alias("l"), F.count(length).alias("ln"))
    return own.groupBy(*keys).agg(
        F.count(prompt).alias("n_prompts"), F.sum("n").alias("n_rollouts"), F.avg("m").alias("pass_at_1"), F.avg("b").alias("best_at_n"), F.avg("sm").alias("strict_pass_at_1"), F.avg("sb").alias("strict_best_at_n"),
        F.try_divide(F.sum("l"), F.sum("ln")).alias("mean_len"),
    )


def prompt_support(df: DataFrame, keys: list[str], metrics: dict[str, str]) -> DataFrame:
    """Per prompt and metric: how many samples have it, the mean and best of those that tell, and whether all, some or none have it.

    Nulls don't tell; they keep a prompt from being `all`.
    """
    aggs = [F.count("*").alias("k")]
    for name, column in metrics.items():
        v = F.col(column).cast("double")
        aggs += [F.count_if(v == 1).alias(f"{name}_count"), F.avg(v).alias(f"{name}_pass_at_1"), F.when(F.count(v) > 0, F.coalesce(F.max((v == 1).cast("double")), F.lit(0.0))).alias(f"{name}_best_at_k")]
    own = df.groupBy(*keys).agg(*aggs)
    return own.withColumns({f"{m}_bin": F.when(F.col(f"{m}_count") == F.col("k"), "all").when(F.col(f"{m}_count") == 0, "zero").otherwise("partial") for m in metrics})


def by_mode(df: DataFrame, keys: list[str], mode: str, metrics: dict[str, str]) -> DataFrame:
    """Per group and opening: rows, their share of the group's, and means of what is known."""
    own = df.groupBy(*keys, mode).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(m) for m, c in metrics.items()])
    return own.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def constraints(df: DataFrame, per: str, *kept: str, other: str | None = None) -> DataFrame:
    """One row a supported constraint: family, instruction, macro and passed (1 or 0), with what the constraint of the same place in `other` says."""
    place = F.posexplode(per).alias("_i", "_c")
    rows = df.select(*kept, *([other] if other else []), place).where(F.coalesce(F.col("_c.supported"), F.lit(False)))
    macro = F.coalesce(F.create_map(*[F.lit(x) for x in chain(*MACROS.items())])[F.col("_c.family")], F.lit("other"))
    said = [F.coalesce(F.get(F.col(other), F.col("_i"))["passed"], F.lit(False)).cast("int").alias("other_passed")] if other else []
    return rows.select(*kept, F.col("_c.family").alias("family"), F.col("_c.name").alias("instruction"), macro.alias("macro"), F.coalesce(F.col("_c.passed"), F.lit(False)).cast("int").alias("passed"), *said)


def constraint_rates(rows: DataFrame, model: str, *, acc: str, length: str) -> DataFrame:
    """Rates by macro, by family and by instruction, each of them by model; what the level is stands in `level`."""
    tables = []
    for level in ("macro", "family", "instruction"):
        tables.append(rows.groupBy(F.lit(level).alias("level"), F.col(level).alias("name"), model).agg(F.count("*").alias("n"), F.avg("passed").alias("if_acc"), rate(acc).alias("s_acc"), F.avg(length).alias("len_words")))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def genuine(df: DataFrame, *, reasoning: str, response: str, bypass: str, acc: str) -> DataFrame:
    """Add whether a row follows in its reasoning, in its response, genuinely (in its reasoning, not bypassing it), and is right as well. Nulls are no."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    true = yes(reasoning) & ~yes(bypass)
    return df.withColumns({"_raw": yes(reasoning).cast("int"), "_response": yes(response).cast("int"), "_bypass": yes(bypass).cast("int"), "_genuine": true.cast("int"), "_joint": (true & yes(acc)).cast("int"), "_acc": yes(acc).cast("int")})


def genuine_rates(rows: DataFrame, keys: list[Column], length: str) -> DataFrame:
    """Rates of genuine() rows by any keys, and by how much responses follow more often than reasoning does."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_acc").alias("acc"), F.avg("_raw").alias("reasoning_follow_raw"), F.avg("_bypass").alias("bypass_rate"), F.avg("_genuine").alias("reasoning_follow_genuine"),
        F.avg("_joint").alias("joint_reason_correct"), F.avg("_response").alias("response_follow_strict"), (F.avg("_response") - F.avg("_raw")).alias("shortcut_gap"), F.avg(length).alias("mean_words"),
    )


def checkpoint_summary(df: DataFrame, keys: list[str], prompt: str, *, acc: str, pred: str, length: str, limit: int) -> DataFrame:
    """Means over prompts: pass@1, best@n, length, share of answers that weren't found and of responses three times the limit or longer."""
    own = df.groupBy(*keys, prompt).agg(rate(acc).alias("p"), F.max(F.col(acc).cast("double")).alias("b"), F.avg(length).alias("l"), F.avg(F.col(pred).isNull().cast("double")).alias("i"), F.avg((F.col(length) >= 3 * limit).cast("double")).alias("t"), F.count("*").alias("n"))
    return own.groupBy(*keys).agg(F.count("*").alias("n_prompts"), F.sum("n").alias("n"), F.avg("p").alias("pass_at_1"), F.avg("b").alias("best_at_n"), F.avg("l").alias("mean_len"), F.avg("i").alias("invalid_frac"), F.avg("t").alias("truncated_frac"))


def sweep(df: DataFrame, keys: list[str], prompt: str, *, acc: str, mode: str, length: str, modes: tuple[str, ...] = ("DRI", "DAI", "CSI", "Other")) -> DataFrame:
    """Per condition: mean over prompts of their best sample, mean over rows, shares of the openings and the mean length."""
    own = df.groupBy(*keys, prompt).agg(
        F.count("*").alias("n"), F.max(F.col(acc).cast("double")).alias("b"), F.sum(F.col(acc).cast("double")).alias("a"), F.count(acc).alias("an"), F.sum(length).alias("l"), F.count(length).alias("ln"),
        F.count(mode).alias("mn"), *[F.count_if(F.col(mode) == m).alias(f"m_{m}") for m in modes],
    )
    return own.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count(prompt).alias("n_prompts"), F.avg("b").alias("best_at_n"), F.try_divide(F.sum("a"), F.sum("an")).alias("avg_at_n"),
        *[F.try_divide(F.sum(f"m_{m}").cast("double"), F.sum("mn")).alias(f"{m.lower()}_rate") for m in modes], F.try_divide(F.sum("l"), F.sum("ln")).alias("mean_len"),
    )


def bucket_summary(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows, and mean and exact median of each value by bucket."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_tokens"), *[x for name, c in values.items() for x in (F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}"))])


def scoped_summary(df: DataFrame, scopes: dict[str, Column], means: list[str], medians: list[str], keys: list[str]) -> DataFrame:
    """Means, medians and counts for overlapping scopes; a row counts in each scope that holds it, and is read once."""
    inside = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in scopes.items()]))
    rows = df.withColumn("scope", F.explode(inside))
    return rows.groupBy(*keys, "scope").agg(F.count("*").alias("n_rows"), *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in means], *[F.median(m).alias(f"median_{m}") for m in medians])


def trajectory_features(df: DataFrame, keys: list[str], step: str, value: str, steps: list[int], early: tuple[int, int], *, over: float) -> DataFrame:
    """Per run: values at given steps, slope and trapezoid mean between two early ones, its signed logarithm, the steps there are, and the first over a threshold.

    What needs a step that isn't there is null; a slope of 0 has no logarithm.
    """
    at = lambda s: F.max(F.when(F.col(step) == s, F.col(value)))
    a, b = early
    own = df.groupBy(*keys).agg(
        *[at(s).alias(f"at_{s}") for s in steps], at(a).alias("_a"), at(b).alias("_b"), F.array_join(F.transform(F.sort_array(F.collect_set(step)), lambda s: s.cast("string")), ",").alias("steps_available"),
        F.count_distinct(step).alias("n_steps"), F.min(F.when(F.col(value) > over, F.col(step))).alias("first_over"),
    )
    slope = (F.col("_b") - F.col("_a")) / (b - a)
    return own.withColumns({"early_slope": slope, "log_early_slope": F.when(slope != 0, F.sign(slope) * F.log10(F.abs(slope))), "early_mean": (F.col("_a") + F.col("_b")) / 2}).drop("_a", "_b")
