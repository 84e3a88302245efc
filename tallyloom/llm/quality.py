"""Quality rules with thresholds that follow the data.

Counts of each text are native expressions. Each (language, source) gets KLL
quantile sketches of a few ratios; sketches merge, so those of a language and of
all rows come from the same ones. Fences around the quantiles are joined to the
rows by language and source and decide: no ratio has a threshold of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SPACE = "[\\x20\\x09-\\x0D]"
#: Ratios as count and what it is a count of.
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_words"), "sign_ratio": ("n_signs", "word_chars"), "capital_ratio": ("n_capitals", "word_chars"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"),
}
QUANTILES = (0.15, 0.5, 0.85)
POSITION_BITS = 20


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes; sorting brings equal ones together, in
    n log n steps for a text of n words. A first sort by 44 bits leaves few of them.
    """
    zero = F.lit(0).cast("long")
    n = F.size(words) - 2
    window = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    few = 1 << POSITION_BITS

    def packed() -> Column:
        """Plain numbers sort fast: the upper bits of the hash, then the position."""
        numbers = F.sort_array(F.transform(window, lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(-few)).bitwiseOR(i.cast("long"))))
        upper = lambda x: F.shiftrightunsigned(x, POSITION_BITS)
        near = lambda s: F.filter(s, lambda x, k: F.coalesce(upper(x) == upper(F.get(s, k - 1)), F.lit(False)) | F.coalesce(upper(x) == upper(F.get(s, k + 1)), F.lit(False)))
        return F.transform(let(numbers, near), lambda x: x.bitwiseAND(F.lit(few - 1)).cast("int"))

    def shared(positions: Column) -> Column:
        """Those of the positions whose windows, compared by their whole hashes, occur twice."""
        own = F.transform(positions, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
        same = lambda s, x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return let(F.sort_array(own), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"])))

    def covered(positions: Column) -> Column:
        start = F.struct(zero.alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(positions, start, step, lambda a: a["n"])

    maybe = F.when(n <= few, packed()).otherwise(F.sequence(F.lit(0), n - 1))
    return F.when(n < 2, zero).otherwise(let(maybe, lambda m: F.when(F.size(m) == 0, zero).otherwise(covered(shared(m)))))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_signs, n_capitals; drop the text.

    A null or empty text has zero of each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_signs", "n_capitals")
    kept = [c for c in docs.columns if c != text and c.lower() not in names]
    split = docs.select(
        *kept,
        F.array_remove(F.split(t, f"{SPACE}+"), "").alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]")).cast("long").alias("n_signs"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    return split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_signs", "n_capitals",
    )


def base_failed(least_words: int = 50, most_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({r: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for r, (a, b) in RATIOS.items()})


def sampling_error(ratio: str, times: float = 4.0) -> Column:
    """How far a text's ratio may be off because it is short: that many standard errors of a count, one more having been seen."""
    m = F.greatest(F.col(RATIOS[ratio][1]), F.lit(1)).cast("double")
    return times * F.sqrt((F.col(ratio) + 1 / m) / m)


def fences(rows: DataFrame, keys: list[str], *, width: float = 4.0, prior_rows: float = 150, k: int = 400) -> DataFrame:
    """One row a group of keys: the least and largest value allowed of each ratio.

    A fence stands `width` times as far from the median as the outer quantile on its side. That of a group
    of n rows is drawn towards the fence of the first key's sketches, merged, and this one towards that of all rows, in the
    proportion of n to prior_rows. Null keys form groups of their own.
    """
    sketches = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in RATIOS])
    merged = lambda over: over.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in RATIOS])
    q = lambda r, p: F.kll_sketch_get_quantile_double(F.col(r), F.lit(p))

    def lines(s: DataFrame, tag: str, by: list[str]) -> DataFrame:
        out = []
        for r in RATIOS:
            low, mid, high = (q(r, p) for p in QUANTILES)
            out += [(mid - width * (mid - low)).alias(f"_low{tag}_{r}"), (mid + width * (high - mid)).alias(f"_high{tag}_{r}")]
        return s.select(*by, (F.col("n") / (F.col("n") + prior_rows)).alias(f"_share{tag}"), *out)

    own, first, all_ = (lines(sketches, "0", keys), lines(merged(sketches.groupBy(keys[0])), "1", keys[:1]), lines(merged(sketches), "2", []))
    first = first.withColumnRenamed(keys[0], "_first")
    joined = own.join(first, own[keys[0]].eqNullSafe(first["_first"]), "left").join(all_, how="left")

    def drawn(side: str, r: str) -> Column:
        a, b, c = (F.col(f"_{side}{t}_{r}") for t in "012")
        return F.col("_share0") * a + (1 - F.col("_share0")) * (F.col("_share1") * b + (1 - F.col("_share1")) * c)

    return joined.select(*keys, F.struct(*[F.struct(*[drawn(side, r).alias(side) for side in ("low", "high")]).alias(r) for r in RATIOS]).alias("_fence"))


def judge(counts: DataFrame, keys: list[str], **settings) -> DataFrame:
    """Add base_failed, kept and failed_ratios to rows of text_counts(), which are written to the shared folder once.

    A ratio fails if it is outside its fence by more than the sampling error of the text's own length.

    Thresholds are learnt from rows that pass the base rules. A group without any
    such row has no fence, and all its rows have failed. An empty table gives an
    empty result. The join is on the keys, which the small side holds once; Spark
    broadcasts it only if it is small, and splits frequent keys otherwise.
    """
    rows = with_ratios(stored(counts, "counts")).withColumn("base_failed", base_failed())
    limits = fences(rows.where(~F.col("base_failed")), keys, **settings)
    renamed = limits.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_fence")
    on = None
    for i, c in enumerate(keys):
        same = rows[c].eqNullSafe(renamed[f"_k{i}"])
        on = same if on is None else on & same
    out = rows.join(renamed, on, "left")
    over = {r: F.col(r) - sampling_error(r) > F.col(f"_fence.{r}.high") for r in RATIOS}
    over["word_length"] |= F.col("word_length") + sampling_error("word_length") < F.col("_fence.word_length.low")
    failed = F.array_compact(F.array(*[F.when(over[r], F.lit(r)) for r in RATIOS]))
    out = out.withColumn("failed_ratios", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_ratios") == 0)).drop("_fence", *[f"_k{i}" for i in range(len(keys))])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_ratios"]
    return judge(text_counts(docs), ["lang", "source"]).select(*names)
