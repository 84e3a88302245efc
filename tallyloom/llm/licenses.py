"""Licences named or quoted in texts, by ordered signature rules.

Stems tell at once which texts can hold a licence at all; only there words are parted.
A rule is tried where its keyword stands. Of detections that lie within another one's
words, those that rank below it are dropped. All of it are native expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, table
from .license_rules import rules
from .quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: One of these, or of the short ones as a word's beginning, is in every text that a rule or phrase can match.
STEMS = (
    "licen", "gpl", "granted", "redistribut", "public", "software", "advertising", "contributors", "misrepresented", "copyright", "verbatim", "retain", "reserved",
    "reproduced", "apache", "gfdl", "bsd", "creative", "expat", "attribution",
)
SHORT = ("cc", "mpl", "epl", "asl", "al2", "x11")
#: Fixed phrases and their labels.
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
#: Patterns see this many words from their keyword on.
SPAN = 40
#: How sure a detection is, by its priority; a name after "under" gains on one alone; fixed phrases by themselves.
SURE, UNDER, PHRASE = (0.4, 0.7, 0.9, 1.0), 0.05, 0.5
DETECTION = "array<struct<start:int,stop:int,label:string,priority:int,rule:int>>"


def may_hold(text: Column) -> Column:
    low = F.lower(text)
    stems = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in STEMS])
    return stems | low.rlike(f"(?<![a-z0-9])(?:{'|'.join(SHORT)})")


def indexes(words: Column) -> Column:
    """0 to n - 1; nothing for no words."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def phrase_starts(words: Column) -> Column:
    """By label where each fixed phrase starts; phrases are looked at where their last word stands."""
    lasts = list({p[-1] for p in PHRASES.values()})
    ends = F.filter(indexes(words), lambda i: F.get(words, i).isin(lasts))

    def starts(at: Column, phrase: tuple[str, ...]) -> Column:
        n = len(phrase) - 1
        fits = lambda i: reduce(lambda a, b: a & b, [F.get(words, i - n + k) == w for k, w in enumerate(phrase)])
        return F.transform(F.filter(at, fits), lambda i: i - n)

    return let(ends, lambda at: F.struct(*[starts(at, p).alias(label) for label, p in PHRASES.items()]))


def table_of_rules() -> tuple[Column, list[str]]:
    """keyword -> its rules, as a literal, and the keywords."""
    by: dict[str, list[Column]] = {}
    for k, (keyword, label, priority, pattern) in enumerate(rules()):
        by.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(k).alias("rule"), F.lit(pattern).alias("pattern")))
    return F.create_map(*[x for keyword, own in by.items() for x in (F.lit(keyword), F.array(*own))]), list(by)


def outranks(a: Column, b: Column) -> Column:
    """Whether a's words hold b's and a goes first: by priority, then length, then the rules' order."""
    longer, same = a["stop"] - a["start"] > b["stop"] - b["start"], (a["stop"] == b["stop"]) & (a["start"] == b["start"])
    holds = (a["start"] <= b["start"]) & (a["stop"] >= b["stop"])
    return holds & ((a["priority"] > b["priority"]) | ((a["priority"] == b["priority"]) & (longer | (same & (a["rule"] < b["rule"])))))


def detections(words: Column) -> Column:
    """What the rules find, without what lies within something that ranks above it; by start.

    Of one start at most one detection a priority is left after a first look, and matches span SPAN words at
    most: so those that may hold another one stand within a fixed number of places before and after it, and the
    time is in proportion to the text.
    """
    literal, keywords = table_of_rules()

    def at(i: Column) -> Column:
        context = F.array_join(F.slice(words, i + 1, SPAN), " ")

        def tried(text: Column) -> Column:
            def one(r: Column) -> Column:
                n = F.size(F.split(F.call_function("regexp_extract", text, r["pattern"], F.lit(0)), " "))
                return F.struct(i.alias("start"), (i + n).alias("stop"), r["label"].alias("label"), r["priority"].alias("priority"), r["rule"].alias("rule"))

            own = F.filter(F.element_at(literal, F.get(words, i)), lambda r: F.call_function("rlike", text, r["pattern"]))
            return let(F.transform(own, one), lambda x: F.filter(x, lambda d: ~F.exists(x, lambda o: outranks(o, d))))

        return let(context, tried)

    anchors = F.filter(indexes(words), lambda i: F.get(words, i).isin(keywords))
    reach = SPAN * len(SURE)
    near = lambda x, k: F.slice(x, F.greatest(k - reach, F.lit(0)) + 1, reach + len(SURE) + 1)
    return let(F.flatten(F.transform(anchors, at)).cast(DETECTION), lambda x: F.filter(x, lambda d, k: ~F.exists(near(x, k), lambda o: outranks(o, d))))


def sureness(words: Column, found: Column) -> Column:
    under = lambda d: F.when((d["priority"] < 3) & F.array_contains(F.slice(words, F.greatest(d["start"] - 5, F.lit(1)), F.least(d["start"], F.lit(6))), "under"), UNDER).otherwise(0.0)
    return F.array_max(F.transform(found, lambda d: F.element_at(F.array(*[F.lit(s) for s in SURE]), d["priority"] + 1) + under(d)))


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, phrases (starts by label), detections, base_labels, labels and score; the text goes.

    A null or empty text has no words, no labels and score 0. Long texts count whole, repeated rows fare alike, no
    rows give none; columns of the names added are replaced, others stay. Detections over the same words go by
    priority, then the rules' order.
    """
    names = ["n_words", "phrases", "detections", "base_labels", "labels", "score"]
    kept = [c for c in apart(docs, names) if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    parted = F.when(may_hold(t), F.array_remove(F.split(F.translate(t, UPPER, LOWER), PARTS), "")).otherwise(F.array().cast("array<string>"))
    split = docs.select(*kept, F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"), parted.alias("_words"))
    found = split.select(*kept, "n_words", "_words", phrase_starts(F.col("_words")).alias("phrases"), detections(F.col("_words")).alias("detections"))
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"phrases.{x}")) > 0, F.lit(x)) for x in PHRASES]))
    told = found.withColumn("base_labels", F.array_sort(base)).withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"])))))
    phrase = F.when(F.size("base_labels") > 0, PHRASE).otherwise(0.0)
    return told.withColumn("score", F.greatest(phrase, F.coalesce(sureness(F.col("_words"), F.col("detections")), F.lit(0.0)))).select(*kept, *names)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    starts = F.concat(*[F.col(f"phrases.{x}") for x in PHRASES])
    joined = lambda c: F.array_join(c, ",").alias(c)
    first, last = F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word")
    return found.select("doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), first, last, joined("base_labels"), joined("labels"), "score", F.to_json("detections").alias("detections"))
