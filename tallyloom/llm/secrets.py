"""Secrets: exact patterns first, then a battery of randomness tests.

Everything is a native expression. Long tokens of digits and letters are tested,
for the encoding they seem to be in, for uniform use of the alphabet and of its kinds of
signs (chi-squared), for runs above and below its middle, and for serial correlation.
The tests' evidence against randomness is added up. How much evidence typed strings of
that encoding and length give is learnt from the corpus itself: the prose of all
documents, written as strings end to end. So a token's p-value is the chance that
something typed looks as random as it does, and Benjamini and Hochberg's procedure, for each
encoding and class of length, bounds the share of typed strings among those
reported. Short strings, which tell little, need more evidence than long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The kinds of secrets, their patterns, the group that is measured and its least length.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("(AKIA[A-Z0-9]+)", 1, 20),
    "hex": ("([0-9a-f]{24,})", 1, 24),
}
GUARDS = {"assign": "(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}

CANDIDATE = "((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2})"
#: Matches of a text whose places are worked out together.
STRETCH = 512
#: A word with a digit. Java is three times as fast with these signs as with \s and \S, which are the same.
NUMBERED = r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r0-9]*+[0-9][^ \t\n\x0B\f\r]*+"
SPAN = "array<struct<kind:string,start:long,stop:long>>"
#: Name, pattern, alphabet in order, size, and how many of its signs are lower case, upper case, digits and others.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 16, (6, 0, 10, 0)),
    ("upper hex", "^[0-9A-F]+$", "0123456789ABCDEF", 16, (0, 6, 10, 0)),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, (0, 26, 6, 0)),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, (26, 26, 10, 2)),
)
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
#: p-values are counted in steps of a tenth of a power of ten, down to this many.
STEPS = 300
#: Classes of length, half powers of two from 20 characters on; longer tokens are held against the last.
SIZES = range(8, 14)
#: Prose that is typed in any corpus: it keeps the typed strings' statistics defined where documents have none.
PROSE = (
    "Whoever keeps a garden learns to wait. Seeds that were sown in March show nothing for weeks, and then one morning the whole bed is green. The old man next door used to say"
    " that patience is a tool like any other: it has to be kept dry and taken out every day. He grew beans along the fence, tall ones with red flowers, and gave away more than he ate."
    " When the summer was wet he complained about snails, and when it was dry about the well, but he never missed an evening outside. We children carried water for him in small cans"
    " and got gooseberries in return. Later I planted some of the same beans behind my own house. They came up crooked, leaned on everything within reach, and bore until October."
    " Reports from the district office list rainfall, yields and prices for every year since the bridge was built, yet nothing in those tables explains why one yard thrives and another fails."
)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def found(text: Column, pattern: str, group: int, least: int, guard: str, kind: str, with_match: bool = False) -> Column:
    """Spans of the matches whose group has the least length, in code points.

    The pieces between matches and the matches themselves add up to the positions:
    first over stretches of STRETCH matches, then within each, so that no list is
    copied more often than it is long in stretches, and the time is nearly linear.
    """
    shape = "array<struct<kind:string,start:long,stop:long,match:string>>" if with_match else SPAN

    def stretch(x: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("at"), F.array().cast(shape).alias("out"))

        def step(a, m):
            start = a["at"] + F.length(m["piece"])
            stop = start + F.length(m["match"])
            own = [F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), *([m["match"].alias("match")] if with_match else [])]
            out = F.when(F.length(m["group"]) >= least, F.concat(a["out"], F.array(F.struct(*own)))).otherwise(a["out"])
            return F.struct(stop.alias("at"), out.alias("out"))

        return F.aggregate(x, first, step, lambda a: a["out"])

    def placed(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRETCH).cast("int")), lambda k: F.slice(x, k * STRETCH + 1, STRETCH))
        length = lambda y: F.aggregate(y, F.lit(0).cast("long"), lambda a, m: a + F.length(m["piece"]) + F.length(m["match"]))
        begins = lambda c: F.aggregate(c, F.array(F.lit(0).cast("long")), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + length(y))))
        several = let(cut, lambda c: let(begins(c), lambda b: F.flatten(F.zip_with(c, F.slice(b, 1, F.size(c)), stretch))))
        return F.when(F.size(x) <= STRETCH, stretch(x, F.lit(0).cast("long"))).otherwise(several)

    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"), F.regexp_extract_all(text, F.lit(pattern), group).alias("group")
    )
    # the last piece has no match after it
    rows = F.filter(zipped, lambda z: z["match"].isNotNull())
    return F.when(text.rlike(guard), let(rows, placed)).otherwise(F.array().cast(shape))


def upper_tail(z: Column) -> Column:
    """Probability beyond z of a standard normal variable, to about 0.3 percent."""
    half = lambda x: 0.5 * F.exp(-0.717 * x - 0.416 * x * x)
    return let(z, lambda x: F.when(x >= 0, half(x)).otherwise(1 - half(-x)))


def chi_tail(chi: Column, degrees: Column | float) -> Column:
    """Probability beyond chi, by Wilson and Hilferty's cube root."""
    spread = 2 / (9 * F.lit(degrees) if isinstance(degrees, float) else 9 * degrees)
    return upper_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / degrees) - (1 - spread)) / F.sqrt(spread))


def evidence(body: Column, alphabet: Column, size: Column, kinds: Column) -> Column:
    """Minus the logarithms of the tests' p-values, added up: small for random strings, large for typed ones."""
    own = F.struct(F.translate(body, "-_", "+/").alias("s"), alphabet.alias("a"), size.cast("double").alias("k"), kinds.alias("g"))  # worked out once, not for each sign
    return let(own, lambda x: tests_of(x["s"], x["a"], x["k"], x["g"]))


def tests_of(s: Column, alphabet: Column, k: Column, kinds: Column) -> Column:
    """The evidence from sums over distinct signs, over neighbours and over halves of the alphabet: each is worked out once a string."""
    chars = F.split(s, "")
    sums = F.struct(F.lit(0.0).alias("squares"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("power"), F.lit(0.0).alias("ones"))

    def signs(x: Column) -> Column:
        """Sums over the distinct signs: of squared counts, of codes, of their squares, and of signs in the upper half."""
        each = F.transform(F.array_distinct(x["chars"]), lambda c: F.struct((x["n"] - F.length(F.replace(s, c, F.lit("")))).alias("c"), F.position(c, alphabet).cast("double").alias("a")))
        step = lambda t, y: F.struct(
            (t["squares"] + y["c"] * y["c"]).alias("squares"), (t["sum"] + y["c"] * y["a"]).alias("sum"), (t["power"] + y["c"] * y["a"] * y["a"]).alias("power"), F.when(y["a"] > k / 2, t["ones"] + y["c"]).otherwise(t["ones"]).alias("ones")
        )
        return F.aggregate(each, sums, step)

    def coarse(n: Column) -> Column:
        """Chi-squared of the kinds of signs and its degrees of freedom."""
        own = F.array(*[n - F.length(F.translate(s, own, "")) for own in GROUPS])
        counts = let(own, lambda c: F.concat(c, F.array(n - c[0] - c[1] - c[2])))
        each = F.filter(F.arrays_zip(counts.alias("c"), F.transform(kinds, lambda g: n * g / k).alias("e")), lambda y: y["e"] > 0)
        return let(each, lambda x: F.struct(F.aggregate(x, F.lit(0.0), lambda a, y: a + (y["c"] - y["e"]) * (y["c"] - y["e"]) / y["e"]).alias("chi"), (F.size(x) - 1).cast("double").alias("degrees")))

    def measured(x: Column) -> Column:
        codes = F.transform(x["chars"], lambda c: F.position(c, alphabet).cast("double"))
        # a sign of the upper half is 1 and one of the lower half 0, so that each change is a 01 or a 10
        half = (k / 2).cast("int")
        up = F.call_function("translate", s, alphabet, F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), half)))
        changes = let(up, lambda u: (2 * F.length(u) - F.length(F.replace(u, F.lit("01"), F.lit(""))) - F.length(F.replace(u, F.lit("10"), F.lit("")))) / 2)
        products = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * b)
        lagged = let(codes, lambda c: F.struct(F.aggregate(products(c), F.lit(0.0), lambda a, y: a + y).alias("products"), (c[0] + F.element_at(c, -1)).alias("ends")))
        return F.struct(x["n"].alias("n"), signs(x).alias("g"), coarse(x["n"]).alias("o"), (changes + 1).alias("runs"), lagged.alias("l"))

    def centred(y: Column) -> Column:
        n, ones, middle = y["n"], y["g"]["ones"], y["g"]["sum"] / y["n"]
        return F.struct(
            (k / n * y["g"]["squares"] - n).alias("chi"), (2 * ones * (n - ones)).alias("both"), (y["g"]["power"] - y["g"]["sum"] * middle).alias("power"),
            (y["l"]["products"] - middle * (2 * y["g"]["sum"] - y["l"]["ends"]) + (n - 1) * middle * middle).alias("lagged"),
        )

    def judged(y: Column, z: Column) -> Column:
        n, both = y["n"], z["both"]
        mean, spread = both / n + 1, F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = F.abs(y["runs"] - mean) / spread
        serial = F.abs(z["lagged"] / F.greatest(z["power"], F.lit(1e-9))) * F.sqrt(n)
        return combined(chi_tail(z["chi"], k - 1), chi_tail(y["o"]["chi"], y["o"]["degrees"]), 2 * upper_tail(runs), 2 * upper_tail(serial))

    def combined(*parts: Column) -> Column:
        return F.aggregate(F.array(*parts), F.lit(0.0), lambda a, p: a - F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30))))

    return let(F.struct(chars.alias("chars"), F.length(s).cast("double").alias("n")), lambda x: let(measured(x), lambda y: let(centred(y), lambda z: judged(y, z))))


def size_of(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double")) * 2), F.lit(SIZES[-1])).cast("int")


def battery(token: Column) -> Column:
    """Struct of encoding (null: not a mix of digits and letters), size (a class of length) and the tests' evidence."""
    body = F.rtrim(token, F.lit("="))
    own = [F.lit(ENCODINGS[-1][0]), *encoding_columns(ENCODINGS[-1])]
    for e in reversed(ENCODINGS[:-1]):
        own = [F.when(token.rlike(e[1]), new).otherwise(old) for new, old in zip([F.lit(e[0]), *encoding_columns(e)], own, strict=True)]
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return F.struct(F.when(mixed, own[0]).alias("encoding"), size_of(F.length(body)).alias("size"), F.when(mixed, evidence(body, *own[1:])).alias("evidence"))


def encoding_columns(e: tuple) -> list[Column]:
    return [F.lit(e[2]), F.lit(e[3]), F.array(*[F.lit(float(x)) for x in e[4]])]


#: The shortest length of each class, which tells least; a block of prose has one string of each.
LENGTHS = {size: math.ceil(2 ** (size / 2)) for size in SIZES}
BLOCK = sum(LENGTHS.values())


def turns() -> Column:
    """For each place to begin with, the classes in turn: size, length and where in a block its string starts."""
    out = []
    for first in range(len(SIZES)):
        at, own = 1, []
        for size in (*SIZES[first:], *SIZES[:first]):
            own.append(F.struct(F.lit(size).alias("size"), F.lit(LENGTHS[size]).alias("n"), F.lit(at).alias("at")))
            at += LENGTHS[size]
        out.append(F.array(*own))
    return F.array(*out)


def typed_strings(docs: DataFrame, text: str) -> DataFrame:
    """(encoding, size, evidence) of strings that prose makes: of every whole text, end to end, and of PROSE.

    Words with digits go, then all but A-Z and a-z. base64 gets the words with capitals in front, run together; the others
    the letters in their own alphabet. Blocks of letters go to one encoding after another, and a block is cut into one string of each
    class of length; with which encoding and class a text begins goes by its hash. Only an end too short for its class is left over.
    """
    rows = docs.where(F.length(text) > 0).select(F.col(text).alias("t"), F.xxhash64(F.col(text), F.lit(7)).alias("h"))
    own = docs.sparkSession.range(len(ENCODINGS) * len(SIZES) * 8).select(F.substring(F.lit(PROSE), (1 + F.pmod(F.col("id") * 37, F.lit(len(PROSE) - 400))).cast("int"), F.lit(400)).alias("t"), F.col("id").alias("h"))
    camel = F.regexp_replace(F.initcap(F.regexp_replace("t", NUMBERED, " ")), "[^A-Za-z]+", "")
    blocks = rows.union(own).select("h", F.posexplode(F.regexp_extract_all(camel, F.lit(f".{{1,{BLOCK}}}"), F.lit(0))).alias("k", "b"))
    turn = F.pmod(F.floor(F.col("h") / len(ENCODINGS)) + F.floor(F.col("k") / len(ENCODINGS)), F.lit(len(SIZES))).cast("int")
    chosen = blocks.select("b", F.pmod(F.col("h") + F.col("k"), F.lit(len(ENCODINGS))).cast("int").alias("e"), F.explode(F.element_at(turns(), turn + 1)).alias("c"))
    strings = chosen.select("e", "c.size", "c.n", F.col("b").substr(F.col("c.at"), F.col("c.n")).alias("s")).where(F.length("s") == F.col("n"))
    lower = F.translate(F.lower("s"), "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef0123456789")
    cut = strings.select("e", "size", F.when(F.col("e") == 3, F.col("s")).when(F.col("e") == 2, F.upper("s")).when(F.col("e") == 1, F.upper(lower)).otherwise(lower).alias("s"))
    pick = lambda k: F.element_at(F.array(*[encoding_columns(e)[k] for e in ENCODINGS]), F.col("e") + 1)
    name = F.element_at(F.array(*[F.lit(e[0]) for e in ENCODINGS]), F.col("e") + 1)
    return cut.select(name.alias("encoding"), "size", evidence(F.col("s"), *[pick(k) for k in range(3)]).alias("evidence"))


def typed_moments(docs: DataFrame, text: str) -> dict[tuple[str, int], tuple[float, float]]:
    """Mean and spread of the square root of typed strings' evidence, by encoding and class of length."""
    root = F.sqrt("evidence")
    rows = typed_strings(docs, text).groupBy("encoding", "size").agg(F.avg(root).alias("m"), F.stddev_pop(root).alias("s")).collect()
    return {(r.encoding, r["size"]): (r.m, max(r.s, 0.1)) for r in rows}


def typed_chance(own: Column, moments: Column) -> Column:
    """The chance that a typed string gives as little evidence against randomness as this one."""
    m = F.element_at(moments, F.concat_ws(" ", own["encoding"], own["size"].cast("string")))
    return F.greatest(upper_tail((m[0] - F.sqrt(own["evidence"])) / m[1]), F.lit(1e-30))


def step_of(p: Column) -> Column:
    return F.least(F.lit(STEPS), F.floor(-10 * F.log10(p))).cast("int")


def rejection_steps(tested: DataFrame, false_discovery: float) -> dict[tuple[str, int], int]:
    """For each encoding and class of length the step of p from which on tokens are reported.

    Counts by step are enough for the procedure, so what reaches the driver is bounded by
    encodings, classes and steps. Rounding p up to its step only makes reports rarer.
    """
    counts = tested.where(F.col("encoding").isNotNull()).groupBy("encoding", "size", step_of(F.col("p")).alias("step")).agg(F.count("*").alias("n")).collect()
    groups: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        groups.setdefault((r.encoding, r["size"]), {})[r.step] = r.n
    out = {}
    for key, steps in groups.items():
        total, below = sum(steps.values()), 0
        out[key] = STEPS + 1
        for step in sorted(steps, reverse=True):
            below += steps[step]
            if math.pow(10, -step / 10) <= false_discovery * below / total:
                out[key] = step
    return out


def find_secrets(docs: DataFrame, *, text: str = "text", false_discovery: float = 0.05) -> DataFrame:
    """Add base_spans (by start, then kind) and added_spans (kind `random`), arrays of (kind, start, stop).

    Of the spans added for an encoding and class of length, at most the share `false_discovery`
    is expected to be typed rather than random. An added span touches no base span. A null or empty text
    has none; equal rows get equal results; columns of the new names are replaced. Texts of any length are
    searched whole. Without candidates nothing is added.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = found(t, CANDIDATE, 1, 20, "[A-Za-z0-9+/_-]{20}", "random", with_match=True)
    typed = typed_moments(docs, text)
    moments = F.create_map(*[x for (e, k), (m, d) in sorted(typed.items()) for x in (F.lit(f"{e} {k}"), F.array(F.lit(m), F.lit(d)))])
    tested = docs.select(F.explode(tokens).alias("c")).select(battery(F.col("c.match")).alias("b")).where("b.encoding IS NOT NULL")
    limits = rejection_steps(tested.select("b.encoding", "b.size", typed_chance(F.col("b"), moments).alias("p")), false_discovery)
    base = F.concat(*[found(t, *PATTERNS[k], GUARDS[k], k) for k in KINDS])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    by_start = F.transform(
        F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )
    kept = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    out = docs.select(*kept, by_start.alias("base_spans"), (tokens if limits else F.array().cast("array<struct<kind:string,start:long,stop:long,match:string>>")).alias("_tokens"))
    if limits:
        limit = F.create_map(*[F.lit(x) for (e, s), step in sorted(limits.items()) for x in (f"{e} {s}", step)])

        def secret(c):
            own = battery(c["match"])
            return let(own, lambda b: b["encoding"].isNotNull() & (step_of(typed_chance(b, moments)) >= F.element_at(limit, F.concat_ws(" ", b["encoding"], b["size"].cast("string")))))

        clear = lambda c: ~F.exists("base_spans", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))
        chosen = F.filter("_tokens", lambda c: clear(c) & secret(c))
    else:
        chosen = F.col("_tokens")
    return out.withColumn("added_spans", F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))).drop("_tokens")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    by_start = F.array_sort(
        F.concat("base_spans", "added_spans"),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.lit(0)),
    )
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(by_start).alias("spans"), F.size("added_spans").cast("long").alias("n_added"))
