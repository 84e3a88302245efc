"""Scorers of answers, tolerant parsers of what models write, and rewards by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import INVALID, dapo_normalize, last, normalize, scored, undecorated  # noqa: F401
from .texts import let, pieces


def last_boxed(x: Column, tail: int | None = None, command: str = "\\boxed") -> Column:
    """What the last \\boxed{...} holds, braces balanced to any depth; null if there is none or it doesn't close."""
    t = F.right(x, F.lit(tail)) if tail else x
    inside = F.substring_index(t, command + "{", -1)

    def scan(s: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

        def step(a: Column, ch: Column) -> Column:
            depth = a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
            return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["n"] + (depth > 0).cast("int")).alias("n")))

        end = F.aggregate(F.split(s, ""), start, step)
        return let(end, lambda e: F.when(e["depth"] == 0, F.substring(s, F.lit(1), e["n"])))

    return F.when(t.contains(command + "{"), let(inside, scan))


def boxed_score(x: Column, gold: Column) -> Column:
    """Struct of score (1 or -1), acc and pred as the competition scorer has them, from the last box of the final 300 characters."""
    return scored(dapo_normalize(F.coalesce(last_boxed(x, 300), F.lit(INVALID))), dapo_normalize(gold))


def strict_box_score(x: Column, gold: Column) -> Column:
    """Struct of score (1 or -1) and pred, from the box in the last 100 characters."""
    pred = last_boxed(x, 100)
    return F.struct(F.when(pred == gold, 1.0).otherwise(-1.0).alias("score"), pred.alias("pred"))


def math_string(x: Column) -> Column:
    """A closed form in one spelling: fractions and roots in braces, no units, sizes, blanks or leading `x =`; 0.5 and a/b as fractions."""
    t = F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(""))
    # Spellings of the same thing.
    for a, b in ((r"\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), (r"\left", ""), (r"\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), (r"\$", "")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"\\text\{ .*$", "")  # units on the right
    for a in (r"\%", "%"):
        t = F.replace(t, F.lit(a), F.lit(""))
    t = F.replace(F.replace(t, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"^[^=]{1,2}=", "")
    t = F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}")
    t = F.replace(t, F.lit(" "), F.lit(""))
    t = F.regexp_replace(t, r"\\frac([^{\\])([^{\\])", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"\\frac([^{\\])\{", r"\\frac{$1}{")
    t = F.when(t == "0.5", r"\frac{1}{2}").otherwise(t)
    return F.regexp_replace(t, r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}")


def math_score(x: Column, gold: Column) -> Column:
    """1 if the last box (\\boxed or \\fbox) spells the gold, else 0."""
    found = F.coalesce(last_boxed(x), last_boxed(x, command="\\fbox"))
    return F.when(found.isNotNull() & (math_string(found) == math_string(gold)), 1.0).otherwise(0.0)


def geometry_score(x: Column, gold: Column, share: float = 0.1) -> Column:
    """Mostly whether the box is right, a little whether thoughts are tagged and an answer boxed."""
    form = x.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")
    right = F.coalesce(normalize(last_boxed(x)) == normalize(gold), F.lit(False))
    return (1 - share) * right.cast("double") + share * form.cast("double")


def placed_at_end(reward: Column, length: Column, mask: Column) -> Column:
    """A vector as long as the mask with the reward at the last valid token, or at none."""
    at = F.coalesce(F.array_max(F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())), F.lit(-1))
    return F.transform(F.sequence(F.lit(0), length.cast("int") - 1), lambda i: F.when(i == at, reward).otherwise(F.lit(0.0)))


def routed(source: Column, instruction_sources: list[str], instruction: Column, math: Column) -> Column:
    """Struct of score, acc and kind: instruction rewards for their sources, the math reward for all others; a failed reward is 0."""
    is_instruction = source.isin(instruction_sources)
    score = F.coalesce(F.when(is_instruction, instruction).otherwise(math), F.lit(0.0))
    return F.struct(score.alias("score"), (score >= 1).alias("acc"), F.when(is_instruction, "if").otherwise("math").alias("kind"))


FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def json_block(x: Column) -> Column:
    """A JSON text within a text: all of it, what a fence holds, or from the first to the last brace or bracket; null if none parses."""
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    blocks = (strip(x), strip(F.regexp_extract(x, FENCE, 1)), F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.regexp_extract(x, r"(?s)(\[.*\])", 1))
    return F.coalesce(*[F.when((b != "") & F.try_parse_json(b).isNotNull(), b) for b in blocks])


def label(x: Column, values: list[str], most: int = 400) -> Column:
    """Struct of label (null unless it is one of the values) and reason (cut), from the JSON object in a text."""
    held = F.from_json(F.regexp_extract(x, r"(?s)(\{.*\})", 1), "label string, reason string")
    name = F.upper(F.trim(held["label"]))
    return F.struct(F.when(name.isin(values), name).alias("label"), F.left(F.coalesce(held["reason"], F.lit("")), F.lit(most)).alias("reason"))


def as_list(x: Column) -> Column:
    """A JSON list as strings; anything else is a list of itself, null an empty one."""
    return F.when(x.isNull(), F.array().cast("array<string>")).when(F.ltrim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array(x))).otherwise(F.array(x))


def as_map(x: Column) -> Column:
    """A JSON object as a map of strings; of a list its first element; else an empty map."""
    first = F.when(F.ltrim(x).startswith("["), F.get_json_object(x, "$[0]")).otherwise(x)
    return F.coalesce(F.when(F.ltrim(first).startswith("{"), F.from_json(first, "map<string,string>")), F.create_map().cast("map<string,string>"))


def quoted(x: Column) -> Column:
    """What stands in double quotes, each once whatever its case, in order."""
    found = F.regexp_extract_all(x, F.lit('"([^"]+)"'), 1)
    low = F.transform(found, F.lower)
    return F.filter(found, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def numbers(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), 0), lambda s: s.cast("long"))


# How limits are written.
AT_LEAST, AT_MOST = r"(?i)(?:at least|no fewer than|minimum of|more than)\s+(\d+)", r"(?i)(?:at most|no more than|maximum of|less than|fewer than)\s+(\d+)"


def limits(x: Column) -> Column:
    """Struct of the least and the most that a constraint's text asks for."""
    number = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).try_cast("long")
    return F.struct(number(AT_LEAST).alias("least"), number(AT_MOST).alias("most"))


def constraint_kind(x: Column) -> Column:
    """What a free-text constraint is about: format, language, affix, length or lexical, told by its words in this order."""
    kinds = (("format", r"json|bullet|title|section|markdown|list"), ("language", r"\b(?:english|chinese|french|german|spanish|language)\b"), ("affix", r"\b(?:begin|start|end|finish)"), ("length", r"\b(?:words?|sentences?|paragraphs?|characters?)\b"))
    out = F.lit("lexical")
    for name, pattern in reversed(kinds):
        out = F.when(F.lower(x).rlike(pattern), name).otherwise(out)
    return out


def satisfied(constraint: Column, text: Column) -> Column:
    """Whether a text keeps a free-text constraint; null where the constraint isn't understood."""
    kind, own, asked, low = constraint_kind(constraint), limits(constraint), quoted(constraint), F.lower(text)
    n = F.size(pieces(text))
    bounded = F.coalesce(n >= own["least"], F.lit(True)) & F.coalesce(n <= own["most"], F.lit(True))
    known = own["least"].isNotNull() | own["most"].isNotNull()
    affix = F.when(F.lower(constraint).rlike("begin|start"), low.startswith(F.lower(F.get(asked, F.lit(0))))).otherwise(low.endswith(F.lower(F.get(asked, F.lit(0)))))
    lexical = F.forall(asked, lambda t: F.contains(low, F.lower(t)))
    lexical = F.when(F.lower(constraint).rlike(r"\b(?:not|avoid|without)\b"), ~F.exists(asked, lambda t: F.contains(low, F.lower(t)))).otherwise(lexical)
    return F.when((kind == "length") & known, bounded).when((kind == "affix") & (F.size(asked) > 0), affix).when((kind == "lexical") & (F.size(asked) > 0), lexical).when((kind == "format") & F.lower(constraint).contains("json"), json_block(text).isNotNull())


def constraint_columns(names: Column, descriptions: Column, arguments: Column) -> Column:
    """Lists of names, descriptions and arguments as one list, short ones of a single element repeated."""
    n = F.greatest(F.size(names), F.size(descriptions), F.size(arguments))
    pick = lambda a, i: F.when(F.size(a) == 1, a[0]).otherwise(F.get(a, i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(pick(names, i).alias("name"), pick(descriptions, i).alias("description"), pick(arguments, i).alias("arguments")))).otherwise(F.array())


def first_violation(verdicts: Column) -> Column:
    """Struct of the first step (from 0) whose verdict is false and its third of the way (early, middle, late); nulls if there is none."""
    at = F.array_position(verdicts, F.lit(False)) - 1
    third = F.floor(at * 3 / F.size(verdicts))
    return F.when(at >= 0, F.struct(at.alias("step"), F.when(third == 0, "early").when(third == 1, "middle").otherwise("late").alias("phase")))


def point_reward(points: Column, box: Column, share: float = 0.2) -> Column:
    """Of JSON points [[x, y], ...]: a share for being well-formed, the rest if the first lies in the box (left, top, right, bottom); three or more on one line are worth nothing."""
    p = F.from_json(points, "array<array<double>>")
    form = p.isNotNull() & (F.size(p) > 0) & F.forall(p, lambda q: F.size(q) == 2)
    a, b = p[0], F.get(p, F.lit(1))
    line = (F.size(p) >= 3) & F.forall(p, lambda q: F.abs((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])) < 1e-9)
    hit = a[0].between(box[0], box[2]) & a[1].between(box[1], box[3])
    return F.when(~F.coalesce(form, F.lit(False)) | F.coalesce(line, F.lit(False)), 0.0).otherwise(share + (1 - share) * hit.cast("double"))


def tagged_messages(x: Column) -> Column:
    """Text with <code>, <interpreter> and <answer> tags as messages (role, content) in order: what stands between them is the assistant's."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)<(code|interpreter|answer)>.*?</\1>|(?:(?!<(?:code|interpreter|answer)>).)+"), 0)
    role = lambda p: F.when(p.startswith("<interpreter>"), "tool").otherwise("assistant")
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, "(?s)^<(?:code|interpreter|answer)>(.*)</(?:code|interpreter|answer)>$", "$1"), r"^\s+|\s+$", "")
    return F.filter(F.transform(parts, lambda p: F.struct(role(p).alias("role"), clean(p).alias("content"))), lambda m: m["content"] != "")


#: Named rewards: Columns of response and gold to a Column. A plug-in is added by register().
REWARDS: dict[str, Callable[[Column, Column], Column]] = {"math": math_score, "geometry": geometry_score, "strict_box": lambda x, g: strict_box_score(x, g)["score"]}


def register(name: str) -> Callable:
    """Add a reward under a name; another function under the same name is an error."""

    def add(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        if REWARDS.setdefault(name, f) is not f:
            raise ValueError(f"{name} is taken")
        return f

    return add


def reward(name: str, x: Column, gold: Column) -> Column:
    if name not in REWARDS:
        raise KeyError(f"{name}: one of {', '.join(sorted(REWARDS))}")
    return REWARDS[name](x, gold)
