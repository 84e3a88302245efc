"""Two further sets of checkers, whose rules differ from those in checkers.py although ids are shared.

LENIENT is for constraints on answers to mathematical tasks, REASONED for those on reasoning traces. verify() gives
null where an id isn't known or its arguments say nothing that could be held against the text. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checkers as C
from .texts import let, words

Rules = dict[str, Callable[[Column, C.Arguments], Column]]
LENIENT: Rules = {}
REASONED: Rules = {}

# Letters that tell a language, and the relations by name.
MARKS = {"es": "[ñáéíóúü¿¡]", "spanish": "[ñáéíóúü¿¡]", "fr": "[àâçéèêëîïôûùü]", "french": "[àâçéèêëîïôûùü]", "de": "[äöüß]", "german": "[äöüß]", "ru": "[а-яё]", "russian": "[а-яё]"}
AT_MOST = ("at most", "less than or equal to", "<=", "le")
AT_LEAST = ("at least", "greater than or equal to", ">=", "ge")
LESS = ("less than", "<", "lt")
MORE = ("more than", ">", "gt")
LATIN, HAN, KANA, HANGUL, CYRILLIC, ARABIC = "[A-Za-z]", "[一-鿿]", "[぀-ヿ]", "[가-힯]", "[Ѐ-ӿ]", "[؀-ۿ]"


def rule(rules: Rules, *ids: str):
    def add(f):
        for i in ids:
            if rules.get(i, f) is not f:
                raise ValueError(f"rule {i} exists")
            rules[i] = f
        return f

    return add


def stated(a: C.Arguments, *names: str) -> Column:
    """The first of these that says something (not empty, not 0), else the last as it is."""
    return F.coalesce(*[F.when(~a(n).isin("", "0"), a(n)) for n in names], a(names[-1]))


def named(a: C.Arguments, *names: str) -> Column:
    """The first of these texts that isn't empty, else null."""
    return F.nullif(stated(a, *names), F.lit(""))


def whole(a: C.Arguments, default: int, *names: str) -> Column:
    return F.coalesce(F.nullif(stated(a, *names).try_cast("int"), F.lit(0)), F.lit(default))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def signs(x: Column, some: str) -> Column:
    """How many signs of a set there are, by what is left without runs of them: no list of single signs is made."""
    return F.length(x) - F.length(F.regexp_replace(x, f"{some}+", ""))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def plain_space(x: Column) -> Column:
    return F.regexp_replace(stripped(x), r"(?U)\s+", " ")


def share(x: Column, some: str) -> Column:
    """The part of the Latin letters that are such; null without letters."""
    return F.try_divide(count(x, some), count(x, LATIN))


def each(a: C.Arguments, *names: str) -> Column:
    """A list, or one text as a list; null if nothing is there."""
    v = named(a, *names)
    found = F.coalesce(F.from_json(v, "array<string>"), F.array(v))
    return F.when(v.isNotNull() & (F.size(found) > 0), found)


@rule(LENIENT, "punctuation:no_comma")
def _(x, a):
    return ~x.contains(",")


@rule(LENIENT, "length_constraint_checkers:number_words")
def _(x, a):
    n, target, relation = count(x, r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"), stated(a, "num_words", "n_words"), F.lower(F.coalesce(named(a, "relation", "comparator", "relation_type"), F.lit("")))
    low, high = stated(a, "num_words_min", "min_words", "num_words_lower"), stated(a, "num_words_max", "max_words", "num_words_upper")
    t = target.try_cast("int")
    met = F.when(relation.isin(*AT_MOST), n <= t).when(relation.isin(*AT_LEAST), n >= t).when(relation.isin(*LESS), n < t).when(relation.isin(*MORE), n > t).otherwise(n == t)
    parts = [F.coalesce(p, F.lit(True)) for p in (met, n >= low.try_cast("int"), n <= high.try_cast("int"))]
    return F.when(F.coalesce(target, low, high).isNotNull(), reduce(and_, parts))


@rule(LENIENT, "language:reasoning_language", "language:response_language")
def _(x, a):
    language, latin = F.lower(named(a, "language", "reasoning_language")), count(x, LATIN)
    out = F.when(language.isin("en", "english"), latin >= F.greatest(F.lit(20), 5 * count(x, r"[^\x00-\x7f]")))
    out = out.when(language.isin("zh", "chinese", "zh-cn"), count(x, HAN) >= F.greatest(F.lit(20), F.floor(latin / 2)))
    for name, marks in MARKS.items():
        out = out.when(language == name, (latin >= 50) & x.rlike("(?iu)" + marks))
    return out


@rule(LENIENT, "startend:end_checker")
def _(x, a):
    bare = lambda c: F.lower(F.regexp_replace(plain_space(c), r"""[."')\]]+\z""", ""))
    return bare(x).endswith(bare(named(a, "end_phrase", "ending", "end", "phrase")))


@rule(LENIENT, "startend:quotation")
def _(x, a):
    return let(stripped(x), lambda t: t.rlike("^[\"'“‘]") & t.rlike("[\"'”’]\\z"))


@rule(LENIENT, "detectable_format:json_format")
def _(x, a):
    fenced = F.regexp_extract(x, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return reduce(lambda p, q: p | q, [let(stripped(c), lambda t: t.rlike(r"^[{\[]") & C.is_json(t)) for c in (fenced, x)])


@rule(LENIENT, "detectable_format:number_highlighted_sections")
def _(x, a):
    return count(x, r"\*\*[^*\n]+\*\*") + count(x, r"(?<!\*)\*[^*\n]+\*(?!\*)") >= whole(a, 1, "num_highlights", "num_highlighted_sections", "count")


@rule(LENIENT, "detectable_format:number_bullet_lists")
def _(x, a):
    return count(x, r"(?mdU)^\s*(?:[-*+]\s+|\d+[.)]\s+)") >= whole(a, 1, "num_bullets", "num_bullet_lists", "count")


@rule(LENIENT, "detectable_format:multiple_sections")
def _(x, a):
    return count(x, r"(?mdU)^\s*(?:#+\s+|Section\s+\d+|SECTION\s+\d+|---+)") >= whole(a, 2, "num_sections", "count")


rule(LENIENT, "change_case:english_capital")(lambda x, a: F.coalesce(share(x, "[A-Z]") >= 0.95, F.lit(False)))
rule(LENIENT, "change_case:english_lowercase")(lambda x, a: F.coalesce(share(x, "[a-z]") >= 0.95, F.lit(False)))


@rule(LENIENT, "change_case:capital_word_frequency")
def _(x, a):
    relation, n = F.lower(F.coalesce(named(a, "relation"), F.lit("at least"))), whole(a, 1, "capital_frequency", "frequency", "num")
    found = F.size(F.filter(F.regexp_extract_all(x, F.lit(r"(?U)\b[\w\-']+\b"), 0), lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
    return F.when(relation.contains("at most") | relation.contains("less"), found <= n).otherwise(found >= n)


@rule(LENIENT, "keywords:frequency")
def _(x, a):
    keyword, n, relation = named(a, "keyword", "word", "token"), whole(a, 1, "frequency", "num", "count"), F.lower(F.coalesce(named(a, "relation"), F.lit("at least")))
    literal = F.regexp_replace(F.lower(keyword), r"([^\p{L}\p{N}\s])", r"\\$1")
    found = F.regexp_count(F.lower(x), F.concat(F.lit(r"(?U)\b"), literal, F.lit(r"\b")))
    met = F.when(relation.contains("at most"), found <= n).when(relation.contains("less"), found < n)
    return F.when(keyword.isNotNull(), met.when(relation.contains("exact") | F.trim(relation).isin("=", "==", "eq"), found == n).otherwise(found >= n))


rule(LENIENT, "keywords:existence")(lambda x, a: F.forall(each(a, "keywords", "required"), lambda k: F.lower(x).contains(F.lower(k))))
rule(LENIENT, "keywords:forbidden_words")(lambda x, a: ~F.exists(each(a, "forbidden_words", "forbidden", "avoid"), lambda k: F.lower(x).contains(F.lower(k))))
rule(LENIENT, "combination:repeat_prompt")(lambda x, a: plain_space(x).contains(plain_space(named(a, "prompt_to_repeat", "prompt", "request"))))

rule(REASONED, "punctuation:no_comma")(lambda x, a: ~x.rlike("[,，]"))


@rule(REASONED, "length_constraint_checkers:number_words")
def _(x, a):
    n, t, relation = F.size(words(x)), a("num_words").try_cast("int"), F.lower(F.trim(a("relation")))
    said = F.when(relation.contains("less"), n < t).when(relation.contains("more") | relation.contains("great"), n > t).when(relation.contains("least"), n >= t)
    said = said.when(relation.contains("most"), n <= t).when(relation.contains("exact") | relation.isin("equal", "=="), n == t).otherwise(n <= t)
    most = lambda k: n <= a(k).try_cast("int")
    least = lambda k: n >= a(k).try_cast("int")
    bounds = (most("max_words"), most("maximum_words"), least("min_words"), least("minimum_words"), n == a("exact_words").try_cast("int"), most("num_words"), most("N"), n <= 200)
    return F.when(a("num_words").isNotNull() & a("relation").isNotNull(), said).otherwise(F.coalesce(*bounds))


@rule(REASONED, "language:reasoning_language")
def _(x, a):
    language = F.lower(named(a, "language", "reasoning_language", "target_language"))
    says = lambda *names: reduce(lambda p, q: p | q, [language.contains(n) for n in names])
    rest = "[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]"
    total = signs(x, LATIN) + signs(x, rest)
    enough = lambda pattern, part: let(signs(x, pattern), lambda n: n >= F.greatest(F.lit(20.0), F.lit(part) * ((n + signs(x, rest)) if pattern == LATIN else total)))
    out = F.when(language.isNull(), F.lit(True)).when(~x.rlike("[A-Za-z一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]"), F.lit(False)).when(says("chinese", "中文"), enough(HAN, 0.4)).when(says("japanese"), enough("[぀-ヿ一-鿿]", 0.4))
    out = out.when(says("korean"), enough(HANGUL, 0.4)).when(says("russian", "cyrillic"), enough(CYRILLIC, 0.4)).when(says("arabic"), enough(ARABIC, 0.4))
    return out.when(says("english", "spanish", "french", "german", "italian", "portuguese", "dutch"), enough(LATIN, 0.6)).otherwise(F.lit(True))


@rule(REASONED, "startend:end_checker")
def _(x, a):
    return F.coalesce(F.regexp_replace(x, r"(?U)\s+\z", "").endswith(stripped(named(a, "end_phrase", "ending", "suffix", "end", "phrase"))), F.lit(True))


@rule(REASONED, "detectable_format:json_format")
def _(x, a):
    fence = r"(?s)```(?:json)?\s*\n(.*?)```"
    inner = stripped(F.when(x.rlike(fence), F.regexp_extract(x, fence, 1)).otherwise(x))
    return let(inner, lambda t: C.is_json(t) | C.is_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)) | C.is_json(F.regexp_extract(t, r"(?s)\[.*\]", 0)))


rule(REASONED, "change_case:english_capital")(lambda x, a: x.rlike("[A-Z]") & ~x.rlike("[a-z]"))


def verify(rules: Rules, text: Column, instruction: Column, arguments: Column, ids: list[str] | None = None) -> Column:
    """Whether the text follows the instruction by one of the two sets; null for what isn't supported. Only the given ids enter the plan."""
    a, out = lambda name: F.try_element_at(arguments, F.lit(name)), F.lit(None).cast("boolean")
    for i in ids or sorted(rules):
        out = F.when(instruction == i, rules[i](F.coalesce(text, F.lit("")), a)).otherwise(out)
    return out


def strict_first(text: Column, instruction: Column, arguments: Column, ids: list[str] | None = None) -> Column:
    """Struct (passed, rule): the verdict of checkers.py where it has the id, else that of LENIENT, and which it was."""
    chosen = ids or sorted(C.IDS | set(LENIENT))
    first = C.check(text, instruction, arguments, [i for i in chosen if i in C.IDS])
    second = verify(LENIENT, text, instruction, arguments, [i for i in chosen if i in LENIENT and i not in C.IDS])
    which = F.when(first.isNotNull(), "vendored").when(second.isNotNull(), "fallback").otherwise("unsupported")
    return F.struct(F.coalesce(first, second).alias("passed"), which.alias("rule"))
