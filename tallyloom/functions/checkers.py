"""Rule-based checkers of instructions: id to a native expression of the text and its arguments.

check() dispatches on an id column; an id that isn't known gives null (not supported), an
empty text false. Arguments are strings in a map; lists are JSON arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let, pieces, sentences, shared_name, sharing, unpunctuated, unsigned, words

Arguments = Callable[[str], Column]
CHECKERS: dict[str, Callable[[Column, Arguments], Column]] = {}


def checker(*ids: str):
    def add(f):
        for i in ids:
            if i in CHECKERS:
                raise ValueError(f"checker {i} exists")
            CHECKERS[i] = f
        return f

    return add


def number(a: Arguments, name: str, default: int = 1) -> Column:
    return F.coalesce(a(name).try_cast("int"), F.lit(default))


def needed(a: Arguments, *names: str) -> Column:
    """The first of these numbers that is there; null, and so not followed, if none is."""
    return F.coalesce(*[a(n).try_cast("int") for n in names])


def listed(a: Arguments, name: str) -> Column:
    return F.coalesce(F.from_json(a(name), "array<string>"), F.array(a(name)))


def given(a: Arguments, *names: str) -> Column:
    """The first of these numbers that is there and isn't 0, else the last; null if there is none."""
    every = [a(n).try_cast("int") for n in names]
    return F.coalesce(*[F.nullif(n, F.lit(0)) for n in every], every[-1])


def filled(a: Arguments, *names: str) -> Column:
    """The first of these texts that is there and isn't empty, else null."""
    return F.coalesce(*[F.nullif(a(n), F.lit("")) for n in names])


def several(a: Arguments, many: str, one: str) -> Column:
    """A list of texts, or the one that stands for it, or none."""
    single = F.when(filled(a, one).isNotNull(), F.array(a(one))).otherwise(F.array().cast("array<string>"))
    return let(F.array_compact(listed(a, many)), lambda found: F.when(F.size(found) > 0, found).otherwise(single))


def related(count: Column, n: Column, relation: Column) -> Column:
    """At least if nothing is said; a relation that isn't known is equality. About is within a tenth, one at least."""
    r = F.lower(F.trim(F.coalesce(F.nullif(relation, F.lit("")), F.lit("at least"))))
    near = F.abs(count - n) <= F.greatest(F.lit(1), (n * F.lit(0.1)).cast("int"))
    out = F.when(r.isin("at least", ">=", "more than", "not less than"), count >= n).when(r.isin("less than", "<"), count < n)
    return out.when(r.isin("at most", "<=", "no more than"), count <= n).when(r.isin("around", "approximately"), near).otherwise(count == n)


def occurrences(x: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(F.length(part) > 0, (F.length(x) - F.length(F.replace(x, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")


def whole_word(x: Column, word: Column) -> Column:
    return F.size(F.filter(words(F.lower(x)), lambda w: w == F.lower(word)))


def bare(x: Column) -> Column:
    """Words without the punctuation around them: of what a word can have, the underscore."""
    return F.filter(F.transform(words(x), lambda w: F.regexp_replace(w, "^_+|_+$", "")), lambda w: w != "")


def edged(x: Column) -> Column:
    """Without ASCII punctuation and blanks at the ends."""
    return F.regexp_replace(x, r"^[\p{Punct} ]+|[\p{Punct} ]+\z", "")


def spoken(w: Column) -> Column:
    return w.rlike(r"\P{Punct}")


def last_bare(parts: Column) -> Column:
    """The last part that isn't punctuation alone, without the punctuation after it."""
    return F.regexp_replace(nth(F.filter(parts, spoken), -1), r"\p{Punct}+\z", "")


def first_bare(parts: Column) -> Column:
    return F.regexp_replace(nth(F.filter(parts, spoken), 1), r"^\p{Punct}+", "")


def paragraphs(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"\n\s*\n"), lambda p: F.trim(p) != "")


def lines(x: Column) -> Column:
    return F.filter(F.split(x, "\n"), lambda s: F.trim(s) != "")


def divided(x: Column) -> Column:
    """Parts between dividers of three stars, which may be spaced out and stand on lines of their own."""
    star = r"(?:\*\s*\*\s*\*|\*{3})"
    parts = F.split(x, rf"(?U)\n\s*{star}\s*\n|\s*{star}\s*")
    return F.filter(F.transform(parts, stripped), lambda p: p != "")


def stripped(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"))


def is_json(x: Column) -> Column:
    """Whether all of the text is one JSON value. What follows a value is not parsed, so a digest of the text must follow it in an array."""
    pair = F.try_parse_json(F.concat(F.lit("["), x, F.lit(',"'), F.md5(x), F.lit('"]')))
    return F.coalesce(F.try_variant_get(pair, "$[1]", "string") == F.md5(x), F.lit(False))


def nth(array: Column, n) -> Column:
    return F.try_element_at(array, n if isinstance(n, Column) else F.lit(n))


def neighbours(array: Column, good) -> Column:
    """Whether good(a, b) holds for every two that stand side by side."""
    n = lambda v: F.greatest(F.size(v) - 1, F.lit(0))
    return let(array, lambda v: F.forall(F.zip_with(F.slice(v, 1, n(v)), F.slice(v, 2, n(v)), lambda p, q: F.coalesce(good(p, q), F.lit(True))), lambda b: b))


checker("keywords:existence")(lambda x, a: F.forall(several(a, "keywords", "keyword"), lambda k: (k != "") & F.lower(x).contains(F.lower(k))))
checker("keywords:frequency")(lambda x, a: related(F.when(filled(a, "keyword").isNotNull(), whole_word(x, a("keyword"))), needed(a, "frequency"), a("relation")))
checker("keywords:forbidden_words")(lambda x, a: ~F.exists(several(a, "forbidden_words", "keyword"), lambda k: (k != "") & F.lower(x).contains(F.lower(k))))
checker("keywords:letter_frequency")(lambda x, a: related(F.when(filled(a, "letter").isNotNull(), occurrences(x, a("letter"))), needed(a, "let_frequency", "frequency"), filled(a, "let_relation", "relation")))
checker("length_constraints:number_sentences")(lambda x, a: related(F.size(sentences(x)), needed(a, "num_sentences"), a("relation")))
checker("length_constraints:number_paragraphs")(lambda x, a: F.size(divided(x)) == needed(a, "num_paragraphs"))
checker("length_constraints:number_words")(lambda x, a: related(F.size(words(x)), needed(a, "num_words"), a("relation")))
checker("length_constraints:nth_paragraph_first_word")(
    lambda x, a: F.when(needed(a, "nth_paragraph") > 0, F.lower(nth(bare(nth(divided(x), F.greatest(needed(a, "nth_paragraph"), F.lit(1)))), 1)) == F.lower(filled(a, "first_word")))
)
checker("detectable_content:number_placeholders")(lambda x, a: F.regexp_count(x, F.lit(r"\[[^\[\]]+\]")) >= needed(a, "num_placeholders"))
checker("detectable_content:postscript")(lambda x, a: x.contains(F.coalesce(filled(a, "postscript_marker"), F.lit("P.S."))))
checker("detectable_format:number_bullet_lists")(lambda x, a: F.regexp_count(x, F.lit(r"(?m)^[^\S\n]*[-*][^\S\n]+\S+")) == needed(a, "num_bullets"))
checker("detectable_format:constrained_response")(lambda x, a: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")).isin("my answer is yes.", "my answer is no.", "my answer is maybe."))
checker("detectable_format:number_highlighted_sections")(lambda x, a: F.regexp_count(x, F.lit(r"\*[^\n*]+\*")) >= needed(a, "num_highlights"))
checker("detectable_format:multiple_sections")(lambda x, a: occurrences(F.lower(x), F.lower(F.coalesce(filled(a, "section_spliter"), F.lit("Section")))) >= needed(a, "num_sections"))
checker("detectable_format:json_format")(lambda x, a: is_json(x))
checker("detectable_format:title")(lambda x, a: x.rlike("(?s)<<.+?>>"))
checker("combination:two_responses")(lambda x, a: (F.size(F.split(x, r"\*{6}")) == 2) & (F.trim(F.split(x, r"\*{6}")[0]) != "") & F.coalesce(F.trim(F.try_element_at(F.split(x, r"\*{6}"), F.lit(2))) != "", F.lit(False)) & F.coalesce(F.trim(F.split(x, r"\*{6}")[0]) != F.trim(F.try_element_at(F.split(x, r"\*{6}"), F.lit(2))), F.lit(False)))
checker("combination:repeat_prompt")(lambda x, a: F.coalesce(x.startswith(filled(a, "prompt_to_repeat")), F.lit(False)))
checker("startend:end_checker")(lambda x, a: F.coalesce(x.endswith(filled(a, "end_phrase")), F.lit(False)))
checker("change_case:capital_word_frequency")(lambda x, a: related(F.regexp_count(x, F.lit(r"(?U)\b[A-Z]+\b")), needed(a, "capital_frequency"), a("capital_relation")))
checker("change_case:english_capital")(lambda x, a: x.rlike(r"\p{L}") & ~x.rlike(r"[\p{L}&&[^\p{Lu}]]"))
checker("change_case:english_lowercase")(lambda x, a: x.rlike(r"\p{L}") & ~x.rlike(r"[\p{L}&&[^\p{Ll}]]"))
checker("punctuation:no_comma")(lambda x, a: ~x.contains(","))
checker("startend:quotation")(lambda x, a: x.startswith('"') & x.endswith('"'))
checker("copy:repeat_phrase")(lambda x, a: F.coalesce(occurrences(x, filled(a, "phrase", "prompt_to_repeat")) >= F.coalesce(given(a, "N", "n"), F.lit(2)), F.lit(False)))
checker("copy:copy", "copy:copying_simple")(lambda x, a: F.coalesce(x.contains(filled(a, "prompt_to_repeat")), F.lit(False)))
checker("new:copy_span_idx")(
    lambda x, a: F.coalesce(x.contains(filled(a, "span", "copy_span")), x.contains(F.substr(a("source_text"), a("start").try_cast("int") + 1, F.greatest(a("end").try_cast("int") - a("start").try_cast("int"), F.lit(0)))), F.lit(False))
)
checker("detectable_format:sentence_hyphens")(lambda x, a: F.replace(x, F.lit(" "), F.lit("")).rlike("[A-Za-z]-[A-Za-z]"))
checker("keywords:no_adjacent_consecutive")(lambda x, a: F.coalesce(~F.lower(x).contains(F.repeat(F.lower(filled(a, "keyword")), F.lit(2))), F.lit(True)))
checker("detectable_format:square_brackets")(lambda x, a: x.rlike(r"\[[^\[\]]+\]"))
checker("keywords:word_once")(lambda x, a: whole_word(x, a("keyword")) == 1)
checker("keywords:word_count_different_numbers")(
    lambda x, a: F.when(filled(a, "keyword").isNotNull() & a("frequency").isNotNull(), whole_word(x, a("keyword")) == a("frequency").try_cast("int")).otherwise(
        F.forall(F.map_entries(F.from_json(a("keyword_count_map"), "map<string,int>")), lambda e: whole_word(x, e["key"]) == e["value"])
    )
)
checker("keywords:exclude_word_harder")(lambda x, a: ~F.lower(x).contains(F.lower(a("keyword"))))
checker("paragraphs:paragraphs", "paragraphs:paragraphs2")(lambda x, a: F.size(paragraphs(x)) == F.coalesce(a("num_paragraphs"), a("N")).try_cast("int"))
checker("first_word:first_word_sent")(lambda x, a: F.forall(sentences(x), lambda s: F.coalesce(F.lower(nth(bare(s), 1)) == F.lower(filled(a, "first_word")), F.lit(False))))
checker("first_word:first_word_answer")(lambda x, a: F.coalesce(F.lower(nth(bare(x), 1)) == F.lower(filled(a, "first_word")), F.lit(False)))
checker("last_word:last_word_sent")(lambda x, a: F.forall(sentences(x), lambda s: F.coalesce(F.lower(nth(bare(s), -1)) == F.lower(filled(a, "last_word")), F.lit(False))))
checker("last_word:last_word_answer")(lambda x, a: F.coalesce(F.lower(nth(words(x), -1)) == F.lower(a("last_word")), F.lit(False)))
checker("detectable_format:bigram_wrapping")(
    lambda x, a: F.when(filled(a, "bigram").isNull(), x.rlike(r"\[[^\]]+\s+[^\]]+\]")).otherwise(x.contains(F.concat(F.lit("["), a("bigram"), F.lit("]"))) | x.contains(F.concat(F.lit("("), a("bigram"), F.lit(")"))))
)
checker("copy:copying_multiple")(lambda x, a: occurrences(x, filled(a, "prompt_to_repeat")) >= F.coalesce(F.nullif(given(a, "N", "n"), F.lit(0)), F.lit(2)))
checker("punctuation:punctuation_dot")(lambda x, a: F.forall(sentences(x), lambda s: s.endswith(".")))
checker("punctuation:punctuation_exclamation")(lambda x, a: F.forall(sentences(x), lambda s: s.endswith("!")))
checker("count:lowercase_counting")(lambda x, a: related(F.regexp_count(x, F.lit(r"\p{IsLowercase}")), given(a, "N", "num_lowercase"), a("relation")))
checker("letters:letter_counting", "letters:letter_counting2")(
    lambda x, a: related(F.when(filled(a, "letter").isNotNull(), occurrences(x, a("letter"))), given(a, "N", "let_frequency", "frequency"), filled(a, "relation", "let_relation"))
)
checker("count:counting_composition")(lambda x, a: related(F.size(words(x)), given(a, "N", "count"), a("relation")))
checker("count:count_unique")(lambda x, a: related(F.size(F.array_distinct(words(F.lower(x)))), given(a, "N", "count"), a("relation")))
checker("count:count_increment_word")(lambda x, a: whole_word(x, filled(a, "keyword", "word")) >= given(a, "N", "count"))
checker("keywords:palindrome")(lambda x, a: (F.length(F.regexp_replace(F.lower(x), "[^a-z0-9]", "")) > 1) & (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") == F.reverse(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))))
checker("keywords:keyword_specific_position")(
    lambda x, a: F.when((number(a, "n", 0) > 0) & (number(a, "m", 0) > 0), nth(bare(nth(sentences(x), F.greatest(number(a, "n"), F.lit(1)))), F.greatest(number(a, "m"), F.lit(1))) == filled(a, "keyword"))
)
checker("keywords:start_end")(lambda x, a: (F.size(words(x)) > 1) & (F.lower(nth(words(x), 1)) == F.lower(nth(words(x), -1))))
checker("language:response_language")(
    lambda x, a: F.when(a("language").isin("zh", "ja", "ko"), F.regexp_count(x, F.lit(r"[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")) > 0.3 * F.length(x)).when(a("language").isin("ru", "bg"), F.regexp_count(x, F.lit(r"\p{IsCyrillic}")) > 0.5 * F.length(x)).otherwise(F.regexp_count(x, F.lit("[A-Za-z]")) > 0.5 * F.length(x))
)

def on_stripped(f: Callable[[Column, Arguments], Column]) -> Callable[[Column, Arguments], Column]:
    return lambda x, a: f(stripped(x), a)


for _id in list(CHECKERS):
    CHECKERS[_id] = on_stripped(CHECKERS[_id])

# the second registry
checker("count:word_count_range")(lambda x, a: F.size(pieces(x)).between(number(a, "min_words"), number(a, "max_words", 1 << 30)))
checker("count:unique_word_count")(lambda x, a: F.size(F.array_distinct(F.transform(F.array_distinct(pieces(F.lower(x))), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")))) >= number(a, "N"))
checker("ratio:sentence_type")(lambda x, a: F.size(F.filter(sentences(x), lambda s: s.endswith("."))) == 2 * F.size(F.filter(sentences(x), lambda s: s.endswith("?"))))
checker("ratio:sentence_balance")(
    lambda x, a: (F.size(F.filter(sentences(x), lambda s: s.endswith("."))) == F.size(F.filter(sentences(x), lambda s: s.endswith("?")))) & (F.size(F.filter(sentences(x), lambda s: s.endswith("?"))) == F.size(F.filter(sentences(x), lambda s: s.endswith("!"))))
)
# The conjunctions and pronouns that are counted.
CONJUNCTIONS = ("and", "but", "for", "nor", "or", "so", "yet")
PRONOUNS = (
    "i me we us you he him she her it they them my mine our ours your yours his hers its their theirs myself ourselves yourself yourselves himself herself itself themselves this that these those who whom whose which what "
    "whoever whomever whatever whichever anybody anyone anything everybody everyone everything nobody nothing somebody someone something each either neither both all some any none"
).split()
checker("count:conjunctions")(lambda x, a: F.size(F.filter(F.array_distinct(pieces(x)), lambda w: F.lower(edged(w)).isin(*CONJUNCTIONS))) >= number(a, "small_n"))
checker("count:pronouns")(lambda x, a: F.size(F.filter(words(F.lower(x)), lambda w: w.isin(*PRONOUNS))) >= number(a, "N"))
checker("count:numbers")(lambda x, a: F.regexp_count(unsigned(x), F.lit(r"\b\d+\b")) == number(a, "N"))
checker("ratio:overlap")(
    lambda x, a: F.abs(
        100.0 * F.size(F.array_intersect(trigrams(x), trigrams(a("reference_text")))) / F.greatest(F.size(F.array_union(trigrams(x), trigrams(a("reference_text")))), F.lit(1)) - number(a, "percentage")
    ) <= 2
)
checker("words:vowel")(lambda x, a: ~F.regexp_replace(x, r"(?U)^\s+|\s+\z", "").contains("\n") & (sum((F.lower(x).contains(v).cast("int") for v in "aeiou"), F.lit(0)) <= 3))
checker("words:consonants")(lambda x, a: F.forall(pieces(F.lower(x)), lambda w: w.rlike("[bcdfghjklmnpqrstvwxyz]{2}")))
checker("words:alphabet")(lambda x, a: let(F.transform(unpunctuated(F.lower(x)), lambda w: F.ascii(w)), lambda v: F.coalesce(nth(v, 1).between(97, 122), F.lit(False)) & neighbours(v, lambda p, q: q == F.when(p == 122, 97).otherwise(p + 1))))
checker("words:palindrome")(lambda x, a: F.size(F.filter(unpunctuated(F.lower(x)), lambda w: (F.length(w) >= 5) & (w == F.reverse(w)))) >= 10)
@checker("count:punctuation")
def _(x, a):
    """All six signs beside one pair of ? and !, or beside the sign that is both."""
    rest = F.when(x.contains("?!"), F.regexp_replace(x, r"(?s)\?!(.*)\z", "$1")).when(x.contains("!?"), F.regexp_replace(x, r"(?s)!\?(.*)\z", "$1")).otherwise(x)
    return let(rest, lambda r: F.forall(F.array(*[F.lit(p) for p in ".,!?;:"]), lambda p: r.contains(p))) & (x.contains("?!") | x.contains("!?") | x.contains("‽"))


checker("words:prime_lengths")(lambda x, a: F.forall(unpunctuated(x), lambda w: F.length(w).isin(*[p for p in range(2, 100) if all(p % q for q in range(2, p))])))
checker("format:options")(lambda x, a: F.exists(listed(a, "options"), lambda o: F.lower(F.trim(x)) == F.lower(F.trim(o))))
checker("format:newline")(lambda x, a: F.size(F.array_remove(F.split(F.regexp_replace(unsigned(x), r"(?U)^\s+|\s+\z", ""), "\n"), "")) == F.size(unpunctuated(x)))
checker("ratio:sentence_words")(lambda x, a: (F.size(sentences(x)) == 3) & (F.size(F.array_distinct(F.transform(sentences(x), F.length))) == 1))
checker("words:repeats")(lambda x, a: let(F.sort_array(unpunctuated(F.lower(x))), lambda v: F.forall(F.zip_with(F.slice(v, F.greatest(number(a, "small_n"), F.lit(0)) + 1, F.greatest(F.size(v), F.lit(1))), v, lambda p, q: F.coalesce(p != q, F.lit(True))), lambda b: b)))
checker("sentence:keyword")(lambda x, a: F.regexp_like(nth(sentences(x), number(a, "N")), F.concat(F.lit(r"(?iU)\b"), F.regexp_replace(a("word"), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b"))))
checker("words:last_first")(lambda x, a: neighbours(F.transform(sentences(x), lambda s: pieces(F.lower(s))), lambda p, q: F.coalesce(last_bare(p) == first_bare(q), F.lit(False))))
checker("words:paragraph_last_first")(lambda x, a: F.forall(F.transform(F.split(F.lower(x), "\n"), lambda s: pieces(edged(F.trim(s)))), lambda v: (F.size(v) == 0) | (nth(v, 1) == nth(v, -1))))
checker("sentence:increment")(lambda x, a: neighbours(F.transform(sentences(x), lambda s: F.size(unpunctuated(s))), lambda p, q: q == p + number(a, "small_n")))
checker("words:no_consecutive")(lambda x, a: neighbours(unpunctuated(F.lower(x)), lambda p, q: F.left(p, F.lit(1)) != F.left(q, F.lit(1))))
checker("format:line_indent")(lambda x, a: neighbours(lines(x), lambda p, q: F.length(q) - F.length(F.ltrim(q)) > F.length(p) - F.length(F.ltrim(p))))
checker("format:quote_unquote")(lambda x, a: let(F.regexp_replace(F.replace(x, F.lit("'\"'"), F.lit("")), r"(?U)\s", ""), lambda v: ~v.contains('""') & ~v.rlike(r'"[0-9\p{Punct}&&[^"]]*\z')))
checker("format:list")(lambda x, a: occurrences(x, a("sep")) >= 2)
checker("format:thesis")(lambda x, a: x.rlike(r"(?s)<(i|em)>.+?</(i|em)>\s*\S"))
checker("format:sub-bullets")(lambda x, a: x.contains("*") & F.forall(F.slice(F.split(x, r"\*"), F.lit(2), F.greatest(F.size(F.split(x, r"\*")) - 1, F.lit(0))), lambda p: p.contains("-")))
checker("custom:multiples")(lambda x, a: F.regexp_extract_all(x, F.lit(r"\d+"), 0) == F.array(*[F.lit(str(7 * k)) for k in range(2, 8)]))
checker("custom:character_reverse")(lambda x, a: F.lower(x).contains("elgae dlab"))
checker("custom:word_reverse")(lambda x, a: F.array_join(F.reverse(words(F.lower(x))), " ").contains("bald eagle"))
checker("custom:sentence_alphabet")(lambda x, a: (F.size(sentences(x)) == 26) & F.forall(F.sequence(F.lit(1), F.lit(26)), lambda i: F.coalesce(F.ascii(F.lower(F.try_element_at(sentences(x), i))) == 96 + i, F.lit(False))))
checker("custom:date_format_list")(lambda x, a: F.forall(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.left(d, F.lit(4)).try_cast("int").between(1769, 1821) & F.try_to_date(d).isNotNull()))
checker("count:keywords_multiple")(lambda x, a: sum(((occurrences(F.lower(x), F.lower(a(f"keyword{i}"))) == n).cast("int") for i, n in enumerate((1, 2, 3, 5, 7), 1)), F.lit(0)) == 5)
checker("words:keywords_specific_position")(lambda x, a: F.coalesce(F.lower(nth(F.regexp_extract_all(nth(sentences(x), number(a, "n")), F.lit(r"(?U)\w+|[^\w\s]"), 0), number(a, "m"))) == F.lower(a("keyword")), F.lit(False)))
checker("words:words_position")(lambda x, a: F.coalesce((F.lower(nth(words(x), 2)) == F.lower(a("keyword"))) & (F.lower(nth(words(x), -2)) == F.lower(a("keyword"))), F.lit(False)))
checker("repeat:repeat_change")(lambda x, a: (x != a("prompt_to_repeat")) & (F.slice(pieces(x), 2, 1 << 30) == F.slice(pieces(a("prompt_to_repeat")), 2, 1 << 30)))
checker("repeat:repeat_simple")(lambda x, a: F.lower(F.trim(x)) == F.lower(F.trim(a("description"))))
checker("repeat:repeat_span")(lambda x, a: F.trim(x) == F.array_join(F.slice(pieces(a("prompt_to_repeat")), number(a, "n_start", 0) + 1, F.greatest(number(a, "n_end", 0) - number(a, "n_start", 0), F.lit(0))), " "))
checker("format:title_case")(lambda x, a: ~F.exists(words(x), lambda w: w.rlike(r"^\p{Ll}$|^\p{Ll}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$|^\p{Ll}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")))
checker("format:output_template")(lambda x, a: x.contains("My Answer:") & x.contains("My Conclusion:") & x.contains("Future Outlook:"))
checker("format:no_whitespace")(lambda x, a: ~x.rlike(r"(?U)\s"))
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}]"


def emoji_ends(parts: Column) -> Column:
    """Whether each sentence without punctuation ends in an emoji, or but for one sign, or the next one begins with one."""
    own = lambda i: F.get(parts, i)
    following = lambda i: F.coalesce(F.get(parts, i + 1).rlike(f"^{EMOJI}"), F.lit(False))
    return F.forall(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (own(i) != "") & (own(i).rlike(rf"(?s){EMOJI}.?\z") | following(i)))


checker("format:emoji")(lambda x, a: let(F.transform(sentences(x), lambda s: stripped(F.regexp_replace(s, r"\p{Punct}", ""))), emoji_ends))
checker("count:words_japanese")(lambda x, a: F.forall(F.filter(F.transform(pieces(x), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: (s["i"] + 1) % number(a, "N") == 0), lambda s: s["w"].rlike(r"[\u3040-\u30ff\u4e00-\u9fff]")))
# The English stop words in common use, names of persons, capitals from north to south, the columns of tables.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom "
    "this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
PERSONS = (
    "Emma Liam Sophia Jackson Olivia Noah Ava Lucas Isabella Mason Mia Ethan Charlotte Alexander Amelia Benjamin Harper Leo Zoe Daniel Chloe Samuel Lily Matthew Grace Owen Abigail Gabriel Ella Jacob Scarlett Nathan "
    "Victoria Elijah Layla Nicholas Audrey David Hannah Christopher Penelope Thomas Nora Andrew Aria Joseph Claire Ryan Stella Jonathan"
).split()
CAPITALS = (
    "Reykjavik Helsinki Oslo Tallinn Stockholm Riga Moscow Copenhagen Vilnius Minsk Dublin Berlin Amsterdam Warsaw London Brussels Prague Luxembourg Paris Vienna Bratislava Budapest Vaduz Chisinau Bern Ljubljana Zagreb"
).split()
CITIES, PRODUCTS, STUDENTS = ("ID", "Country", "City", "Year", "Count"), ("ProductID", "Category", "Brand", "Price", "Stock"), ("StudentID", "Subject", "Grade", "Semester", "Score")
# Letters whose compatibility decomposition has one ASCII character, and those characters.
_ASCII = {c: d for c in map(chr, range(128, 0x10000)) if len(d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
ODD, SIMPLE = "\ue000", "\ue001"


def ascii_only(x: Column) -> Column:
    """Without marks on letters; other characters beyond ASCII go, also the few that stand for several."""
    return F.regexp_replace(F.translate(x, "".join(_ASCII), "".join(_ASCII.values())), r"[^\x00-\x7f]", "")


def cells(x: Column, separator: str) -> Column:
    """The rows of a table of separated values, as arrays of cells. Cells in double quotes become one character, ODD if they hold a sign, else SIMPLE."""
    start, rest = rf"(?<![^\r\n{separator}])\"", r'[^"]*+(?:""[^"]*+)*+"'
    marked = F.regexp_replace(F.regexp_replace(x, start + r'(?=[^"\n]*(?:[^\w\s"]|"")[^\n]*")' + rest, ODD), start + rest, SIMPLE)
    return F.transform(F.split(F.regexp_replace(marked, r"\r?\n\z", ""), r"\r\n|\r|\n"), lambda r: F.when(r == "", F.array().cast("array<string>")).otherwise(F.split(r, separator)))


def headed(x: Column, names: tuple[str, ...], between: str) -> Column:
    return F.trim(F.split(x, "\n")[0]).rlike("^\\s*" + between.join(f'(?:{n}|"{n}")' for n in names) + "\\s*$")


checker("ratio:stop_words")(lambda x, a: (F.size(words(x)) > 0) & (100.0 * F.size(F.filter(words(F.lower(x)), lambda w: w.isin(*STOP_WORDS))) / F.size(words(x)) <= number(a, "percentage")))
checker("count:person_names")(lambda x, a: F.size(F.array_intersect(words(x), F.array(*map(F.lit, PERSONS)))) >= number(a, "N"))


@checker("sentence:alliteration_increment")
def _(x, a):
    """A sentence scores the words that stand in runs of the same first letter; each must score more than the one before."""
    letters = lambda s: F.array_join(F.transform(F.array_remove(F.transform(pieces(F.lower(s)), lambda w: F.regexp_replace(w, r"^[\p{Punct} ]+", "")), ""), lambda w: F.left(w, F.lit(1))), "")
    return neighbours(F.transform(F.transform(sentences(x), letters), lambda r: F.length(r) - F.length(F.regexp_replace(r, r"(?s)(.)\1+", ""))), lambda p, q: q > p)


@checker("format:parentheses")
def _(x, a):
    """Five brackets deep and then closed rightly. A wrong bracket starts anew; beyond five only the innermost one counts, so the state is short."""

    def step(open_, c):
        closed = F.when(F.right(open_, F.lit(1)) != F.translate(c, ")]}", "([{"), "").when(F.length(open_) == 5, "done").otherwise(F.left(open_, F.length(open_) - 1))
        return F.when(open_ == "done", open_).when(c.isin("(", "[", "{"), F.concat(F.left(open_, F.lit(4)), c)).otherwise(F.when(open_ == "", "").otherwise(closed))

    return F.aggregate(F.regexp_extract_all(x, F.lit(r"[()\[\]{}]"), 0), F.lit(""), step) == "done"


@checker("format:quotes")
def _(x, a):
    """Double and single quotes that alternate inside each other; three levels closed below the deepest."""

    def step(s, c):
        top = F.when(s["depth"] % 2 == 1, s["outer"]).otherwise(F.translate(s["outer"], "\"'", "'\""))
        shut = (s["depth"] > 0) & (c == top)
        depth = s["depth"] + F.when(shut, -1).otherwise(1)
        deepest = F.greatest(s["deepest"], depth)
        return F.struct(F.when(s["depth"] == 0, c).otherwise(s["outer"]).alias("outer"), depth.alias("depth"), deepest.alias("deepest"), (s["done"] | (shut & (deepest - depth >= 3))).alias("done"))

    return F.aggregate(F.regexp_extract_all(x, F.lit("[\"']"), 0), F.struct(F.lit("").alias("outer"), F.lit(0).alias("depth"), F.lit(0).alias("deepest"), F.lit(False).alias("done")), step, lambda s: s["done"])


@checker("format:no_bullets_bullets")
def _(x, a):
    """Lines with two sentences or more in all, then nothing but two lines or more that start with a star. A line without a sentence may only be the last of the first part."""
    every = F.split(x, "\n")
    first = F.array_position(F.transform(every, lambda s: F.trim(s).startswith("*")), F.lit(True)).cast("int")
    said = F.transform(F.slice(every, 1, F.greatest(first - 1, F.lit(0))), lambda s: F.size(sentences(s)))
    starred = F.size(F.filter(every, lambda s: F.trim(s).startswith("*")))
    return (starred >= 2) & (starred == F.size(every) - first + 1) & (F.aggregate(said, F.lit(0), lambda n, m: n + m) >= 2) & F.forall(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), lambda n: n > 0)


@checker("custom:mcq_count_length")
def _(x, a):
    """Four questions, each with five options, from the shortest to the longest; nothing before the first."""
    asked = F.filter(F.transform(F.split(x, r"\n*Question \d+[.|):;]?\s*"), lambda s: F.trim(s)), lambda q: ~q.rlike(r"(?U)^\s*$"))
    rows = F.transform(asked, lambda q: F.transform(F.split(q, "\n"), lambda s: F.trim(s)))
    option = lambda s: s.rlike(r"(?U)^[A-Ea-e][.|)]\s*\w")
    before = lambda r: F.slice(r, 1, F.greatest(F.array_position(F.transform(r, option), F.lit(True)).cast("int") - 1, F.lit(0)))
    return x.startswith("Question") & (F.size(rows) == 4) & F.forall(rows, lambda r: F.size(F.filter(r, option)) == 5) & neighbours(F.transform(rows, lambda r: F.length(F.trim(F.array_join(before(r), " ")))), lambda p, q: p < q)


@checker("custom:reverse_newline")
def _(x, a):
    """From the first line that names Zimbabwe, 52 lines or more in falling order, whatever the marks on letters."""
    rows = F.array_remove(F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"^[\p{Punct} ]+|[\p{Punct} ]+$", "")), "")
    first = F.array_position(F.transform(rows, lambda s: s.contains("Zimbabwe")), F.lit(True)).cast("int")
    return (first > 0) & (F.size(rows) - first + 1 >= 52) & neighbours(F.transform(F.slice(rows, F.greatest(first, F.lit(1)), F.greatest(F.size(rows), F.lit(1))), ascii_only), lambda p, q: p >= q)


checker("custom:european_capitals_sort")(lambda x, a: F.array_remove(F.transform(F.split(ascii_only(x), ","), lambda s: F.trim(s)), "") == F.array(*map(F.lit, CAPITALS)))
checker("custom:csv_city")(lambda x, a: F.split(x, r"\r?\n")[0].rlike("^" + ",".join(f'(?:{n}|"{n}")' for n in CITIES) + "$") & (F.size(cells(x, ",")) == 8) & F.forall(cells(x, ","), lambda r: F.size(r) == 5))


@checker("custom:csv_special_character")
def _(x, a):
    """Fifteen rows. Of those after the head, the first that has not five cells or has a quoted cell with a sign decides."""
    odd = lambda r: F.exists(r, lambda c: c.startswith(ODD))
    first = F.filter(F.slice(cells(x, ","), 2, 14), lambda r: (F.size(r) != 5) | odd(r))
    return headed(x, PRODUCTS, r",[ \t]*") & (F.size(cells(x, ",")) == 15) & F.coalesce((F.size(nth(first, 1)) == 5) & odd(nth(first, 1)), F.lit(False))


checker("custom:csv_quotes")(
    lambda x, a: headed(x, STUDENTS, "\t *") & (F.size(cells(x, "\t")) == 4) & F.forall(cells(x, "\t"), lambda r: (F.size(r) == 5) & F.forall(r, lambda c: F.trim(c).rlike(f'^["{ODD}{SIMPLE}](.*["{ODD}{SIMPLE}])?$')))
)
IDS = frozenset(CHECKERS)


def trigrams(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit("(?s)(?=(...))"), 1))


def check(text: Column, instruction: Column, arguments: Column, ids: list[str] | None = None) -> Column:
    """Whether the text follows the instruction; null for an id that isn't known. Only the given ids enter the plan."""
    a = lambda name: F.try_element_at(arguments, F.lit(name))
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    out = F.lit(None).cast("boolean")
    for i in ids or sorted(CHECKERS):
        out = F.when(instruction == i, ~blank & F.coalesce(CHECKERS[i](text, a), F.lit(False))).otherwise(out)
    return out


def fixed(arguments: dict[str, str]):
    """Arguments that are the same for all rows, as checkers ask for them."""
    return lambda name: F.lit(arguments.get(name)).cast("string")


def check_each(df: DataFrame, text: str, cases: list[tuple[str, dict[str, str]]], verdict: Callable | None = None) -> DataFrame:
    """One row a row and case, with id and passed: every text against a fixed list of (id, arguments).

    A text is read once and judged for all cases before they become rows, so no copy of it is made for a case. Its words,
    sentences and other parts that cases ask for are worked out once, in columns before the cases.
    verdict(text, id, arguments) gives the column of a case; by default that of check(). Each case is a function of
    the text that isn't compiled with the others: what they cost is the patterns, and all together are too large a method.
    """

    def own(t: Column, instruction: str, arguments) -> Column:
        if instruction not in CHECKERS:
            return F.lit(None).cast("boolean")
        return (F.coalesce(F.trim(t), F.lit("")) != "") & F.coalesce(CHECKERS[instruction](t, arguments), F.lit(False))

    t = F.col("_text")
    case = lambda i, args: let(F.lit(0), lambda _: (verdict or own)(t, i, fixed(args)))
    with sharing(*[f(x) for x in (t, stripped(t)) for f in (lambda x: x, F.lower)]) as parts:
        every = F.array(*[F.struct(F.lit(i).alias("id"), case(i, args).alias("passed")) for i, args in cases])
    rows = df.select(*df.columns, F.col(text).alias("_text"))
    for (kind, of), made in list(parts.items()):  # a part may be made of one that comes before it
        rows = rows.withColumn(shared_name(kind, of, parts), made)
    judged = rows.select(*df.columns, every.alias("_cases"))
    dealt = F.explode_outer if cases else F.explode  # the plain one brings a filter on the array's size that works out all cases a second time
    return judged.select(*df.columns, dealt("_cases").alias("_case")).select(*df.columns, "_case.id", "_case.passed")


def supported_only(ids: Column) -> Column:
    """Whether there are ids and all are known."""
    return (F.size(ids) > 0) & F.forall(ids, lambda i: i.isin(*sorted(IDS)))


def fold(passed: Column) -> Column:
    """Struct of an array of results: num_constraints, num_supported, num_satisfied, soft, strict (null without a supported one)."""
    known, good = F.size(F.filter(passed, lambda p: p.isNotNull())), F.size(F.filter(passed, lambda p: F.coalesce(p, F.lit(False))))
    return F.struct(F.size(passed).alias("num_constraints"), known.alias("num_supported"), good.alias("num_satisfied"), F.try_divide(good.cast("double"), known).alias("soft"), F.when(known > 0, (good == known)).alias("strict"))
