"""Checkers on small cases, with the verdicts that the reference's rules give."""

from pyspark.sql import functions as F

from tallyloom.functions import checkers as C
from tallyloom.functions import verifiers as W

QUIZ = "\n\n".join(f"Question {n}: Which {q}?\n" + "\n".join(f"{c}. {c.lower()}" for c in "ABCDE") for n, q in enumerate(("x", "xx", "xxx", "xxxx"), 1))

CASES = [
    ("count:count_unique", {"N": "2"}, "a a b", True), ("count:count_unique", {"N": "3"}, "a a b", False), ("count:count_unique", {"count": "2", "relation": "at most"}, "a A b", True), ("count:count_unique", {}, "a b", False),
    ("letters:letter_counting", {"N": "3", "letter": "e"}, "eel and ewe", True), ("letters:letter_counting2", {"let_frequency": "3", "letter": "x", "let_relation": "less than"}, "axxe", True), ("letters:letter_counting", {"N": "3", "letter": "x"}, "axxe", False),
    ("count:lowercase_counting", {"N": "3"}, "abcd E", True), ("count:lowercase_counting", {"N": "3", "relation": "at most"}, "abcd E", False), ("count:lowercase_counting", {"num_lowercase": "4"}, "abc", False), ("count:lowercase_counting", {}, "abc", False),
    ("count:counting_composition", {"N": "4"}, "one two three", False), ("count:counting_composition", {"count": "3", "relation": "exactly"}, "one two three", True), ("count:counting_composition", {"n_words": "1"}, "one two", False),
    ("count:counting_composition", {"N": "20", "relation": "around"}, "w " * 22, True), ("count:counting_composition", {"N": "20", "relation": "around"}, "w " * 23, False), ("count:counting_composition", {"N": "2", "relation": "no more than"}, "a b c", False),
    ("count:count_increment_word", {"keyword": "go", "N": "2"}, "Go, go", True), ("count:count_increment_word", {"word": "go", "count": "3"}, "go go", False), ("count:count_increment_word", {"keyword": "go"}, "go", False),
    ("detectable_format:bigram_wrapping", {"bigram": "big cat"}, "a [big cat]", True), ("detectable_format:bigram_wrapping", {"bigram": "big cat"}, "a (big cat)", True), ("detectable_format:bigram_wrapping", {"bigram": "big cat"}, "<<big cat>>", False), ("detectable_format:bigram_wrapping", {}, "[x y]", True),
    ("copy:copying_multiple", {"prompt_to_repeat": "hi"}, "hi", False), ("copy:copying_multiple", {"prompt_to_repeat": "hi", "n": "3"}, "hi hi hi", True),
    ("paragraphs:paragraphs", {"N": "3"}, "a\n\nb\n\nc", True), ("paragraphs:paragraphs2", {}, "a\n\nb", False),
    ("keywords:word_count_different_numbers", {"keyword": "a", "frequency": "1", "relation": "at least"}, "a a", False), ("keywords:word_count_different_numbers", {"keyword_count_map": '{"a": 2, "b": 1}'}, "a A b", True), ("keywords:word_count_different_numbers", {"keyword_count_map": '{"a": 2, "b": 2}'}, "a A b", False),
    ("keywords:palindrome", {}, "x", False), ("keywords:palindrome", {}, "Never odd, or even", True), ("keywords:palindrome", {}, "é aa", True),
    ("keywords:keyword_specific_position", {"keyword": "b", "n": "2", "m": "1"}, "a. _b_ c.", True), ("keywords:keyword_specific_position", {"keyword": "a"}, "a b.", False), ("keywords:keyword_specific_position", {"keyword": "a", "n": "0", "m": "1"}, "a b.", False),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "Say it. It.", True), ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "say it", False), ("combination:repeat_prompt", {}, "x", False),
    ("startend:end_checker", {"end_phrase": "The end."}, "x The end.", True), ("startend:end_checker", {"end_phrase": "The end."}, "x the end.", False), ("startend:end_checker", {"end_phrase": ""}, "x", False),
    ("copy:repeat_phrase", {"phrase": "ab"}, "ab ab", True), ("copy:repeat_phrase", {"phrase": "ab"}, "ab", False), ("copy:repeat_phrase", {"prompt_to_repeat": "ab", "N": "1"}, "ab", True), ("copy:repeat_phrase", {}, "ab", False),
    ("new:copy_span_idx", {"source_text": "abcdef", "start": "2", "end": "4"}, "x cd y", True), ("new:copy_span_idx", {"copy_span": "zz"}, "x cd y", False), ("new:copy_span_idx", {"source_text": "abc"}, "abc", False),
    ("detectable_format:sentence_hyphens", {}, "one. -two a - b", True), ("detectable_format:sentence_hyphens", {}, "one.-2", False),
    ("keywords:no_adjacent_consecutive", {"keyword": "go"}, "gogo", False), ("keywords:no_adjacent_consecutive", {"keyword": "go"}, "go go", True), ("keywords:no_adjacent_consecutive", {}, "x", True),
    ("change_case:english_capital", {}, "ABC 12!", True), ("change_case:english_capital", {}, "12", False), ("change_case:english_lowercase", {}, "ab\u00df 1", True), ("change_case:english_lowercase", {}, "aB", False),
    ("detectable_format:json_format", {}, '{"a": 1}', True), ("detectable_format:json_format", {}, '```json\n{}\n```', False), ("startend:quotation", {}, '"a"', True), ("startend:quotation", {}, ' "a"', True),
    ("detectable_format:constrained_response", {}, " my answer is Maybe.\n", True), ("copy:copying_simple", {}, "x", False),
    ("keywords:start_end", {}, "word", False), ("keywords:start_end", {}, "Word a word.", True),
    ("copy:copy", {"prompt_to_repeat": "a b"}, "x a b", True), ("first_word:first_word_answer", {"first_word": "so"}, "So it is", True), ("first_word:first_word_sent", {"first_word": "a"}, "A b. A c. D", False), ("last_word:last_word_answer", {"last_word": "end"}, "the End.", True),
    ("last_word:last_word_sent", {"last_word": "x"}, "a x. b X!", True), ("length_constraints:number_paragraphs", {"num_paragraphs": "2"}, "a\n***\nb", True), ("length_constraints:number_sentences", {"num_sentences": "2", "relation": "less than"}, "A. B.", False),
    ("punctuation:punctuation_dot", {}, "A. B.", True), ("punctuation:punctuation_dot", {}, "A! B.", False), ("punctuation:punctuation_exclamation", {}, "A! B!", True), ("repeat:repeat_change", {"prompt_to_repeat": "a b c"}, "x b c", True), ("repeat:repeat_change", {"prompt_to_repeat": "a b c"}, "a b c", False),
    ("repeat:repeat_span", {"prompt_to_repeat": "a b c d", "n_start": "1", "n_end": "3"}, "b c", True), ("words:keywords_specific_position", {"keyword": "b", "n": "2", "m": "3"}, "A. x, B.", True), ("format:options", {"options": '["yes", "no"]'}, " YES ", True), ("format:options", {"options": '["yes", "no"]'}, "maybe", False),
    ("format:line_indent", {}, "a\n b\n  c", True), ("format:line_indent", {}, "a\n b\n c", False), ("format:sub-bullets", {}, "* a\n - b\n* c\n - d", True), ("format:sub-bullets", {}, "* a\n* c\n - d", False), ("combination:two_responses", {}, "a******b", True), ("combination:two_responses", {}, "a******a", False),
    ("custom:sentence_alphabet", {}, " ".join(f"{c} x." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), True), ("custom:sentence_alphabet", {}, "A x. B x.", False), ("count:words_japanese", {"N": "2"}, "a \u3042 b \u4e2d", True), ("count:words_japanese", {"N": "2"}, "a b", False),
    ("count:keywords_multiple", {f"keyword{i}": f"k{i}" for i in range(1, 6)}, "k1 " + "k2 " * 2 + "k3 " * 3 + "k4 " * 5 + "k5 " * 7, True), ("count:keywords_multiple", {f"keyword{i}": f"k{i}" for i in range(1, 6)}, "k1 k2", False),
    ("words:repeats", {"small_n": "2"}, "a b A", True), ("words:repeats", {"small_n": "2"}, "a b A a", False), ("words:repeats", {}, "a b", True), ("words:repeats", {}, "a b a", False),
    ("ratio:overlap", {"reference_text": "abcde", "percentage": "50"}, "abcdxy", False), ("ratio:overlap", {"reference_text": "abcd", "percentage": "67"}, "abcde", True), ("ratio:overlap", {"reference_text": "abc", "percentage": "1"}, "ab", True),
    ("words:alphabet", {}, "yes zoo a big", True), ("words:alphabet", {}, "a big dog", False), ("words:no_consecutive", {}, "a big bad", False), ("words:no_consecutive", {}, "one", True), ("sentence:increment", {"small_n": "1"}, "a. b c. d e f.", True), ("sentence:increment", {"small_n": "1"}, "a. b c. d e.", False),
    ("words:last_first", {}, "One two.  Two three. Three x!", True), ("words:last_first", {}, "One two. Three two.", False), ("custom:date_format_list", {}, "1769-08-15, 1821-05-05", True), ("custom:date_format_list", {}, "1769-08-15, 1821-13-05", False),
    ("count:conjunctions", {"small_n": "2"}, "and And x", True), ("count:conjunctions", {"small_n": "2"}, "a and b and c", False), ("words:vowel", {}, "a\n\n", True), ("words:vowel", {}, "a\nb", False), ("words:alphabet", {}, "1 a", False),
    ("count:punctuation", {}, "a. b, c! d? e; f: ?!", True), ("count:punctuation", {}, "a. b, c! e; f: ?!", False), ("format:newline", {}, "a-b\nc!", True), ("format:newline", {}, "a b", False), ("sentence:keyword", {"N": "2", "word": "c++"}, "a. b c++x.", True), ("sentence:keyword", {"N": "3", "word": "a"}, "a. b.", False),
    ("count:pronouns", {"N": "3"}, "Those/these are what", True), ("words:paragraph_last_first", {}, "(One two one!)\n\nB b", True), ("words:paragraph_last_first", {}, "One two", False), ("words:paragraph_last_first", {}, "one x One's", False),
    ("format:quote_unquote", {}, "plain", True), ("format:quote_unquote", {}, 'a "b" c', True), ("format:quote_unquote", {}, 'a "b".', False), ("format:quote_unquote", {}, 'a "b" "c" d', False), ("format:title_case", {}, "A Big aBc 1x", True), ("format:title_case", {}, "A big", False), ("format:title_case", {}, "A aBC", False),
    ("words:no_consecutive", {}, "don't n", True), ("sentence:increment", {"small_n": "1"}, "a-b. it's so.", True), ("words:last_first", {}, "a. ... b.", False),
    ("count:person_names", {"N": "2"}, "Emma met Liam and Emma.", True), ("count:person_names", {"N": "2"}, "Emmas met Liam and Liam.", False),
    ("ratio:stop_words", {"percentage": "50"}, "The cat shouldn't sleep", False), ("ratio:stop_words", {"percentage": "50"}, "The cats sleep", True), ("ratio:stop_words", {"percentage": "50"}, "...", False),
    ("sentence:alliteration_increment", {}, "One two. Big bad wolf. Some sad (six songs.", True), ("sentence:alliteration_increment", {}, "Big bad wolf. Cold cat.", False), ("sentence:alliteration_increment", {}, "Big bad bee. Aa ab xx bb bc.", True),
    ("format:parentheses", {}, "([{([x])}])", True), ("format:parentheses", {}, "([{(x)}])", False), ("format:parentheses", {}, "([{([x)", False), ("format:parentheses", {}, "((((((]", False), ("format:parentheses", {}, ")(((((( )", True), ("format:parentheses", {}, "()()()()()()", False),
    ("format:quotes", {}, "\"a 'b \"c\" d' e\"", True), ("format:quotes", {}, "\"a 'b' c\"", False), ("format:quotes", {}, "'a' 'b' 'c' 'd'", False), ("format:quotes", {}, "'a \"b 'c' d\" e'", True), ("format:quotes", {}, "'a \"b 'c' d", False),
    ("format:no_bullets_bullets", {}, "One. Two.\n* a\n* b", True), ("format:no_bullets_bullets", {}, "One. Two.\n* a\n* b\n", False), ("format:no_bullets_bullets", {}, "One.\n\n* a\n* b", False), ("format:no_bullets_bullets", {}, "One. Two.\n\n* a\n* b", True),
    ("format:no_bullets_bullets", {}, "One. Two.\n\nThree.\n* a\n* b", False), ("format:no_bullets_bullets", {}, "One. Two.\n* a", False), ("format:no_bullets_bullets", {}, "* a\n* b", False),
    ("custom:mcq_count_length", {}, QUIZ, True), ("custom:mcq_count_length", {}, "Here: " + QUIZ, False), ("custom:mcq_count_length", {}, QUIZ.replace("E. e", ""), False), ("custom:mcq_count_length", {}, QUIZ.replace("xxx", "x"), False),
    ("custom:reverse_newline", {}, "So:\nZimbabwe\n" + "\n".join(f"- C{n:02d}" for n in range(60, 8, -1)), True), ("custom:reverse_newline", {}, "Zimbabwe\nS\u00e3o\nSap\n" + "\n".join(f"C{n:02d}" for n in range(60, 8, -1)), False),
    ("custom:reverse_newline", {}, "Zimbabwe\nS\u00e3p\nSao\n" + "\n".join(f"C{n:02d}" for n in range(60, 8, -1)), True), ("custom:reverse_newline", {}, "Zimbabwe\nA", False),
    ("custom:european_capitals_sort", {}, ", ".join(C.CAPITALS).replace("Chisinau", "Chi\u0219in\u0103u"), True), ("custom:european_capitals_sort", {}, ", ".join(C.CAPITALS[1:]), False),
    ("custom:csv_city", {}, "ID,Country,City,Year,Count\n" + '1,"A, b",c,"x\ny",5\n' * 7, True), ("custom:csv_city", {}, "ID,Country,City,Year,Count\n" + "1,A,c,2,5\n" * 6, False), ("custom:csv_city", {}, "ID,Country,City,Year,Count\n" + "1,A,c,2\n" * 7, False),
    ("custom:csv_city", {}, "ID,Country,City,Year,Count\n\n" + "1,A,c,2,5\n" * 6, False),
    ("custom:csv_special_character", {}, "ProductID, Category,Brand,Price,Stock\n" + "1,a,b,2,3\n" * 13 + '1,"a & b",c,2,3', True), ("custom:csv_special_character", {}, "ProductID,Category,Brand,Price,Stock\n" + "1,a,b,2,3\n" * 13 + '1,"a b",c,2,3', False),
    ("custom:csv_special_character", {}, "ProductID,Category,Brand,Price,Stock\n" + "1,a\n" + "1,a,b,2,3\n" * 12 + '1,"a & b",c,2,3', False),
    ("custom:csv_quotes", {}, "\n".join(['"StudentID"\t"Subject"\t"Grade"\t"Semester"\t"Score"'] + ['"1"\t"a b"\t"c"\t"d"\t"e"'] * 3), True), ("custom:csv_quotes", {}, "\n".join(['"StudentID"\t"Subject"\t"Grade"\t"Semester"\t"Score"'] + ['"1"\ta\t"c"\t"d"\t"e"'] * 3), False),
    ("detectable_format:json_format", {}, "{} x", False), ("detectable_format:json_format", {}, "[1]], 2", False), ("detectable_format:json_format", {}, '{"a": [1, "]"]}', True),
    ("detectable_content:postscript", {}, "then p.s. more", False), ("detectable_content:postscript", {}, "then P.S. more", True), ("detectable_content:postscript", {"postscript_marker": ""}, "P.S.", True),
    ("length_constraints:nth_paragraph_first_word", {"nth_paragraph": "2", "first_word": "Two"}, "one x\n***\n_two_ y", True), ("length_constraints:nth_paragraph_first_word", {"nth_paragraph": "3", "first_word": "Two"}, "one x * * * two y", False),
    ("length_constraints:nth_paragraph_first_word", {"first_word": "one"}, "one", False), ("length_constraints:number_paragraphs", {"num_paragraphs": "3"}, "a * * * b\n*** \nc", True), ("length_constraints:number_paragraphs", {"num_paragraphs": "2"}, "a\n\nb", False),
    ("length_constraints:number_words", {}, "a b", False), ("keywords:frequency", {"keyword": "a"}, "a", False), ("keywords:letter_frequency", {"letter": "a", "frequency": "1", "relation": "less than"}, "b", True), ("letters:letter_counting", {"N": "1"}, "abc", False),
    ("detectable_format:number_bullet_lists", {"num_bullets": "1"}, "-\nfoo\n* a", True), ("keywords:existence", {"keyword": "Cat"}, "a cat", True), ("keywords:existence", {}, "a", True), ("keywords:forbidden_words", {"keyword": "cat"}, "a Cat", False),
    ("first_word:first_word_sent", {"first_word": "so"}, "_So it is. So.", True), ("startend:end_checker", {"end_phrase": "end"}, "the end \n", True), ("custom:word_reverse", {}, "eagle bald the is it", True), ("custom:word_reverse", {}, "bald eagle", False),
    ("format:emoji", {}, "Hi there \U0001F600", True), ("format:emoji", {}, "Hi \U0001F600. there", False), ("format:emoji", {}, "Hi \U0001F600!!", True), ("format:emoji", {}, "Hi. \U0001F600 there \U0001F600", True), ("format:emoji", {}, "Hi. ... \U0001F600", False), ("format:emoji", {}, "One. Two \U0001F600", False), ("language:response_language", {"language": "ru"}, "\u043f\u0440\u0438\u0432\u0435\u0442", True), ("language:response_language", {"language": "ru"}, "hello", False),
]


def test_checkers_follow_the_reference(spark):
    rows = spark.createDataFrame([(k, i, a, t) for k, (i, a, t, _) in enumerate(CASES)], "k int, id string, args map<string,string>, text string")
    got = dict(rows.select("k", C.check(F.col("text"), F.col("id"), F.col("args"), sorted({c[0] for c in CASES}))).collect())
    assert [(*c[:3], got[k]) for k, c in enumerate(CASES) if got[k] is not c[3]] == []


L, R = "lenient", "reasoned"
OTHER = [
    (L, "punctuation:no_comma", {}, "a，b", True), (R, "punctuation:no_comma", {}, "a，b", False), (L, "punctuation:no_comma", {}, None, True),
    (L, "length_constraint_checkers:number_words", {}, "a", None), (L, "length_constraint_checkers:number_words", {"num_words": "2", "relation": "at most"}, "a-b it's", True), (L, "length_constraint_checkers:number_words", {"num_words": "2"}, "a b c", False),
    (L, "length_constraint_checkers:number_words", {"min_words": "2", "num_words_max": "3"}, "a b c d", False), (L, "length_constraint_checkers:number_words", {"num_words": "many"}, "a", True), (L, "length_constraint_checkers:number_words", {"min_words": "0", "num_words_lower": "2"}, "a", False),
    (R, "length_constraint_checkers:number_words", {}, "w " * 200, True), (R, "length_constraint_checkers:number_words", {}, "w " * 201, False), (R, "length_constraint_checkers:number_words", {"num_words": "2", "relation": "less than"}, "it's", False),
    (R, "length_constraint_checkers:number_words", {"num_words": "2", "relation": "at least"}, "it's", True), (R, "length_constraint_checkers:number_words", {"min_words": "x", "num_words": "1"}, "a b", False),
    (L, "language:reasoning_language", {"language": "en"}, "a" * 20, True), (L, "language:reasoning_language", {"language": "en"}, "a" * 20 + "\u00e9" * 5, False), (L, "language:response_language", {"language": "German"}, "a" * 50 + "\u00dc", True),
    (L, "language:response_language", {"language": "xx"}, "a", None), (L, "language:response_language", {}, "a", None), (L, "language:reasoning_language", {"language": "zh"}, "\u4e2d" * 20 + "a" * 42, False),
    (R, "language:reasoning_language", {}, "", True), (R, "language:reasoning_language", {"language": "english"}, "1", False), (R, "language:reasoning_language", {"language": "Japanese"}, "\u3042" * 20 + "a" * 30, True),
    (R, "language:reasoning_language", {"language": "English"}, "a" * 30 + "\u4e2d" * 21, False), (R, "language:reasoning_language", {"language": "klingon"}, "a", True), (R, "language:response_language", {"language": "klingon"}, "a", None),
    (L, "startend:end_checker", {"ending": "The  end."}, 'x the end."', True), (L, "startend:end_checker", {}, "x", None), (R, "startend:end_checker", {}, "x", True), (R, "startend:end_checker", {"suffix": "End"}, "the End \n", True), (R, "startend:end_checker", {"suffix": "End"}, "the end", False),
    (L, "startend:quotation", {}, " \u201chi\u201d ", True), (L, "startend:quotation", {}, "", False), (L, "startend:quotation", {}, "hi", False),
    (L, "detectable_format:json_format", {}, "x ```JSON {\"a\": 1}```", True), (L, "detectable_format:json_format", {}, "3", False), (L, "detectable_format:json_format", {}, "x {}", False),
    (R, "detectable_format:json_format", {}, "3", True), (R, "detectable_format:json_format", {}, "so {\"a\": 1} it is", True), (R, "detectable_format:json_format", {}, "```json\n[1]\n```", True), (R, "detectable_format:json_format", {}, "{a}", False), (R, "detectable_format:json_format", {}, "", False),
    (L, "detectable_format:number_highlighted_sections", {"count": "2"}, "**a** and *b*", True), (L, "detectable_format:number_highlighted_sections", {"count": "2"}, "**a**", False),
    (L, "detectable_format:number_bullet_lists", {"num_bullets": "3"}, "- a\n2) b\n + c", True), (L, "detectable_format:number_bullet_lists", {"num_bullets": "3"}, "-a\n2 b", False),
    (L, "detectable_format:multiple_sections", {}, "# a\nSection 2", True), (L, "detectable_format:multiple_sections", {}, "# a", False),
    (L, "change_case:english_capital", {}, "A" * 19 + "b", True), (L, "change_case:english_capital", {}, "1", False), (R, "change_case:english_capital", {}, "A" * 19 + "b", False), (R, "change_case:english_capital", {}, "A \u00e9", True), (L, "change_case:english_lowercase", {}, "aaB", False),
    (L, "change_case:capital_word_frequency", {"frequency": "2"}, "ABC I D-F", True), (L, "change_case:capital_word_frequency", {"num": "1", "relation": "less than"}, "ABC DE", False),
    (L, "keywords:frequency", {"word": "c++x", "count": "1", "relation": "exactly"}, "use C++x now", True), (L, "keywords:frequency", {}, "a", None), (L, "keywords:frequency", {"word": "a", "num": "2", "relation": "less than"}, "a A", False), (L, "keywords:frequency", {"keyword": "an"}, "and", False),
    (L, "keywords:existence", {"required": "Cat"}, "a cat", True), (L, "keywords:existence", {"keywords": "[]"}, "a", None), (L, "keywords:existence", {"keywords": '["a", "b"]'}, "a", False), (L, "keywords:forbidden_words", {"avoid": '["a"]'}, "bcd", True), (L, "keywords:forbidden_words", {}, "a", None),
    (L, "combination:repeat_prompt", {"request": "say  it"}, "I say\nit", True), (L, "combination:repeat_prompt", {"request": "say it"}, "Say it", False), (L, "none:such", {}, "a", None), (R, "none:such", {}, "a", None),
]


def test_verifiers_follow_the_reference(spark):
    rows = spark.createDataFrame([(k, w, i, a, t) for k, (w, i, a, t, _) in enumerate(OTHER)], "k int, which string, id string, args map<string,string>, text string")
    sets = {L: W.LENIENT, R: W.REASONED}
    got = {}
    for name, rules in sets.items():
        got |= dict(rows.where(F.col("which") == name).select("k", W.verify(rules, F.col("text"), F.col("id"), F.col("args"))).collect())
    assert [(*c[:4], got[k]) for k, c in enumerate(OTHER) if got[k] is not c[4]] == []


def test_strict_first(spark):
    cases = [("combination:repeat_prompt", {"prompt_to_repeat": "b"}, "a b", False, "vendored"), ("punctuation:no_comma", {}, "a,b", False, "vendored"), ("none:such", {}, "a", None, "unsupported"), ("length_constraint_checkers:number_words", {"max_words": "1"}, "a", True, "fallback")]
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, id string, args map<string,string>, text string")
    got = {r[0]: r[1] for r in rows.select("k", W.strict_first(F.col("text"), F.col("id"), F.col("args"), [c[0] for c in cases])).collect()}
    assert [(got[k]["passed"], got[k]["rule"]) for k in range(len(cases))] == [c[3:] for c in cases]


def test_checker_queries_without_a_text(spark):
    """As in the queries' SQL: null without a text but for what can't pass, and an empty text has no comma."""
    from tallyloom.plans import texts

    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.id, r.passed) for r in texts.C.check_each(rows, "text", [c[:2] for c in texts.CASES], texts._verdict).collect()}
    assert {i for d, i, passed in got if d == 1 and passed is False} == {*texts._CLOSED, "detectable_content:number_placeholders"}
    assert (1, "detectable_content:number_placeholders", None) in got and (1, "punctuation:no_comma", None) in got
    assert (2, "punctuation:no_comma", True) in got and (2, "totally:unknown", None) in got


def test_languages_without_lists_of_signs(spark):
    """Letters are counted by lengths, over all scripts and planes, and not by a list of the single ones."""
    texts = ["a" * 20, "a" * 19, "a" * 30 + "я" * 20, "a" * 30 + "я" * 21, "𝒜" * 40 + "b" * 20, "", "12", None, "漢" * 20 + "a" * 30, "漢" * 20 + "a" * 31]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    told = lambda language: df.select("i", W.REASONED["language:reasoning_language"](F.coalesce("t", F.lit("")), lambda n: F.lit(language if n == "language" else None).cast("string")).alias("p"))
    assert {r.i: r.p for r in told("English").collect()} == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: True}
    assert {r.i: r.p for r in told("Chinese").collect() if r.i > 7} == {8: True, 9: False}
    assert "regexp_extract_all" not in (plan := told("English")._jdf.queryExecution().optimizedPlan().toString()) and "regexp_count" not in plan


def test_parts_of_a_text_are_shared(spark, capsys):
    """Words and sentences are worked out once for all cases, and cases give what they give one by one."""
    cases = [("ratio:stop_words", {"percentage": "50"}), ("count:pronouns", {"N": "2"}), ("ratio:sentence_balance", {}), ("ratio:sentence_type", {}), ("words:last_first", {}), ("count:person_names", {"N": "2"}), ("format:title_case", {}), ("words:repeats", {"small_n": "1"})]
    texts = ["He/she met Emma, Liam! Liam -- met Noah. \"Noah\" left...", "Emma_ Emmas", "A b.\nB c! -- C d?", "", None, "  ", "A. B? C!"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    every = C.check_each(docs, "t", cases)
    every.explain()
    plan = capsys.readouterr().out
    assert 0 < plan.count("\\w+\\b") <= 4 and 0 < plan.count("(?<=[.!?])") <= 2  # a plan is printed with its projection's inputs at most twice
    got = {(r.k, r.id): r.passed for r in every.collect()}
    for i, args in cases:
        single = docs.select("k", C.check(F.col("t"), F.lit(i), F.create_map(*[F.lit(x) for p in args.items() for x in p]) if args else F.lit(None).cast("map<string,string>"), [i]).alias("p"))
        assert {r.k: r.p for r in single.collect()} == {k: p for (k, j), p in got.items() if j == i}
    assert [got[k, "count:person_names"] for k in range(2)] == [True, False]
    assert got[2, "words:last_first"] is True
