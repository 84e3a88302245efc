"""BLEU of each text against all others of its group, by its definition in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from tallyloom.operators import diversity


def tokens(text):
    t = regex.sub(r"(\P{N})(\p{P})", r"\1 \2 ", text or "")
    return regex.sub(r"(\p{S})", r" \1 ", regex.sub(r"(\p{P})(\P{N})", r" \1 \2", t)).split()


def counts(t, n):
    return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))


def bleu(own, others):
    if not others:
        return None
    log, orders, halvings, hit = 0.0, 0, 1.0, 0
    for n in range(1, 5):
        mine, best = counts(own, n), Counter()
        for o in others:
            best |= counts(o, n)
        total, matched = sum(mine.values()), sum((mine & best).values())
        if total == 0:
            break
        hit += matched
        if matched == 0:
            halvings /= 2
        orders, log = n, log + math.log((matched or halvings) / total)
    if not hit:
        return 0.0
    near = min(others, key=lambda o: (abs(len(o) - len(own)), len(o)))
    return math.exp(min(0, 1 - len(near) / len(own))) * math.exp(log / orders)


def test_against_definition(spark):
    rng = random.Random(3)
    words = ["the", "a", "cat", "sat.", "on", "3.5", "$2", "mat,", "été", "x=1", "(so)"]
    rows = [(g, k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 3, 5, 9, 30))))) for g, n in (("one", 1), ("two", 2), ("hot", 60), (None, 4), ("same", 5)) for k in range(n)]
    rows = [(g, k, "the cat sat. the cat" if g == "same" else t) for g, k, t in rows] + [("two", 7, None)]
    got = {(r.g, r.k): r.bleu for r in diversity.sentence_scores(spark.createDataFrame(rows, "g string, k long, text string"), ["g"], "k", "text").collect()}
    assert len(got) == len(rows)
    for g, k, t in rows:
        want = bleu(tokens(t), [tokens(x) for h, j, x in rows if h == g and j != k])
        assert got[g, k] == (None if want is None else pytest.approx(want, abs=1e-9)), (g, k, t)
    groups = {r.g: (r.n, r.self_bleu) for r in diversity.self_bleu(spark.createDataFrame(rows, "g string, k long, text string"), ["g"], "k", "text").collect()}
    assert groups["one"] == (1, None) and groups["same"] == (5, pytest.approx(1.0))


def test_no_rows(spark):
    assert diversity.self_bleu(spark.createDataFrame([], "g string, k long, text string"), ["g"], "k", "text").collect() == []


def test_ngrams_are_counted_where_texts_are(spark):
    """Texts are shuffled once by row; counting their n-grams needs no shuffle of its own, and what goes on is hashes."""
    rows = spark.createDataFrame([("g", k, "a b c d e f") for k in range(3)], "g string, k long, text string")
    plan = diversity.sentence_scores(rows, ["g"], "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(g" in line and "gram" in line]


def test_only_packed_lines_go_on(spark):
    """Lines of n-grams are packed by range of hashes, not rows of their own; stretches of few tokens give the same scores."""
    rng = random.Random(8)
    rows = [(g, k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 4, 40))))) for g, n in (("one", 1), ("two", 30), (None, 25)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, text string")
    whole = {(r.g, r.k): r.bleu for r in diversity.sentence_scores(df, ["g"], "k", "text").collect()}
    for n in (1, 7):
        held = list(diversity.held([(i, np.array([5, 6, 5, 6]), np.array([1, 2, 1, 2])) for i in range(3)], [(1, 1), (1, 1), (2, 2)], n))
        assert sum(len(diversity.unpacked(d, *diversity.LINES)[0]) for _, k, _, d in held if k == 1) == 4  # two n-grams in each of two groups
    plan = diversity.sentence_scores(df, ["g"], "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert "data#" in plan and "hashpartitioning(part#" in plan and not [line for line in plan.splitlines() if "hashpartitioning(g#" in line and ", n#" in line]
    assert all(whole[g, k] == (None if g == "one" else pytest.approx(bleu(tokens_, [tokens_b for h, j, tokens_b in split if h == g and j != k]), abs=1e-9)) for split in [[(h, j, t.split()) for h, j, t in rows]] for g, k, tokens_ in split)
