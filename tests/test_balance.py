"""Balanced parts against slow versions of the rules: no heaps, every state compared anew."""

import functools
import random

import pytest

from tallyloom.operators import batches as B


def slow_differencing(lengths, k, equal=False):
    order = sorted((n, i) for i, n in enumerate(lengths))
    states = [order[j : j + k] for j in range(0, len(order), k)] if equal else [[x] for x in order]

    def size(s):
        return sum(n for _, n in s), len(s), s

    def tidy(sets):
        return sorted(sets, key=size, reverse=True)

    states = [tidy([[(i, n)] for n, i in s] + [[]] * (k - len(s))) for s in states]

    def before(a, b):
        da, db = (size(s[0])[0] - size(s[-1])[0] for s in (a, b))
        return db - da if da != db else -1 if size(a[0]) > size(b[0]) else 1

    while len(states) > 1:
        states.sort(key=functools.cmp_to_key(before))
        a, b, *states = states
        states.append(tidy([a[i] + b[k - 1 - i] for i in range(k)]))
    return [sorted(i for i, _ in s) for s in states[0]]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("equal", [False, True])
def test_largest_differencing(k, equal):
    rng = random.Random(k)
    for _ in range(60):
        n = k * rng.randint(1, 6) if equal else rng.randint(k, 30)
        lengths = [rng.randint(0, rng.choice((3, 1000))) for _ in range(n)]
        parts = B.largest_differencing(lengths, k, equal_size=equal)
        assert parts == slow_differencing(lengths, k, equal)
        assert sorted(i for p in parts for i in p) == list(range(n)) and (not equal or {len(p) for p in parts} == {n // k})


def test_known_cuts():
    lengths = [4, 5, 6, 7, 8]
    assert sorted(sum(lengths[i] for i in p) for p in B.largest_differencing(lengths, 2)) == [14, 16]
    assert B.least_loaded([1, 9, 1, 1], 2) == [[0, 2, 3], [1]]
    assert B.least_loaded([9, 1, 1, 1], 2, equal_size=True) == [[0, 3], [1, 2]]
    for bad in (lambda: B.largest_differencing([1], 2), lambda: B.largest_differencing([1, 2, 3], 2, equal_size=True), lambda: B.least_loaded([1, 2, 3], 2, equal_size=True), lambda: B.budget_batches([5, 9], 8)):
        with pytest.raises(ValueError):
            bad()


def test_budget_batches():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 25))]
        parts = B.budget_batches(lengths, 60)
        k = min(len(lengths), -(-sum(lengths) // 60))
        cost = [24576 * n + n * n for n in lengths]
        falling = sorted(slow_differencing(cost, k), key=lambda p: (-sum(cost[i] for i in p), -p[0]))
        assert parts == falling[0::2][::-1] + falling[1::2]
        sums = [sum(cost[i] for i in p) for p in parts]
        assert len(sums) < 3 or max(sums) not in (sums[0], sums[-1]) or sums.count(max(sums)) > 1
    assert len(B.budget_batches([5] * 10, 50, least=3, multiple=2)) == 4 and B.budget_batches([], 5) == []


def test_rank_order():
    rng = random.Random(6)
    lengths = [rng.randint(1, 500) for _ in range(48)]
    cost = [B.workload(n) for n in lengths]
    for mini in (None, 12):
        order = B.rank_order(lengths, 4, mini=mini)
        assert sorted(order) == list(range(48))
        ranks = [order[j : j + 12] for j in range(0, 48, 12)]
        sums = [sum(cost[i] for i in r) for r in ranks]
        assert max(sums) - min(sums) <= max(cost)
        for r in ranks:
            own = [cost[i] for i in r]
            assert own[:6] == sorted(own[:6]) and own[6:] == sorted(own[6:], reverse=True)
            if mini:
                assert [sum(i // 12 == b for i in r) for b in range(4)] == [3, 3, 3, 3]
