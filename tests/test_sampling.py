"""Splits by place in an order."""

import pytest

from tallyloom.operators import sampling as S


@pytest.mark.parametrize("keys", [list(range(5)), [7], [3, -9, 10**15, 4, 4, 4, 4, 8, 1], [None, 1, None, None, 2], [None] * 5, [], [6] * 9, list(range(0, 90_000, 7))])
def test_head_tail_is_by_row_number(spark, keys):
    """Also where a quarter of the rows isn't a whole number (5, 9 rows), and with equal and null keys."""
    got = S.head_tail(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", 3, 4, "train", "test", "s").collect()
    order = sorted(keys, key=lambda k: (k is None, k))
    want = [(k, "train" if i + 1 <= 0.75 * len(keys) else "test") for i, k in enumerate(order)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
