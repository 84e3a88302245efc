"""Parts of the views."""

from conftest import SMALL

from tallyloom.sources import views as V


def test_parts_grow_with_rows(spark, monkeypatch):
    """A part holds a bounded number of rows, however few shuffle partitions the session sets (4 here)."""
    monkeypatch.setattr(V, "PART_ROWS", 300)
    for rows in (V.rollouts(spark, SMALL), V.tokens(spark, SMALL)):
        held = [r["count"] for r in rows.groupBy(V.F.spark_partition_id()).count().collect()]
        assert len(held) > 12 and max(held) < 900 and sum(held) == V.table(spark, SMALL, "lineitem").count()
