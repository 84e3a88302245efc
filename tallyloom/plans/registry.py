"""How a query gets its name and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def snapped(sql: str) -> str:
    """The SQL with each round(x, 6) done on decimals of nine places, so that sums in another order don't fall to another side of a tie."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 6 : end - 1]
        out.append(sql[at:start] + (f"CAST(round(CAST({snapped(inner[:-3])} AS DECIMAL(30, 9)), 6) AS DOUBLE)" if inner.endswith(", 6") else sql[start:end]))
        at = end
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None, *, exact: bool = False):
    """Register a query. In its SQL the views are at hand; doubles are rounded to six places on both sides, if `exact` by way of decimals."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), exact=exact)
        if sql:
            needed = [v for v in SQL_VIEWS if v in sql]
            needed = [v for v in SQL_VIEWS if v in needed or any(v in SQL_VIEWS[w] for w in needed)]
            views = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
            body = snapped(sql.strip()) if exact else sql.strip()
            if views:
                head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(h)), "")
                body = f"{head or 'WITH '}{views}{', ' if head else ' '}{body[len(head) :]}"
            ORACLES[name] = body
        return f

    return add


def scaled_round(name: str, digits: int) -> Column:
    """A double rounded as SQL engines do: scaled, rounded to a whole number and scaled back. Spark's own round goes by the shortest decimals, which puts products such as 0.032805 on the other side of a tie."""
    scale = float(10**digits)
    return F.round(F.col(name) * scale) / scale


def rounded(df: DataFrame, digits: int = 6, exact: bool = False) -> DataFrame:
    """Doubles rounded, NaN as null, negative zero as zero, counts as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            plain = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            c = F.round(plain.cast("decimal(30,9)") if exact else plain, digits).cast("double") + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)
