"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.plans.sqltext import settle_rounding
from hazegrid.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = (), text: Sequence[str] = ()):
    """Register ``fn(tables) -> DataFrame``.

    ``sql`` may use the named adapter views. ``text`` lists date or timestamp outputs that
    both sides return as text, so that no client library's date type matters.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: F.col(c).cast("string") for c in text}) if text else out

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            body = settle_rounding(with_views(sql, views))
            if text:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
                body = f"SELECT * REPLACE ({casts}) FROM (\n{body}\n)"
            ORACLES[name] = body
        return fn

    return wrap


def rnd(c: Column, digits: int) -> Column:
    """Round for comparison, with the same arithmetic in both engines.

    The tie is shifted by 1e-6 of a step, so that sums added in another order do not fall on
    different sides of an exact half.
    """
    scale = F.lit(10.0**digits)
    return F.floor(c * scale + F.lit(0.500001)).cast("double") / scale


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rnd(F.col(c), digits) for c in columns})
