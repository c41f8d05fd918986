"""Median / quartile scaling driven by exact distributed quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.ranking import exact_quantiles


@dataclass(frozen=True)
class RobustScale:
    columns: list[str]
    centre: list[float]
    spread: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> RobustScale:
        q = exact_quantiles(df, list(columns), [0.25, 0.5, 0.75])
        centre = [q[c][1] if q[c][1] is not None else 0.0 for c in columns]
        spread = [(q[c][2] - q[c][0]) if q[c][2] is not None and q[c][2] != q[c][0] else 1.0 for c in columns]
        return cls(list(columns), centre, spread)

    def apply(self, df: DataFrame, prefix: str = "_s_") -> DataFrame:
        """Scaled copies of the columns; a missing value takes the median, hence 0."""
        return df.withColumns(
            {
                f"{prefix}{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.centre, self.spread, strict=True)
            }
        )
