"""Air-quality index expressions: sub-index, overall index, category, entropy index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid import constants as K


def _usable(c: Column) -> Column:
    return (c >= F.lit(0.0)) & ~F.isnan(c)


def sub_index(conc: Column, pollutant: str, bands: Mapping[str, Sequence] | None = None) -> Column:
    """Piecewise-linear index of one concentration.

    A band reaches up to the next band's lower edge while keeping its own slope, so a value
    in the gap between two bands overshoots the band's upper index slightly. The last band
    is closed above; anything beyond it takes the top index. NULL, NaN and negative
    concentrations have no index.
    """
    rows = [tuple(float(v) for v in band) for band in (bands or K.BREAKPOINTS)[pollutant]]
    c = conc.cast("double")
    out = None
    for pos, (c_lo, c_hi, i_lo, i_hi) in enumerate(rows):
        line = F.lit((i_hi - i_lo) / (c_hi - c_lo)) * (c - F.lit(c_lo)) + F.lit(i_lo)
        last = pos == len(rows) - 1
        below = c <= F.lit(c_hi) if last else c < F.lit(rows[pos + 1][0])
        out = F.when(below, line) if out is None else out.when(below, line)
    return F.when(_usable(c), out.otherwise(F.lit(rows[-1][3])))


def sub_index_map(concentrations: Mapping[str, Column], bands=None) -> Column:
    """MAP<pollutant, sub-index> holding only the pollutants that have an index."""
    table = bands or K.BREAKPOINTS
    known = [p for p in concentrations if p in table]
    pairs = F.create_map(*[x for p in known for x in (F.lit(p), sub_index(concentrations[p], p, table))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _present(indices: Mapping[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in indices.values()])


def is_valid(indices: Mapping[str, Column], mandatory=K.MANDATORY, min_count: int = K.MIN_POLLUTANTS) -> Column:
    """Enough pollutants, at least one of them mandatory."""
    particles = [indices[m].isNotNull() for m in mandatory if m in indices] or [F.lit(False)]
    return (_present(indices) >= F.lit(min_count)) & reduce(lambda a, b: a | b, particles)


def _greatest(indices: Mapping[str, Column]) -> Column:
    cols = list(indices.values())
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def overall_index(indices: Mapping[str, Column], **rule) -> Column:
    """Largest sub-index where the validity rule holds, else NULL."""
    return F.when(is_valid(indices, **rule), _greatest(indices))


def dominant_pollutant(indices: Mapping[str, Column], **rule) -> Column:
    """Pollutant with the largest sub-index; the first one in mapping order wins a tie."""
    top = _greatest(indices)
    named = F.coalesce(*[F.when(c == top, F.lit(p)) for p, c in indices.items()])
    return F.when(is_valid(indices, **rule), named)


def _by_band(value: Column, pick: int, strict_bands: bool, categories=None) -> Column:
    rows = categories or K.CATEGORIES
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for lo, hi, *texts in rows:
        inside = value <= F.lit(float(hi))
        if strict_bands:
            inside = inside & (value >= F.lit(float(lo)))
        out = out.when(inside, F.lit(texts[pick]))
    return out.otherwise(F.lit(rows[-1][2 + pick]))


def category(value: Column, strict_bands: bool = False, categories=None) -> Column:
    """Label of an index value.

    By default each label reaches up to its upper edge, so 50.4 is the label above 50.
    ``strict_bands=True`` reads the bands literally: a value in the gap between two integer
    bands matches none and falls to the last label.
    """
    return _by_band(value, 0, strict_bands, categories)


def colour(value: Column, strict_bands: bool = False, categories=None) -> Column:
    return _by_band(value, 1, strict_bands, categories)


def entropy_index(values: Column) -> Column:
    """Entropy-weighted index of an ARRAY<DOUBLE> of sub-indices (list form).

    Zero and NULL entries are dropped before shares, count and mean are formed.
    """
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0))
    n = F.size(kept).cast("double")
    zero = F.lit(0.0)
    total = F.aggregate(kept, zero, lambda acc, v: acc + v)
    shannon = F.aggregate(
        kept, zero, lambda acc, v: acc - (v / total) * F.log(v / total + F.lit(1e-12))
    )
    share = F.when(n > 1, shannon / F.log(n)).otherwise(zero)
    top = F.array_max(kept)
    return F.when(n > 0, top * (F.lit(1.0) + (total / n / top) * share))


def entropy_index_cells(indices: Mapping[str, Column], **rule) -> Column:
    """Entropy-weighted index of a cell (column form).

    Zero sub-indices count towards the number and the mean but carry no entropy; the
    validity rule is the one of :func:`overall_index`.
    """
    n, total, top, weighted = entropy_parts(indices).values()
    return entropy_from_parts(n, total, top, weighted, is_valid(indices, **rule))


def entropy_parts(indices: Mapping[str, Column]) -> dict[str, Column]:
    """Count, sum, maximum and sum of ``s ln s`` of the sub-indices.

    With shares ``s / T`` the entropy is ``ln T - sum(s ln s) / T``, so one logarithm per
    pollutant is enough and the expression stays short.
    """
    zero, cols = F.lit(0.0), list(indices.values())
    return {
        "n": _present(indices).cast("double"),
        "total": reduce(lambda a, b: a + b, [F.coalesce(c, zero) for c in cols]),
        "top": _greatest(indices),
        "weighted": reduce(lambda a, b: a + b, [F.when(c > 0, c * F.ln(c)).otherwise(zero) for c in cols]),
    }


def entropy_from_parts(n: Column, total: Column, top: Column, weighted: Column, valid: Column) -> Column:
    zero = F.lit(0.0)
    even = F.when(n > 1, (F.ln(total) - weighted / total) / F.ln(n)).otherwise(zero)
    return F.when(valid, F.when(top > 0, top + (total / n) * even).otherwise(zero))
