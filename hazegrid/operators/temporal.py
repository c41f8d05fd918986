"""Calendar aggregation and regulatory daily values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid import constants as K

CELL = ("row", "col")


def _mean_over(df: DataFrame, label: Column | None, name: str, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    groups = [label.alias(name), *keys] if label is not None else list(keys)
    return df.groupBy(*groups).agg(*[F.avg(v).alias(v) for v in variables])


def daily_mean(df: DataFrame, variables: Sequence[str], time_col: str = "time", keys: Sequence[str] = CELL) -> DataFrame:
    return _mean_over(df, F.to_date(time_col), "date", variables, keys)


def monthly_mean(df: DataFrame, variables: Sequence[str], time_col: str = "date", keys: Sequence[str] = CELL) -> DataFrame:
    return _mean_over(df, F.trunc(F.to_date(time_col), "month"), "date", variables, keys)


def annual_mean(df: DataFrame, variables: Sequence[str], time_col: str = "date", keys: Sequence[str] = CELL) -> DataFrame:
    return _mean_over(df, F.trunc(F.to_date(time_col), "year"), "date", variables, keys)


def period_mean(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Mean over the whole record, one row per key."""
    return _mean_over(df, None, "", variables, keys)


def season_of(date: Column, seasons: Mapping[str, Sequence[int]] | None = None) -> Column:
    month = F.month(date)
    table = list((seasons or K.SEASONS).items())
    return F.coalesce(*[F.when(month.isin(*months), F.lit(name)) for name, months in table])


def seasonal_mean(
    df: DataFrame,
    variables: Sequence[str],
    time_col: str = "date",
    keys: Sequence[str] = CELL,
    seasons: Mapping[str, Sequence[int]] | None = None,
    by_year: bool = False,
) -> DataFrame:
    """Mean per season, pooled over years unless ``by_year``."""
    tagged = df.withColumn("season", season_of(F.col(time_col), seasons))
    groups = ["season", *keys]
    if by_year:
        tagged = tagged.withColumn("season_year", F.year(time_col))
        groups = ["season", "season_year", *keys]
    return _mean_over(tagged, None, "", variables, groups)


def pivot_measurements(
    long: DataFrame,
    parameters: Sequence[str],
    keys: Sequence[str] = ("station_id", "datetime"),
    parameter_col: str = "parameter",
    value_col: str = "value",
) -> DataFrame:
    """Long -> wide with the mean of repeated readings.

    Written as conditional averages: one shuffle on the keys with map-side partial sums,
    where a pivot would aggregate twice.
    """
    wide = [F.avg(F.when(F.col(parameter_col) == p, F.col(value_col))).alias(p) for p in parameters]
    return long.groupBy(*keys).agg(*wide)


def _eight_hour_means(rows: DataFrame, station_col: str, peaks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Rows with ``_<name>_8h``, the mean over ``(t - 8 h, t]`` of the day from (sum, count) of each row; NULL below 6 readings.

    The day has three blocks of 8 hours. The window ends in the row's block, as what has come there so far, and begins in
    the block before, as what is left of it: its rows are sent on by 8 hours and those later than the row are summed.
    Two running sums take the place of a frame that is summed anew for every row, and nothing is subtracted.
    """
    span = 8 * 3600 * 1_000_000
    block = F.floor(F.col("_clock") / span).cast("int")
    own = F.struct(block.alias("block"), F.col("_clock").alias("at"), F.lit(False).alias("before"))
    left = F.struct((block + 1).alias("block"), (F.col("_clock") + span).alias("at"), F.lit(True).alias("before"))
    sent = rows.withColumns({f"_{c}_{kind}": e for c, pair in peaks.items() for kind, e in zip(("part", "count"), pair, strict=True)})
    sent = sent.withColumn("_e", F.explode(F.array_compact(F.array(own, F.when(block < 2, left)))))
    sent = sent.withColumns({"_block": F.col("_e.block"), "_at": F.col("_e.at"), "_before": F.col("_e.before")}).repartition(station_col, "date")
    one = Window.partitionBy(station_col, "date", "_block")
    come = one.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    # a row of just 8 hours ago is outside: it stands behind the rows that it could be left for
    stay = one.orderBy(F.desc("_at"), "_before").rowsBetween(Window.unboundedPreceding, 0)

    def total(name: str) -> Column:
        now = F.sum(F.when(~F.col("_before"), F.col(name))).over(come)
        return F.coalesce(now, F.lit(0)) + F.coalesce(F.sum(F.when(F.col("_before"), F.col(name))).over(stay), F.lit(0))

    sums = sent.withColumns({f"{name}_8h": total(name) for c in peaks for name in (f"_{c}_part", f"_{c}_count")}).where(~F.col("_before"))
    found = {f"_{c}_8h": F.when(F.col(f"_{c}_count_8h") >= K.EIGHT_HOUR_MIN_VALID, F.col(f"_{c}_part_8h") / F.col(f"_{c}_count_8h")) for c in peaks}
    return sums.select(*rows.columns, *[e.alias(name) for name, e in found.items()])


def daily_values(
    hourly: DataFrame,
    station_col: str = "station_id",
    time_col: str = "datetime",
    unique_times: bool = False,
) -> DataFrame:
    """Regulatory daily values per station.

    Means for particles, NO2 and SO2; for O3 and CO the daily maximum of the 8-hour mean
    over ``(t - 8 h, t]``, never reaching back over midnight and needing 6 readings. A
    station-day with at most 3 rows is taken as already daily; any other with fewer than 16
    distinct hours is left out.

    The window is partitioned by station *and* day, so no partition exceeds one day of one
    station however long or busy the station's record is. Its time is linear in the readings.
    """
    means = [c for c in K.DAILY_MEAN_POLLUTANTS if c in hourly.columns]
    peaks = [c for c in K.EIGHT_HOUR_POLLUTANTS if c in hourly.columns]
    # Microseconds since midnight, so the window works on timestamps with or without a zone.
    whole = (F.hour(time_col) * 3600 + F.minute(time_col) * 60).cast("bigint") * 1_000_000
    clock = whole + (F.date_part(F.lit("SECOND"), F.col(time_col)) * 1_000_000).cast("bigint")
    rows = hourly.withColumns({"date": F.to_date(time_col), "_clock": clock})
    if peaks and unique_times:
        rows = _eight_hour_means(rows, station_col, {c: (F.col(c), F.col(c).isNotNull().cast("long")) for c in peaks})
    elif peaks:
        # Repeated instants are merged into sums first; the window then carries one row per
        # instant while means and counts still weigh every reading.
        rows = (
            rows.groupBy(station_col, "date", "_clock").agg(
                F.count(F.lit(1)).alias("_rows"),
                *[F.sum(c).alias(f"_{c}_sum") for c in means + peaks],
                *[F.count(c).alias(f"_{c}_n") for c in means + peaks],
                *[F.max(c).alias(f"_{c}_top") for c in peaks],
            )
        )
        rows = _eight_hour_means(rows, station_col, {c: (F.col(f"_{c}_sum"), F.col(f"_{c}_n")) for c in peaks})
    merged = bool(peaks) and not unique_times
    n_rows = F.sum("_rows") if merged else F.count(F.lit(1))

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(f"_{c}_sum"), F.sum(f"_{c}_n")) if merged else F.avg(c)

    out = rows.groupBy(station_col, "date").agg(
        n_rows.alias("_n_rows"),
        # distinct hours as a 24-bit mask: constant size, no second shuffle
        F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(_clock div 3600000000 as int))"))).alias("_hours"),
        *[mean(c).alias(c) for c in means],
        *[F.max(f"_{c}_top" if merged else c).alias(f"_{c}_max") for c in peaks],
        *[F.max(f"_{c}_8h").alias(f"_{c}_8h") for c in peaks],
    )
    as_daily = F.col("_n_rows") <= K.ALREADY_DAILY_ROWS
    return out.where(as_daily | (F.col("_hours") >= K.MIN_HOURS_PER_DAY)).select(
        station_col,
        "date",
        *means,
        *[F.when(as_daily, F.col(f"_{c}_max")).otherwise(F.col(f"_{c}_8h")).alias(c) for c in peaks],
    )


def station_season_mean(daily: DataFrame, station_col: str = "station_id") -> DataFrame:
    """Mean per station with gas columns renamed to their observed-target names."""
    values = [c for c in ("pm25", "pm10", "no2", "so2", "o3", "co") if c in daily.columns]
    return daily.groupBy(station_col).agg(*[F.avg(c).alias(K.OBSERVED_NAMES.get(c, c)) for c in values])


def date_axis(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Distinct dates with a dense 0-based index. One row per day of record, so one task is enough."""
    days = df.where(F.col(date_col).isNotNull()).select(date_col).distinct()
    return days.withColumn("t_idx", F.row_number().over(Window.orderBy(date_col)) - 1)


def burning_window(df: DataFrame, frp: str = "frp_mean", before: int = 5, after: int = 5, date_col: str = "date") -> DataFrame:
    """Dates around the day with the highest mean fire power, clipped to the record.

    The window counts positions in the record, not calendar days; the earliest of equal
    peaks wins.
    """
    per_day = df.groupBy(date_col).agg(F.avg(frp).alias("_power"))
    axis = date_axis(per_day, date_col).join(per_day, date_col)
    whole = Window.orderBy("t_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peak = F.max(F.struct(F.coalesce(F.col("_power"), F.lit(float("-inf"))), -F.col("t_idx"))).over(whole)
    return (
        axis.withColumn("_peak", -peak.getField("col2"))
        .where(F.col("t_idx").between(F.col("_peak") - before, F.col("_peak") + after))
        .select(date_col, "t_idx", F.col("_peak").alias("peak_idx"))
    )


def burning_composite(df: DataFrame, keys: Sequence[str] = CELL, hcho: str = "hcho", frp: str = "frp_mean") -> DataFrame:
    """Per cell: mean column and peak fire power inside the burning window, mean over the record.

    One scan-and-aggregate: the window is a flag on the (few) dates, not a second pass.
    """
    window = burning_window(df, frp).select("date", F.lit(True).alias("_burning"))
    flagged = df.join(window, "date", "left")
    burning = F.col("_burning")
    return flagged.groupBy(*keys).agg(
        F.avg(F.when(burning, F.col(hcho))).alias("hcho_burning"),
        F.max(F.when(burning, F.col(frp))).alias("frp_burning"),
        F.avg(hcho).alias("hcho_season"),
    )


def evenly_spaced_frames(df: DataFrame, n_frames: int = 8, date_col: str = "date") -> DataFrame:
    """Up to ``n_frames`` dates evenly spread over the record, first and last included."""
    axis = date_axis(df, date_col)
    count = axis.agg(F.max("t_idx").alias("last"))
    steps = max(n_frames - 1, 1)
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(n_frames - 1)),
        lambda i: F.floor(i.cast("double") * (F.col("last").cast("double") / F.lit(float(steps)))).cast("int"),
    )
    # the last pick is the end of the record by definition, not by floating arithmetic
    picks = F.array_union(F.slice(picks, 1, n_frames - 1), F.array(F.col("last"))) if n_frames > 1 else picks
    chosen = count.where(F.col("last").isNotNull()).select(F.explode(F.array_distinct(picks)).alias("t_idx"))
    return axis.join(chosen, "t_idx", "left_semi")


def as_day(ts: Column) -> Column:
    """Wall-clock day of a timestamp; a zone, if any, has no effect on the day kept."""
    return F.to_date(ts)
