from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import features, qa, temporal


def hourly(spark, rows):
    return spark.createDataFrame(rows, "station_id string, datetime timestamp, pm25 double, o3 double")


def test_daily_values_gate_pass_through_and_window(spark):
    day = datetime(2024, 3, 1)
    full = [("full", day + timedelta(hours=h), float(h), float(h)) for h in range(24)]
    short = [("short", day + timedelta(hours=h), 1.0, 1.0) for h in range(15)]
    exact = [("exact", day + timedelta(hours=h), 2.0, 2.0) for h in range(16)]
    sparse = [("daily", day, 10.0, 20.0), ("daily", day + timedelta(hours=1), 30.0, 50.0)]
    nulls = [("nulls", day + timedelta(hours=h), None, None) for h in range(20)]
    got = {r["station_id"]: r for r in temporal.daily_values(hourly(spark, full + short + exact + sparse + nulls)).collect()}
    assert set(got) == {"full", "exact", "daily", "nulls"}
    assert got["full"]["pm25"] == pytest.approx(11.5)
    assert got["full"]["o3"] == pytest.approx(np.mean(range(16, 24)))  # best window is the last eight hours
    assert (got["daily"]["pm25"], got["daily"]["o3"]) == (20.0, 50.0)
    assert (got["nulls"]["pm25"], got["nulls"]["o3"]) == (None, None)


def test_eight_hour_window_matches_pandas_and_stops_at_midnight(spark):
    rng = np.random.default_rng(0)
    base, rows = datetime(2024, 3, 1), []
    for m in sorted(rng.choice(48 * 60, 300, replace=False)):
        v = None if rng.random() < 0.4 else float(rng.random() * 100)
        rows.append(("a", base + timedelta(minutes=int(m)), 1.0, v))
    pdf = pd.DataFrame(rows, columns=["s", "t", "p", "o3"]).set_index("t")
    want = {d: g["o3"].astype(float).rolling("8h", min_periods=6).mean().max() for d, g in pdf.groupby(pdf.index.date)}
    for unique in (True, False):
        got = {r["date"]: r["o3"] for r in temporal.daily_values(hourly(spark, rows), unique_times=unique).collect()}
        assert got.keys() == want.keys()
        for d, v in want.items():
            assert got[d] == pytest.approx(v)


@pytest.mark.parametrize("unique", [True, False])
def test_eight_hour_window_leaves_out_the_reading_of_just_eight_hours_ago(spark, unique):
    rng = np.random.default_rng(4)
    base = datetime(2024, 3, 1)
    # quarters of an hour, so windows begin at readings, also at the borders of 0, 8 and 16 o'clock; a gap and a huge value
    rows = [("a", base + timedelta(minutes=15 * i), 1.0, None if 40 < i < 60 else 1e12 if i == 3 else float(rng.integers(0, 99))) for i in range(96)]
    df = hourly(spark, rows)
    sums = temporal._eight_hour_means(
        df.withColumns({"date": F.to_date("datetime"), "_clock": F.unix_micros("datetime") - F.unix_micros(F.to_date("datetime").cast("timestamp"))}),
        "station_id", {"o3": (F.col("o3"), F.col("o3").isNotNull().cast("long"))},
    )
    got = {r["datetime"]: r["_o3_8h"] for r in sums.collect()}
    for _, t, _, _ in rows:
        near = [v for _, s, _, v in rows if v is not None and t - timedelta(hours=8) < s <= t]
        assert got[t] == (None if len(near) < 6 else sum(near) / len(near)), t
    # no frame that is summed anew for every row
    assert "-28799999999" not in temporal.daily_values(df, unique_times=unique)._jdf.queryExecution().executedPlan().toString()


def test_pivot_averages_duplicates(spark):
    t = datetime(2024, 1, 1)
    long = spark.createDataFrame([("s", t, "pm25", 1.0), ("s", t, "pm25", 3.0), ("s", t, "co", 5.0)], "station_id string, datetime timestamp, parameter string, value double")
    r = temporal.pivot_measurements(long, ["pm25", "co", "o3"]).first()
    assert (r["pm25"], r["co"], r["o3"]) == (2.0, 5.0, None)


def test_seasonal_mean_pools_years_unless_asked(spark):
    rows = [(date(2022, 1, 1), 0, 0, 1.0), (date(2023, 2, 1), 0, 0, 3.0), (date(2023, 7, 1), 0, 0, 9.0)]
    df = spark.createDataFrame(rows, "date date, row int, col int, v double")
    assert {r["season"]: r["v"] for r in temporal.seasonal_mean(df, ["v"]).collect()} == {"winter": 2.0, "monsoon": 9.0}
    assert temporal.seasonal_mean(df, ["v"], by_year=True).count() == 3


def test_burning_window_clips_and_prefers_the_earliest_peak(spark):
    days = [date(2023, 10, 1) + timedelta(days=2 * i) for i in range(8)]
    power = [1.0, 9.0, 2.0, 9.0, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(d, 0, 0, float(i), p) for i, (d, p) in enumerate(zip(days, power))], "date date, row int, col int, hcho double, frp_mean double")
    got = temporal.burning_window(df).orderBy("t_idx").collect()
    assert [r["t_idx"] for r in got] == [0, 1, 2, 3, 4, 5, 6] and got[0]["peak_idx"] == 1
    comp = temporal.burning_composite(df).first()
    assert comp["hcho_burning"] == pytest.approx(3.0) and comp["frp_burning"] == 9.0 and comp["hcho_season"] == pytest.approx(3.5)


@pytest.mark.parametrize("n", [1, 5, 8, 61])
def test_frame_selection_matches_linspace(spark, n):
    df = spark.createDataFrame([(date(2023, 1, 1) + timedelta(days=i),) for i in range(n)], "date date")
    want = sorted(set(np.linspace(0, n - 1, 8).astype(int)))
    assert sorted(r["t_idx"] for r in temporal.evenly_spaced_frames(df).collect()) == want


# --- screening ---------------------------------------------------------------------------------
def test_clip_is_unit_tolerant(spark):
    rows = [(1e-4, 6e15, 0.5, 1e16), (9e-1, -1.0, 6.0, -5e15), (2e-4, 8e15, 1.0, 2e16)]
    df = spark.createDataFrame(rows, "no2 double, co double, aod double, hcho double")
    got = [tuple(r) for r in qa.clip_to_range(df).collect()]
    assert got[0] == (1e-4, 6e15, 0.5, 1e16)  # other units stay
    assert got[1] == (None, None, None, -5e15)  # negatives go only where the range is non-negative


def test_sigma_screen_uses_population_deviation(spark):
    vals = [0.0] * 99 + [100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    sd = np.std(vals)
    kept = qa.within_sigma(df, ["v"], 99 / sd + 1e-6).where(F.col("v").isNotNull()).count()
    dropped = qa.within_sigma(df, ["v"], 99 / sd - 1e-6).where(F.col("v").isNotNull()).count()
    assert (kept, dropped) == (100, 99)


def test_screen_can_leave_variables_out(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 50 + [(1.0, 1.0)], "aod double, burned double")
    got = qa.screen(df, ["aod", "burned"], 2.0, exclude=["burned"])
    assert got.where(F.col("aod").isNull()).count() == 1 and got.where(F.col("burned").isNull()).count() == 0


# --- features --------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", ["month", "year", "quarter"])
def test_chunked_lags_equal_plain_windows(spark, chunk):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(6):
        for d in sorted(rng.choice(1500, int(rng.integers(1, 60)), replace=False)):
            rows.append((f"s{s}", date(2020, 1, 1) + timedelta(days=int(d)), None if rng.random() < 0.2 else float(rng.random())))
    df = spark.createDataFrame(rows, "station_id string, date date, v double")
    plain = sorted(map(tuple, features.add_lags(df, ["v"], chunk=None).collect()), key=str)
    cut = features.add_lags(df, ["v"], chunk=chunk)
    assert sorted(map(tuple, cut.select(*features.add_lags(df, ["v"], chunk=None).columns).collect()), key=str) == plain


def test_rolling_mean_never_sees_the_current_row(spark):
    df = spark.createDataFrame([("a", date(2024, 1, i), float(i)) for i in range(1, 6)], "station_id string, date date, v double")
    got = {r["date"].day: (r["v_lag1"], r["v_roll3"]) for r in features.add_lags(df, ["v", "absent"]).collect()}
    assert got == {1: (None, None), 2: (1.0, 1.0), 3: (2.0, 1.5), 4: (3.0, 2.0), 5: (4.0, 3.0)}


def test_feature_chain_uses_what_is_there(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 2.0, 4.0)], "date date, hcho double, no2 double")
    r = features.engineer(df).first()
    assert r["fnr"] == pytest.approx(0.5) and r["doy_sin"] == pytest.approx(np.sin(2 * np.pi / 365.25))
    assert "aod_blh" not in r.asDict()


def test_standardizer_replaces_zero_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = features.channel_statistics(df, ["a", "b"])
    assert stats == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    back = features.destandardize(features.standardize(df, ["a", "b"], stats), ["a", "b"], stats)
    assert sorted(map(tuple, back.collect())) == [(1.0, 5.0), (3.0, 5.0)]
    assert sorted(map(tuple, features.standardize(df, ["a", "b"]).collect())) == [(-1.0, 0.0), (1.0, 0.0)]
