import math

import pytest
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions import index as ix
from hazegrid.operators import layers


def one(spark, expr, **cols):
    schema = ", ".join(f"{c} double" for c in cols) or "x double"
    return spark.createDataFrame([tuple(cols.values()) or (0.0,)], schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "conc, expected",
    [(45.0, 74.655), (30.0, 50.0), (60.0, 100.0), (10_000.0, 500.0), (500.0, 500.0), (0.0, 0.0), (None, None), (-5.0, None), (math.nan, None)],
)
def test_sub_index_values(spark, conc, expected):
    got = one(spark, ix.sub_index(F.col("c"), "pm25"), c=conc)
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-2)


def test_gap_value_overshoots_its_band(spark):
    assert 50.0 <= one(spark, ix.sub_index(F.col("c"), "pm25"), c=30.5) < 51.0
    # non-monotone by design: just below the next band is above its start
    assert one(spark, ix.sub_index(F.col("c"), "pm25"), c=30.99) > one(spark, ix.sub_index(F.col("c"), "pm25"), c=31.0)


def test_touching_bands_take_the_upper_one(spark):
    assert one(spark, ix.sub_index(F.col("c"), "pb"), c=0.5) == pytest.approx(51.0)
    assert one(spark, ix.sub_index(F.col("c"), "pb"), c=3.5) == pytest.approx(401.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{p} double" for p in K.DEFAULT_POLLUTANTS))


def test_overall_index_dominant_and_validity(spark):
    rows = [
        (45.0, 120.0, 50.0, None, None, None),
        (45.0, None, 50.0, None, None, None),
        (None, None, 50.0, 30.0, None, 40.0),
    ]
    got = layers.add_index(frame(spark, rows)).select("aqi", "aqi_dominant", "aqi_category").collect()
    assert got[0]["aqi"] == pytest.approx(113.62, abs=0.1) and got[0]["aqi_dominant"] == "pm10"
    assert got[0]["aqi_category"] == "Moderate"
    assert [tuple(r) for r in got[1:]] == [(None, None, None)] * 2


def test_dominant_tie_goes_to_the_first(spark):
    row = layers.add_index(frame(spark, [(30.0, 50.0, 40.0, None, None, None)])).first()
    assert row["aqi"] == pytest.approx(50.0) and row["aqi_dominant"] == "pm25"


def test_categories_and_colours(spark):
    got = spark.createDataFrame([(25.0,), (50.4,), (450.0,), (None,)], "v double").select(
        ix.category(F.col("v")).alias("c"), ix.colour(F.col("v")).alias("k"), ix.category(F.col("v"), True).alias("s")
    ).collect()
    assert [r["c"] for r in got] == ["Good", "Satisfactory", "Severe", None]
    assert got[0]["k"] == "#009865"
    assert got[1]["s"] == "Severe"  # a literal reading of integer bands


def _scalar(values):
    kept = [v for v in values if v and v > 0]
    p = [v / sum(kept) for v in kept]
    h = -sum(q * math.log(q + 1e-12) for q in p) / math.log(len(kept)) if len(kept) > 1 else 0.0
    return max(kept) * (1 + (sum(kept) / len(kept) / max(kept)) * h)


def test_entropy_index_forms_agree(spark):
    df = frame(spark, [(90.0, 180.0, 80.0, None, None, None), (250.0, 60.0, 10.0, None, None, None)])
    out = layers.add_dual_index(df).collect()
    lists = df.select(ix.entropy_index(F.array(*layers.sub_indices().values())).alias("r")).collect()
    for row, single in zip(out, lists, strict=True):
        assert row["rapi"] >= row["cpcb"] - 1e-6
        assert row["rapi"] == pytest.approx(single["r"], abs=1e-4)
    assert out[0]["divergence"] > out[1]["divergence"]
    assert one(spark, ix.entropy_index(F.array(F.lit(74.66), F.lit(113.62), F.lit(62.31)))) == pytest.approx(_scalar([74.66, 113.62, 62.31]))


def test_entropy_index_keeps_zero_in_cells_but_not_in_lists(spark):
    df = frame(spark, [(0.0, 50.0, 40.0, None, None, None)])
    cell = layers.add_dual_index(df).first()["rapi"]
    listed = df.select(ix.entropy_index(F.array(*layers.sub_indices().values())).alias("r")).first()["r"]
    assert cell == pytest.approx(50 + (100 / 3) * (math.log(2) / math.log(3)))
    assert listed == pytest.approx(100.0)


def test_sub_index_map_drops_invalid(spark):
    m = one(spark, ix.sub_index_map({"pm25": F.lit(45.0), "nh3": F.lit(100.0), "co": F.lit(-1.0), "zz": F.lit(1.0)}))
    assert set(m) == {"pm25", "nh3"}


def test_histogram_and_summary(spark):
    df = layers.add_dual_index(frame(spark, [(45.0, 120.0, 50.0, None, None, None)] * 3 + [(5.0, 5.0, 5.0, None, None, None), (None,) * 6]))
    assert {r["category"]: r["cells"] for r in layers.category_histogram(df).collect()} == {"Moderate": 3, "Good": 1}
    assert layers.index_summary(df).first()["valid_cells"] == 4
