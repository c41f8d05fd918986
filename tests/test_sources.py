import gzip
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hazegrid.sources import documents, stations, tables
from hazegrid.session import discard, materialize, scratch_root


def test_metadata_headers_and_bad_cells(spark, tmp_path):
    (tmp_path / "m.csv").write_text(" Station ID ,Name,LAT, Lon \na,North,12.5,77.0\nb,South,oops,78.0\n")
    df = stations.station_metadata(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["station_id", "name", "lat", "lon"]
    assert [(r["lat"], r["lon"]) for r in df.orderBy("station_id").collect()] == [(12.5, 77.0), (None, 78.0)]


def test_measurements_merge_aliases(spark, tmp_path):
    (tmp_path / "h.csv").write_text("station_id, datetime ,PM2.5 ,Ozone,O3\na,2024-01-01 01:00:00,5,,7\na,2024-01-01 02:00:00,x,8,9\n")
    rows = stations.raw_measurements(spark, str(tmp_path / "h.csv")).orderBy("datetime").collect()
    assert [(r["pm25"], r["o3"]) for r in rows] == [(5.0, 7.0), (None, 8.0)]
    assert rows[0]["datetime"] == datetime(2024, 1, 1, 1)


def test_folder_scan_skips_fires_and_foreign_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "stations.csv").write_text("station_id,lat,lon\na,1,2\n")
    (tmp_path / "sub" / "x.csv").write_text("station_id,datetime,PM2.5\na,2024-01-01 00:00:00,1\n")
    (tmp_path / "sub" / "y.csv").write_text("station_id,datetime,CO\na,2024-01-01 01:00:00,2\n")
    (tmp_path / "sub" / "notes.csv").write_text("some,thing\n1,2\n")
    (tmp_path / "FIRMS_2024.csv").write_text("latitude,longitude,frp\n1,2,3\n")
    meta, measured = stations.station_folder(spark, str(tmp_path))
    assert meta.count() == 1
    got = sorted((r["pm25"] or 0, r["co"] or 0) for r in measured.collect())
    assert got == [(0, 2.0), (1.0, 0)]
    (tmp_path / "none").mkdir()
    assert stations.station_folder(spark, str(tmp_path / "none")) == (None, None)


def test_folder_of_files_with_differing_headers(spark, tmp_path):
    heads = ["station_id,datetime,PM2.5", "datetime, station_id ,O3,Ozone", '"station_id","NO2","datetime"', "station_id,datetime,CO,remark", "station_id,time,PM10"]
    bodies = ["a{k},2024-01-01 0{h}:00:00,{k}", "2024-01-01 0{h}:00:00,a{k},,{k}", 'a{k},bad,2024-01-01 0{h}:00:00', 'a{k},2024-01-01 0{h}:00:00,{k},"x, y"', "a{k},2024-01-01 0{h}:00:00,1"]
    for k in range(60):
        lines = [heads[k % 5]] + [bodies[k % 5].format(k=k, h=h) for h in range(3)]
        (tmp_path / f"f{k:03d}.csv").write_text("\n".join(lines) + "\n")
    meta, measured = stations.station_folder(spark, str(tmp_path))
    rows = measured.collect()
    assert meta is None and len(rows) == 48 * 3 and all(r["datetime"] is not None for r in rows)
    by = {r["station_id"]: r for r in rows}
    assert (by["a0"]["pm25"], by["a1"]["o3"], by["a2"]["no2"], by["a3"]["co"], by["a3"]["remark"]) == (0.0, 1.0, None, 3.0, "x, y")
    assert "a4" not in by


def test_fire_points_fixed_schema(spark, tmp_path):
    (tmp_path / "f.csv").write_text("acq_date,scan,Latitude,longitude,frp,daynight\n2024-01-02,1,10.5,70.5,3.5,D\n")
    r = stations.fire_points(spark, str(tmp_path / "f.csv")).first()
    assert (r["latitude"], r["frp"], r["confidence"], r["acq_date"], r["daynight"]) == (10.5, 3.5, None, date(2024, 1, 2), "D")


def test_archive_reads_all_or_every_third_file(spark, tmp_path):
    for loc in (1, 2):
        for day in range(1, 8):
            d = tmp_path / f"locationid={loc}" / "year=2024" / "month=10"
            d.mkdir(parents=True, exist_ok=True)
            with gzip.open(d / f"location-{loc}-202410{day:02d}.csv.gz", "wt") as fh:
                fh.write(f"location_id,datetime,parameter,value\n{loc},2024-10-{day:02d} 00:00:00,pm25,{day}\n")
    got = sorted((r["location_id"], r["value"]) for r in stations.archive_measurements(spark, str(tmp_path), 2024, [10, 11], every=3).collect())
    assert stations.archive_measurements(spark, str(tmp_path), 2024, [10, 11]).count() == 14
    assert got == [(k, v) for k in ("1", "2") for v in (1.0, 4.0, 7.0)]
    assert stations.archive_measurements(spark, str(tmp_path), 2023, [10]).count() == 0


def test_layer_names(spark):
    dates = {"s5p_no2_2021-10-01_2021-12-31.tif": "2021-10-01", "era5_2021-10-01_2021-12-31.tif": "2021-10-01", "worldcover_fractions.tif": None,
             "srtm_terrain.tif": None, "insat_20211005.h5": "2021-10-05", "insat_2021-10-05.h5": "2021-10-05"}
    names = spark.createDataFrame([(n,) for n in dates], "name string")
    assert {r["name"]: r["start_date"] and str(r["start_date"]) for r in stations.layer_catalogue(names).collect()} == dates


def test_layer_cells_from_files(spark, tmp_path):
    one = spark.createDataFrame([(0, 0, 1.5)], "row int, col int, value double")
    frp = spark.createDataFrame([(0, 0, 2.0, 3.0, 1.0)], "row int, col int, frp_mean double, frp_max double, fire_count double")
    dem = spark.createDataFrame([(0, 0, 100.0)], "row int, col int, elevation double")
    # another file of the family has a band of its own
    spark.createDataFrame([(1, 1, 9.0)], "row int, col int, frp_min double").toPandas().to_parquet(tmp_path / "modis_frp_2022-01-01_2022-03-31.parquet")
    for df, name in ((one, "s5p_no2_2021-10-01_2021-12-31"), (frp, "modis_frp_2021-10-01_2021-12-31"), (dem, "srtm_terrain"), (one, "unknown_thing")):
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = {(str(r["date"]), r["variable"]): (r["value"], r["is_static"]) for r in stations.layer_cells(spark, str(tmp_path)).collect()}
    assert got == {
        ("2021-10-01", "no2"): (1.5, False), ("2021-10-01", "frp_mean"): (2.0, False), ("2021-10-01", "frp_max"): (3.0, False),
        ("2021-10-01", "fire_count"): (1.0, False), ("None", "elevation"): (100.0, True),
        ("2022-01-01", "frp_min"): (9.0, False),
    }


def test_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"), 1.0, "x"), (float("inf"), 2.0, "y")], "a double, b double, c string").write.parquet(str(tmp_path / "t"))
    df = tables.read_table(spark, str(tmp_path / "t"), ["a", "b"])
    assert [tuple(r) for r in df.orderBy("b").collect()] == [(None, 1.0), (None, 2.0)]


def test_partitioned_write_keeps_all_days_and_other_months(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(date(2024, m, d), float(d)) for m in (1, 2) for d in range(1, 11)], "date date, aod double")
    tables.write_partitioned(tables.training_table(df), path)
    assert tables.read_months(spark, path, "2024-01-03", "2024-02-03").count() == 10
    redo = df.where("month(date) = 2").withColumn("aod", F.lit(-1.0))
    tables.write_partitioned(tables.training_table(redo), path)
    again = spark.read.parquet(path)
    assert again.count() == 20 and again.where("aod < 0").count() == 10
    plan = tables.read_months(spark, path, "2024-02-01", "2024-03-01", ["date", "aod"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_inference_rows_need_a_predictor(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0, 2.0, None, None), (date(2024, 1, 1), 1.0, 3.0, 0.5, None)], "date date, lat double, lon double, aod double, hcho double")
    out = tables.inference_table(df)
    assert out.count() == 1 and dict(out.dtypes)["aod"] == "float" and out.first()["month"] == 1


def test_json_layers(spark, tmp_path):
    layers = spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":2}'), ("a", '{"x":3}')], "layer string, json string")
    documents.write_layers(layers, str(tmp_path / "out"))
    back = spark.read.schema("x int, layer string").json(str(tmp_path / "out"))
    assert {(r["layer"], r["x"]) for r in back.collect()} == {("a", 1), ("b", 2), ("a", 3)}
    cells = spark.createDataFrame([(70.123, 20.456, 0.12345)], "lon double, lat double, no2 double")
    assert documents.gas_cell_documents(cells, ["no2"]).first()["json"] == '{"lon":70.12,"lat":20.46,"no2":0.123}'


def stub(master, configured):
    conf = type("Conf", (), {"get": staticmethod(lambda *_: configured)})
    context = type("Context", (), {"master": master, "applicationId": "app", "getConf": staticmethod(lambda: conf)})
    return type("Session", (), {"conf": conf, "sparkContext": context})


def test_scratch_follows_the_session_setting():
    assert scratch_root(stub("spark://host:7077", "hdfs://shared/dir/")) == "hdfs://shared/dir"
    assert scratch_root(stub("local[2]", None)).startswith("/")
    with pytest.raises(RuntimeError):
        scratch_root(stub("spark://host:7077", None))


def test_scratch_tables_can_be_discarded(spark):
    from pathlib import Path

    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and list(Path(df._scratch_path).rglob("*.parquet"))
    discard(df)
    assert not Path(df._scratch_path).exists()
    discard(None)
