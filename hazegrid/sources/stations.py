"""Delimited station, fire and archive files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import constants as K
from hazegrid.session import materialize

STATION_TYPES = {"lat": "double", "lon": "double", "latitude": "double", "longitude": "double"}
FIRE_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("frp", T.DoubleType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("daynight", T.StringType()),
    ]
)


def _csv(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """Text columns by header name; types are applied afterwards, so a bad cell is NULL and no row is lost."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    return reader.options(**options).csv(path if isinstance(path, str) else list(path))


def station_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Station table with headers trimmed, lower-cased and joined by underscores."""
    raw = _csv(spark, path)
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    return named.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in STATION_TYPES.items() if c in named.columns})


def raw_measurements(spark: SparkSession, path: str | Sequence[str], time_col: str = "datetime") -> DataFrame:
    """Station measurements with trimmed headers and one name per pollutant.

    Two headers that mean the same pollutant are merged, the first present value winning.
    """
    raw = _csv(spark, path)
    trimmed = [c.strip() for c in raw.columns]
    named = raw.toDF(*[f"c{i}" for i in range(len(trimmed))])
    targets: dict[str, list[str]] = {}
    for i, c in enumerate(trimmed):
        targets.setdefault(K.POLLUTANT_ALIASES.get(c, c), []).append(f"c{i}")
    pollutants = set(K.POLLUTANT_ALIASES.values())

    def column(name: str, sources: list[str]):
        if name in pollutants:
            return F.coalesce(*[F.expr(f"try_cast({s} AS double)") for s in sources]).alias(name)
        if name == time_col:
            return F.expr(f"try_cast({sources[0]} AS timestamp)").alias(name)
        return F.col(sources[0]).alias(name)

    return named.select(*[column(n, s) for n, s in targets.items()])


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(path, name) of the files under a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def _folder_lines(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, start, value`` of every line of the CSV files below a folder, fire files excepted."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    path = F.col("_metadata.file_path")
    tagged = lines.select(path.alias("path"), F.lower(F.element_at(F.split(path, "/"), -1)).alias("name"), F.col("_metadata.file_block_start").alias("start"), "value")
    return tagged.where(~F.col("name").contains("firms"))


def _headers(lines: DataFrame) -> DataFrame:
    """``path, name, head`` (first line) and ``columns`` (its trimmed names) of every file."""
    numbered = lines.where("start = 0").withColumn("at", F.monotonically_increasing_id())
    first = numbered.groupBy("path", "name").agg(F.min_by("value", "at").alias("head"))
    names = F.transform(F.split("head", ","), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    return first.withColumn("columns", names)


def station_folder(spark: SparkSession, root: str, time_col: str = "datetime") -> tuple[DataFrame | None, DataFrame | None]:
    """(station metadata, measurements) from every CSV below a folder, fire files excepted.

    The first file named like a station or metadata table is the metadata. All other files are one scan of lines,
    joined with the table of their headers by path and read by the names there, whatever their columns and order; a
    file without a time column is no measurement file and is left out. Names that mean one pollutant are merged, the
    first present value of a line winning. What comes to the driver is the metadata's path and the column names.
    """
    lines = _folder_lines(spark, root)
    headers = materialize(_headers(lines), "headers")
    meta = headers.where(F.col("name").contains("station") | F.col("name").contains("meta")).agg(F.min("path")).first()[0]
    wanted = headers.where((F.col("path") != F.lit(meta or "")) & F.array_contains("columns", time_col)).select("path", "head", "columns")
    shape = wanted.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("names"), F.max(F.size("columns")).alias("width")).first()
    if not shape["width"]:
        return (station_metadata(spark, meta) if meta else None), None
    body = lines.select("path", "value").join(wanted, "path").where(F.col("value") != F.col("head"))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(shape["width"])))
    body = body.withColumn("cells", cells).withColumn("cells", F.array(*[F.col(f"cells.c{i}") for i in range(shape["width"])]))

    targets: dict[str, list[str]] = {}
    for name in shape["names"]:
        targets.setdefault(K.POLLUTANT_ALIASES.get(name, name), []).append(name)
    pollutants = set(K.POLLUTANT_ALIASES.values())

    def column(name: str, sources: list[str]):
        kind = "double" if name in pollutants else "timestamp" if name == time_col else "string"
        found = F.zip_with("columns", "cells", lambda n, v: F.when(n.isin(sources), v.try_cast(kind)))
        return F.get(F.array_compact(found), F.lit(0)).alias(name)

    return (station_metadata(spark, meta) if meta else None), body.select(*[column(n, c) for n, c in targets.items()])


def fire_points(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Active-fire points; other columns of the file are ignored."""
    raw = _csv(spark, path)
    present = {c.strip().lower(): c for c in raw.columns}
    return raw.select(
        *[
            (F.expr(f"try_cast(`{present[f.name]}` AS {f.dataType.simpleString()})") if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in FIRE_SCHEMA
        ]
    )


def archive_measurements(spark: SparkSession, root: str, year: int, months: Sequence[int], every: int = 1) -> DataFrame:
    """Long measurements from a gzip archive laid out by location, year and month.

    Partition folders are pruned by year and month before any file is opened. All files are read, or every
    ``every``-th of each location and year, counted in path order; the choice is a semi-join on the file's path.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", "*.csv.gz").csv(root)
    there = {c.lower(): c for c in raw.columns}
    if not {"locationid", "year", "month"} <= set(there):
        return spark.createDataFrame([], "location_id string, datetime timestamp, parameter string, value double")
    chosen = raw.where((F.col(there["year"]) == year) & F.col(there["month"]).cast("int").isin(list(months)))
    rows = chosen.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/locationid=([^/]+)/", 1).alias("location_id"),
        F.expr(f"try_cast({there['datetime']} AS timestamp)").alias("datetime"),
        F.col(there["parameter"]).alias("parameter"),
        F.expr(f"try_cast({there['value']} AS double)").alias("value"),
        F.col(there["month"]).cast("int").alias("_month"),
        F.col("_metadata.file_path").alias("_path"),
    )
    if every > 1:
        # one row per file; a location has few in a year
        order = Window.partitionBy("location_id").orderBy("_month", "_path")
        files = rows.select("location_id", "_month", "_path").distinct().withColumn("_n", F.row_number().over(order) - 1)
        rows = rows.join(files.where(F.col("_n") % every == 0).select("_path"), "_path", "left_semi")
    return rows.select("location_id", "datetime", "parameter", "value")


# --- layers by file name ----------------------------------------------------------------------
#: A dated layer is named by first and last day, an AOD file by one day with or without separators.
_DAY = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_FIRST_DAY = f"({_DAY})_{_DAY}"
_LOOSE_DAY = "([0-9]{4})[_-]?([0-9]{2})[_-]?([0-9]{2})"
#: How the file names of each family begin.
FAMILY_PREFIXES = {
    "s5p": "s5p_", "era5": "era5_", "modis_frp": "modis_frp_", "modis_burned": "modis_burned_",
    "modis_evi": "modis_evi_", "worldcover": "worldcover", "srtm": "srtm", "insat": "insat",
}


def layer_catalogue(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Adds ``start_date, family, variable, is_static`` parsed from layer file names.

    A single-band family names its variable (``s5p_<gas>``, ``modis_burned``, ``modis_evi``);
    multi-band families (weather, fire power, terrain, land cover) carry several and have a
    NULL variable. Unknown names have a NULL family.
    """
    n = F.col(name_col)
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    period = F.nullif(F.regexp_extract(n, _FIRST_DAY, 1), F.lit(""))
    loose = F.when(
        F.regexp_extract(n, _LOOSE_DAY, 0) != "",
        F.concat_ws("-", *[F.regexp_extract(n, _LOOSE_DAY, i) for i in (1, 2, 3)]),
    )
    family = F.coalesce(*[F.when(stem.startswith(prefix), F.lit(kind)) for kind, prefix in FAMILY_PREFIXES.items()])
    variable = (
        F.when(family == "s5p", F.get(F.split(stem, "_"), F.lit(1)))
        .when(family == "modis_burned", "burned").when(family == "modis_evi", "evi").when(family == "insat", "aod")
    )
    static = F.coalesce(family.isin("worldcover", "srtm"), F.lit(False))
    date_text = F.when(~static, F.coalesce(period, F.when(family == "insat", loose)))
    return names.withColumns(
        {"start_date": F.try_to_date(date_text, "yyyy-MM-dd"), "family": family, "variable": variable, "is_static": static}
    )


def layer_cells(spark: SparkSession, root: str) -> DataFrame:
    """Long layers (date, variable, row, col, value, is_static) from per-layer Parquet pixel tables.

    Single-band files hold ``row, col, value``; multi-band files hold one column per band.
    Each family of names is one scan, chosen by how the names begin.
    """
    out = None
    for prefix in FAMILY_PREFIXES.values():
        glob = f"{prefix}*.parquet"
        if list_files(spark, root, glob).isEmpty():
            continue
        # files of one family may hold different bands
        found = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(root)
        raw = found.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        tagged = layer_catalogue(raw)
        bands = [c for c in raw.columns if c not in ("row", "col", "name")]
        if bands == ["value"]:
            part = tagged.select(F.col("start_date").alias("date"), "variable", "row", "col", F.col("value").cast("double").alias("value"), "is_static")
        else:
            part = tagged.select(
                F.col("start_date").alias("date"), "row", "col", "is_static",
                F.explode(F.array(*[F.struct(F.lit(b).alias("variable"), F.col(b).cast("double").alias("value")) for b in bands])).alias("b"),
            ).select("date", "b.variable", "row", "col", "b.value", "is_static").where(F.col("value").isNotNull())
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no recognised layer files under {root}")
    return out


def extraction_table(rows: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Point extractions (epoch milliseconds, longitude, latitude, bands) -> mean per (lon, lat, date).

    Coordinates are rounded to 3 digits; unreadable band values are missing.
    """
    ready = rows.select(
        F.round(F.col("longitude").cast("double"), 3).alias("lon"),
        F.round(F.col("latitude").cast("double"), 3).alias("lat"),
        F.to_date(F.timestamp_millis(F.col("time").cast("bigint"))).alias("date"),
        *[F.expr(f"try_cast(`{b}` AS double)").alias(b) for b in bands],
    )
    return ready.groupBy("lon", "lat", "date").agg(*[F.avg(b).alias(b) for b in bands])
