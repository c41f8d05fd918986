"""Web layers, rounding and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.functions import index as ix
from hazegrid.functions.geo import finite, portable_hash
from hazegrid.operators.joining import within_box
from hazegrid.operators.ranking import exact_quantiles
from hazegrid.operators.temporal import season_of


# --- index tables ------------------------------------------------------------------------
def sub_indices(columns: Mapping[str, str] | Sequence[str] = K.DEFAULT_POLLUTANTS, bands=None) -> dict[str, Column]:
    mapping = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    return {p: ix.sub_index(F.col(c), p, bands) for p, c in mapping.items() if p in (bands or K.BREAKPOINTS)}


def _with_sub_indices(df: DataFrame, columns) -> tuple[DataFrame, dict[str, Column], list[str]]:
    mapping = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    mapping = {p: c for p, c in mapping.items() if c in df.columns}
    made = {f"_si_{p}": e for p, e in sub_indices(mapping).items()}
    return df.withColumns(made), {n[4:]: F.col(n) for n in made}, list(made)


def add_index(df: DataFrame, columns: Mapping[str, str] | Sequence[str] = K.DEFAULT_POLLUTANTS, strict_bands: bool = False) -> DataFrame:
    """Adds ``aqi, aqi_dominant, aqi_category``. ``columns`` maps pollutants to column names."""
    ready, si, scratch = _with_sub_indices(df, columns)
    ready = ready.withColumn("aqi", ix.overall_index(si))
    named = F.coalesce(*[F.when(c == F.col("aqi"), F.lit(p)) for p, c in si.items()])
    out = ready.withColumns({"aqi_dominant": named, "aqi_category": ix.category(F.col("aqi"), strict_bands)})
    return out.drop(*scratch)


def add_dual_index(df: DataFrame, columns: Mapping[str, str] | Sequence[str] = K.DEFAULT_POLLUTANTS) -> DataFrame:
    """Adds ``cpcb, rapi, dominant, divergence``.

    Built in stages, so that shared parts are computed once and no generated method grows
    past what the JVM will compile.
    """
    ready, si, scratch = _with_sub_indices(df, columns)
    parts = {f"_e_{n}": e for n, e in ix.entropy_parts(si).items()}
    ready = ready.withColumns({**parts, "_valid": ix.is_valid(si)})
    n, total, top, weighted = (F.col(c) for c in parts)
    named = F.coalesce(*[F.when(c == top, F.lit(p)) for p, c in si.items()])
    out = ready.withColumns(
        {
            "cpcb": F.when(F.col("_valid"), top),
            "rapi": ix.entropy_from_parts(n, total, top, weighted, F.col("_valid")),
            "dominant": F.when(F.col("_valid"), named),
        }
    )
    return out.withColumn("divergence", F.col("rapi") - F.col("cpcb")).drop(*scratch, *parts, "_valid")


def category_histogram(df: DataFrame, value: str = "cpcb", strict_bands: bool = False) -> DataFrame:
    valid = df.where(F.col(value).isNotNull())
    return valid.groupBy(ix.category(F.col(value), strict_bands).alias("category")).agg(F.count(F.lit(1)).alias("cells"))


def index_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("cpcb").alias("cpcb_mean"), F.max("cpcb").alias("cpcb_max"), F.avg("rapi").alias("rapi_mean"),
        F.max("rapi").alias("rapi_max"), F.avg("divergence").alias("divergence_mean"), F.count("cpcb").alias("valid_cells"),
    )


def seasonal_index(df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ("row", "col"), predict=None) -> DataFrame:
    """Average the inputs over time first, then (optionally) predict, then form the indices."""
    inputs = [c for c in df.columns if c not in (*keys, "date", "time", "t_idx")]
    mean = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in inputs])
    return add_dual_index(predict(mean) if predict else mean, columns)


def index_frames(predicted: DataFrame, frames: DataFrame, inside: DataFrame | None, columns) -> DataFrame:
    """Rounded (date, lon, lat, aqi, rapi) cells of the chosen dates inside the mask."""
    picked = predicted.join(frames.select("date"), "date", "left_semi")
    if inside is not None:
        picked = picked.join(inside.select("row", "col"), ["row", "col"], "left_semi")
    dual = add_dual_index(picked, columns).where(F.col("cpcb").isNotNull())
    return dual.select(
        "date", F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"),
        F.floor("cpcb").cast("int").alias("aqi"), F.floor("rapi").cast("int").alias("rapi"),
    )


def frames_json(cells: DataFrame, tile_degrees: float = 2.0) -> DataFrame:
    """One compact JSON object per date and square of ``tile_degrees``: date, key and cell arrays.

    The squares lie fixed on the globe, so a frame of any size is cut alike and a document holds one square.
    """
    tile = {f"tile_{c}": F.floor(F.col(c) / F.lit(tile_degrees)).cast("int") for c in ("lon", "lat")}
    parted = cells.withColumns(tile)
    entry = F.array(F.col("lon"), F.col("lat"), F.col("aqi").cast("double"), F.col("rapi").cast("double"))
    return parted.groupBy("date", "tile_lon", "tile_lat").agg(
        F.to_json(
            F.struct(
                F.first(F.col("date").cast("string")).alias("date"),
                F.array(*[F.lit(k) for k in ("lon", "lat", "aqi", "rapi")]).alias("key"),
                F.array_sort(F.collect_list(entry)).alias("cells"),
            )
        ).alias("json")
    )


# --- stretches and rounding ----------------------------------------------------------------
def percentile_stretch(df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98, inside: str | None = None) -> DataFrame:
    """Columns scaled to [0, 1] between two percentiles of the masked cells."""
    basis = df.where(F.col(inside)) if inside else df
    cuts = exact_quantiles(basis, list(columns), [low, high])

    def stretched(c: str) -> Column:
        lo, hi = cuts[c]
        if lo is None:
            return F.lit(None).cast("double")
        t = (F.col(c) - F.lit(lo)) / F.lit(hi - lo + 1e-12)
        return F.when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))

    return df.withColumns({c: stretched(c) for c in columns})


def tidy_numbers(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Finite values rounded to the stated digits; anything else NULL."""
    return df.withColumns({c: F.round(finite(F.col(c)), d) for c, d in digits.items()})


def fire_sample(fires: DataFrame, limit: int, seed: int = 0, key: str = "fire_id") -> DataFrame:
    """Repeatable sample of at most ``limit`` fires for display: the smallest seeded hashes."""
    return fires.orderBy(portable_hash(F.col(key), str(seed), 15), key).limit(limit)


def fire_points(fires: DataFrame) -> DataFrame:
    return fires.select(
        F.round("longitude", 2).alias("lon"), F.round("latitude", 2).alias("lat"), F.round("frp", 0).alias("frp")
    )


def hotspot_points(attributed: DataFrame) -> DataFrame:
    return attributed.select(
        F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"), "source",
        F.coalesce("source_detail", F.lit("")).alias("detail"), F.round("frp_mean", 1).alias("frp"),
        F.col("n_cells").alias("n"),
    )


def path_points(path: DataFrame) -> DataFrame:
    return path.select("parcel_id", "step", F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"))


# --- summaries -----------------------------------------------------------------------------
def season_pairs(df: DataFrame, x: str = "hcho", y: str = "o3_obs", date_col: str = "date") -> DataFrame:
    """Paired-value statistics per season, the table behind a scatter by season."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("season", season_of(F.col(date_col)))
    return both.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias(f"{x}_mean"), F.avg(y).alias(f"{y}_mean"), F.corr(x, y).alias("r")
    )


def run_summary(training: DataFrame, features: Sequence[str], variable: str = "aod") -> DataFrame:
    return training.agg(
        F.count(F.lit(1)).alias("training_rows"),
        F.lit(len([c for c in features if c in training.columns])).cast("bigint").alias("n_features"),
        (F.count_if(F.col(variable).isNull()) / F.count(F.lit(1))).alias("missing_frac"),
        F.count_distinct("station_id").alias("stations"),
    )


def metrics_json(metrics: DataFrame, name_col: str = "target", scheme_col: str | None = None) -> DataFrame:
    """Long metrics -> one nested JSON document. One row per target (and scheme), so the document is small.

    With ``scheme_col`` a target has its ``n``, its ``stations`` (where there is such a column) and ``schemes``: the
    other metrics by scheme.
    """
    if scheme_col:
        shared = [c for c in ("n", "stations") if c in metrics.columns]
        own = F.struct(*[c for c in metrics.columns if c not in (name_col, scheme_col, *shared)])
        schemes = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(scheme_col), own))))
        metrics = metrics.groupBy(name_col).agg(*[F.max(c).alias(c) for c in shared], schemes.alias("schemes"))
    values = [c for c in metrics.columns if c != name_col]
    by_name = lambda a, b: F.when(a[name_col] < b[name_col], -1).when(a[name_col] > b[name_col], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col(name_col), F.struct(*values))), by_name)
    return metrics.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


# --- dossier -------------------------------------------------------------------------------
def cell_dossier(
    places: DataFrame,
    index_cells: DataFrame,
    hcho_cells: DataFrame,
    zone_cells: DataFrame,
    anomaly_cells: DataFrame,
    fires: DataFrame,
    hotspots: DataFrame,
    match_deg: float = 0.4,
    fire_deg: float = 2.0,
    source_deg2: float = 4.0,
) -> DataFrame:
    """What every layer says about each place (``place_id, lon, lat``).

    First matching cell within ``match_deg`` in (row, col) order; fires in a box; the closest hotspot if its squared
    distance is below ``source_deg2``. Places, fires and hotspots are merged per coordinate beforehand, so pairs are
    those of different coordinates.
    """
    spots = places.select("lon", "lat").distinct()

    def first_match(layer: DataFrame, values: Sequence[str]) -> DataFrame:
        near = within_box(spots, layer.select("lon", "lat", "row", "col", *values), match_deg)
        best = F.min(F.struct("r_row", "r_col", *[f"r_{v}" for v in values])).alias("_m")
        return near.groupBy("lon", "lat").agg(best).select("lon", "lat", *[F.col(f"_m.r_{v}").alias(v) for v in values])

    burning = fires.groupBy(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("frp", F.lit(0.0))).alias("frp")
    )
    near_fires = within_box(spots, burning, fire_deg).groupBy("lon", "lat").agg(
        F.sum("r_n").alias("nearby_fire_count"), F.sum("r_frp").alias("nearby_frp")
    )
    reach = source_deg2**0.5
    # of the hotspots of one coordinate, all equally far, the first one wins
    named = hotspots.groupBy("lon", "lat").agg(F.min(F.struct("hotspot_id", "source")).alias("first"))
    pairs = within_box(spots, named, reach)
    d2 = (F.col("r_lon") - F.col("lon")) * (F.col("r_lon") - F.col("lon")) + (F.col("r_lat") - F.col("lat")) * (
        F.col("r_lat") - F.col("lat")
    )
    closest = (
        pairs.where(d2 < F.lit(source_deg2)).groupBy("lon", "lat")
        .agg(F.min(F.struct(d2.alias("d"), F.col("r_first"))).alias("_m"))
        .select("lon", "lat", F.col("_m.r_first.source").alias("source"))
    )
    for part in (
        first_match(index_cells, ["aqi"]),
        first_match(hcho_cells, ["hcho"]),
        first_match(zone_cells, ["zone_id", "zone_label"]),
        first_match(anomaly_cells, ["isolation_score"]),
        near_fires,
        closest,
    ):
        spots = spots.join(part, ["lon", "lat"], "left")
    out = places.join(spots, ["lon", "lat"], "left").select(*places.columns, *[c for c in spots.columns if c not in ("lon", "lat")])
    return out.withColumns(
        {
            "nearby_fire_count": F.coalesce("nearby_fire_count", F.lit(0)).cast("bigint"),
            "nearby_frp": F.coalesce("nearby_frp", F.lit(0.0)),
        }
    )
