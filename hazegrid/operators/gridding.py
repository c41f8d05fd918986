"""Operators between grids and over cell neighbourhoods, all keyed on integer indices."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.grid import GridSpec

MOORE = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def offsets_within(radius_cells: float) -> list[tuple[int, int]]:
    """Offsets (including none) within a radius in cells; the edge counts, with a 1e-9 tolerance."""
    r = math.floor(radius_cells + 1e-9)
    limit = radius_cells * radius_cells + 1e-9
    return [(dr, dc) for dr in range(-r, r + 1) for dc in range(-r, r + 1) if dr * dr + dc * dc <= limit]


def box_offsets(r: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-r, r + 1) for dc in range(-r, r + 1)]


def neighbour_aggregate(
    cells: DataFrame,
    value: str,
    offsets: Sequence[tuple[int, int]],
    aggregates: Mapping[str, Column] | None = None,
    scene: Sequence[str] = (),
    weights: Mapping[tuple[int, int], float] | None = None,
) -> DataFrame:
    """Aggregate ``value`` of the cells around each cell; missing neighbours are ignored.

    Every cell sends its value to the cells it is a neighbour of, as a column of a short
    literal array, then one aggregation keyed on the target cell adds them up. Partial sums
    form before the shuffle, so scanning cells in spatial order sends little more than
    the cells themselves. ``aggregates`` may use ``_v`` and ``_w``; targets may lie off grid.
    """
    moves = F.array(
        *[
            F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float((weights or {}).get((dr, dc), 1.0))).alias("w"))
            for dr, dc in offsets
        ]
    )
    sent = (
        cells.where(F.col(value).isNotNull())
        .select(*scene, "row", "col", F.col(value).alias("_v"), F.explode(moves).alias("_m"))
        .select(
            *scene,
            (F.col("row") + F.col("_m.dr")).cast("int").alias("row"),
            (F.col("col") + F.col("_m.dc")).cast("int").alias("col"),
            "_v",
            F.col("_m.w").alias("_w"),
        )
    )
    chosen = aggregates or {"neighbour_mean": F.avg("_v"), "neighbour_count": F.count("_v")}
    return sent.groupBy(*scene, "row", "col").agg(*[e.alias(n) for n, e in chosen.items()])


def with_neighbours(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]] = MOORE, scene: Sequence[str] = (), **options) -> DataFrame:
    """The cells with their neighbourhood aggregates attached (NULL where no neighbour has a value)."""
    return cells.join(neighbour_aggregate(cells, value, offsets, scene=scene, **options), [*scene, "row", "col"], "left")


def smooth(cells: DataFrame, value: str, radius: int = 1, scene: Sequence[str] = (), out: str = "smoothed") -> DataFrame:
    """Gaussian mean over a square window, weights renormalised over the values present."""
    if radius <= 0:
        return cells.withColumn(out, F.col(value))
    spread = 2 * K.SMOOTHING_SIGMA**2
    weights = {(dr, dc): math.exp(-(dr * dr + dc * dc) / spread) for dr, dc in box_offsets(radius)}
    agg = {out: F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")}
    return with_neighbours(cells, value, list(weights), scene, aggregates=agg, weights=weights)


# --- regridding ---------------------------------------------------------------------------
def _source_position(coord: Column, origin: float, res: float, count: int) -> tuple[Column, Column, Column]:
    """(lower index, fraction, inside hull) of a coordinate on an ascending axis of centres."""
    x = (coord - F.lit(origin)) / F.lit(res)
    inside = (x >= F.lit(-1e-9)) & (x <= F.lit(count - 1 + 1e-9))
    low = F.greatest(F.lit(0), F.least(F.floor(x + F.lit(1e-9)), F.lit(max(count - 2, 0)))).cast("int")
    return low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - low)), inside


def bilinear_weights(spark: SparkSession, source: GridSpec, target: GridSpec) -> DataFrame:
    """(row, col) of each target cell with its four source cells and weights.

    Depends on the two grids only, not on data or dates.
    """
    west = source.min_lon + source.resolution / 2
    south = source.max_lat - source.resolution / 2 - (source.n_rows - 1) * source.resolution
    c0, fx, in_x = _source_position(F.col("lon"), west, source.resolution, source.n_cols)
    r0, fy, in_y = _source_position(F.col("lat"), south, source.resolution, source.n_rows)
    located = target.cells(spark).withColumns({"c0": c0, "fx": fx, "r0": r0, "fy": fy, "_in": in_x & in_y}).where("_in")
    corner = [
        F.struct(
            (F.lit(source.n_rows - 1) - (F.col("r0") + dy)).cast("int").alias("r"),
            (F.col("c0") + dx).cast("int").alias("c"),
            ((F.col("fy") if dy else 1 - F.col("fy")) * (F.col("fx") if dx else 1 - F.col("fx"))).alias("w"),
        )
        for dy in (0, 1)
        for dx in (0, 1)
    ]
    return located.select("row", "col", F.explode(F.array(*corner)).alias("k")).select(
        "row", "col", F.col("k.r").alias("src_row"), F.col("k.c").alias("src_col"), F.col("k.w").alias("weight")
    )


def regrid_linear(
    layer: DataFrame, source: GridSpec, target: GridSpec, values: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Bilinear resampling of every value column. Cells outside the source hull are absent; a
    cell with a missing corner is NULL."""
    weights = bilinear_weights(layer.sparkSession, source, target)
    src = layer.select(*keys, F.col("row").alias("src_row"), F.col("col").alias("src_col"), *values)
    joined = src.join(weights, ["src_row", "src_col"])
    return joined.groupBy(*keys, "row", "col").agg(
        *[F.when(F.count(v) == 4, F.sum(F.col(v) * F.col("weight"))).alias(v) for v in values]
    )


def regrid_nearest(
    layer: DataFrame, source: GridSpec, target: GridSpec, values: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Nearest-cell resampling inside the source hull; halfway points take the south-western cell."""
    west = source.min_lon + source.resolution / 2
    south = source.max_lat - source.resolution / 2 - (source.n_rows - 1) * source.resolution
    c0, fx, in_x = _source_position(F.col("lon"), west, source.resolution, source.n_cols)
    r0, fy, in_y = _source_position(F.col("lat"), south, source.resolution, source.n_rows)
    half = F.lit(0.5 + 1e-9)
    mapping = (
        target.cells(layer.sparkSession)
        .where(in_x & in_y)
        .select(
            "row",
            "col",
            (F.lit(source.n_rows - 1) - (r0 + (fy > half).cast("int"))).cast("int").alias("src_row"),
            (c0 + (fx > half).cast("int")).cast("int").alias("src_col"),
        )
    )
    src = layer.select(*keys, F.col("row").alias("src_row"), F.col("col").alias("src_col"), *values)
    return src.join(mapping, ["src_row", "src_col"]).select(*keys, "row", "col", *values)


def resampling_of(variable: str) -> str:
    categorical = variable.startswith(K.NEAREST_LAYER_PREFIX) or variable in K.NEAREST_LAYERS
    return "nearest" if categorical else "linear"


def regrid(layer: DataFrame, source: GridSpec, target: GridSpec, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Resample each variable the way its kind needs."""
    parts = [
        method(layer, source, target, picked, keys)
        for method, picked in (
            (regrid_linear, [v for v in values if resampling_of(v) == "linear"]),
            (regrid_nearest, [v for v in values if resampling_of(v) == "nearest"]),
        )
        if picked
    ]
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], [*keys, "row", "col"], "full_outer")


def align_layers(layers: Mapping[str, tuple[DataFrame, GridSpec]], reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bring every (one-variable) layer onto the grid of the reference layer, as one wide table."""
    base, target = layers[reference]
    out = base.select(*keys, "row", "col", reference)
    for name, (df, grid) in layers.items():
        if name == reference:
            continue
        moved = df.select(*keys, "row", "col", name) if grid == target else regrid(df, grid, target, [name], keys)
        out = out.join(moved, [*keys, "row", "col"], "left")
    return out


def assemble_stack(
    layers: DataFrame, variables: Sequence[str], static: DataFrame | None = None, static_variables: Sequence[str] = ()
) -> DataFrame:
    """Long layers (date, variable, row, col, value) -> one wide row per date and cell.

    Static layers (variable, row, col, value) repeat on every date. Undated layers are used
    only if nothing is dated, and then count as 1970-01-01. A stack needs a dated layer.
    """
    if not variables:
        raise ValueError("no dated layers to assemble")
    dated = layers.agg(F.max(F.col("date").isNotNull()).alias("any")).scalar()
    usable = layers.where(F.col("date").isNotNull() | ~F.coalesce(dated, F.lit(False)))
    wide = usable.groupBy(F.coalesce(F.col("date"), F.lit("1970-01-01").cast("date")).alias("date"), "row", "col").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    )
    if static is None:
        return wide
    fixed = static.groupBy("row", "col").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in static_variables]
    )
    return wide.join(fixed, ["row", "col"], "left")


# --- masks ------------------------------------------------------------------------------
def largest_ring(polygons: Sequence[Sequence[Sequence[float]]]) -> list[tuple[float, float]]:
    """Outer ring with the largest bounding box."""

    def extent(ring) -> float:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        return (max(xs) - min(xs)) * (max(ys) - min(ys))

    return [(float(p[0]), float(p[1])) for p in max(polygons, key=extent)]


def polygon_cells(spark: SparkSession, grid: GridSpec, ring: Sequence[tuple[float, float]]) -> DataFrame:
    """Cells of the grid whose centre lies inside the ring (even-odd rule).

    Each edge is expanded only to the grid rows it spans; a row collects its few crossing
    longitudes (never more than the ring has edges) and its cells count those to the east.
    """
    edges = [
        (float(x1), float(y1), float(x0), float(y0))
        for (x1, y1), (x0, y0) in zip(ring, [ring[-1], *ring[:-1]], strict=True)
        if y1 != y0
    ]
    schema = "xi double, yi double, xj double, yj double"
    top = grid.max_lat - grid.resolution / 2
    rows = spark.createDataFrame(edges, schema).withColumns(
        {
            "_first": F.greatest(F.lit(0), F.floor((F.lit(top) - F.greatest("yi", "yj")) / F.lit(grid.resolution)) - 1),
            "_last": F.least(
                F.lit(grid.n_rows - 1), F.ceil((F.lit(top) - F.least("yi", "yj")) / F.lit(grid.resolution)) + 1
            ),
        }
    )
    spanned = (
        rows.where(F.col("_first") <= F.col("_last"))
        .select("xi", "yi", "xj", "yj", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_last").cast("int"))).alias("row"))
        .withColumn("lat", grid.lat_of("row"))
        .where((F.col("yi") > F.col("lat")) != (F.col("yj") > F.col("lat")))
    )
    crossing = (F.col("xj") - F.col("xi")) * (F.col("lat") - F.col("yi")) / (F.col("yj") - F.col("yi")) + F.col("xi")
    crossings = spanned.groupBy("row").agg(F.collect_list(crossing).alias("_x"))
    return (
        grid.cells(spark).join(crossings, "row")
        .where(F.size(F.filter("_x", lambda x: F.col("lon") < x)) % 2 == 1)
        .drop("_x")
    )


def infer_grid(points: DataFrame, lon: str = "lon", lat: str = "lat", fallback: float = 0.5) -> DataFrame:
    """One row: resolution (smallest positive longitude gap) and the bounds of a point table.

    Gaps are taken inside one-degree bands, each its own window, and between the ends of
    neighbouring bands, of which there are at most a few hundred.
    """
    distinct = points.where(F.col(lon).isNotNull()).select(F.col(lon).alias("_x")).distinct()
    banded = distinct.withColumn("_band", F.floor("_x"))
    inside = banded.withColumn("_gap", F.col("_x") - F.lag("_x").over(Window.partitionBy("_band").orderBy("_x")))
    bands = inside.groupBy("_band").agg(F.min("_gap").alias("_in"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    between = F.col("_first") - F.lag("_last").over(Window.orderBy("_band"))
    step = bands.withColumn("_gap", F.least("_in", between)).agg(F.min("_gap").alias("resolution"))
    bounds = points.agg(
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat")
    )
    res = F.coalesce(step.scalar(), F.lit(fallback))
    return bounds.withColumn("resolution", res).withColumns(
        {
            "n_cols": (F.floor((F.col("max_lon") - F.col("min_lon")) / F.col("resolution") + 0.5) + 1).cast("int"),
            "n_rows": (F.floor((F.col("max_lat") - F.col("min_lat")) / F.col("resolution") + 0.5) + 1).cast("int"),
        }
    )


# --- samples around points ---------------------------------------------------------------
def on_grid(samples: DataFrame, grid: GridSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Samples inside the grid, with their ``row`` and ``col``; the others are dropped."""
    row, col = grid.cell_index(F.col(lon), F.col(lat))
    return samples.withColumns({"row": row, "col": col}).where(F.col("row").isNotNull())


def _reflect(i: Column, n: int) -> Column:
    """Index mirrored at both ends without repeating the edge."""
    if n == 1:
        return F.lit(0)
    period = 2 * (n - 1)
    m = F.pmod(i, F.lit(period))
    return F.when(m < n, m).otherwise(F.lit(period) - m)


#: Columns of one strip of a row, without the rims on either side.
STRIP = 64


def _mirrors(n: int, rim: int) -> list[tuple[int, int]]:
    """(sign, shift) of the places ``sign * col + shift`` in ``-rim .. n - 1 + rim`` at which a column of ``n`` is seen."""
    if n == 1:
        return [(0, x) for x in range(-rim, rim + 1)]
    period = 2 * (n - 1)
    turns = range(-(rim // period + 1), rim // period + 2)
    return [(1, k * period) for k in turns] + [(-1, k * period) for k in turns]


def row_strips(stack: DataFrame, channels: Sequence[str], n_cols: int, rim: int) -> DataFrame:
    """``t_idx, row, strip`` and ``values``: an array over the columns of each strip and its rims, mirrored at the grid's edges.

    An entry has the channels; a missing cell or value is 0. ``stack`` has one row for each cell and time.
    """
    edge = F.col("col").isin(0, n_cols - 1)
    # a cell on the edge is its own mirror
    seen = F.array_distinct(F.array(*[(F.lit(sign) * F.col("col") + F.lit(shift)).cast("int") for sign, shift in _mirrors(n_cols, rim)]))
    placed = stack.where(F.col("col").between(0, n_cols - 1)).select("t_idx", "row", *channels, F.explode(F.when(edge | (F.col("col") <= rim) | (F.col("col") >= n_cols - 1 - rim), seen).otherwise(F.array(F.col("col").cast("int")))).alias("x"))
    placed = placed.where(F.col("x").between(-rim, n_cols - 1 + rim))
    strips = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("x") - rim - (STRIP - 1)) / STRIP)), F.least(F.lit((n_cols - 1) // STRIP), F.floor((F.col("x") + rim) / STRIP)))
    placed = placed.withColumn("strip", F.explode(strips.cast("array<int>")))
    values = F.struct(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float").alias(c) for c in channels])
    packed = placed.groupBy("t_idx", "row", "strip").agg(F.map_from_entries(F.collect_list(F.struct("x", values))).alias("_at"))
    first = F.col("strip") * STRIP - rim
    zero = F.struct(*[F.lit(0.0).cast("float").alias(c) for c in channels])
    last = F.least(first + (STRIP + 2 * rim - 1), F.lit(n_cols - 1 + rim))  # nothing is seen beyond the grid's own rim
    dense = F.transform(F.sequence(first, last), lambda x: F.coalesce(F.try_element_at("_at", x), zero))
    return packed.select("t_idx", "row", "strip", dense.alias("values"))


def patch_sequences(
    samples: DataFrame,
    stack: DataFrame,
    channels: Sequence[str],
    stats: Mapping[str, tuple[float, float]],
    grid: GridSpec,
    patch: int = 15,
    steps: int = 7,
    sample_key: str = "sample_id",
) -> DataFrame:
    """Standardised (steps x channels x patch x patch) tensor per sample as one flat array.

    ``samples`` carry ``t_idx, row, col``; ``stack`` carries ``t_idx, row, col`` and the
    channels. Before the record starts the first frame repeats; past the edge the grid is
    mirrored; a missing value is 0 after standardisation. Positions run time, channel, row,
    column. Samples of one time, row and strip share one block of steps x patch lines, as wide as their columns need, so
    what is shuffled grows with the places asked for and not with the samples; each sample cuts its patch out of its block.
    """
    half = patch // 2
    strip = F.least(F.floor(F.col("col") / STRIP), F.lit((grid.n_cols - 1) // STRIP)).cast("int")
    block = ["t_idx", "row", "strip"]
    placed = samples.select(sample_key, F.coalesce("t_idx", F.lit(0)).alias("t_idx"), "row", strip.alias("strip"), (F.col("col") - strip * STRIP).alias("_c"))
    # blocks are small for the work they bring, so their number of tasks is not left to their size
    placed = placed.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block)
    blocks = placed.groupBy(*block).agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"))
    number = F.sequence(F.lit(0), F.lit(steps * patch - 1))
    wanted = blocks.withColumn("p", F.explode(number)).select(
        *[F.col(c).alias(f"_{c}") for c in block], "_low", "_high", "p", "strip",
        F.greatest(F.lit(0), F.col("t_idx") - (steps - 1) + F.floor(F.col("p") / patch)).cast("int").alias("t_idx"),
        _reflect(F.col("row") - half + F.pmod(F.col("p"), F.lit(patch)), grid.n_rows).cast("int").alias("row"),
    )
    scaled = stack.select("t_idx", "row", "col", *[((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) for c in channels])
    # no window reaches rows outside the grid: it is mirrored there
    inside = scaled.where(F.col("row").between(0, grid.n_rows - 1))
    met = wanted.join(row_strips(inside, channels, grid.n_cols, half), block, "left")
    # the rim is as wide as half a patch, so a window begins at the sample's own column in the strip
    span = F.slice("values", (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low") + patch).cast("int"))

    def pick(c: str):
        return lambda v: v.getField(c)

    lines = met.select(*[f"_{c}" for c in block], "_low", F.struct("p", *[F.transform(span, pick(c)).alias(c) for c in channels]).alias("_line"))
    gathered = lines.groupBy(*[f"_{c}" for c in block]).agg(F.first("_low").alias("_low"), F.array_sort(F.collect_list("_line")).alias("_lines"))
    nothing = F.array_repeat(F.lit(0.0).cast("float"), patch)
    held = placed.join(gathered.withColumnsRenamed({f"_{c}": c for c in block}), block, "left")

    def window(c: str):
        return lambda v: F.coalesce(F.slice(v.getField(c), (F.col("_c") - F.col("_low") + 1).cast("int"), F.lit(patch)), nothing)

    def frame(step: Column) -> Column:
        rows = F.slice("_lines", step * patch + 1, F.lit(patch))
        return F.flatten(F.array(*[F.flatten(F.transform(rows, window(c))) for c in channels]))

    return held.select(
        sample_key,
        F.coalesce(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), frame)), F.array_repeat(F.lit(0.0).cast("float"), steps * len(channels) * patch * patch)).alias("patch"),
        F.array(*[F.lit(x) for x in (steps, len(channels), patch, patch)]).alias("shape"),
    )
