"""Hotspot, transport and export queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hazegrid import constants as K
from hazegrid.models import metrics, zones
from hazegrid.models.isolation import isolation_hotspots
from hazegrid.operators import analysis, components, gridding, hotspots, layers, temporal, transport
from hazegrid.plans import sqltext as S
from hazegrid.plans.grid_queries import _FRAMES_MASK, RING, _box_sql, disc_sql
from hazegrid.plans.index_queries import _FRAMES
from hazegrid.plans.registry import query, rounded
from hazegrid.plans.views import FIRST_SECOND_WIND, STACK_GRID, WIND_FRAMES, WIND_GRID, WIND_STEP, Tables

# --- vicinity ratio -------------------------------------------------------------------------
_PHV = """, near AS (SELECT a.row, a.col, avg(b.hcho) AS m FROM scene a JOIN scene b ON b.row BETWEEN a.row - 1 AND a.row + 1
        AND b.col BETWEEN a.col - 1 AND a.col + 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY 1, 2),
    phv AS (SELECT scene.*, hcho / nullif(m, 0) AS phv FROM scene LEFT JOIN near USING (row, col)),
    hva AS (SELECT *, coalesce(phv > 1.05e0 AND hcho >= 60000, false) AS hva FROM phv)"""


def _flagged(t: Tables):
    return hotspots.high_value_areas(t.scene(), ratio_min=1.05, threshold=60000.0, to_molec_cm2=1.0)


@query("hs_01_vicinity_ratio", _PHV + " SELECT row, col, round(phv, 5) AS phv FROM phv", ["scene"])
def _(t: Tables):
    return rounded(hotspots.vicinity_ratio(t.scene()).select("row", "col", "phv"), 5, "phv")


@query("hs_02_high_value_areas", _PHV + " SELECT row, col, round(phv, 5) AS phv, round(hcho, 3) AS hcho_molec_cm2, hva FROM hva", ["scene"])
def _(t: Tables):
    return rounded(rounded(_flagged(t).select("row", "col", "phv", "hcho_molec_cm2", "hva"), 5, "phv"), 3, "hcho_molec_cm2")


@query(
    "hs_03_confirm_change",
    _PHV + " SELECT row, col, hva, hva AND coalesce(hcho / nullif(hcho_before, 0) > 1.2e0, false) AS hva_confirmed FROM hva",
    ["scene"],
)
def _(t: Tables):
    before = t.scene().select("row", "col", F.col("hcho_before").alias("hcho"))
    return hotspots.confirm_change(_flagged(t), before, to_molec_cm2=1.0).select("row", "col", "hva", "hva_confirmed")


@query(
    "hs_04_flagged_percent",
    _PHV + " SELECT count(*) FILTER (WHERE hva) AS hva_cells, round(100e0 * count(*) FILTER (WHERE hva) / greatest(count(phv), 1), 6) AS phv_pct FROM hva",
    ["scene"],
)
def _(t: Tables):
    return rounded(hotspots.flagged_percent(_flagged(t)), 6, "phv_pct")


# --- Gi* --------------------------------------------------------------------------------------
_TAIL = """exp(-x * x / 2e0) / 2.5066282746310002e0 * ((((((1.330274429e0 * k - 1.821255978e0) * k + 1.781477937e0) * k - 0.356563782e0) * k + 0.31938153e0) * k))"""
_GI = f""", v AS (SELECT row, col, hcho AS x FROM scene WHERE hcho IS NOT NULL),
    s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd, CAST(count(x) AS DOUBLE) AS n FROM v),
    b AS (SELECT a.row, a.col, sum(b.x) AS bs, CAST(count(b.x) AS DOUBLE) AS w FROM v a JOIN v b ON b.row BETWEEN a.row - 2 AND a.row + 2
        AND b.col BETWEEN a.col - 2 AND a.col + 2 AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 6.25e0 GROUP BY 1, 2),
    z AS (SELECT row, col, (bs - m * w) / (sd * sqrt((n * w - w * w) / (n - 1))) AS gi_z FROM b, s),
    gi AS (SELECT row, col, gi_z, {_TAIL} AS gi_p FROM (SELECT *, abs(gi_z) AS x, 1e0 / (1e0 + 0.2316419e0 * abs(gi_z)) AS k FROM z)),
    adj AS (SELECT *, least(1e0, min(gi_p * n / rk) OVER (ORDER BY gi_p DESC)) AS p_adj FROM
        (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY gi_p) AS rk FROM gi))"""


def _gi(t: Tables):
    return hotspots.local_g(t.scene().select("row", "col", "lon", "lat", "hcho"), spacing=0.1, band=0.25)


@query("hs_05_local_g", _GI + " SELECT row, col, round(gi_z, 5) AS gi_z, round(gi_p, 6) AS gi_p FROM gi", ["scene"])
def _(t: Tables):
    return rounded(rounded(_gi(t).select("row", "col", "gi_z", "gi_p"), 5, "gi_z"), 6, "gi_p")


PERMS = 99


@query(
    "hs_06_permutation_p",
    f""", v AS (SELECT row, col, hcho AS x, CAST(row AS VARCHAR) || ',' || CAST(col AS VARCHAR) AS place FROM scene WHERE hcho IS NOT NULL),
    slots AS (SELECT row, col, row_number() OVER (ORDER BY substr(md5('slot0:' || place), 1, 15), row, col) AS slot FROM v),
    vals AS (SELECT perm, x, row AS fr, col AS fc, row_number() OVER (PARTITION BY perm ORDER BY substr(md5('value0:' || CAST(perm AS VARCHAR) || ':' || place), 1, 15), row, col) AS slot
        FROM v, range(1, {PERMS + 1}) r(perm)),
    sim AS (SELECT perm, row, col, CAST(x AS DECIMAL(24,6)) AS x, fr, fc FROM vals JOIN slots USING (slot)),
    off AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE dr * dr + dc * dc <= 6.25e0),
    ms AS (SELECT perm, row + dr AS row, col + dc AS col, x, dr = 0 AND dc = 0 AS here, fr = row + dr AND fc = col + dc AS home FROM sim, off),
    sp AS (SELECT perm, row, col, coalesce(sum(x) FILTER (WHERE NOT here AND NOT home), 0) + CASE WHEN count(*) FILTER (WHERE NOT here AND home) > 0 THEN coalesce(max(x) FILTER (WHERE here), 0) ELSE 0 END AS s
        FROM ms GROUP BY 1, 2, 3),
    ss AS (SELECT perm, sp.row, sp.col, s + coalesce(CAST(v.x AS DECIMAL(24,6)), 0) AS s FROM sp LEFT JOIN v ON sp.row = v.row AND sp.col = v.col),
    oo AS (SELECT row + dr AS row, col + dc AS col, sum(CAST(x AS DECIMAL(24,6))) AS s FROM v, off GROUP BY 1, 2),
    ge AS (SELECT oo.row, oo.col, count(*) FILTER (WHERE ss.s >= oo.s) AS g FROM oo JOIN ss ON oo.row = ss.row AND oo.col = ss.col GROUP BY 1, 2)
    SELECT scene.row, scene.col, round((least(g, {PERMS} - g) + 1) / {PERMS + 1}e0, 6) AS p_sim FROM scene LEFT JOIN ge ON scene.row = ge.row AND scene.col = ge.col""",
    ["scene"],
)
def _(t: Tables):
    out = hotspots.permutation_p(t.scene(), spacing=0.1, band=0.25, permutations=PERMS)
    return rounded(out.select("row", "col", "p_sim"), 6, "p_sim")


@query("hs_07_fdr_adjust", _GI + " SELECT row, col, round(gi_p, 6) AS gi_p, round(p_adj, 6) AS p_adj FROM adj", ["scene"])
def _(t: Tables):
    out = hotspots.fdr_adjust(_gi(t))
    return rounded(out.select("row", "col", "gi_p", "p_adj"), 6, "gi_p", "p_adj")


@query("hs_08_significant_high", _GI + " SELECT row, col, coalesce(p_adj < 0.5e0 AND gi_z > 0, false) AS hotspot FROM adj", ["scene"])
def _(t: Tables):
    return hotspots.significant_high(hotspots.fdr_adjust(_gi(t)), alpha=0.5).select("row", "col", "hotspot")


# --- clusters ---------------------------------------------------------------------------------
def _reach_sql(mask: str, diagonal: bool) -> str:
    touch = (
        "abs(m.row - r.row) <= 1 AND abs(m.col - r.col) <= 1" if diagonal else "abs(m.row - r.row) + abs(m.col - r.col) = 1"
    )
    return f""", RECURSIVE m AS (SELECT row, col, lon, lat, hcho FROM scene WHERE {mask}),
    r AS (SELECT row, col, row AS r0, col AS c0 FROM m UNION SELECT m.row, m.col, r.r0, r.c0 FROM r JOIN m ON {touch}),
    lab AS (SELECT row, col, min(r0 * 100000 + c0) AS root FROM r GROUP BY 1, 2)"""


@query(
    "hs_09_clusters",
    _reach_sql("hcho > 50000", False)
    + """ SELECT CAST(root // 100000 AS INT) AS cluster_row, CAST(root % 100000 AS INT) AS cluster_col, round(avg(lon), 5) AS lon, round(avg(lat), 5) AS lat,
    count(*) AS n_cells, round(avg(hcho), 3) AS hcho_value FROM lab JOIN m USING (row, col) GROUP BY 1, 2""",
    ["scene"],
)
def _(t: Tables):
    cells = t.scene().withColumn("mask", F.coalesce(F.col("hcho") > 50000, F.lit(False)))
    return rounded(rounded(components.clusters(cells, "mask", "hcho"), 5, "lon", "lat"), 3, "hcho_value")


@query(
    "hs_10_cluster_cells",
    _reach_sql("hcho > 60000", True)
    + """ SELECT row, col, CAST(root // 100000 AS INT) AS cluster_row, CAST(root % 100000 AS INT) AS cluster_col, count(*) OVER (PARTITION BY root) AS cluster_size FROM lab""",
    ["scene"],
)
def _(t: Tables):
    # small tiles so that clusters cross tile borders at every scale
    cells = t.scene().withColumn("mask", F.coalesce(F.col("hcho") > 60000, F.lit(False)))
    return components.cluster_cells(cells, "mask", connectivity=8, tile=16)


@query("hs_11_isolation_forest")
def _(t: Tables):
    out, _meta = isolation_hotspots(t.scene(), ["hcho", "no2", "co", "frp_mean"])
    return out.select("row", "col", "isolation_score", "isolation_anomaly", "isolation_cluster_id", "isolation_cluster_size")


@query(
    "hs_12_compare_masks",
    _PHV + """, c AS (SELECT count(*) FILTER (WHERE hva) AS r, count(*) FILTER (WHERE no2 > 26) AS c, count(*) FILTER (WHERE hva AND no2 > 26) AS o, count(*) FILTER (WHERE hva OR no2 > 26) AS u FROM hva)
    SELECT r AS reference_cells, c AS candidate_cells, o AS overlap_cells, round(o / CAST(u AS DOUBLE), 6) AS jaccard, round(o / CAST(c AS DOUBLE), 6) AS candidate_precision_against_reference,
    round(o / CAST(r AS DOUBLE), 6) AS reference_recall_against_candidate, 'agreement diagnostic, not supervised accuracy' AS interpretation FROM c""",
    ["scene"],
)
def _(t: Tables):
    out = hotspots.compare_masks(_flagged(t).withColumn("cand", F.col("no2") > 26), "hva", "cand")
    return rounded(out, 6, "jaccard", "candidate_precision_against_reference", "reference_recall_against_candidate")


def _source_sql(season: str | None) -> str:
    return f""", a AS (SELECT *, coalesce(frp_mean, 0e0) AS fire, {_box_sql(K.FOREST_FIRE, season)} AS f, {_box_sql(K.CROP_BURNING, season)} AS c,
        {_box_sql(K.INDUSTRIAL)} AS i, {disc_sql()} AS u FROM places),
    src AS (SELECT *, CASE WHEN fire >= 1 AND f IS NOT NULL THEN 'forest_fire' WHEN fire >= 1 AND c IS NOT NULL THEN 'agri_burning' WHEN i IS NOT NULL THEN 'industrial'
        WHEN u IS NOT NULL THEN 'urban' WHEN evi >= 0.4e0 AND fire < 1 THEN 'biogenic' ELSE 'other' END AS source,
        coalesce(CASE WHEN fire >= 1 THEN coalesce(f, c) END, i, u) AS source_detail FROM a)"""


@query("hs_13_attribute_sources", _source_sql(None) + " SELECT place_id, source, source_detail FROM src", ["places"])
def _(t: Tables):
    return hotspots.attribute_sources(t.places()).select("place_id", "source", "source_detail")


@query("hs_13_attribute_sources_in_season", _source_sql("post_monsoon") + " SELECT place_id, source, source_detail FROM src", ["places"])
def _(t: Tables):
    return hotspots.attribute_sources(t.places(), "post_monsoon").select("place_id", "source", "source_detail")


def _zone_cells(t: Tables):
    return t.scene().select("row", "col", "lon", "lat", (F.col("no2") * 8.0).alias("aqi"), "hcho", "no2", "co", "frp_mean")


@query("hs_14_pollution_zones")
def _(t: Tables):
    out, meta = zones.fit_zones(_zone_cells(t), ["aqi", "hcho", "no2", "co"])
    rows = [(int(k), v, int(k) == meta["selected_k"]) for k, v in meta["candidate_silhouette"].items()]
    return t.spark.createDataFrame(rows, "k int, silhouette double, selected boolean")


@query(
    "hs_14_zone_invariants",
    """ SELECT count(*) FILTER (WHERE hcho IS NOT NULL AND no2 IS NOT NULL AND co IS NOT NULL) AS clustered,
    count(*) FILTER (WHERE hcho IS NULL OR no2 IS NULL OR co IS NULL) AS left_out, true AS ids_from_zero, true AS means_rise, true AS scores_cancel FROM scene""",
    ["scene"],
)
def _(t: Tables):
    out, _meta = zones.fit_zones(_zone_cells(t), ["aqi", "hcho", "no2", "co"])
    per_zone = out.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.avg("aqi").alias("m"), F.abs(F.avg("zone_score")).alias("off"))
    inside = F.col("zone_id").isNotNull()
    ranked = F.array_sort(F.collect_list(F.when(inside, F.struct("zone_id", "m"))))
    ids, means = F.transform(ranked, lambda z: z["zone_id"]), F.transform(ranked, lambda z: z["m"])
    return per_zone.agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("clustered"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("left_out"),
        (ids == F.sequence(F.lit(0), F.size(ids) - 1)).alias("ids_from_zero"), (means == F.array_sort(means)).alias("means_rise"), (F.max("off") < 1e-6).alias("scores_cancel"),
    )


# fixed starting centres of one step, over quantity and discount
LLOYD_CENTRES = [[[10.3, 0.0213], [24.7, 0.0507], [39.9, 0.0791]], [[19.7, 0.0311], [31.3, 0.0713]]]
_STEP_SQL = " UNION ALL ".join(
    f"""SELECT {m} AS model, a.i AS cluster, count(*) AS n, round(sum(a.d), 4) AS cost, round(avg(no2), 6) AS no2, round(avg(co), 8) AS co FROM (
        SELECT no2, co, list_min([{", ".join(f"{{'d': (no2 - {S.num(x)}) * (no2 - {S.num(x)}) + (co * 100e0 - {S.num(100 * y)}) * (co * 100e0 - {S.num(100 * y)}), 'i': {i}}}" for i, (x, y) in enumerate(model))}]) AS a
        FROM scene WHERE no2 IS NOT NULL AND co IS NOT NULL) GROUP BY a.i"""
    for m, model in enumerate(LLOYD_CENTRES)
)


@query("hs_14_lloyd_step", " " + _STEP_SQL, ["scene"])
def _(t: Tables):
    points = t.scene().where(F.col("no2").isNotNull() & F.col("co").isNotNull()).select("no2", (F.col("co") * 100.0).alias("co"))
    models = [np.array(m) * [1.0, 100.0] for m in LLOYD_CENTRES]
    step = zones.lloyd_step(points, ["no2", "co"], models)
    out = step.select("model", "cluster", "n", "cost", (F.col("sum_no2") / F.col("n")).alias("no2"), (F.col("sum_co") / F.col("n") / 100.0).alias("co"))
    return rounded(rounded(rounded(out, 4, "cost"), 6, "no2"), 8, "co")


_GIVEN = """, cl AS (SELECT row, col, lon, lat, no2 * 8e0 AS aqi, hcho, no2, co, CASE WHEN no2 IS NOT NULL THEN row % 4 END AS g FROM scene),
    zm AS (SELECT g, avg(aqi) AS m, count(*) AS n FROM cl WHERE g IS NOT NULL GROUP BY 1),
    zn AS (SELECT *, CAST(row_number() OVER (ORDER BY m NULLS LAST, g) - 1 AS INT) AS zone_id FROM zm),
    zl AS (SELECT cl.*, zone_id, [""" + ", ".join(f"'{x}'" for x in K.ZONE_LABELS[4]) + """][zone_id + 1] AS zone_label, aqi - m AS zone_score FROM cl LEFT JOIN zn USING (g))"""


def _given_zones(t: Tables):
    """Cells labelled by given clusters instead of fitted ones, which SQL can follow."""
    cells = _zone_cells(t).withColumn("g", F.when(F.col("no2").isNotNull(), F.col("row") % 4))
    return zones.label_zones(cells, "g", "aqi", K.ZONE_LABELS[4])


@query("hs_15_zone_labels", _GIVEN + " SELECT row, col, zone_id, zone_label, round(zone_score, 4) AS zone_score FROM zl", ["scene"])
def _(t: Tables):
    return rounded(_given_zones(t).select("row", "col", "zone_id", "zone_label", "zone_score"), 4, "zone_score")


@query(
    "hs_16_zone_metadata",
    _GIVEN + """ SELECT zone_id, zone_label, count(*) AS n_cells, round(avg(aqi), 4) AS aqi, round(avg(hcho), 2) AS hcho, round(avg(no2), 4) AS no2, round(avg(co), 5) AS co
    FROM zl WHERE zone_id IS NOT NULL GROUP BY 1, 2""",
    ["scene"],
)
def _(t: Tables):
    table = zones.zone_table(_given_zones(t), ["aqi", "hcho", "no2", "co"])
    return rounded(rounded(rounded(table, 4, "aqi", "no2"), 2, "hcho"), 5, "co")


@query("hs_16_fitted_zones")
def _(t: Tables):
    _out, meta = zones.fit_zones(_zone_cells(t), ["aqi", "hcho", "no2", "co"])
    return zones.zone_metadata_rows(t.spark, meta)


@query("hs_17_analysis_layers")
def _(t: Tables):
    flagged = _flagged(t).select("row", "col", "hva")
    cells = _zone_cells(t).join(flagged, ["row", "col"])
    return analysis.analysis_layers(cells, date="2024-01-01", mask="hva")


@query(
    "hs_17_zone_layer",
    _GIVEN + """ SELECT CAST(zone_id AS BIGINT) AS zone_id, count(*) AS cells, round(sum(round(lon, 3)), 1) AS lon_sum, round(sum(zone_score), 1) AS score_sum, count(hcho) AS with_hcho
    FROM zl WHERE zone_id IS NOT NULL GROUP BY 1""",
    ["scene"],
)
def _(t: Tables):
    kinds = "zone_id bigint, lon double, zone_score double, hcho double"
    cells = analysis.zone_layer(_given_zones(t)).select(F.from_json("json", kinds).alias("j")).select("j.*")
    sums = [F.count(F.lit(1)).alias("cells"), F.sum("lon").alias("lon_sum"), F.sum("zone_score").alias("score_sum"), F.count("hcho").alias("with_hcho")]
    return rounded(cells.groupBy("zone_id").agg(*sums), 1, "lon_sum", "score_sum")


@query(
    "hs_18_confidence",
    _source_sql(None) + """ SELECT place_id, CASE WHEN source = 'agri_burning' AND fire > 100 THEN 'High' WHEN fire > 0 OR source <> 'other' THEN 'Medium' ELSE 'Low' END AS confidence,
    CASE source """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SOURCE_ACTIONS.items()) + " END AS action FROM src",
    ["places"],
)
def _(t: Tables):
    return hotspots.with_confidence(hotspots.attribute_sources(t.places())).select("place_id", "confidence", "action")


@query("hs_19_count_by_source", _source_sql(None) + " SELECT source, count(*) AS n FROM src GROUP BY 1", ["places"])
def _(t: Tables):
    return hotspots.count_by_source(hotspots.attribute_sources(t.places()))


# --- transport ---------------------------------------------------------------------------------
_DIR = "CASE WHEN d < 0 THEN d + 360e0 WHEN d >= 360 THEN d - 360e0 ELSE d END"
_WIND = f"w AS (SELECT t_idx, row, col, sqrt(u_wind * u_wind + v_wind * v_wind) AS sp, {_DIR} AS dir FROM (SELECT *, 270e0 - degrees(atan2(v_wind, u_wind)) AS d FROM wind))"


@query("tr_01_wind", f", {_WIND} SELECT t_idx, row, col, round(sp, 5) AS wind_speed, round(dir, 5) AS wind_from FROM w", ["wind"])
def _(t: Tables):
    return rounded(transport.add_wind(t.wind()).select("t_idx", "row", "col", "wind_speed", "wind_from"), 5, "wind_speed", "wind_from")


@query(
    "tr_02_wind_rose",
    """WITH w AS (SELECT sqrt(u * u + v * v) AS sp, 270e0 - degrees(atan2(v, u)) AS d FROM (SELECT l_quantity - 25.3e0 AS u, l_tax * 300e0 - 12.1e0 AS v FROM lineitem)),
    b AS (SELECT CAST(floor(((d + 11.25e0) % 360 + 360) % 360 / 22.5e0) AS INT) % 16 AS sector, CASE WHEN sp >= 10 THEN 10e0 WHEN sp >= 8 THEN 8e0 WHEN sp >= 6 THEN 6e0 WHEN sp >= 4 THEN 4e0 WHEN sp >= 2 THEN 2e0 ELSE 0e0 END AS speed_bin FROM w)
    SELECT sector, speed_bin, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM b GROUP BY 1, 2""",
)
def _(t: Tables):
    winds = t.table("lineitem").select((F.col("l_quantity") - 25.3).alias("u_wind"), (F.col("l_tax") * 300.0 - 12.1).alias("v_wind"))
    return rounded(transport.wind_rose(winds), 6, "percent")


HOURS, DT = 36, 3
_W, _R = WIND_GRID, "2e0"
_WEST, _EAST = _W.min_lon + 1.0, _W.min_lon + 1.0 + (_W.n_cols - 1) * 2.0
_NORTH = _W.max_lat - 1.0
_SOUTH = _NORTH - (_W.n_rows - 1) * 2.0
_PATH = f""", RECURSIVE path AS (
    SELECT parcel_id, 0 AS step, CAST(time AS BIGINT) AS time, lon, lat, false AS done FROM parcels
    UNION ALL
    SELECT parcel_id, step + 1, time - {DT * 3600}, greatest({S.num(_WEST)}, least({S.num(_EAST)}, nlon)), greatest({S.num(_SOUTH)}, least({S.num(_NORTH)}, nlat)),
        nlon < {S.num(_WEST)} OR nlon > {S.num(_EAST)} OR nlat < {S.num(_SOUTH)} OR nlat > {S.num(_NORTH)}
    FROM (SELECT p.*, lon - (u_wind * {DT * 3600}e0) / (6371008.8e0 * cos(radians(lat))) * 57.29577951308232e0 AS nlon,
            lat - (v_wind * {DT * 3600}e0) / 6371008.8e0 * 57.29577951308232e0 AS nlat
        FROM (SELECT *, CAST(greatest(0, least({WIND_FRAMES - 1}, ceil((time - {FIRST_SECOND_WIND}) / {WIND_STEP}e0 - 0.5e0))) AS INT) AS t_idx,
            CAST(greatest(0, least({_W.n_rows - 1}, ceil(({S.num(_NORTH)} - lat) / {_R} - 0.5e0))) AS INT) AS row,
            CAST(greatest(0, least({_W.n_cols - 1}, floor((lon - {S.num(_WEST)}) / {_R} + 0.5e0))) AS INT) AS col
            FROM path WHERE NOT done AND step < {HOURS // DT}) p JOIN wind USING (t_idx, row, col)))"""


def _paths(t: Tables):
    return transport.back_trajectories(
        t.parcels(), t.wind(), WIND_GRID, FIRST_SECOND_WIND, WIND_STEP, WIND_FRAMES, hours=HOURS, dt_hours=DT
    )


@query("tr_03_back_trajectories", _PATH + " SELECT parcel_id, step, time, round(lon, 5) AS lon, round(lat, 5) AS lat FROM path", ["wind", "parcels"])
def _(t: Tables):
    return rounded(_paths(t), 5, "lon", "lat")


@query("ex_06_path_points", _PATH + " SELECT parcel_id, step, round(lon, 2) AS lon, round(lat, 2) AS lat FROM path", ["wind", "parcels"])
def _(t: Tables):
    return layers.path_points(_paths(t))


_HIT = S.haversine("longitude", "latitude", "lon", "lat")


@query(
    "tr_04_fires_along_path",
    _PATH + f""", hit AS (SELECT DISTINCT parcel_id, fire_id FROM path JOIN fires ON abs(latitude - lat) <= 1.36e0 AND {_HIT} <= 150)
    SELECT p.parcel_id, count(fire_id) AS fires_along_path FROM (SELECT DISTINCT parcel_id FROM path) p LEFT JOIN hit ON p.parcel_id = hit.parcel_id GROUP BY 1""",
    ["wind", "parcels", "fires"],
)
def _(t: Tables):
    return transport.fires_along_path(_paths(t), t.fires(), 150.0)


@query(
    "tr_05_fire_density",
    f"""SELECT CAST(least(119, floor((longitude - 68e0) / {S.num((97.5 - 68.0) / 120)})) AS INT) AS x_bin, CAST(least(119, floor((latitude - 6.5e0) / {S.num((37.5 - 6.5) / 120)})) AS INT) AS y_bin, count(*) AS n
    FROM fires WHERE longitude BETWEEN 68 AND 97.5 AND latitude BETWEEN 6.5 AND 37.5 GROUP BY 1, 2""",
    ["fires"],
)
def _(t: Tables):
    return transport.fire_density(t.fires())


@query(
    "tr_06_trajectory_summary",
    _PATH + f""", hit AS (SELECT DISTINCT parcel_id, fire_id FROM path JOIN fires ON abs(latitude - lat) <= 0.46e0 AND {_HIT} <= 50),
    n AS (SELECT parcel_id, count(*) AS fires_along_path FROM hit GROUP BY 1)
    SELECT parcel_id, count(*) AS trajectory_points, round(max_by(lon, step), 5) AS end_lon, round(max_by(lat, step), 5) AS end_lat, coalesce(max(fires_along_path), 0) AS fires_along_path
    FROM path LEFT JOIN n USING (parcel_id) GROUP BY 1""",
    ["wind", "parcels", "fires"],
)
def _(t: Tables):
    return rounded(transport.trajectory_summary(_paths(t), t.fires(), 50.0), 5, "end_lon", "end_lat")


# --- export -----------------------------------------------------------------------------------
_MAP = {"pm25": "p1", "pm10": "p2", "no2": "p3", "co": "p4"}
_PRED = "pred AS (SELECT date, row, col, lon, lat, no2 * 6e0 AS p1, hcho * 4e0 AS p2, aod * 400e0 AS p3, co * 40e0 AS p4 FROM stack)"


@query(
    "aq_11_index_frames",
    _FRAMES + f""", {_PRED}, si AS (SELECT date, lon, lat, {S.si_select(_MAP)} FROM pred JOIN frames USING (date) WHERE {_FRAMES_MASK}),
    d AS (SELECT date, lon, lat, {S.aqi(_MAP)} AS cpcb, {S.rapi(_MAP)} AS rapi FROM si)
    SELECT date, round(round(lon, 2), 2) AS lon, round(lat, 2) AS lat, CAST(floor(cpcb) AS INT) AS aqi, CAST(floor(rapi) AS INT) AS rapi FROM d WHERE cpcb IS NOT NULL""",
    ["stack"],
    text=["date"],
)
def _(t: Tables):
    pred = t.stack().select(
        "date", "row", "col", "lon", "lat", (F.col("no2") * 6.0).alias("p1"), (F.col("hcho") * 4.0).alias("p2"), (F.col("aod") * 400.0).alias("p3"), (F.col("co") * 40.0).alias("p4"),
    )
    frames = temporal.evenly_spaced_frames(t.stack())
    inside = gridding.polygon_cells(t.spark, STACK_GRID, RING)
    return rounded(layers.index_frames(pred, frames, inside, _MAP), 2, "lon", "lat")


@query(
    "ex_01_percentile_stretch",
    """, c AS (SELECT quantile_cont(hcho, [0.02, 0.98]) AS h, quantile_cont(no2, [0.02, 0.98]) AS n FROM scene WHERE col >= 3)
    SELECT row, col, round(greatest(0e0, least(1e0, (hcho - h[1]) / (h[2] - h[1] + 1e-12))), 6) AS hcho, round(greatest(0e0, least(1e0, (no2 - n[1]) / (n[2] - n[1] + 1e-12))), 6) AS no2 FROM scene, c WHERE hcho IS NOT NULL
    UNION ALL SELECT row, col, NULL, round(greatest(0e0, least(1e0, (no2 - n[1]) / (n[2] - n[1] + 1e-12))), 6) FROM scene, c WHERE hcho IS NULL""",
    ["scene"],
)
def _(t: Tables):
    cells = t.scene().select("row", "col", "hcho", "no2", (F.col("col") >= 3).alias("inside"))
    return rounded(layers.percentile_stretch(cells, ["hcho", "no2"], inside="inside").drop("inside"), 6, "hcho", "no2")


@query(
    "ex_02_fire_sample",
    "SELECT fire_id FROM fires ORDER BY substr(md5('0:' || CAST(fire_id AS VARCHAR)), 1, 15), fire_id LIMIT 1400",
    ["fires"],
)
def _(t: Tables):
    return layers.fire_sample(t.fires(), 1400).select("fire_id")


@query(
    "ex_03_tidy_numbers",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice / l_discount, 3) END AS ratio, round(l_tax, 1) AS tax FROM lineitem",
)
def _(t: Tables):
    big = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.nullif(F.col("l_discount"), F.lit(0.0)))
    raw = t.table("lineitem").select("l_orderkey", "l_linenumber", big.alias("ratio"), F.col("l_tax").alias("tax"))
    tidy = layers.tidy_numbers(raw, {"ratio": 6, "tax": 6})
    return rounded(rounded(tidy, 3, "ratio"), 1, "tax")


_OP = ", o AS (SELECT pm25 AS t, no2_obs * 3e0 AS p FROM panel WHERE pm25 IS NOT NULL AND no2_obs IS NOT NULL)"


@query(
    "ex_04_observed_predicted",
    _OP + """ SELECT 'pm25' AS target, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2, round(sqrt(avg((t - p) * (t - p))), 5) AS rmse, round(avg(abs(t - p)), 5) AS mae, count(*) AS n FROM o""",
    ["panel"],
)
def _(t: Tables):
    pairs = t.panel().withColumn("p", F.col("no2_obs") * 3.0)
    return rounded(rounded(metrics.score(pairs, {"pm25": ("pm25", "p")}), 6, "r2"), 5, "rmse", "mae")


@query(
    "ex_04_density_bins",
    _OP + """, l AS (SELECT least(0e0, min(t), min(p)) AS lo, greatest(max(t), max(p)) AS hi FROM o)
    SELECT CAST(least(49, floor((t - lo) / ((hi - lo) / 50e0))) AS INT) AS truth_bin, CAST(least(49, floor((p - lo) / ((hi - lo) / 50e0))) AS INT) AS prediction_bin, count(*) AS n FROM o, l GROUP BY 1, 2""",
    ["panel"],
)
def _(t: Tables):
    return metrics.density_bins(t.panel().withColumn("p", F.col("no2_obs") * 3.0), "pm25", "p")


@query(
    "ex_05_season_pairs",
    f"""SELECT {S.season('date')} AS season, count(*) AS n, round(avg(hcho), 4) AS hcho_mean, round(avg(o3_obs), 4) AS o3_obs_mean, round(corr(hcho, o3_obs), 6) AS r
    FROM panel WHERE hcho IS NOT NULL AND o3_obs IS NOT NULL GROUP BY 1""",
    ["panel"],
)
def _(t: Tables):
    return rounded(rounded(layers.season_pairs(t.panel()), 4, "hcho_mean", "o3_obs_mean"), 6, "r")


@query(
    "ex_06_web_layers",
    _source_sql(None) + """ SELECT 'hotspot' AS layer, round(lon, 2) AS lon, round(lat, 2) AS lat, source AS label, coalesce(source_detail, '') AS detail, round(frp_mean, 1) AS frp, CAST(n_cells AS BIGINT) AS n FROM src
    UNION ALL SELECT 'fire', round(longitude, 2), round(latitude, 2), '', '', round(frp, 0), 1 FROM fires""",
    ["places", "fires"],
)
def _(t: Tables):
    spots = layers.hotspot_points(hotspots.attribute_sources(t.places()))
    a = spots.select(F.lit("hotspot").alias("layer"), "lon", "lat", F.col("source").alias("label"), "detail", "frp", F.col("n").cast("bigint"))
    b = layers.fire_points(t.fires()).select(F.lit("fire").alias("layer"), "lon", "lat", F.lit("").alias("label"), F.lit("").alias("detail"), "frp", F.lit(1).cast("bigint").alias("n"))
    return a.unionByName(b)


@query(
    "ex_07_run_summary",
    "SELECT count(*) AS training_rows, CAST(3 AS BIGINT) AS n_features, round(count(*) FILTER (WHERE aod IS NULL) / CAST(count(*) AS DOUBLE), 6) AS missing_frac, count(DISTINCT station_id) AS stations FROM panel",
    ["panel"],
)
def _(t: Tables):
    return rounded(layers.run_summary(t.panel(), ["aod", "no2", "blh", "absent"]), 6, "missing_frac")
