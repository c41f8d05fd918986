"""SQL fragments of the oracles, built from the same fixed tables as the library."""

from __future__ import annotations

from hazegrid import constants as K

POLLUTANTS = K.DEFAULT_POLLUTANTS


def settle_rounding(sql: str) -> str:
    """``round(x, d)`` -> the arithmetic of :func:`registry.rnd`."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, start + 6, -1
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        inner = settle_rounding(sql[start + 6 : comma])
        scale = f"1e{int(sql[comma + 1 : end - 1])}"
        out.append(f"{sql[at:start]}(floor(({inner}) * {scale} + 0.500001e0) / {scale})")
        at = end
    return "".join(out) + sql[at:]


def num(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def sub_index(col: str, pollutant: str) -> str:
    rows = [tuple(float(v) for v in band) for band in K.BREAKPOINTS[pollutant]]
    parts = [f"CASE WHEN {col} IS NULL OR {col} < 0 THEN NULL"]
    for pos, (c_lo, c_hi, i_lo, i_hi) in enumerate(rows):
        last = pos == len(rows) - 1
        test = f"{col} <= {num(c_hi)}" if last else f"{col} < {num(rows[pos + 1][0])}"
        parts.append(f"WHEN {test} THEN {num((i_hi - i_lo) / (c_hi - c_lo))} * ({col} - {num(c_lo)}) + {num(i_lo)}")
    return " ".join(parts) + f" ELSE {num(rows[-1][3])} END"


def category(col: str, strict: bool = False, pick: int = 2) -> str:
    parts = [f"CASE WHEN {col} IS NULL THEN NULL"]
    for row in K.CATEGORIES:
        low = f"{col} >= {num(row[0])} AND " if strict else ""
        parts.append(f"WHEN {low}{col} <= {num(row[1])} THEN '{row[pick]}'")
    return " ".join(parts) + f" ELSE '{K.CATEGORIES[-1][pick]}' END"


def si_select(cols: dict[str, str]) -> str:
    return ", ".join(f"{sub_index(c, p)} AS si_{p}" for p, c in cols.items())


def valid(ps) -> str:
    count = " + ".join(f"CAST(si_{p} IS NOT NULL AS INT)" for p in ps)
    mand = " OR ".join(f"si_{p} IS NOT NULL" for p in ps if p in K.MANDATORY)
    return f"({count} >= 3 AND ({mand}))"


def aqi(ps) -> str:
    return f"CASE WHEN {valid(ps)} THEN greatest({', '.join(f'si_{p}' for p in ps)}) END"


def dominant(ps) -> str:
    top = f"greatest({', '.join(f'si_{p}' for p in ps)})"
    whens = " ".join(f"WHEN si_{p} = {top} THEN '{p}'" for p in ps)
    return f"CASE WHEN {valid(ps)} THEN CASE {whens} END END"


def rapi(ps) -> str:
    n = "(" + " + ".join(f"CAST(si_{p} IS NOT NULL AS INT)" for p in ps) + ")"
    total = "(" + " + ".join(f"coalesce(si_{p}, 0e0)" for p in ps) + ")"
    top = f"greatest({', '.join(f'si_{p}' for p in ps)})"
    ent = " + ".join(f"CASE WHEN si_{p} > 0 THEN -(si_{p} / {total}) * ln(si_{p} / {total}) ELSE 0e0 END" for p in ps)
    even = f"CASE WHEN {n} > 1 THEN ({ent}) / ln(CAST({n} AS DOUBLE)) ELSE 0e0 END"
    value = f"CASE WHEN {top} > 0 THEN {top} * (1e0 + ({total} / {n} / {top}) * ({even})) ELSE 0e0 END"
    return f"CASE WHEN {valid(ps)} THEN {value} END"


def season(col: str) -> str:
    whens = " ".join(f"WHEN month({col}) IN ({', '.join(map(str, m))}) THEN '{s}'" for s, m in K.SEASONS.items())
    return f"CASE {whens} END"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    dlat = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    dlon = f"sin((radians({lon2}) - radians({lon1})) / 2)"
    a = f"{dlat} * {dlat} + cos(radians({lat1})) * cos(radians({lat2})) * {dlon} * {dlon}"
    return f"{num(2 * K.EARTH_RADIUS_KM)} * asin(sqrt(least(1e0, {a})))"


def daily(source: str) -> str:
    """Regulatory daily values over a wide view with pm25, pm10, no2, o3, co."""
    return f"""
    win AS (SELECT *, CAST(datetime AS DATE) AS date,
        CASE WHEN count(o3) OVER w >= 6 THEN avg(o3) OVER w END AS o3_8h,
        CASE WHEN count(co) OVER w >= 6 THEN avg(co) OVER w END AS co_8h
        FROM {source}
        WINDOW w AS (PARTITION BY station_id, CAST(datetime AS DATE) ORDER BY datetime
                     RANGE BETWEEN INTERVAL 28799 SECONDS PRECEDING AND CURRENT ROW)),
    agg AS (SELECT station_id, date, count(*) AS n_rows, count(DISTINCT hour(datetime)) AS hours,
        avg(pm25) AS pm25, avg(pm10) AS pm10, avg(no2) AS no2, max(o3) AS o3_max, max(co) AS co_max,
        max(o3_8h) AS o3_8h, max(co_8h) AS co_8h FROM win GROUP BY 1, 2),
    daily AS (SELECT station_id, date, pm25, pm10, no2, CASE WHEN n_rows <= 3 THEN o3_max ELSE o3_8h END AS o3,
        CASE WHEN n_rows <= 3 THEN co_max ELSE co_8h END AS co FROM agg WHERE n_rows <= 3 OR hours >= 16)"""
