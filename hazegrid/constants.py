"""Fixed values that results depend on: index bands, plausibility limits, regions.

Everything in this module is a published or agreed constant, written out plainly and in
its natural order. No logic lives here.
"""

from __future__ import annotations

# --- fixed values: national index bands (2014 scheme) -------------------------------
# One row per band: concentration low/high, index low/high. ug/m3, CO in mg/m3.
BREAKPOINTS = {
    "pm25": [
        (0, 30, 0, 50),
        (31, 60, 51, 100),
        (61, 90, 101, 200),
        (91, 120, 201, 300),
        (121, 250, 301, 400),
        (251, 500, 401, 500),
    ],
    "pm10": [
        (0, 50, 0, 50),
        (51, 100, 51, 100),
        (101, 250, 101, 200),
        (251, 350, 201, 300),
        (351, 430, 301, 400),
        (431, 600, 401, 500),
    ],
    "no2": [
        (0, 40, 0, 50),
        (41, 80, 51, 100),
        (81, 180, 101, 200),
        (181, 280, 201, 300),
        (281, 400, 301, 400),
        (401, 600, 401, 500),
    ],
    "so2": [
        (0, 40, 0, 50),
        (41, 80, 51, 100),
        (81, 380, 101, 200),
        (381, 800, 201, 300),
        (801, 1600, 301, 400),
        (1601, 2400, 401, 500),
    ],
    "co": [
        (0.0, 1.0, 0, 50),
        (1.1, 2.0, 51, 100),
        (2.1, 10.0, 101, 200),
        (10.1, 17.0, 201, 300),
        (17.1, 34.0, 301, 400),
        (34.1, 50.0, 401, 500),
    ],
    "o3": [
        (0, 50, 0, 50),
        (51, 100, 51, 100),
        (101, 168, 101, 200),
        (169, 208, 201, 300),
        (209, 748, 301, 400),
        (749, 1000, 401, 500),
    ],
    "nh3": [
        (0, 200, 0, 50),
        (201, 400, 51, 100),
        (401, 800, 101, 200),
        (801, 1200, 201, 300),
        (1201, 1800, 301, 400),
        (1801, 2400, 401, 500),
    ],
    "pb": [
        (0.0, 0.5, 0, 50),
        (0.5, 1.0, 51, 100),
        (1.1, 2.0, 101, 200),
        (2.1, 3.0, 201, 300),
        (3.1, 3.5, 301, 400),
        (3.5, 5.0, 401, 500),
    ],
}

# (index low, index high, label, colour)
CATEGORIES = [
    (0, 50, "Good", "#009865"),
    (51, 100, "Satisfactory", "#84CF33"),
    (101, 200, "Moderate", "#FFFB26"),
    (201, 300, "Poor", "#F2A93B"),
    (301, 400, "Very Poor", "#EA3324"),
    (401, 500, "Severe", "#9C2E2C"),
]
MANDATORY = ("pm25", "pm10")
MIN_POLLUTANTS = 3
DEFAULT_POLLUTANTS = ("pm25", "pm10", "no2", "so2", "co", "o3")

# --- fixed values: raw station headers ----------------------------------------------
POLLUTANT_ALIASES = {
    "PM2.5": "pm25",
    "PM10": "pm10",
    "NO2": "no2",
    "SO2": "so2",
    "Ozone": "o3",
    "O3": "o3",
    "CO": "co",
}
DAILY_MEAN_POLLUTANTS = ("pm25", "pm10", "no2", "so2")
EIGHT_HOUR_POLLUTANTS = ("o3", "co")
MIN_HOURS_PER_DAY = 16
ALREADY_DAILY_ROWS = 3
EIGHT_HOUR_MIN_VALID = 6
OBSERVED_NAMES = {"no2": "no2_obs", "so2": "so2_obs", "o3": "o3_obs", "co": "co_obs"}

# --- fixed values: plausibility limits ----------------------------------------------
VALID_RANGES = {
    "aod": (0.0, 5.0),
    "no2": (0.0, 5e-3),
    "so2": (-1e-3, 5e-3),
    "co": (0.0, 1.0),
    "o3": (0.0, 1.0),
    "hcho": (-1e-4, 5e-3),
    "temperature": (220.0, 330.0),
    "rh": (0.0, 100.0),
    "pressure": (5e4, 1.1e5),
    "pm25": (0.0, 1000.0),
    "pm10": (0.0, 2000.0),
}
GAS_COLUMNS = ("no2", "so2", "co", "o3", "hcho")
UNIT_TOLERANCE = 100.0
TARGET_CAPS = {
    "pm25": (1.0, 1000.0),
    "pm10": (1.0, 2000.0),
    "no2_obs": (0.0, 400.0),
    "so2_obs": (0.0, 400.0),
    "o3_obs": (1.0, 400.0),
    "co_obs": (0.0, 50.0),
}

# --- fixed values: calendar ---------------------------------------------------------
SEASONS = {
    "winter": (1, 2),
    "pre_monsoon": (3, 4, 5),
    "monsoon": (6, 7, 8, 9),
    "post_monsoon": (10, 11, 12),
}

# --- fixed values: source regions. bbox = min lon, min lat, max lon, max lat ----------
URBAN = {
    "delhi_ncr": (77.10, 28.65, 60.0),
    "mumbai": (72.88, 19.08, 40.0),
    "bangalore": (77.59, 12.97, 35.0),
    "hyderabad": (78.49, 17.39, 35.0),
    "kolkata": (88.36, 22.57, 35.0),
    "chennai": (80.27, 13.08, 35.0),
    "ahmedabad": (72.57, 23.03, 30.0),
}
INDUSTRIAL = {
    "gujarat_belt": (70.0, 21.0, 73.5, 24.5),
    "jharkhand": (84.5, 22.5, 87.5, 24.5),
    "odisha_coast": (84.5, 19.5, 87.5, 22.0),
    "korba_singrauli": (81.5, 22.0, 83.5, 24.5),
}
CROP_BURNING = {
    "indo_gangetic_plain": ((73.5, 27.5, 84.5, 32.0), ("post_monsoon", "pre_monsoon")),
    "central_india": ((74.0, 21.0, 84.0, 26.5), ("pre_monsoon",)),
    "eastern": ((81.3, 17.8, 87.5, 22.6), ("pre_monsoon",)),
}
FOREST_FIRE = {
    "north_east": ((89.5, 22.0, 97.5, 29.5), ("pre_monsoon",)),
    "western_ghats": ((73.0, 8.0, 77.5, 21.0), ("pre_monsoon",)),
    "himalayan": ((75.5, 28.7, 81.0, 31.5), ("pre_monsoon",)),
}
NATIONAL_BBOX = (68.0, 6.5, 97.5, 37.5)
FIRE_THRESHOLD = 1.0
EVI_THRESHOLD = 0.4

# --- fixed values: layer catalogue and land cover -------------------------------------
LAND_COVER_CLASSES = {
    10: "tree",
    20: "shrub",
    30: "grass",
    40: "crop",
    50: "built",
    60: "bare",
    70: "snow",
    80: "water",
    90: "wetland",
    95: "mangrove",
    100: "moss",
}
NEAREST_LAYERS = ("burned",)
NEAREST_LAYER_PREFIX = "lc_"

# --- fixed values: analysis table schema ----------------------------------------------
PREDICTORS = (
    "aod", "no2", "so2", "co", "o3", "hcho",
    "temperature", "rh", "u_wind", "v_wind", "wind_speed",
    "pressure", "precipitation", "solar_radiation", "blh",
    "frp_mean", "frp_max", "fire_count", "burned", "evi",
    "elevation", "slope", "aspect",
    "lc_tree", "lc_shrub", "lc_grass", "lc_crop", "lc_built",
    "lc_bare", "lc_water", "lc_wetland",
    "lat", "lon", "fnr", "doy_sin", "doy_cos",
)
TABLE_KEYS = ("date", "lat", "lon")
TARGETS = ("pm25", "pm10", "no2_obs", "so2_obs", "o3_obs", "co_obs")
PARTITION_COLUMNS = ("year", "month")

# --- fixed values: models and physics ---------------------------------------------------
GAPFILL_COVARIATES = (
    "temperature", "rh", "wind_speed", "pressure", "solar_radiation", "blh",
    "elevation", "slope", "lc_crop", "lc_built", "lc_tree", "lc_bare",
    "lat", "lon", "doy_sin", "doy_cos",
)
CALIBRATION_COVARIATES = ("no2", "blh", "temperature", "wind_speed", "rh")
BENCHMARK_R2 = {"pm25": 0.86, "pm10": 0.85, "no2": 0.83, "o3": 0.60, "so2": 0.40, "co": 0.58}
ZONE_LABELS = {
    2: ("Lower pollution", "Higher pollution"),
    3: ("Good", "Moderate", "Poor"),
    4: ("Good", "Moderate", "Poor", "Severe"),
    5: ("Good", "Moderate", "Poor", "Severe", "Hazardous"),
    6: ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe"),
}
SOURCE_ACTIONS = {
    "agri_burning": "Crop residue burning surveillance and downwind VOC precursor alert",
    "industrial": "Industrial VOC inspection and stack-emission monitoring",
    "urban": "Traffic, NO2 and urban VOC precursor monitoring",
    "biogenic": "Ozone precursor watch during high-temperature periods",
    "forest_fire": "Forest-fire smoke and VOC plume monitoring",
    "other": "Ground validation required before attribution",
}
EARTH_RADIUS_KM = 6371.0088
YEAR_DAYS = 365.25
MOLEC_PER_CM2 = 6.022e19
SMOOTHING_SIGMA = 0.9
FIRE_DENSITY_EXTENT = (68.0, 97.5, 6.5, 37.5)
FIRE_DENSITY_BINS = 120
