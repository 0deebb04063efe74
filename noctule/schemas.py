"""Column contracts of the measurement tables, documents and pixel tables."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_COLUMNS = [
    "timestamp", "timezone_offset", "exposure", "gain", "brightness",
    "mean_r", "mean_g", "mean_b", "noise", "hdr", "night_mode", "stars",
    "sqm", "focus",
]
METEO_COLUMNS = [
    "timestamp", "temperature", "humidity", "dew_point", "pressure_msl",
    "surface_pressure", "cloud_cover", "cloud_low", "cloud_mid", "cloud_high",
    "visibility", "wind_speed_10m", "wind_dir_10m", "wind_speed_300hPa",
]
AURORA_COLUMNS = [
    "timestamp", "probability_percent", "probability_max", "probability_avg",
    "kp_index", "bt", "bz", "density", "speed", "temperature",
]

_INTEGER_COLUMNS = {"timezone_offset", "hdr", "night_mode", "stars"}


def _measurement(columns: list[str]) -> T.StructType:
    fields = [T.StructField("station", T.LongType())]
    for name in columns:
        if name == "timestamp":
            kind = T.LongType()
        elif name in _INTEGER_COLUMNS:
            kind = T.IntegerType()
        else:
            kind = T.DoubleType()
        fields.append(T.StructField(name, kind))
    fields.append(T.StructField("day", T.DateType()))
    return T.StructType(fields)


#: one row per capture / forecast hour / space-weather poll, partitioned by day
IMAGE = _measurement(IMAGE_COLUMNS)
METEO = _measurement(METEO_COLUMNS)
AURORA = _measurement(AURORA_COLUMNS)
MEASUREMENTS = {"image": IMAGE, "meteo": METEO, "aurora": AURORA}

#: frames in one exposure bracket, longest exposure first
BRACKET_SIZE = 5

_D, _I, _L, _S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()

SIDECAR = T.StructType(
    [T.StructField("timestamp", _L), T.StructField("timezone_offset", _I),
     T.StructField("width", _I), T.StructField("height", _I)]
    + [T.StructField(f"exposure_t{i}", _D) for i in range(BRACKET_SIZE)]
    + [T.StructField(f"sigma_noise_t{i}", _D) for i in range(BRACKET_SIZE)]
    + [T.StructField("gain", _D), T.StructField("focus", _D),
       T.StructField("capture_interval", _I), T.StructField("night_mode", _I),
       T.StructField("hdr", _I), T.StructField("sensor_temperature", _D),
       T.StructField("temperature", _D), T.StructField("humidity", _D),
       T.StructField("pressure", _D), T.StructField("mean_brightness", _D),
       T.StructField("target_brightness", _D), T.StructField("stars", _I),
       T.StructField("sqm", _D), T.StructField("sun_altitude", _D),
       T.StructField("moon_altitude", _D), T.StructField("moon_phase_percentage", _D)]
)

STARS = T.StructType([T.StructField("stars", T.ArrayType(T.StructType([
    T.StructField("x", _I), T.StructField("y", _I)])))])

GRID_DOCUMENT = T.StructType([
    T.StructField("Observation Time", _S),
    T.StructField("Forecast Time", _S),
    T.StructField("coordinates", T.ArrayType(T.ArrayType(_D))),
])

HEADER_ROWS = T.ArrayType(T.ArrayType(_S))

#: weather document array name -> table column
HOURLY_FIELDS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "dew_point_2m": "dew_point",
    "pressure_msl": "pressure_msl",
    "surface_pressure": "surface_pressure",
    "cloud_cover": "cloud_cover",
    "cloud_cover_low": "cloud_low",
    "cloud_cover_mid": "cloud_mid",
    "cloud_cover_high": "cloud_high",
    "visibility": "visibility",
    "wind_speed_10m": "wind_speed_10m",
    "wind_direction_10m": "wind_dir_10m",
    "wind_speed_300hPa": "wind_speed_300hPa",
}
HOURLY_DOCUMENT = T.StructType([T.StructField("hourly", T.StructType(
    [T.StructField("time", T.ArrayType(_S))]
    + [T.StructField(name, T.ArrayType(_D)) for name in HOURLY_FIELDS]))])

DETECTIONS = T.StructType([
    T.StructField("image", _S),
    T.StructField("objects", T.ArrayType(T.StructType([
        T.StructField("cls", _I), T.StructField("name", _S), T.StructField("conf", _D),
        T.StructField("x1", _D), T.StructField("y1", _D),
        T.StructField("x2", _D), T.StructField("y2", _D)]))),
])

SCORES = T.StructType([T.StructField("image", _S), T.StructField("result", T.ArrayType(_D))])

COMET = T.StructType([T.StructField("comet_fullname", _S),
                      T.StructField("best_ra", _S), T.StructField("best_dec", _S)])

#: dictionary entry of a settings key
SETTING_HELP = T.StructType([
    T.StructField("description", _S), T.StructField("unit", _S),
    T.StructField("range", _S), T.StructField("default", _S),
    T.StructField("recommendations", T.ArrayType(_S))])
