"""Column lists and struct types shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

HORIZON = 7
KEYS = ["series_id", "obs_date"]

# Fixed names and order of the wide feature table.
GOLD_COLUMNS = [
    "obs_date", "series_id", "base_currency", "quote_currency",
    "value", "prev_value",
    "daily_return", "log_return", "return_5d", "return_21d",
    "lag_1d", "lag_2d", "lag_3d", "lag_5d", "lag_21d",
    "rolling_mean_5d", "rolling_mean_21d", "rolling_std_5d", "rolling_std_21d",
    "volatility_ratio", "ma_crossover", "distance_from_ma21",
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
    "is_month_start", "is_month_end", "is_quarter_end", "is_year_start", "is_year_end",
    "target_return_1d", "target_direction_1d", "target_return_5d",
    "source", "run_id", "processed_at",
]

# Fixed names and order of the direction-model inputs.
H7_FEATURES = [
    "value",
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_21d",
    "vol_5d", "vol_10d", "vol_21d", "vol_63d",
    "mom_5d", "mom_10d", "mom_21d",
    "zret_1d_21d", "zret_1d_63d", "vol_ratio_21_63",
    "vol_21_med_252", "is_high_vol",
    "day_of_week", "month", "is_month_end",
]
H7_TARGETS = ["direction_7d", "fwd_return_7d"]

# Fixed names and order: inputs of the first research baselines, as stored models expect them.
BASELINE_FEATURES = [
    "daily_return", "log_return", "return_5d", "return_21d",
    "lag_1d", "lag_2d", "lag_3d", "lag_5d", "lag_21d",
    "rolling_std_5d", "rolling_std_21d", "rolling_mean_5d", "rolling_mean_21d",
    "volatility_ratio", "day_of_week", "month", "is_month_end",
]

# Fixed names and order of the prediction files that readers expect.
PREDICTION_COLUMNS = ["obs_date", "series_id", "p_up_logreg", "action_logreg"]

# One landed payload: observations whose value key carries the series name.
PAYLOAD = "observations array<map<string,string>>"

# Sidecar document of one payload. Fixed names: they are the keys of the documents that lie in the landing zone.
PAYLOAD_META = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("series_id", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("request_url", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("retrieved_at_utc", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("sha256_raw", T.StringType()),
    T.StructField("raw_bytes", T.LongType()),
    T.StructField("gz_bytes", T.LongType()),
    T.StructField("response_headers_subset", T.MapType(T.StringType(), T.StringType())),
    T.StructField("response_keys", T.ArrayType(T.StringType())),
    T.StructField("observations_count", T.LongType()),
    T.StructField("is_backfill", T.BooleanType()),
])
