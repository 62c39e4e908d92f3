"""Every operator as a named query over the test tables.

Each entry takes (spark, folder) and returns a DataFrame over the whole tables. Doubles are rounded to
6 digits so that results can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalframe import contracts
from signalframe.functions import dates, names, numbers, signals
from signalframe.operators import (
    baselines,
    features,
    folds,
    incremental,
    metrics,
    models,
    quality,
    pooled,
    quota,
    serving,
    subscribers,
    sweep,
)
from signalframe.operators.windows import by_series, exact_rank, keep_latest
from signalframe.plans import fixtures
from signalframe.schemas import BASELINE_FEATURES, H7_FEATURES
from signalframe.session import durable, scratch_path
from signalframe.sources import bucketed, landing, observed, tables, versions
from signalframe.sources import subscribers as subscriber_source
from signalframe.streaming import subscriptions
from signalframe.streaming.ordered import start_writing
from signalframe.streaming.quota import start_quota
from signalframe.streaming.requests import request_answers
from signalframe.streaming.silver import start_silver

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

T60 = 0.6
MODELS = {"p_up_logreg": "p_up_logreg", "p_up_tree": "p_up_tree"}
RUN_DATES = ["1998-06-01", "1998-05-29", "1998-06-06"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Sums of whole numbers and one division: the same double everywhere, so never rounded (rounding
# would meet exact ties, on which engines differ).
EXACT = {"value", "prev_value", "lag_1d", "lag_2d", "lag_3d", "lag_5d", "lag_21d", "rolling_mean_5d"}
# Multiples of 2.5e-6 and the like: 6 digits would be an exact tie.
FINE = {"confidence", "web_confidence", "band"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    def shown(field: T.StructField):
        if not isinstance(field.dataType, T.DoubleType) or field.name in EXACT:
            return F.col(field.name)
        return F.round(field.name, digits + 3 if field.name in FINE else digits).alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def _gold(spark: SparkSession, folder: str, **options) -> DataFrame:
    return features.gold_features(fixtures.observations(spark, folder), **options)


def _features(spark: SparkSession, folder: str, **options) -> DataFrame:
    return features.h7_features(_gold(spark, folder), **options)


def _long(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with one row per model."""
    preds = fixtures.predictions(spark, folder)
    return metrics.unpivot_models(preds, MODELS, ["series_id", "obs_date", "y_true", "is_high_vol"])


def _contract(spark: SparkSession, folder: str) -> DataFrame:
    preds = fixtures.predictions(spark, folder)
    p = F.col("p_up_logreg")
    return contracts.as_predictions(
        preds.select("obs_date", "series_id", "p_up_logreg", signals.decision(p, T60).alias("action_logreg"))
    )


def _latest_rows(spark: SparkSession, folder: str, limit: int = 365) -> DataFrame:
    return serving.latest_rows(fixtures.predictions(spark, folder), T60, limit)


GOLD_VALUES = [
    "series_id", "obs_date", "target_direction_1d", "value", "prev_value", "daily_return", "log_return",
    "return_5d", "return_21d", "lag_1d", "lag_2d", "lag_3d", "lag_5d", "lag_21d",
    "rolling_mean_5d", "rolling_mean_21d", "rolling_std_5d", "rolling_std_21d",
    "volatility_ratio", "ma_crossover", "distance_from_ma21", "target_return_1d", "target_return_5d",
]
CALENDAR = [
    "base_currency", "quote_currency", "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
    "is_month_start", "is_month_end", "is_quarter_end", "is_year_start", "is_year_end",
]

# --- features and quality ---------------------------------------------------------------------


@query
def latest_per_series(spark, folder):
    newest = serving.latest_per_series(fixtures.predictions(spark, folder), ["p_up_logreg"])
    return rounded(serving.score_decisions(newest, T60))


@query
def gold_load(spark, folder):
    return rounded(features.load_series(fixtures.observations(spark, folder), "FXAFXCAD"))


@query
def gold_features(spark, folder):
    return rounded(_gold(spark, folder).select(*GOLD_VALUES))


@query
def gold_features_chunked(spark, folder):
    return rounded(_gold(spark, folder, chunk_rows=512).select(*GOLD_VALUES))


@query
def gold_calendar(spark, folder):
    return _gold(spark, folder).select("series_id", "obs_date", *CALENDAR)


@query
def gold_incremental(spark, folder):
    obs = durable(fixtures.observations(spark, folder))
    restate = (F.dayofmonth("obs_date") == 13) & (F.year("obs_date") == 1999)
    late = F.col("obs_date") > F.lit("1999-12-31").cast("date")
    old = features.gold_features(obs.filter(~late))
    current = obs.withColumn("value", F.when(restate, F.col("value") * 1.01).otherwise(F.col("value")))
    changed = current.filter(restate | late)
    return rounded(incremental.refresh_gold(current, old, changed).select(*GOLD_VALUES))


def _silver_in_versions(spark, folder) -> versions.VersionedTable:
    """Observations up to 1999, then restated and later ones as a second version."""
    obs = durable(fixtures.observations(spark, folder))
    restate = (F.dayofmonth("obs_date") == 13) & (F.year("obs_date") == 1999)
    late = F.col("obs_date") > F.lit("1999-12-31").cast("date")
    silver = versions.VersionedTable(spark, scratch_path(spark, "silver"))
    stamped = lambda df, text: df.withColumns({"ingested_at": F.lit(text).cast("timestamp"), "raw_path": F.lit(text)})
    silver.upsert(stamped(obs.filter(~late), "2024-01-01 00:00:00"))
    current = obs.withColumn("value", F.when(restate, F.col("value") * 1.01).otherwise(F.col("value")))
    silver.upsert(stamped(current.filter(restate | late), "2024-02-01 00:00:00"))
    return silver


@query
def silver_versions(spark, folder):
    """Both versions of a table, read after the second was committed."""
    silver = _silver_in_versions(spark, folder)
    both = [silver.read(v).select(F.lit(v).alias("version"), "series_id", "obs_date", "value") for v in (1, 2)]
    return rounded(both[0].unionByName(both[1]))


@query
def changed_keys(spark, folder):
    """What differs between two versions, found by comparing digests from the top."""
    return _silver_in_versions(spark, folder).changed_keys(1, 2)


@query
def gold_versions(spark, folder):
    """The wide table after the second version, of which only the months that the changes reach were made anew."""
    silver = _silver_in_versions(spark, folder)
    gold = versions.VersionedTable(spark, scratch_path(spark, "gold"))
    gold.commit(features.gold_features(silver.read(1)), None, None, {"silver": 1})
    return rounded(gold.read(versions.refresh_gold(silver, gold)).select(*GOLD_VALUES))


@query
def gold_merge(spark, folder):
    obs = fixtures.observations(spark, folder)
    old = obs.filter(F.col("obs_date") <= F.lit("1999-06-30").cast("date"))
    new = obs.filter(F.col("obs_date") >= F.lit("1999-01-01").cast("date"))
    return rounded(incremental.merge_keep_last(old, new.withColumn("value", F.col("value") * 2)))


@query
def h7_features(spark, folder):
    return rounded(_features(spark, folder))


@query
def h7_features_chunked(spark, folder):
    return rounded(_features(spark, folder, chunk_rows=512))


@query
def h7_features_moving(spark, folder):
    return rounded(_features(spark, folder, moving_median=True))


@query
def h7_features_research(spark, folder):
    return rounded(_features(spark, folder, eps=1e-12))


@query
def direction_target(spark, folder):
    labelled = features.direction_target(fixtures.observations(spark, folder))
    return rounded(labelled.select("series_id", "obs_date", "target_return_7d", "target_direction_7d"))


@query
def impute_ffill(spark, folder):
    filled = features.forward_filled(_gold(spark, folder), BASELINE_FEATURES)
    return rounded(filled.select("series_id", "obs_date", *BASELINE_FEATURES))


@query
def contract_violations(spark, folder):
    before = F.lag("value").over(by_series())
    given = F.when(F.dayofmonth("obs_date") == 13, before + 1).otherwise(before)
    broken = fixtures.observations(spark, folder).withColumn("prev_value", given)
    return rounded(contracts.gold_violations(broken).select("series_id", "obs_date", "value", "prev_value", "kind"))


@query
def required_columns(spark, folder):
    """For each column of the wide table: known values, and whether the table is refused without it or renamed."""
    gold = _gold(spark, folder).select(*GOLD_VALUES)

    def refused(df: DataFrame, exact: bool) -> bool:
        try:
            contracts.require_columns(df, ["obs_date", "series_id", "value", "prev_value"] if not exact else GOLD_VALUES, exact)
        except contracts.ContractError:
            return True
        return False

    known = gold.agg(*[F.count(c).alias(c) for c in GOLD_VALUES])
    checks = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).alias("known"),
            F.lit(refused(gold.drop(c), False)).alias("refused_without"),
            F.lit(refused(gold.withColumn(f"{c}_again", F.col(c)), True)).alias("refused_with_another"),
            F.lit(refused(gold, True)).alias("refused"),
        )
        for c in GOLD_VALUES
    ]
    return known.select(F.inline(F.array(*checks)))


@query
def selected_features(spark, folder):
    """Rows and sum of each numeric feature that may be trained on, by the spec of all of them."""
    rows = _features(spark, folder)
    chosen = contracts.select_features(rows, contracts.numeric_features(rows))
    sums = chosen.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).cast("double").alias(c) for c in chosen.columns])
    return sums.select(
        F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 4).alias("total")) for c in chosen.columns])).alias("position", "f"),
        "n_rows",
    ).select("position", "f.*", "n_rows")


@query
def null_rates(spark, folder):
    columns = [c for c in GOLD_VALUES if c not in ("series_id", "obs_date", "target_direction_1d")]
    return rounded(quality.null_rates(_gold(spark, folder), columns))


@query
def class_balance(spark, folder):
    return rounded(quality.class_balance(_features(spark, folder), "direction_7d"))


@query
def gap_histogram(spark, folder):
    return quality.gap_histogram(fixtures.observations(spark, folder))


@query
def feature_target_corr(spark, folder):
    return quality.target_correlation(_features(spark, folder), H7_FEATURES, "direction_7d")


@query
def coerce_numeric(spark, folder):
    events = fixtures.table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return events.select("event_id", numbers.as_number(k).alias("k"), numbers.as_number(F.col("event_type")).alias("bad"))


@query
def series_parts(spark, folder):
    ids = quality.distinct_series(fixtures.observations(spark, folder))
    usd = ids.select(F.concat(F.lit("FX"), F.substring("series_id", 3, 3), F.lit("USD")).alias("series_id"))
    events = fixtures.table(spark, folder, "events").select(F.col("event_type").alias("series_id"))
    s = F.col("series_id")
    pair = names.pair_of_series(s)
    return ids.unionByName(usd).unionByName(events).distinct().select(
        s,
        names.base_currency(s).alias("base"),
        names.quote_currency(s).alias("quote"),
        pair.alias("pair"),
        (~names.is_pair_series(s)).alias("rejected"),
        names.pair_label(pair).alias("label"),
        names.series_label(s).alias("display"),
        names.series_of_pair(pair).alias("back"),
        names.slug(F.concat(pair, F.lit(" / h7!"))).alias("slug"),
    )


@query
def label_normalise(spark, folder):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "signup", " abstain ").when(kind == "view", "up").when(kind == "click", "Down").when(kind == "purchase", "HOLD")
    )
    labelled = fixtures.table(spark, folder, "events").select("event_id", raw.alias("raw"))
    r = F.col("raw")
    return labelled.select(
        "event_id",
        F.when(signals.normal_label(r).isNotNull(), signals.normal_label(r)).alias("label"),
        signals.direction(r).alias("direction"),
        signals.api_direction(r).alias("api_direction"),
        signals.display_direction(signals.direction(r)).alias("display"),
        signals.signal_word(r).alias("word"),
    )


@query
def pairs_normalise(spark, folder):
    pairs = names.pair_list(F.col("pairs_csv"))
    return fixtures.subscriptions(spark, folder).select(
        "id", F.array_join(pairs, "|").alias("pairs"), F.size(pairs).alias("n_pairs")
    )


@query
def toronto_dates(spark, folder):
    ts = F.col("ts")
    return fixtures.table(spark, folder, "events").select(
        "event_id", dates.local_date(ts).alias("local_date"), dates.local_iso(ts).alias("local_iso")
    )


# --- predictions, metrics, policies -----------------------------------------------------------


@query
def predictions(spark, folder):
    return _contract(spark, folder)


@query
def predictions_wide(spark, folder):
    preds = fixtures.predictions(spark, folder)
    keys = ["series_id", "obs_date"]
    logreg, tree = preds.select(*keys, "y_true", "p_up_logreg"), preds.select(*keys, "p_up_tree")
    flags = _features(spark, folder).select(*keys, "is_high_vol", "is_month_end", "day_of_week", "month")
    return logreg.join(tree, keys).join(flags, keys, "left")


def _bucketed(spark, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Written with equally many buckets and read back, in a session that makes use of them."""
    session = bucketed.co_partitioned_session(spark)
    found = {}
    for name, df in frames.items():
        path = scratch_path(spark, name)
        found[name] = bucketed.read_bucketed(session, path, bucketed.write_bucketed(df, path), df.schema)
    return found


@query
def h7_features_bucketed(spark, folder):
    """Features of a wide table that lies in buckets: no exchange."""
    gold = _bucketed(spark, {"gold": _gold(spark, folder)})["gold"]
    return rounded(features.h7_features(gold))


@query
def predictions_wide_bucketed(spark, folder):
    """The joins of ``predictions_wide`` on tables in buckets: no exchange."""
    keys = ["series_id", "obs_date"]
    kept = _bucketed(spark, {"predictions": fixtures.predictions(spark, folder), "gold": _gold(spark, folder)})
    preds = kept["predictions"]
    logreg, tree = preds.select(*keys, "y_true", "p_up_logreg"), preds.select(*keys, "p_up_tree")
    flags = features.h7_features(kept["gold"]).select(*keys, "is_high_vol", "is_month_end", "day_of_week", "month")
    return logreg.join(tree, keys).join(flags, keys, "left")


@query
def baseline_probs(spark, folder):
    return rounded(baselines.baseline_probabilities(_gold(spark, folder)))


@query
def compare_predictions(spark, folder):
    preds = fixtures.predictions(spark, folder)
    return rounded(
        quality.compare_predictions(preds, preds, "p_up_logreg", "p_up_tree", ["series_id", "obs_date"])
    )


@query
def metrics_overall(spark, folder):
    return rounded(metrics.overall(_long(spark, folder), by=("model",)))


@query
def metrics_clipped(spark, folder):
    """The calibration report's variant: probabilities kept 1e-6 away from 0 and 1."""
    found = metrics.overall(_long(spark, folder), by=("model",), floor=1e-6)
    return rounded(found.select("model", "n", "log_loss", "brier"))


@query
def metrics_by_threshold(spark, folder):
    return rounded(metrics.by_threshold(_long(spark, folder), (0.5, 0.55, 0.6, 0.65, 0.7)))


@query
def metrics_by_bucket(spark, folder):
    return rounded(metrics.by_bucket(_long(spark, folder)))


@query
def metrics_by_year(spark, folder):
    preds = fixtures.predictions(spark, folder)
    p = F.col("p_up_logreg")
    return rounded(metrics.by_year(preds.withColumn("p", p).withColumn("act", signals.side(p, T60)), worst=5))


@query
def metrics_by_year_all(spark, folder):
    preds = fixtures.predictions(spark, folder)
    p = F.col("p_up_logreg")
    return rounded(metrics.by_year(preds.withColumn("p", p).withColumn("act", signals.side(p, T60))))


@query
def calibration_line(spark, folder):
    return rounded(metrics.calibration_line(_long(spark, folder)))


@query
def ece(spark, folder):
    return rounded(metrics.calibration_error(_long(spark, folder), (10, 20)))


@query
def reliability_bins(spark, folder):
    return rounded(metrics.reliability(_long(spark, folder)))


@query
def policy_labels(spark, folder):
    p, q = F.col("p_up_logreg"), F.col("p_up_tree")
    return fixtures.predictions(spark, folder).select(
        "series_id",
        "obs_date",
        signals.decision(p, 0.55).alias("decision_55"),
        signals.action(p, 0.55).alias("action_55"),
        signals.decision(p, T60).alias("decision_60"),
        signals.action(q, T60).alias("action_tree_60"),
        signals.side(p, T60).alias("side_60"),
    )


@query
def policy_confidence(spark, folder):
    p = F.col("p_up_logreg")
    return rounded(
        fixtures.predictions(spark, folder).select(
            "series_id",
            "obs_date",
            signals.band_confidence(p, T60).alias("band"),
            signals.plain_confidence(p).alias("plain"),
            signals.served_confidence(p, T60).alias("served"),
            signals.confidence_word(p, signals.decision(p, T60)).alias("word"),
        )
    )


@query
def policy_eval(spark, folder):
    acted = _long(spark, folder).withColumn("act", signals.side(F.col("p"), T60))
    return rounded(metrics.evaluate_acted(acted, ["model"]))


@query
def policy_sweep(spark, folder):
    return rounded(sweep.policy_sweep(fixtures.predictions(spark, folder)))


@query
def policy_by_regime(spark, folder):
    return rounded(sweep.regime_report(fixtures.predictions(spark, folder), MODELS))


@query
def balanced_topk(spark, folder):
    top = sweep.balanced_topk(fixtures.predictions(spark, folder), "p_up_logreg", 0.20)
    return rounded(top.select("series_id", "obs_date", "y_true", "p_up_logreg", "act", "rank"))


@query
def rolling_policy_metrics(spark, folder):
    acted = sweep.balanced_topk_per_series(fixtures.predictions(spark, folder), "p_up_logreg", 0.20)
    return rounded(sweep.rolling_scores(acted, "p_up_logreg"))


@query
def walkforward_folds(spark, folder):
    return folds.fold_table(_features(spark, folder))


# --- ingest and tables ------------------------------------------------------------------------


@query
def silver_dedup(spark, folder):
    return rounded(incremental.latest_versions(fixtures.silver_events(spark, folder), tiebreak="event_id"))


@query
def silver_since(spark, folder):
    rows = incremental.since(fixtures.silver_events(spark, folder), "2024-01-15")
    return rounded(incremental.latest_versions(rows, tiebreak="event_id"))


@query
def ingest_watermark(spark, folder):
    """Versions newer than what each series had by the 20th; signups were not ingested at all."""
    rows = fixtures.silver_events(spark, folder)
    known = rows.filter((F.col("obs_date") <= F.lit("2024-01-20").cast("date")) & (F.col("series_id") != "signup"))
    return rounded(incremental.after_watermark(rows, incremental.watermarks(known)))


@query
def silver_upsert(spark, folder):
    """Three overlapping batches, the newest first, then one of them again."""
    rows = fixtures.silver_events(spark, folder).withColumn("raw_path", F.lpad(F.col("event_id").cast("string"), 19, "0"))
    root = scratch_path(spark, "upsert")
    for i, third in enumerate((2, 0, 1, 0)):
        batch = rows.filter(F.col("event_id") % 3 == third)
        tables.upsert_silver(batch, f"{root}/silver", f"{root}/stage/{i}", keep_stage=False)
    return rounded(tables.read_silver(spark, f"{root}/silver").drop("raw_path"))


def _landed(spark, folder, scale: float = 1.0, second: str = "00") -> DataFrame:
    """Observations as yearly payloads, ingested at noon of the last day of their year."""
    day = F.last_day(F.make_date(F.year("obs_date"), F.lit(12), F.lit(1)))
    return fixtures.observations(spark, folder).select(
        F.lit("daily").alias("source"),
        F.col("series_id").alias("series"),
        day.cast("string").alias("ingest_date"),
        F.concat(F.date_format(day, "yyyyMMdd"), F.lit(f"T1200{second}Z")).alias("ingest_ts"),
        "obs_date",
        (F.col("value") * scale).alias("value"),
    )


@query
def bronze_scan(spark, folder):
    root = scratch_path(spark, "landing")
    landing.write_landing(landing.build_payloads(_landed(spark, folder)), root)
    rows = landing.scan(spark, root, "run", landing.WRITTEN_PAYLOADS, landing.WRITTEN_SIDECARS)
    good = landing.accepted(rows)
    return rounded(
        good.select(
            "series_id",
            "obs_date",
            "value",
            "base_currency",
            "quote_currency",
            F.date_format(dates.utc_wall(F.col("ingested_at")), "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
        )
    )


@query
def stream_silver(spark, folder):
    """First payloads, then restated ones a second later, then a run with nothing new."""
    root = scratch_path(spark, "stream")
    for scale, second in ((1.0, "00"), (2.0, "01"), (None, None)):
        if scale is not None:
            landing.write_landing(landing.build_payloads(_landed(spark, folder, scale, second)), f"{root}/landing")
        start_silver(
            spark,
            f"{root}/landing",
            f"{root}/silver",
            f"{root}/state",
            "run",
            f"{root}/rejects",
            landing.WRITTEN_PAYLOADS,
            grain="month",
            meta_files=landing.WRITTEN_SIDECARS,
        ).awaitTermination()
    return rounded(tables.read_silver(spark, f"{root}/silver").select("series_id", "obs_date", "value"))


@query
def landing_audit(spark, folder):
    html = F.col("html")
    return fixtures.table(spark, folder, "pages").select(
        "page_id", landing.digest(html.cast("binary")).alias("sha256"), F.octet_length(html).cast("long").alias("bytes")
    )


@query
def stored_audit(spark, folder):
    """Landed files as stored: how many, with how many different hashes, and whether their sidecars hold their content's hash."""
    root = scratch_path(spark, "landing")
    landing.write_landing(landing.build_payloads(_landed(spark, folder)), root)
    files = landing.audit_files(spark, root, landing.WRITTEN_PAYLOADS)
    parts = {k: landing.path_part(F.col("path"), k) for k in ("series", "ingest_date")}
    stored = files.select(parts["series"].alias("series_id"), parts["ingest_date"].alias("ingest_date"), "path", "sha256", "stored_bytes")
    content = landing.read_payloads(spark, root, landing.WRITTEN_PAYLOADS).select(
        F.col("raw_path").alias("path"), landing.digest(F.col("payload").cast("binary")).alias("content_sha256")
    )
    said = (
        spark.read.option("basePath", root).option("pathGlobFilter", landing.WRITTEN_SIDECARS).json(root)
        .select("series_id", F.col("ingest_date").cast("string").alias("ingest_date"), "sha256_raw", "observations_count")
    )
    name = F.regexp_replace("path", "^file:/+", "/")
    together = stored.withColumn("path", name).join(content.withColumn("path", name), "path").join(said, ["series_id", "ingest_date"])
    return together.groupBy("series_id", "ingest_date").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct("sha256").alias("hashes"),
        F.sum("observations_count").alias("observations_count"),
        F.bool_and(F.col("content_sha256") == F.col("sha256_raw")).alias("as_sidecar_says"),
        F.bool_and(F.col("stored_bytes") > 0).alias("stored"),
    )


@query
def payload_audit(spark, folder):
    payloads = landing.build_payloads(_landed(spark, folder))
    audited = landing.audit_payloads(
        payloads.select(
            F.col("value").alias("payload"), F.col("series").alias("series_id"), F.col("ingest_date").alias("raw_path")
        )
    )
    return audited.select(
        "series_id",
        F.col("raw_path").alias("ingest_date"),
        "observations_count",
        F.array_join("response_keys", ",").alias("keys"),
        (F.length("sha256_raw") == 64).alias("hashed"),
    )


@query
def input_ranges(spark, folder):
    return quality.input_range(fixtures.observations(spark, folder), ("series_id",))


@query
def rows_by_series(spark, folder):
    return quality.rows_by_series(fixtures.predictions(spark, folder))


@query
def coverage_missing(spark, folder):
    preds = fixtures.predictions(spark, folder).select("series_id").filter(F.col("series_id") != "FXAFXCAD")
    extra = fixtures.silver_events(spark, folder).select("series_id")
    return quality.coverage_missing(fixtures.observations(spark, folder), preds.unionByName(extra))


@query
def gold_scan(spark, folder):
    """Files in three layouts; one holds several series and is left out."""
    root = scratch_path(spark, "gold")
    obs = fixtures.observations(spark, folder)
    tables.write_gold(obs, f"{root}/a")
    obs.coalesce(1).write.parquet(f"{root}/mixed")
    found = tables.scan_gold_files(spark, root)
    return quality.input_range(found, ("series_id",))


@query
def gold_scan_rejects(spark, folder):
    """What ``gold_scan`` leaves out, per folder: a file of several series, a file that is no Parquet."""
    root = scratch_path(spark, "gold")
    obs = fixtures.observations(spark, folder)
    tables.write_gold(obs, f"{root}/a")
    obs.coalesce(1).write.parquet(f"{root}/mixed")
    tables.write_marker(spark, f"{root}/torn/part.parquet", "PAR1 and no more")
    where = F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)
    return tables.gold_file_rejects(spark, root).groupBy(where.alias("folder"), "reason").agg(F.count(F.lit(1)).alias("files"))


@query
def publish_run(spark, folder):
    root = scratch_path(spark, "publish")
    preds = _contract(spark, folder)
    early = preds.filter(F.col("obs_date") < F.lit("1999-01-01").cast("date"))
    tables.publish_run(spark, {"predictions": early}, root, "2024-01-14")
    tables.publish_run(spark, {"predictions": preds}, root, "2024-01-15")
    try:  # the same date once more: refused, and readers stay where they are
        tables.publish_run(spark, {"predictions": early, "manifest": early.limit(0)}, root, "2024-01-15")
    except ValueError:
        pass
    return tables.read_latest(spark, root, "predictions")


@query
def run_manifest(spark, folder):
    return serving.manifest_rows(fixtures.observations(spark, folder), fixtures.predictions(spark, folder))


@query
def observed_manifest(spark, folder):
    """What two outputs hold, observed while they were written."""
    outputs = {"gold": _gold(spark, folder).select("series_id", "obs_date", "lag_21d", "return_5d"), "predictions": fixtures.predictions(spark, folder).select("series_id", "obs_date", "y_true")}
    check = {"gold": ("series_id", "obs_date"), "predictions": ("series_id", "obs_date", "y_true")}
    return observed.fact_rows(spark, observed.publish_observed(spark, outputs, scratch_path(spark, "observed"), "2024-01-15", check))


@query
def run_manifest_document(spark, folder):
    """The nested manifest of a run, taken apart again: inputs, predictions and the files that a run left."""
    root = scratch_path(spark, "document")
    preds = fixtures.predictions(spark, folder)
    # One file, so that its facts do not depend on partitions.
    preds.agg(F.count(F.lit(1)).cast("string").alias("value")).coalesce(1).write.text(f"{root}/models")
    files = tables.file_facts(spark, f"{root}/models", "part-*").withColumn("name", F.lit("model"))
    document = serving.run_manifest(fixtures.observations(spark, folder), preds, {"run_date": "2024-01-15"}, files)
    inputs = document.select("run_date", F.inline("gold_inputs")).select(
        "run_date", F.lit("input").alias("section"), F.col("series_id").alias("name"), "rows", "min_obs_date", "max_obs_date", F.lit(None).cast("string").alias("sha256")
    )
    counts = document.select("run_date", F.explode("predictions.by_series_rows").alias("name", "rows"), F.col("predictions.min_obs_date"), F.col("predictions.max_obs_date"))
    made = counts.select("run_date", F.lit("predictions").alias("section"), "name", "rows", "min_obs_date", "max_obs_date", F.lit(None).cast("string").alias("sha256"))
    none = F.lit(None).cast("date")
    left = document.select("run_date", F.explode("model_files").alias("name", "f")).select(
        "run_date", F.lit("file").alias("section"), "name", F.col("f.bytes").alias("rows"), none.alias("min_obs_date"), none.alias("max_obs_date"), F.col("f.sha256").alias("sha256")
    )
    return inputs.unionByName(made).unionByName(left)


# --- serving and subscribers ------------------------------------------------------------------


@query
def latest_artifacts(spark, folder):
    return rounded(_latest_rows(spark, folder).drop("series_id"))


@query
def latest_documents(spark, folder):
    rows = _latest_rows(spark, folder)
    documents = serving.latest_documents(rows, "unknown", "h7", "2024-01-15T00:00:00Z")
    return documents.select(
        "pair",
        "horizon",
        F.size("rows").alias("n_rows"),
        F.get("rows", F.lit(0))["obs_date"].alias("first_date"),
        F.element_at("rows", -1)["obs_date"].alias("last_date"),
        F.element_at("rows", -1)["decision"].alias("last_decision"),
    )


@query
def signal_history(spark, folder):
    history = serving.signal_history(_latest_rows(spark, folder))
    return history.withColumn("history", F.array_join("history", ","))


@query
def lookup_latest(spark, folder):
    asked = fixtures.subscriptions(spark, folder).select(F.explode(names.pair_list(F.col("pairs_csv"))).alias("pair"))
    return rounded(serving.lookup_latest(asked, _latest_rows(spark, folder)))


@query
def serving_header(spark, folder):
    rows = _latest_rows(spark, folder)
    documents = serving.latest_documents(rows, "unknown", "h7", "2024-01-15T00:00:00Z")
    newest = serving.latest_per_series(rows, ["decision"])
    return serving.serving_header(documents, newest)


@query
def confidence_histogram(spark, folder):
    preds = fixtures.predictions(spark, folder)
    return metrics.confidence_histogram(
        preds.withColumn("confidence", signals.served_confidence(F.col("p_up_logreg"), T60))
    )


def _status(spark, folder) -> DataFrame:
    counts = quality.rows_by_series(fixtures.observations(spark, folder)).withColumnRenamed("rows", "records")
    left = F.col("records") % 3
    state = F.when(left == 0, "success").when(left == 1, "no_new_files").otherwise("error")
    return counts.withColumn("status", state)


@query
def run_summary(spark, folder):
    return quality.run_summary(_status(spark, folder), quality.SILVER_OK)


@query
def resume_pending(spark, folder):
    """Every series once succeeded; its newest state counts."""
    keys = quality.distinct_series(fixtures.observations(spark, folder))
    newest = _status(spark, folder).select("series_id", "status", F.lit(2).alias("at"))
    log = newest.unionByName(newest.select("series_id", F.lit("success").alias("status"), F.lit(1).alias("at")))
    return quality.pending(keys, log, at="at")


@query
def subscribers_active(spark, folder):
    rows = fixtures.subscriptions(spark, folder)
    stamp = F.when(F.col("verified"), F.lit("2024-01-01").cast("timestamp_ntz"))
    accounts = rows.select("id", "email", stamp.alias("verified_at"))
    settings = rows.select(
        F.col("id").alias("subscription_id"),
        "frequency",
        "weekly_day",
        "monthly_timing",
        names.pair_list(F.col("pairs_csv")).alias("pairs"),
        F.lit(None).cast("string").alias("timezone"),
    )
    found = subscribers.active(accounts, settings, verified_only=True)
    return found.withColumn("pairs", F.array_join("pairs", "|"))


@query
def subscription_validate(spark, folder):
    key = F.col("id")
    requests = fixtures.subscriptions(spark, folder).withColumns(
        {
            "email": F.when(key % 11 == 0, F.concat(F.lit("User"), key)).otherwise(F.col("email")),
            "pairs": names.pair_list(F.col("pairs_csv")),
            "run_text": F.concat(F.lit("2024-02-"), F.lpad((key % 40).cast("string"), 2, "0")),
        }
    )
    return subscribers.validated(requests).select(
        "id", "email", "accepted", "reason", "subscription_key", dates.valid_date_text(F.col("run_text")).alias("date_ok")
    )


def _due(spark, folder) -> DataFrame:
    rows = fixtures.subscriptions(spark, folder)
    return subscribers.due(rows.withColumn("pairs", names.pair_list(F.col("pairs_csv"))), RUN_DATES)


@query
def due_subscribers(spark, folder):
    return _due(spark, folder).select("run_date", "id")


@query
def digest_rows(spark, folder):
    newest = serving.latest_per_series(_contract(spark, folder), ["p_up_logreg", "action_logreg"])
    return subscribers.digest_rows(_due(spark, folder), newest)


@query
def subscription_state(spark, folder):
    """Settings of the last upsert, token (event id) of the first one since the last delete."""
    log = fixtures.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value", "props")
    gone = F.col("event_type") == "error"
    return incremental.final_state(log, "user_id", "ts", gone, "event_id", ("value", "props"), ("event_id",))


@query
def subscription_verify(spark, folder):
    """Requests with known tokens: of rows that are not verified yet, those that have not expired take them."""
    token = F.md5(F.concat(F.lit("token"), F.col("id").cast("string")).cast("binary"))
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    rows = fixtures.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 5000, stamp("2023-12-01 00:00:00")).alias("verified_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        (stamp("2024-01-01 00:00:00") + F.make_dt_interval(F.col("c_nationkey").cast("int"))).alias("verification_expires_at"),
    )
    rows = rows.withColumn("verification_token", token)
    asked = fixtures.table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).select(token.alias("token"))
    return incremental.verify(rows, asked, stamp("2024-01-10 00:00:00"))


@query
def subscription_status(spark, folder):
    log = fixtures.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return incremental.soft_state(log, "user_id", "ts", F.col("event_type") == "error", "event_id")


@query
def quota_windows(spark, folder):
    events = fixtures.table(spark, folder, "events").select("event_id", "user_id", "ts")
    placed = quota.request_quota(events, "user_id", "ts", "event_id", 86400, 3)
    return placed.select("window_start", "user_id", "event_id", "n", "allowed", "remaining", "reset_at")


@query
def quota_retained(spark, folder):
    events = fixtures.table(spark, folder, "events").select("user_id", "ts")
    counts = quota.window_counts(events, "user_id", "ts", 86400, 3)
    return quota.retained(counts, F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))


@query
def stream_quota(spark, folder):
    root = scratch_path(spark, "quota")
    schema = fixtures.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    start_quota(stream, "user_id", "ts", 86400, 3, f"{root}/out", f"{root}/state", late="60 days").awaitTermination()
    counts = quota.newest_count(spark.read.parquet(f"{root}/out"), ["window_start", "user_id"])
    return counts.withColumn("window_start", dates.utc_wall(F.col("window_start")))


def _streamed(spark, rows, late_key: str, start):
    """Run ``start(stream)`` on ``rows`` in several batches, then once more after a row that moves the watermark past everything."""
    root = scratch_path(spark, "feed")
    rows.repartition(3).write.parquet(f"{root}/a")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(root)
    start(stream).awaitTermination()
    beat = rows.limit(1).withColumn(late_key, F.lit(None).cast(rows.schema[late_key].dataType))
    beat.withColumn("ts", F.lit("2100-01-01 00:00:00").cast(rows.schema["ts"].dataType)).write.parquet(f"{root}/b")
    start(stream).awaitTermination()


@query
def stream_quota_requests(spark, folder):
    """Every request's place and answer from a stream in three batches."""
    out = scratch_path(spark, "answers")
    events = fixtures.table(spark, folder, "events").select("event_id", "user_id", "ts")

    def start(stream):
        return start_writing(request_answers(stream, "user_id", "ts", "event_id", 86400, 3, late="60 days"), f"{out}/rows", f"{out}/state")

    _streamed(spark, events, "user_id", start)
    rows = spark.read.parquet(f"{out}/rows").drop("batch")
    return rows.withColumns({c: dates.utc_wall(F.col(c)) for c in ("window_start", "reset_at")})


@query
def stream_subscriptions(spark, folder):
    """The state after a feed of upserts and deletes, with every tenth change sent twice."""
    out = scratch_path(spark, "subscriptions")
    log = fixtures.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value", "props")
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    # JSON leaves nulls out and numbers come back exactly as text.
    settings = F.to_json(F.struct(F.col("value").cast("string").alias("value"), "props"))

    def start(stream):
        made = subscriptions.subscription_changes(stream, "user_id", "ts", "event_id", subscriptions.change(kind, settings), late="60 days")
        return start_writing(made, f"{out}/rows", f"{out}/state")

    _streamed(spark, log.unionByName(log.filter("event_id % 10 = 0")), "user_id", start)
    live = subscriptions.newest(spark.read.parquet(f"{out}/rows"), "user_id")
    given = F.from_json("settings", "value string, props string")
    wall = lambda c: dates.utc_wall(F.timestamp_micros(c))
    return live.select(
        "user_id", wall("created").alias("created_at"), wall("updated").alias("updated_at"), given["value"].cast("double").alias("value"),
        given["props"].alias("props"), F.col("token").cast("long").alias("first_event_id"),
    )


@query
def stream_verifications(spark, folder):
    """Tokens that expire, and requests to verify them, as one feed."""
    out = scratch_path(spark, "verifications")
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    token = F.md5(F.concat(F.lit("token"), F.col("id").cast("string")).cast("binary"))
    micros = lambda c: F.unix_micros(dates.utc_instant(c))
    rows = fixtures.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    expires = stamp("2024-01-01 00:00:00") + F.make_dt_interval(F.col("c_nationkey").cast("int"))
    verified = F.when(F.col("c_acctbal") > 5000, micros(stamp("2023-12-01 00:00:00")))
    made = rows.select(
        "id", (F.col("id") * 2).alias("event_id"), stamp("2023-11-01 00:00:00").alias("ts"),
        subscriptions.change(F.lit("upsert"), token=token, expires=micros(expires), verified=verified).alias("body"),
    )
    asked = fixtures.table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).distinct().select(
        "id", (F.col("id") * 2 + 1).alias("event_id"), stamp("2024-01-10 00:00:00").alias("ts"), subscriptions.change(F.lit("verify"), token=token).alias("body")
    )

    def start(stream):
        return start_writing(subscriptions.subscription_changes(stream, "id", "ts", "event_id", F.col("body"), late="400 days"), f"{out}/rows", f"{out}/state")

    _streamed(spark, made.unionByName(asked), "id", start)
    live = subscriptions.newest(spark.read.parquet(f"{out}/rows"), "id")
    wall = lambda c: dates.utc_wall(F.timestamp_micros(c))
    return live.select(
        "id", wall("verified").alias("verified_at"), F.when(F.col("updated") > F.col("created"), wall("updated")).alias("updated_at"),
        F.col("token").alias("verification_token"), wall("expires").alias("verification_expires_at"),
    )


# --- models -----------------------------------------------------------------------------------


@query
def fit_global(spark, folder):
    return models.train_global(_features(spark, folder)).coefficients(spark)


@query
def score_global(spark, folder):
    rows = _features(spark, folder, drop_unlabelled=False)
    model = models.train_global(rows.filter(F.col("fwd_return_7d").isNotNull()))
    return models.score_global(model, rows, T60)


@query
def fit_per_series(spark, folder):
    return folds.fit_per_series(_features(spark, folder), H7_FEATURES, scale=True)


@query
def walkforward_logreg(spark, folder):
    return folds.walk_forward(_features(spark, folder), H7_FEATURES)


@query
def walkforward_coefficients(spark, folder):
    history = folds.coefficient_history(_features(spark, folder), H7_FEATURES)
    return folds.coefficient_extremes(history)


@query
def walkforward_stability(spark, folder):
    return folds.coefficient_stability(folds.coefficient_history(_features(spark, folder), H7_FEATURES))


@query
def score_per_series(spark, folder):
    rows = durable(_features(spark, folder))
    weights = folds.fit_per_series(rows, H7_FEATURES, scale=True)
    return folds.score_per_series(rows, weights, H7_FEATURES).select("series_id", "obs_date", "p_up")


@query
def walkforward_gbt(spark, folder):
    return folds.walk_forward(_features(spark, folder), H7_FEATURES, kind="trees")


@query
def walkforward_calibrated(spark, folder):
    return folds.walk_forward_calibrated(_features(spark, folder), H7_FEATURES)


@query
def walkforward_daily(spark, folder):
    gold = features.direction_target(_gold(spark, folder))
    filled = features.forward_filled(gold, BASELINE_FEATURES)
    return folds.walk_forward(
        filled, BASELINE_FEATURES, target="target_direction_7d", step="day", scale=False
    )


@query
def permutation_importance(spark, folder):
    return folds.tree_importance(_features(spark, folder), H7_FEATURES)


# --- sinks read back, order, bounds of fits -----------------------------------------------------


@query
def predictions_sink(spark, folder):
    """The written predictions with their place in the sink: file by file, row by row."""
    path = scratch_path(spark, "predictions")
    tables.write_predictions(_contract(spark, folder), path)
    rows = spark.read.parquet(path).select("series_id", "obs_date", "_metadata.file_name", "_metadata.row_index")
    placed = exact_rank(rows, [F.col("file_name"), F.col("row_index")], (), "position")
    return placed.select("position", "obs_date", "series_id")


@query
def features_sink(spark, folder):
    path = scratch_path(spark, "features")
    tables.write_sorted(_features(spark, folder), path, ["series_id", "obs_date"])
    return quality.input_range(spark.read.parquet(path), ("series_id",))


@query
def metrics_sink(spark, folder):
    """Yearly metrics as CSV with a header, read back."""
    path = scratch_path(spark, "metrics")
    tables.write_metrics(metrics_by_year_all(spark, folder), path)
    rows = spark.read.schema("year int, n_acted long, coverage double, acc double, logloss double").option("header", True).csv(path)
    return rows.select("year", "n_acted")


@query
def metrics_sorted(spark, folder):
    """Years by accuracy, nulls last, with their position; one row per year."""
    placed = F.row_number().over(Window.orderBy(F.asc_nulls_last("acc"), "year"))
    return metrics_by_year_all(spark, folder).select("year", "acc", placed.alias("position"))


@query
def coerce_columns(spark, folder):
    """A text column of numbers becomes a double, one with a single other value stays text."""
    text = F.col("value").cast("string")
    rows = fixtures.table(spark, folder, "events").select(
        "event_id", text.alias("numbers"), F.when(F.col("event_id") % 2 == 0, text).otherwise("x").alias("mixed")
    )
    out = features.coerce_text(rows)
    return out.select("event_id", F.typeof("numbers").alias("numbers_type"), F.typeof("mixed").alias("mixed_type"), "numbers")


@query
def subscriber_table(spark, folder):
    return subscriber_source.read_table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


@query
def walkforward_bounds(spark, folder):
    """Keys, labels and fold bounds of the walk-forward output."""
    out = folds.walk_forward(_features(spark, folder), H7_FEATURES)
    return out.select("series_id", "obs_date", "y_true", "test_month", "train_end", "n_train", "n_test")


@query
def walkforward_pooled(spark, folder):
    """One model over all series per month, all months fitted together."""
    return pooled.walk_forward_folds(_features(spark, folder), H7_FEATURES)


@query
def walkforward_pooled_bounds(spark, folder):
    out = pooled.walk_forward_folds(_features(spark, folder), H7_FEATURES)
    share = F.col("p_up").between(0.0, 1.0).alias("is_share")
    return out.select("series_id", "obs_date", "y_true", "test_month", "train_end", "n_train", "n_test", share)


@query
def pooled_calibration(spark, folder):
    """Isotonic calibration of the pooled walk-forward on the last 252 dates before 2001, applied to them and to what follows.

    An isotonic fit keeps the sum of what it is fitted to, so the calibrated probabilities add up to the positives.
    """
    out = durable(pooled.walk_forward_folds(_features(spark, folder), H7_FEATURES))
    early = F.col("obs_date") < F.lit("2001-01-01").cast("date")
    # Dates of a calendar: bounded.
    days = out.filter(early).select("obs_date").distinct().orderBy(F.desc("obs_date")).limit(folds.CAL_ROWS)
    tail = out.join(F.broadcast(days), "obs_date").withColumn("part", F.lit("calibration"))
    both = tail.unionByName(out.filter(~early).withColumn("part", F.lit("later")))
    scored = models.calibrate_pooled(tail, both)
    return scored.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("y_true").alias("positives"),
        F.sum(F.col("p_cal").between(0.0, 1.0).cast("long")).alias("shares"),
        F.round(F.sum(F.when(F.col("part") == "calibration", F.col("p_cal"))), 6).alias("fitted"),
    )


@query
def fit_offsets(spark, folder):
    return pooled.fit_offsets(_features(spark, folder), H7_FEATURES).coefficients()


@query
def offsets_optimum(spark, folder):
    """Whether the fit is where its gradient vanishes: per series and shared column the weight against the summed errors."""
    rows = durable(_features(spark, folder))
    model = pooled.fit_offsets(rows, H7_FEATURES)
    error = F.col("p_up") - F.col("direction_7d")
    scored = durable(model.predict(rows).select("series_id", error.alias("error"), *H7_FEATURES))
    found = scored.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("error").alias("error"))
    series = found.join(model.offsets.drop("n_rows"), "series_id").select(
        F.concat(F.lit("series_id="), "series_id").alias("term"), "n_rows", (F.abs(F.col("error") + F.col("offset")) < 1e-6).alias("settled")
    )
    out = series
    for c, w in zip(H7_FEATURES, model.scaled[1:]):
        # Sum of the standardised column times the error, from moments of one aggregate.
        slope = (F.sum(F.col(c) * F.col("error")) - F.avg(c) * F.sum("error")) / F.stddev_pop(c) + F.lit(float(w))
        out = out.unionByName(scored.agg(F.lit(c).alias("term"), F.count(F.lit(1)).alias("n_rows"), (F.abs(slope) < 1e-6).alias("settled")))
    return out


@query
def walkforward_calibration_sizes(spark, folder):
    out = folds.walk_forward_calibrated(_features(spark, folder), H7_FEATURES)
    return out.select("series_id", "obs_date", "y_true", "test_month", "cal_size")


@query
def fit_per_series_sizes(spark, folder):
    weights = folds.fit_per_series(_features(spark, folder), H7_FEATURES, scale=True)
    return weights.groupBy("series_id").agg(F.count(F.lit(1)).alias("terms"), F.max("n_rows").cast("long").alias("n_rows"))


@query
def per_series_optimum(spark, folder):
    """Whether the fit of each series is where its gradient vanishes, by sums that Spark takes over the scored rows."""
    rows = durable(_features(spark, folder))
    weights = durable(folds.fit_per_series(rows, H7_FEATURES, scale=True))
    found = folds.logistic_gradient(rows, weights, H7_FEATURES)
    return found.select("series_id", "term", "n_rows", (F.abs("gradient") < 1e-6).alias("settled"))


@query
def score_global_actions(spark, folder):
    """Every labelled row is scored, and its action follows from its probability."""
    rows = durable(_features(spark, folder))
    scored = models.score_global(models.train_global(rows), rows, T60)
    p = F.col("p_up_logreg")
    action = F.when(p >= T60, "UP").when(p <= 1 - T60, "DOWN").otherwise("SIDEWAYS")
    return scored.select("series_id", "obs_date", p.between(0.0, 1.0).alias("is_share"), (F.col("action_logreg") == action).alias("follows"))
