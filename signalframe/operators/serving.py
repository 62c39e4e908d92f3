"""Tables a consumer of the signals reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions import names, signals
from signalframe.operators.quality import input_range
from signalframe.operators.windows import last_rows


def score_decisions(preds: DataFrame, t: float, p: str = "p_up_logreg") -> DataFrame:
    """Policy decision and rescaled confidence of every row."""
    return preds.withColumns(
        {"decision": signals.decision(F.col(p), t), "confidence": signals.band_confidence(F.col(p), t)}
    )


def latest_per_series(preds: DataFrame, columns: list[str]) -> DataFrame:
    """Newest row per series as one hash aggregate: only one partial row per series leaves a task."""
    return preds.groupBy("series_id").agg(
        F.max("obs_date").alias("obs_date"), *[F.max_by(c, "obs_date").alias(c) for c in columns]
    )


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def latest_rows(preds: DataFrame, t: float, limit: int = 365) -> DataFrame:
    """The last ``limit`` rows of every pair with actions, decision and confidence.

    A given decision or confidence is used; else both come from the first model that has a value.
    Series that are not pairs are left out (``rejected_series`` lists them). ``row_no`` counts
    from the oldest row kept.
    """
    logreg = _column(preds, "p_up_logreg", "double")
    if "p_up_logreg" not in preds.columns:
        logreg = _column(preds, "p_up_raw", "double")
    tree, given = _column(preds, "p_up_tree", "double"), _column(preds, "decision", "string")
    given_conf = _column(preds, "confidence", "double")
    text = F.nullif(F.trim(given), F.lit(""))
    p = signals.primary_probability(logreg, tree)
    recent = last_rows(preds.filter(names.is_pair_series(F.col("series_id"))), limit)
    kept = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return recent.select(
        "series_id",
        "obs_date",
        (kept - F.col("recency") + 1).cast("int").alias("row_no"),
        names.pair_of_series(F.col("series_id")).alias("pair"),
        logreg.alias("p_up_logreg"),
        tree.alias("p_up_tree"),
        signals.action(logreg, t).alias("action_logreg"),
        signals.action(tree, t).alias("action_tree"),
        signals.resolved_decision(given, p, t).alias("decision"),
        F.when(text.isNull() & p.isNotNull(), signals.band_confidence(p, t)).otherwise(given_conf).alias("confidence"),
    )


def rejected_series(preds: DataFrame) -> DataFrame:
    return preds.select("series_id").distinct().filter(~names.is_pair_series(F.col("series_id")))


def latest_documents(rows: DataFrame, sha: str, horizon: str, generated_at: str) -> DataFrame:
    """One nested document per pair: a header and its rows, oldest first (at most the row limit)."""
    row = F.struct(
        "obs_date", "pair", "p_up_logreg", "p_up_tree", "action_logreg", "action_tree", "decision", "confidence"
    )
    return (
        rows.groupBy("pair")
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select(
            F.lit(sha).alias("sha"),
            "pair",
            F.lit(horizon).alias("horizon"),
            F.lit(generated_at).alias("generated_at"),
            "rows",
        )
    )


def signal_history(rows: DataFrame, length: int = 7) -> DataFrame:
    """The last ``length`` directions of a pair, oldest first, padded in front with the newest."""
    shown = signals.served_direction(F.col("decision"), F.col("action_logreg"), F.col("p_up_logreg"))
    recent = last_rows(rows, length, keys=("pair",)).withColumn("direction", shown)
    lists = recent.groupBy("pair").agg(
        F.max("obs_date").alias("obs_date"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("obs_date", "direction"))), lambda r: r["direction"]
        ).alias("seen"),
    )
    current = F.element_at("seen", -1)
    return lists.withColumn("direction", current).withColumn(
        "history", F.concat(F.array_repeat(current, F.lit(length) - F.size("seen")), F.col("seen"))
    ).drop("seen")


def lookup_latest(requested: DataFrame, rows: DataFrame, n: int = 1, t: float = 0.6) -> DataFrame:
    """The ``n`` newest rows of each requested pair; a pair without rows gets a neutral placeholder."""
    wanted = requested.select(names.normal_pair(F.col("pair")).alias("pair")).distinct()
    found = last_rows(rows, n, keys=("pair",))
    p = F.coalesce(F.col("p_up_logreg"), F.lit(0.5))
    present = F.col("obs_date").isNotNull()
    return wanted.join(found, "pair", "left").select(
        "pair",
        names.pair_label(F.col("pair")).alias("pair_label"),
        "obs_date",
        F.when(present, signals.api_direction(F.col("action_logreg"))).otherwise("ABSTAIN").alias("direction"),
        signals.served_direction(F.col("decision"), F.col("action_logreg"), F.col("p_up_logreg"), t).alias(
            "web_direction"
        ),
        F.when(present, signals.plain_confidence(p)).otherwise(0.0).alias("confidence"),
        F.when(
            present & F.col("decision").isNotNull(),
            F.coalesce(F.col("confidence"), signals.served_confidence(F.col("p_up_logreg"), t)),
        )
        .otherwise(signals.served_confidence(F.col("p_up_logreg"), t))
        .alias("web_confidence"),
        p.alias("p_up"),
    )


def serving_header(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Newest generation time and newest date over what is served."""
    dates = items.agg(F.max("obs_date").alias("run_date"), F.count("obs_date").alias("n_items"))
    stamp = documents.agg(F.max("generated_at").alias("g"))
    return dates.select(F.lit("h7").alias("horizon"), stamp.scalar().alias("as_of"), "run_date", "n_items")


def manifest_rows(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Per series: rows and dates of its input, rows and dates of its predictions; nulls where it has none."""
    scored = input_range(preds, ("series_id",)).select(
        "series_id",
        F.col("rows").alias("prediction_rows"),
        F.col("min_obs_date").alias("first_prediction"),
        F.col("max_obs_date").alias("last_prediction"),
    )
    return input_range(gold, ("series_id",)).join(scored, "series_id", "full_outer")


def run_manifest(
    gold: DataFrame, preds: DataFrame, header: dict[str, str], files: DataFrame | None = None
) -> DataFrame:
    """One nested row describing a run: inputs per series, predictions, model files.

    ``files`` comes from ``sources.tables.file_facts``. The document lists every series, so it is as
    large as their number; ``manifest_rows`` is the same as a table. An input series without
    predictions fails the job when there are several inputs.
    """
    entry = F.when(F.col("rows").isNotNull(), F.struct("series_id", "rows", "min_obs_date", "max_obs_date"))
    count = F.when(F.col("prediction_rows").isNotNull(), F.struct("series_id", F.col("prediction_rows").alias("rows")))
    lacks = F.when(F.col("prediction_rows").isNull(), F.col("series_id"))
    whole = manifest_rows(gold, preds).agg(
        F.array_sort(F.collect_list(entry)).alias("gold_inputs"),
        F.array_sort(F.collect_list(lacks)).alias("_missing"),
        F.struct(
            F.coalesce(F.sum("prediction_rows"), F.lit(0)).alias("rows"),
            F.min("first_prediction").alias("min_obs_date"),
            F.max("last_prediction").alias("max_obs_date"),
            F.map_from_entries(F.array_sort(F.collect_list(count))).alias("by_series_rows"),
        ).alias("predictions"),
    )
    failed = F.raise_error(F.concat(F.lit("series missing in predictions: "), F.array_join("_missing", ", ")))
    inputs = (
        F.when((F.size("gold_inputs") > 1) & (F.size("_missing") > 0), failed.cast(whole.schema["gold_inputs"].dataType))
        .otherwise(F.col("gold_inputs"))
        .alias("gold_inputs")
    )
    facts = F.lit(None)
    if files is not None:
        fact = F.struct("name", F.struct("path", "sha256", "bytes"))
        facts = files.agg(F.map_from_entries(F.array_sort(F.collect_list(fact)))).scalar()
    return whole.select(
        *[F.lit(v).alias(k) for k, v in header.items()], inputs, "predictions", facts.alias("model_files")
    )
