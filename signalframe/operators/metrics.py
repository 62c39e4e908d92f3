"""Scores of probabilities and of decisions.

Every score here is a sum over rows, so rows are first added up per small cell (group, probability
bin, decision band) with map-side combining, and the ratios are taken on the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.numbers import (
    LOG_FLOOR,
    bucket_label,
    count_reached,
    equal_edges,
    log_loss,
    probability_bin,
    squared_error,
)
from signalframe.functions.signals import plain_confidence


def unpivot_models(df: DataFrame, models: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, model) with its probability as ``p``; ``models`` maps name to column."""
    structs = [F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()]
    return df.select(*keep, F.inline(F.array(*structs)))


def overall(df: DataFrame, y: str = "y_true", p: str = "p", by: Sequence[str] = (), floor: float = LOG_FLOOR) -> DataFrame:
    """Size, accuracy, log loss, Brier score and means."""
    yt, pt = F.col(y), F.col(p)
    hit = ((pt >= 0.5).cast("int") == yt).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        F.avg(log_loss(yt, pt, floor)).alias("log_loss"),
        F.avg(squared_error(yt, pt)).alias("brier"),
        F.avg(plain_confidence(pt)).alias("mean_confidence"),
        F.avg(pt).alias("mean_p_up"),
        F.avg(yt.cast("double")).alias("pos_rate"),
    )


def by_threshold(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("model",)) -> DataFrame:
    """Coverage and scores of the rows whose confidence reaches each threshold.

    A row's level is the number of thresholds it reaches; rows are summed per level and a level then
    counts towards every threshold at or below it, so no row is multiplied.
    """
    ts = sorted(thresholds)
    y, p = F.col("y_true"), F.col("p")
    level = count_reached("_conf", ts)
    cells = df.withColumn("_conf", plain_confidence(p)).groupBy(*by, level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((p >= 0.5).cast("int") == y).cast("long")).alias("hits"),
        F.sum(log_loss(y, p)).alias("ll"),
        F.sum(squared_error(y, p)).alias("se"),
    )
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("conf_thr")) for i, t in enumerate(ts)])
    reached = F.col("level") > F.col("i")
    spread = cells.select("*", F.inline(grid))
    n = F.sum(F.when(reached, F.col("n")).otherwise(0))
    return spread.groupBy(*by, "conf_thr").agg(
        (n / F.sum("n")).alias("coverage"),
        (F.sum(F.when(reached, F.col("hits"))) / n).alias("accuracy"),
        (F.sum(F.when(reached, F.col("ll"))) / n).alias("log_loss"),
        (F.sum(F.when(reached, F.col("se"))) / n).alias("brier"),
    )


def by_bucket(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Scores per probability bucket; coverage counts the rows in no bucket as well."""
    y, p = F.col("y_true"), F.col("p")
    cells = df.groupBy(*by, bucket_label(p).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg(p).alias("avg_p_up"),
        F.avg(y.cast("double")).alias("pos_rate"),
        F.avg(plain_confidence(p)).alias("avg_confidence"),
    )
    # A group has one row per bucket by now.
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return cells.withColumn("coverage", share).filter(F.col("bucket").isNotNull())


def _bins(df: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, probability_bin("p", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum(F.col("y_true").cast("double")).alias("sum_y")
    )


def calibration_error(df: DataFrame, bins: Sequence[int] = (10,), by: Sequence[str] = ("model",)) -> DataFrame:
    """Expected calibration error: size-weighted gap between mean probability and share of ups.

    Several bin counts share one pass: rows are added up per combination of their bins.
    """
    combined = df.groupBy(*by, *[probability_bin("p", k).alias(f"_bin{k}") for k in bins]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum(F.col("y_true").cast("double")).alias("sum_y")
    )
    choices = F.array(*[F.struct(F.lit(k).alias("bins"), F.col(f"_bin{k}").alias("bin")) for k in bins])
    sums = [F.sum(c).alias(c) for c in ("n", "sum_p", "sum_y")]
    per_bin = combined.select(*by, "n", "sum_p", "sum_y", F.inline(choices)).groupBy(*by, "bins", "bin").agg(*sums)
    gap = F.abs(F.col("sum_y") - F.col("sum_p"))
    return per_bin.groupBy(*by, "bins").agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def reliability(df: DataFrame, bins: int = 10, by: Sequence[str] = ("model",)) -> DataFrame:
    """Every equal-width bin of every group, empty ones included."""
    edges = equal_edges(bins)
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("p_lo"), F.lit(edges[i + 1]).alias("p_hi"))
            for i in range(bins)
        ]
    )
    cell = F.struct("bin", F.struct("n", "sum_p", "sum_y"))
    # A map of at most ``bins`` entries per group, looked up for every bin of the grid.
    maps = _bins(df, bins, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))
    found = F.try_element_at("_cells", F.col("bin"))
    return (
        maps.select(*by, "_cells", F.inline(grid))
        .withColumn("_c", found)
        .select(
            *by,
            "bin",
            "p_lo",
            "p_hi",
            F.coalesce("_c.n", F.lit(0)).alias("n"),
            (F.col("_c.sum_p") / F.col("_c.n")).alias("p_mean"),
            (F.col("_c.sum_y") / F.col("_c.n")).alias("y_mean"),
        )
    )


def calibration_line(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Least-squares line of the outcome on the probability."""
    y = F.col("y_true").cast("double")
    return df.groupBy(*by).agg(
        F.regr_intercept(y, F.col("p")).alias("cal_intercept"), F.regr_slope(y, F.col("p")).alias("cal_slope")
    )


# --- decisions -------------------------------------------------------------------------------


def acted_cells(df: DataFrame, by: Sequence[str], act: str = "act", bins: int = 10, floor: float = LOG_FLOOR) -> DataFrame:
    """Sums of the scoring terms per (group, side, probability bin)."""
    y, p, a = F.col("y_true"), F.col("p"), F.col(act)
    yhat = (a == 1).cast("int")
    return df.groupBy(*by, F.col(act).alias("act"), probability_bin("p", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((yhat == y).cast("long")).alias("hits"),
        F.sum(log_loss(y, p, floor)).alias("ll"),
        F.sum(squared_error(y, p)).alias("se"),
        F.sum("p").alias("sum_p"),
        F.sum(y.cast("double")).alias("sum_y"),
    )


def acted_scores(cells: DataFrame, by: Sequence[str], total: Column | None = None) -> DataFrame:
    """Scores of the acted rows from ``acted_cells`` sums (``act`` 0 means not acted).

    ``total`` replaces the row count where the cells do not hold the rows left alone.
    """
    acted = F.col("act") != 0

    def over(name: str) -> Column:
        return F.sum(F.when(acted, F.col(name)))

    per_bin = cells.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"),
        *[over(c).alias(c) for c in ("hits", "ll", "se", "sum_p", "sum_y")],
        F.coalesce(over("n"), F.lit(0)).alias("n_acted"),
        F.sum(F.when(F.col("act") == 1, F.col("n")).otherwise(0)).alias("n_up_acted"),
        F.sum(F.when(F.col("act") == -1, F.col("n")).otherwise(0)).alias("n_down_acted"),
    )
    n = F.sum("n") if total is None else F.max(total)
    k = F.nullif(F.sum("n_acted"), F.lit(0))
    return per_bin.groupBy(*by).agg(
        n.alias("n"),
        F.sum("n_acted").alias("n_acted"),
        (F.sum("n_acted") / n).alias("coverage"),
        (F.sum("hits") / k).alias("acc"),
        (F.sum("ll") / k).alias("logloss"),
        (F.sum("se") / k).alias("brier"),
        (F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))) / k).alias("ece"),
        (F.sum("n_up_acted") / k).alias("act_up_rate"),
        (F.sum("n_down_acted") / k).alias("act_down_rate"),
        F.sum("n_up_acted").alias("n_up_acted"),
        F.sum("n_down_acted").alias("n_down_acted"),
    )


def evaluate_acted(df: DataFrame, by: Sequence[str], act: str = "act", floor: float = LOG_FLOOR) -> DataFrame:
    return acted_scores(acted_cells(df, by, act, floor=floor), by)


def with_collapse(df: DataFrame, limit: float = 0.20) -> DataFrame:
    """Flag decisions that nearly all fall on one side."""
    smaller = F.least("act_up_rate", "act_down_rate")
    return df.withColumns(
        {
            "min_side_frac": smaller,
            "direction_collapse": F.coalesce((F.col("n_acted") > 0) & (smaller < limit), F.lit(False)),
        }
    )


def by_year(df: DataFrame, by: Sequence[str] = (), worst: int | None = None) -> DataFrame:
    """Yearly scores of the acted rows, the least accurate ``worst`` years if asked for."""
    scores = evaluate_acted(df.withColumn("year", F.year("obs_date")), [*by, "year"]).select(
        *by, "year", "n_acted", "coverage", "acc", "logloss"
    )
    return scores if worst is None else scores.orderBy(F.asc_nulls_last("acc"), "year").limit(worst)


def confidence_histogram(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Counts per fifth of confidence in whole percent; rows at 0 percent are left out."""
    percent = F.floor(F.col(confidence) * 100 + 0.5)
    bounds = [(lo, lo + 20) for lo in range(0, 100, 20)]
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{lo}-{hi}%").alias("bucket")) for i, (lo, hi) in enumerate(bounds)])
    slot = F.ceil(percent / 20) - 1
    counts = df.agg(*[F.count_if((percent > 0) & (slot == i)).alias(f"c{i}") for i in range(len(bounds))])
    return counts.select(F.inline(grid), F.array(*[f"c{i}" for i in range(len(bounds))]).alias("c")).select(
        "bucket", F.element_at("c", F.col("i") + 1).alias("n")
    )
