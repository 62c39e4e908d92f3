"""Decision policies over grids of thresholds and coverages.

The grids never multiply rows. A row that acts at threshold ``t`` acts at every lower one, and a row
chosen for a small coverage is chosen for every larger one. So each row gets a single level, rows
are added up per (policy, model, side, level, probability bin), a table whose size depends on the
grid alone, and only that table is spread over the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions.numbers import LOG_FLOOR, count_reached, log_loss
from signalframe.functions.signals import check_threshold
from signalframe.operators.metrics import acted_cells, acted_scores, unpivot_models, with_collapse
from signalframe.operators.selection import with_levels
from signalframe.operators.windows import by_series, exact_rank, trailing
from signalframe.session import durable

# Grids of the research sweeps.
THRESHOLDS = (0.52, 0.54, 0.56, 0.58, 0.60, 0.62, 0.65, 0.70)
COVERAGES = (0.05, 0.10, 0.15, 0.20, 0.30, 0.40)
REGIME_THRESHOLDS = (0.56, 0.60, 0.65)

# Names of the score columns.
SCORES = [
    "n", "n_acted", "coverage", "acc", "logloss", "brier", "ece",
    "act_up_rate", "act_down_rate", "n_up_acted", "n_down_acted",
]


def _banded(policy: str, model: str, p: str, up: Column, down: Column) -> Column:
    """A row under one policy: the side it is on, how many thresholds it acts at, its probability."""
    return F.struct(
        F.lit(policy).alias("policy"),
        F.lit(model).alias("model"),
        F.when(up > 0, 1).otherwise(-1).alias("side"),
        F.greatest(up, down).alias("level"),
        F.col(p).alias("p"),
    )


def _spread(cells: DataFrame, grid: Sequence[float], name: str, by: Sequence[str], floor_up: bool) -> DataFrame:
    """Cells to one copy per grid point, with the side acted on there (0 where not reached)."""
    points = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(g)).alias(name)) for i, g in enumerate(grid)])
    spread = cells.select("*", F.inline(points))
    acts = F.col("level") > F.col("_i") if floor_up else F.col("level") <= F.col("_i")
    act = F.when(acts, F.col("side")).otherwise(0)
    return spread.withColumn("act", act).drop("_i")


def threshold_sweep(
    preds: DataFrame,
    models: dict[str, str],
    thresholds: Sequence[float] = THRESHOLDS,
    agreement: tuple[str, str] | None = None,
    by: Sequence[str] = (),
    floor: float = LOG_FLOOR,
) -> DataFrame:
    """Single-model bands, and bands on which two models agree, at every threshold.

    ``models`` maps a model name to its probability column. The agreement policy is scored with the
    probabilities of its first column.
    """
    ts = sorted(thresholds)
    for t in ts:
        check_threshold(t)
    columns = dict.fromkeys([*models.values(), *(agreement or ())])
    levels = {f"_up_{c}": count_reached(c, ts) for c in columns}
    levels |= {f"_down_{c}": count_reached(c, [1.0 - t for t in ts], "<=") for c in columns}
    parts = [
        _banded("single_model_threshold", m, c, F.col(f"_up_{c}"), F.col(f"_down_{c}")) for m, c in models.items()
    ]
    if agreement:
        a, b = agreement
        up, down = (F.least(f"_{side}_{a}", f"_{side}_{b}") for side in ("up", "down"))
        parts.append(_banded("agreement_threshold", "logreg_vs_tree", a, up, down))
    rows = preds.withColumns(levels).select(*by, "y_true", F.inline(F.array(*parts)))
    keys = [*by, "policy", "model", "level"]
    cells = acted_cells(rows, keys, act="side", floor=floor).withColumnRenamed("act", "side")
    out = [*by, "policy", "model", "t"]
    return acted_scores(_spread(cells, ts, "t", by, floor_up=True), out)


def topk_sizes(n: Column, coverage: float, split: float | None = 0.5) -> tuple[Column, Column]:
    """Rows to take on the up side and the down side for a target coverage.

    Halves round to even. ``split=None`` halves by integer division instead, as the operating point does.
    """
    total = F.bround(n * F.lit(float(coverage))).cast("long")
    up = F.floor(total / 2) if split is None else F.bround(total * F.lit(float(split))).cast("long")
    return up, total - up


def topk_size(n: int, coverage: float, split: float | None = 0.5) -> tuple[int, int]:
    """As ``topk_sizes`` for a known number of rows."""
    total = round(n * float(coverage))
    up = total // 2 if split is None else round(total * float(split))
    return up, total - up


CONFIDENCE = "_conf"
TIES = ["obs_date", "series_id"]


def _sided(preds: DataFrame, p: str) -> DataFrame:
    """The side of 0.5 that each row is on, and its distance from it."""
    return preds.withColumn("side", F.when(F.col(p) >= 0.5, 1).otherwise(-1)).withColumn(CONFIDENCE, F.abs(F.col(p) - 0.5))


def _sizes(n: int, coverages: Sequence[float], split: float | None = 0.5) -> dict[int, list[int]]:
    """Rows to take per side (1 up, -1 down) at each coverage, ascending."""
    sizes = [topk_size(n, c, split) for c in sorted(coverages)]
    return {1: [up for up, _ in sizes], -1: [down for _, down in sizes]}


def balanced_topk(preds: DataFrame, p: str, coverage: float, split: float | None = None) -> DataFrame:
    """The most confident rows of each side, about ``coverage`` of all rows, with their action.

    The rows are selected first; only the chosen ones are ranked.
    """
    sided = durable(_sided(preds, p))
    sizes = _sizes(sided.count(), [coverage], split)
    ties = [F.asc(c) for c in TIES]
    chosen = with_levels(sided, F.col(CONFIDENCE), ties, {(s,): k for s, k in sizes.items()}, ("side",), "_level").filter("_level = 0").drop("_level")
    return exact_rank(chosen, [F.desc(CONFIDENCE), *ties], keys=("side",)).drop(CONFIDENCE).withColumnRenamed("side", "act")


def balanced_topk_per_series(preds: DataFrame, p: str, coverage: float, split: float | None = None) -> DataFrame:
    """As ``balanced_topk`` within every series, all rows kept, ``act`` 0 where not chosen."""
    sided = preds.withColumn("_side", F.when(F.col(p) >= 0.5, 1).otherwise(-1))
    by_conf = Window.partitionBy("series_id", "_side").orderBy(F.desc(F.abs(F.col(p) - 0.5)), "obs_date")
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    up, down = topk_sizes(F.col("_n"), coverage, split)
    chosen = F.col("_rank") <= F.when(F.col("_side") == 1, up).otherwise(down)
    return (
        sided.withColumn("_n", n)
        .withColumn("_rank", F.row_number().over(by_conf))
        .withColumn("act", F.when(chosen, F.col("_side")).otherwise(0))
        .drop("_side", "_n", "_rank")
    )


def topk_sweep(
    preds: DataFrame, models: dict[str, str], coverages: Sequence[float] = COVERAGES, floor: float = LOG_FLOOR
) -> DataFrame:
    """Balanced top-k at every target coverage; rows are counted by confidence, and sorted at the edges only.

    ``preds`` is read once per step of the selection: checkpoint it if it is dear.
    """
    cs = sorted(coverages)
    sizes = _sizes(preds.count(), cs)
    sided = _sided(unpivot_models(preds, models, ["series_id", "obs_date", "y_true"]), "p")
    targets = {(m, s): k for m in models for s, k in sizes.items()}
    # Level: the first coverage that reaches the row.
    ranked = with_levels(sided, F.col(CONFIDENCE), [F.asc(c) for c in TIES], targets, ("model", "side"))
    rows = ranked.select("y_true", "p", "side", "level", "model", F.lit("balanced_topk_confidence").alias("policy"))
    cells = acted_cells(rows, ["policy", "model", "level"], act="side", floor=floor).withColumnRenamed("act", "side")
    spread = _spread(cells, cs, "coverage_target", (), floor_up=False)
    return acted_scores(spread, ["policy", "model", "coverage_target"])


def policy_sweep(preds: DataFrame, logreg: str = "p_up_logreg", tree: str = "p_up_tree") -> DataFrame:
    """All three policies over their grids, with collapse flags.

    The predictions are read several times (bands, size, the ranking and its sampling), so they
    are checkpointed first.
    """
    preds = durable(preds.select("series_id", "obs_date", "y_true", logreg, tree))
    models = {logreg: logreg, tree: tree}
    single = threshold_sweep(preds, models, agreement=(logreg, tree))
    ranked = topk_sweep(preds, models)
    both = with_collapse(single.unionByName(ranked, allowMissingColumns=True))
    return both.select("policy", "model", "t", "coverage_target", *SCORES, "min_side_frac", "direction_collapse")


def regime_report(preds: DataFrame, models: dict[str, str], thresholds: Sequence[float] = REGIME_THRESHOLDS) -> DataFrame:
    """Threshold policy within each volatility regime."""
    return threshold_sweep(preds, models, thresholds, by=("is_high_vol",)).select(
        "is_high_vol", "policy", "model", "t", *SCORES
    )


def rolling_scores(acted: DataFrame, p: str, window: int = 252, min_acted: int = 30) -> DataFrame:
    """Trailing accuracy and log loss of the acted rows per series, from the first full window on.

    Null scores where fewer than ``min_acted`` rows of the window were acted on.
    """
    w = by_series()
    frame = trailing(w, window)
    y, a = F.col("y_true"), F.col("act")
    hit = F.when(a != 0, ((a == 1).cast("int") == y).cast("double"))
    loss = F.when(a != 0, log_loss(y, F.col(p)))
    rolled = acted.withColumns(
        {
            "_rn": F.row_number().over(w),
            "n_acted": F.sum((a != 0).cast("long")).over(frame),
            "_acc": F.avg(hit).over(frame),
            "_loss": F.avg(loss).over(frame),
        }
    ).filter(F.col("_rn") >= window)
    enough = F.col("n_acted") >= min_acted
    return rolled.select(
        "series_id",
        "obs_date",
        "n_acted",
        F.when(enough, F.col("_acc")).alias("acc"),
        F.when(enough, F.col("_loss")).alias("logloss"),
    )
