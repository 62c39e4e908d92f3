"""Schema contracts: checked on ``df.schema``, no job is run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalframe.operators.windows import by_series
from signalframe.schemas import H7_TARGETS, PREDICTION_COLUMNS


class ContractError(ValueError):
    """A frame does not have the columns its consumer needs."""


def require_columns(df: DataFrame, columns: Iterable[str], exact: bool = False) -> DataFrame:
    wanted, have = list(columns), set(df.columns)
    missing = sorted(set(wanted) - have)
    if missing:
        raise ContractError(f"missing required columns: {missing}; have {sorted(have)}")
    extra = sorted(have - set(wanted))
    if exact and extra:
        raise ContractError(f"extra columns: {extra}; only {wanted} are allowed")
    return df


def require_instant(df: DataFrame, name: str) -> DataFrame:
    """The column must be a point in time: a wall-clock time without zone has no local date."""
    if not isinstance(df.schema[name].dataType, T.TimestampType):
        raise ContractError(f"{name} must be a timestamp with a zone, not {df.schema[name].dataType.simpleString()}")
    return df


def as_predictions(df: DataFrame) -> DataFrame:
    """The four contract columns, in order; other columns are an error, a null id fails the job."""
    require_columns(df, PREDICTION_COLUMNS, exact=True)
    checked = F.when(F.col("series_id").isNull(), F.raise_error(F.lit("series_id is null")).cast("string"))
    return df.select(
        "obs_date", checked.otherwise(F.col("series_id")).alias("series_id"), "p_up_logreg", "action_logreg"
    )


def numeric_features(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither keys nor targets, sorted by name.

    Both the direction label and the forward return it is made from are left out: a model that
    sees either is trained on the answer.
    """
    out = {"obs_date", "series_id", *H7_TARGETS, *exclude}
    return sorted(f.name for f in df.schema if f.name not in out and isinstance(f.dataType, T.NumericType))


def feature_spec(spec) -> dict[str, list[str]]:
    """A plain list of numeric names, or a dict with ``categorical`` and ``numeric``."""
    if isinstance(spec, dict):
        return {"categorical": list(spec.get("categorical", [])), "numeric": list(spec.get("numeric", []))}
    if isinstance(spec, (list, tuple)):
        return {"categorical": [], "numeric": list(spec)}
    raise ContractError(f"unknown feature spec: {type(spec).__name__}")


def select_features(df: DataFrame, spec) -> DataFrame:
    names = feature_spec(spec)
    wanted = names["categorical"] + names["numeric"]
    return require_columns(df, wanted).select(*wanted)


def gold_violations(df: DataFrame) -> DataFrame:
    """Rows that break the wide-table contract, with the kind of violation."""
    require_columns(df, ["series_id", "obs_date", "value", "prev_value"])
    # Rows without an id are violations already; in the window they would all be one group.
    unnamed = df.filter(F.col("series_id").isNull()).withColumn("kind", F.lit("null_series_id"))
    before = F.lag("value").over(by_series())
    kind = F.when(before.isNotNull() & ~F.col("prev_value").eqNullSafe(before), "prev_value_mismatch")
    named = df.filter(F.col("series_id").isNotNull()).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return named.unionByName(unnamed)
