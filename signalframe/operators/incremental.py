"""Keeping derived tables in step with changed inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.operators.features import GOLD_AHEAD, GOLD_BACK, gold_features
from signalframe.operators.windows import by_series, keep_latest, salted_join
from signalframe.schemas import KEYS


def latest_versions(df: DataFrame, ingested: str = "ingested_at", tiebreak: str = "raw_path") -> DataFrame:
    """The newest version of every (series, date); equal times are settled by ``tiebreak``, descending."""
    return keep_latest(df, KEYS, [F.desc_nulls_last(ingested), F.desc_nulls_last(tiebreak)])


def merge_keep_last(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Append ``new`` to ``old``; where both have a key, ``new`` wins. Only common columns are kept."""
    keys = keys or KEYS
    common = [c for c in new.columns if c in old.columns]
    both = (
        old.select(*common)
        .withColumn("_turn", F.lit(0))
        .unionByName(new.select(*common).withColumn("_turn", F.lit(1)))
    )
    return keep_latest(both, keys, [F.desc("_turn")]).drop("_turn")


def _near(mark: str, before: int, after: int) -> Column:
    """Is a marked row among the ``before`` rows before this one, itself, or the ``after`` rows after it."""
    return F.max(mark).over(by_series().rowsBetween(-before, after)) == 1


def affected_keys(keys: DataFrame, changed: DataFrame, back: int, ahead: int) -> DataFrame:
    """Which rows must be recomputed, and which are needed to do so.

    A row reads the ``back`` rows before it and the ``ahead`` rows after it, so a changed row
    affects the rows up to ``ahead`` before and ``back`` after it. Works on (series, date) only.
    """
    marked = keys.select(*KEYS).join(
        changed.select(*KEYS).distinct().withColumn("_hit", F.lit(1)), KEYS, "left"
    ).withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    return (
        marked.withColumn("affected", _near("_hit", back, ahead))
        .withColumn("_aff", F.col("affected").cast("int"))
        .withColumn("needed", _near("_aff", ahead, back))
        .filter("needed")
        .select(*KEYS, "affected")
    )


def refresh_gold(
    silver: DataFrame, gold: DataFrame, changed: DataFrame, back: int = GOLD_BACK, ahead: int = GOLD_AHEAD
) -> DataFrame:
    """The wide table after ``changed`` (series, date) keys arrived or were restated in ``silver``.

    Recomputes the affected rows only, including the forward targets of the rows just before a
    change, and keeps all others. Equals a full recompute over ``silver``. Every row of ``silver``
    that is not in ``gold`` must be among the changed keys.
    """
    parts = affected_keys(silver, changed, back, ahead)
    needed = silver.join(parts, KEYS)
    fresh = (
        gold_features(needed.drop("affected"))
        .join(parts.filter("affected").select(*KEYS), KEYS, "left_semi")
    )
    kept = gold.join(parts.filter("affected").select(*KEYS), KEYS, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def since(df: DataFrame, date: str | None = None, dates: list[str] | None = None, column: str = "obs_date") -> DataFrame:
    """Rows after a date, or of the given dates; on a partition column Spark lists only those folders."""
    out = df
    if date is not None:
        out = out.filter(F.col(column) > F.lit(date).cast("date"))
    if dates is not None:
        out = out.filter(F.col(column).isin([F.lit(d).cast("date") for d in dates]))
    return out


def watermarks(silver: DataFrame, ingest: str = "ingested_at") -> DataFrame:
    """Per series, the newest ingest time and the newest date seen."""
    return silver.groupBy("series_id").agg(F.max(ingest).alias("last_ingest"), F.max("obs_date").alias("last_obs_date"))


def after_watermark(landed: DataFrame, marks: DataFrame, ingest: str = "ingested_at") -> DataFrame:
    """Rows newer than their series' watermark; a series without one is taken whole."""
    return (
        landed.join(marks.select("series_id", F.col("last_ingest").alias("_mark")), "series_id", "left")
        .filter(F.col("_mark").isNull() | (F.col(ingest) > F.col("_mark")))
        .drop("_mark")
    )


def final_state(
    changes: DataFrame,
    key: str,
    at: str,
    is_delete: Column,
    spread_by: str,
    settings: tuple[str, ...] = (),
    first: tuple[str, ...] = (),
) -> DataFrame:
    """Replay an upsert/delete log: live keys with their first and last upsert since the last delete.

    ``spread_by`` is the event id: changes of one time follow each other by it. ``settings`` are taken
    from the last upsert, ``first`` (a token, say) from the first one since the last delete.

    One map-side-combined pass finds each key's last delete. The log is then joined to it with
    salted keys, so that a key holding much of the log is read by several tasks, and the
    surviving upserts are combined again.
    """
    when = F.struct(at, spread_by)
    ended = changes.groupBy(key).agg(F.max(F.when(is_delete, when)).alias("_ended"))
    upserts = changes.filter(~is_delete)
    alive = salted_join(upserts, ended, [key], spread_by).filter(F.col("_ended").isNull() | (when > F.col("_ended")))
    return alive.groupBy(key).agg(
        F.min(at).alias("created_at"),
        F.max(at).alias("updated_at"),
        *[F.max_by(c, when).alias(c) for c in settings],
        *[F.min_by(c, when).alias(f"first_{c}") for c in first],
    )


def soft_state(changes: DataFrame, key: str, at: str, is_delete: Column, order: str) -> DataFrame:
    """As ``final_state`` where a delete only deactivates: every key ever upserted, with its status.

    One map-side-combined aggregate. Deletes of unknown keys do nothing. ``order`` settles changes of one time.
    """
    return (
        changes.groupBy(key)
        .agg(
            F.min(F.when(~is_delete, F.col(at))).alias("created_at"),
            F.max(at).alias("updated_at"),
            F.max_by(is_delete, F.struct(at, order)).alias("_ended"),
        )
        .filter(F.col("created_at").isNotNull())
        .withColumn("status", F.when(F.col("_ended"), "inactive").otherwise("active"))
        .drop("_ended")
    )


def verify(subscriptions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Apply verification requests by token: known, unexpired and unverified rows become verified."""
    tokens = requests.select(F.col("token").alias("verification_token")).distinct().withColumn("_asked", F.lit(True))
    joined = subscriptions.join(tokens, "verification_token", "left")
    expired = F.coalesce(F.col("verification_expires_at") < now, F.lit(False))
    takes = F.coalesce(F.col("_asked"), F.lit(False)) & ~expired & F.col("verified_at").isNull()
    out = joined.withColumns(
        {
            "verified_at": F.when(takes, now).otherwise(F.col("verified_at")),
            "updated_at": F.when(takes, now).otherwise(F.col("updated_at")),
            "verification_token": F.when(~takes, F.col("verification_token")),
            "verification_expires_at": F.when(~takes, F.col("verification_expires_at")),
        }
    )
    return out.select(*subscriptions.columns)
