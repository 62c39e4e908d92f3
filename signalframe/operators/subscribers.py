"""Subscriber tables, who is due, and what each of them gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.functions import dates, names, signals
from signalframe.functions.numbers import percent_text
from signalframe.operators.windows import salted_join

# Allowed settings of a subscription.
FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI")
TIMINGS = ("FIRST_BUSINESS_DAY", "LAST_BUSINESS_DAY")
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

EVERY_PAIR = "*"


def active(subscriptions: DataFrame, preferences: DataFrame, verified_only: bool = False) -> DataFrame:
    """Subscriptions with their preferences; both are keyed by id, which is unique on either side."""
    rows = subscriptions.filter(F.col("verified_at").isNotNull()) if verified_only else subscriptions
    return rows.join(preferences, rows["id"] == preferences["subscription_id"]).select(
        "id",
        "email",
        "frequency",
        "weekly_day",
        "monthly_timing",
        F.coalesce("pairs", F.array().cast("array<string>")).alias("pairs"),
        F.coalesce("timezone", F.lit(dates.LOCAL_ZONE)).alias("timezone"),
    )


def validated(requests: DataFrame, fill_weekly: bool = False) -> DataFrame:
    """Accept or reject each request, with the first reason; ``fill_weekly`` sets the signup default."""
    weekly = F.col("weekly_day")
    if fill_weekly:
        weekly = F.when((F.col("frequency") == "WEEKLY") & weekly.isNull(), "WED").otherwise(weekly)
    bad_email = ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))
    reason = (
        F.when(bad_email, "email")
        .when(F.coalesce(F.size("pairs"), F.lit(0)) < 1, "pairs")
        .when(~F.coalesce(F.col("frequency").isin(*FREQUENCIES), F.lit(False)), "frequency")
        .when((F.col("frequency") == "WEEKLY") & ~F.coalesce(weekly.isin(*WEEKDAYS), F.lit(False)), "weekly_day")
        .when(
            (F.col("frequency") == "MONTHLY")
            & ~F.coalesce(F.col("monthly_timing").isin(*TIMINGS), F.lit(False)),
            "monthly_timing",
        )
    )
    return requests.withColumns(
        {
            "weekly_day": F.when(F.col("frequency") == "WEEKLY", weekly),
            "monthly_timing": F.when(F.col("frequency") == "MONTHLY", F.col("monthly_timing")),
            "email": F.lower(F.trim("email")),
            "subscription_key": names.email_key(F.col("email")),
            "reason": reason,
            "accepted": reason.isNull(),
        }
    )


def is_due(day: Column) -> Column:
    """Does a subscription send on ``day``: never on weekends, weekly on FRI unless a day is set."""
    weekly = F.when(
        F.col("weekly_day").isNull() | (F.col("weekly_day") == ""), dates.weekday(day) == 4
    ).otherwise(F.coalesce(dates.is_weekday_name(day, F.col("weekly_day")), F.lit(False)))
    monthly = F.when(F.col("monthly_timing") == "LAST_BUSINESS_DAY", day == dates.last_business_day(day)).otherwise(
        day == dates.first_business_day(day)
    )
    rule = (
        F.when(F.col("frequency") == "DAILY", True)
        .when(F.col("frequency") == "WEEKLY", weekly)
        .when(F.col("frequency") == "MONTHLY", monthly)
        .otherwise(False)
    )
    return dates.is_business_day(day) & rule


def due(subscribers: DataFrame, run_dates: list[str]) -> DataFrame:
    """Subscribers due on each run date, one row per date and subscriber."""
    days = F.array(*[F.lit(d).cast("date") for d in run_dates])
    return subscribers.withColumn("run_date", F.explode(days)).filter(is_due(F.col("run_date")))


def digest_rows(due_rows: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per due subscriber and signal they asked for; an empty list asks for every signal.

    Both kinds meet in one equi-join: a signal carries its own id and the wildcard, a subscriber
    the ids asked for or the wildcard. The wildcard is a hot key, so the join is salted by
    subscriber. Subscribers without any signal simply have no row.
    """
    asked = F.array_distinct(F.transform("pairs", lambda p: names.series_of_pair(p)))
    wanted = due_rows.withColumn(
        "_ask", F.explode(F.when(F.size("pairs") == 0, F.array(F.lit(EVERY_PAIR))).otherwise(asked))
    )
    offered = latest.select(
        "series_id",
        F.col("obs_date").alias("signal_date"),
        "p_up_logreg",
        "action_logreg",
        F.explode(F.array("series_id", F.lit(EVERY_PAIR))).alias("_ask"),
    )
    label, p = F.col("action_logreg"), F.col("p_up_logreg")
    return salted_join(wanted, offered, ["_ask"], "id").select(
        "run_date",
        "id",
        "series_id",
        names.series_label(F.col("series_id")).alias("pair_label"),
        "signal_date",
        signals.signal_word(label).alias("signal"),
        signals.confidence_word(p, label).alias("confidence_word"),
        percent_text(p).alias("probability"),
        dates.readable_date(F.col("run_date")).alias("run_date_text"),
    )
