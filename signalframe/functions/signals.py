"""Labels, threshold policies and confidence scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slack on the policy boundary, so that 1 - 0.55 still counts as 0.45.
BOUNDARY_SLACK = 1e-10


def check_threshold(t: float) -> None:
    if not 0.5 < t < 1.0:
        raise ValueError("threshold must lie strictly between 0.5 and 1")


def decision(p: Column, t: float, slack: float = BOUNDARY_SLACK) -> Column:
    """UP, DOWN or SIDEWAYS; null for a null probability. UP wins where both hold."""
    check_threshold(t)
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p >= t - slack, "UP")
        .when(p <= (1.0 - t) + slack, "DOWN")
        .otherwise("SIDEWAYS")
    )


def action(p: Column, t: float) -> Column:
    """The older labels: the same bands without slack."""
    return decision(p, t, slack=0.0)


def side(p: Column, t: float) -> Column:
    """+1, 0 or -1 without slack."""
    return F.when(p >= t, 1).when(p <= 1.0 - t, -1).otherwise(0)


def band_confidence(p: Column, t: float) -> Column:
    """Distance past the band, rescaled to 0..1; 0 inside it."""
    label = decision(p, t)
    past = F.when(label == "UP", (p - t) / (1.0 - t)).when(label == "DOWN", ((1.0 - t) - p) / (1.0 - t)).otherwise(0.0)
    return F.when(p.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(past, F.lit(0.0)), F.lit(1.0)))


def plain_confidence(p: Column) -> Column:
    """The probability of the likelier side."""
    return F.greatest(p, 1.0 - p)


def served_confidence(p: Column, t: float = 0.6) -> Column:
    """The probability of the side acted on; 0 inside the band or for no probability."""
    return F.when(p >= t, p).when(p <= 1 - t, 1 - p).otherwise(0.0)


def confidence_word(p: Column, label: Column) -> Column:
    """High, Moderate or Low by distance from a coin flip; Low for a neutral label."""
    score = F.abs(p - 0.5) * 2
    graded = F.when(score >= 0.4, "High").when(score >= 0.2, "Moderate").otherwise("Low")
    return F.when(is_neutral(label), "Low").otherwise(graded)


def is_neutral(label: Column) -> Column:
    """Neither UP nor DOWN: SIDEWAYS, HOLD, ABSTAIN, unknown or missing."""
    return ~F.coalesce(normal_label(label).isin("UP", "DOWN"), F.lit(False))


def normal_label(label: Column) -> Column:
    """Upper case, trimmed, with the old ABSTAIN read as SIDEWAYS."""
    text = F.trim(F.upper(label))
    return F.when(text == "ABSTAIN", "SIDEWAYS").otherwise(text)


def direction(label: Column) -> Column:
    """UP and DOWN as they are, everything else (also null) SIDEWAYS."""
    return F.when(F.upper(label).isin("UP", "DOWN"), F.upper(label)).otherwise("SIDEWAYS")


def api_direction(label: Column) -> Column:
    """As ``direction`` with the older name of the neutral side."""
    return F.when(F.upper(label).isin("UP", "DOWN"), F.upper(label)).otherwise("ABSTAIN")


def display_direction(label: Column) -> Column:
    return F.when(label == "UP", "BULLISH").when(label == "DOWN", "BEARISH").otherwise("SIDEWAYS")


def signal_word(label: Column) -> Column:
    """Bullish, Bearish or Neutral."""
    return F.when(is_neutral(label), "Neutral").when(normal_label(label) == "UP", "Bullish").otherwise("Bearish")


def primary_probability(logreg: Column, tree: Column, raw: Column | None = None) -> Column:
    """The first model that has a value: logistic, then the older raw column, then tree."""
    return F.coalesce(logreg, *([raw] if raw is not None else []), tree)


def resolved_decision(given: Column, p: Column, t: float) -> Column:
    """The given decision if there is one, else the policy's."""
    text = F.nullif(F.trim(given), F.lit(""))
    return F.coalesce(normal_label(text), decision(p, t))


def served_direction(given: Column, acted: Column, p: Column, t: float = 0.6) -> Column:
    """Direction to show: from the decision, else the action, else the probability."""
    from_p = decision(F.coalesce(p, F.lit(0.5)), t, slack=0.0)
    return (
        F.when(given.isNotNull(), direction(given))
        .when(acted.isNotNull() & (acted != ""), direction(acted))
        .otherwise(from_p)
    )
