"""Numeric helpers: guarded division, coercion, cleaning, scoring terms."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest probability a log is taken of: the double epsilon, as common scoring libraries do.
LOG_FLOOR = 2.220446049250313e-16


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def as_number(text: Column) -> Column:
    """A double, or null where the text is not a number."""
    return text.try_cast("double")


def clip(p: Column, floor: float = LOG_FLOOR) -> Column:
    return F.least(F.greatest(p, F.lit(floor)), F.lit(1.0 - floor))


def log_loss(y: Column, p: Column, floor: float = LOG_FLOOR) -> Column:
    q = clip(p, floor)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1.0 - q))


def squared_error(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def equal_edges(bins: int) -> list[float]:
    """Bin edges as the doubles a linear grid gives, so 0.3 falls where those doubles put it."""
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def count_reached(name: str, cuts: Iterable[float], test: str = ">=") -> Column:
    """How many cuts the column passes; a null passes none. One expression text, as ladders are long."""
    return F.expr(" + ".join(f"if({name} {test} {float(c)!r}D, 1, 0)" for c in cuts))


def probability_bin(name: str, bins: int) -> Column:
    """Equal-width bin of a probability column, left-closed; 1.0 belongs to the last bin."""
    return count_reached(name, equal_edges(bins)[1:-1])


def bucket_label(p: Column, edges: tuple[float, ...] = (0.0, 0.4, 0.45, 0.55, 0.6, 1.0)) -> Column:
    """Right-open probability buckets; the last edge itself is in none, though its label closes."""
    label = F.lit(None).cast("string")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        text = f"[{edges[i]:.2f},{edges[i + 1]:.2f}" + ("]" if i == last else ")")
        label = F.when((p >= edges[i]) & (p < edges[i + 1]), text).otherwise(label)
    return label


def percent_text(p: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(p * 100, digits), F.lit("%"))
