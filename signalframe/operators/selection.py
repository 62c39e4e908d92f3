"""The first k rows of a group by value, without sorting the group.

Values are counted by their leading bits; the bin that holds the k-th row is counted by its next bits, and so on until it is small. Rows in
higher bins are in, rows in lower ones are out, and only the rows of that bin are sorted, ties and all. Each step is one
map-side-combined count that sends the driver at most 2^BITS numbers per group and target.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalframe.operators.windows import exact_rank

#: Bits looked at per step, steps at most (doubles below 1 have no more that matter here), rows of a bin that are sorted.
BITS, STEPS, SETTLED = 12, 4, 50_000


@dataclass(frozen=True)
class Region:
    """The rows of a group whose value times ``scale``, rounded down, is ``bin``; ``above`` rows of the group have more."""

    group: tuple
    scale: float
    bin: int
    above: int


def _bin(value: Column, scale: float) -> Column:
    """Powers of two scale exactly. Null is the smallest."""
    return F.coalesce(F.floor(value * F.lit(scale)).cast("long"), F.lit(-1).cast("long"))


def _in_group(keys: tuple[str, ...], group: tuple) -> Column:
    same = F.lit(True)
    for k, v in zip(keys, group):
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return same


def regions(df: DataFrame, value: Column, targets: dict[tuple, list[int]], keys: tuple[str, ...], settled: int | None = None) -> dict[tuple, dict[int, Region]]:
    """Per group and target the region that holds the group's ``target``-th largest value.

    ``value`` is between 0 and 1. Targets below 1 or beyond the group have no region: none or all of its rows are taken. Groups and targets are few: they are a query's
    constants, not data.
    """
    settled = SETTLED if settled is None else settled
    found: dict[tuple, dict[int, Region]] = defaultdict(dict)
    # Where each open target is: (scale, bin, rows above).
    open_ = {(g, k): Region(g, 0.0, 0, 0) for g, ks in targets.items() for k in ks if k > 0}
    for step in range(STEPS):
        if not open_:
            break
        scale = 2.0 ** (BITS * (step + 1))
        wanted = F.lit(False)
        for r in set(open_.values()):
            inside = _in_group(keys, r.group)
            wanted = wanted | (inside & (_bin(value, r.scale) == r.bin) if r.scale else inside)
        counts = df.filter(wanted).select(*keys, _bin(value, scale).alias("_bin")).groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
        bins: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for r in counts.collect():
            bins[tuple(r[k] for k in keys)].append((r["_bin"], r["_n"]))
        for own in bins.values():
            own.sort(reverse=True)
        left = {}
        for (group, k), r in open_.items():
            above = r.above
            for b, n in bins[group]:
                if r.scale and (b >> BITS if b >= 0 else -1) != r.bin:
                    continue  # another target's bin
                if above + n >= k:
                    here = Region(group, scale, b, above)
                    if n <= settled or step == STEPS - 1 or b < 0:
                        found[group][k] = here
                    else:
                        left[group, k] = here
                    break
                above += n
        open_ = left
    return found


def with_levels(
    df: DataFrame, value: Column, ties: list[Column], targets: dict[tuple, list[int]], keys: tuple[str, ...], out: str = "level", settled: int | None = None
) -> DataFrame:
    """``df`` and as ``out`` how many of its group's targets do not reach the row: 0 for rows among the first ``targets[0]``.

    The first rows are those with the largest ``value``, then in the order of ``ties``. Targets of a group ascend. Rows of a group without
    targets get 0.
    """
    found = regions(df, value, targets, keys, settled)
    level = F.lit(0)
    region = F.lit(None).cast("int")
    rank_level = F.lit(0)
    listed: list[Region] = []
    for group, ks in targets.items():
        inside = _in_group(keys, group)
        beyond, by_rank = F.lit(0), F.lit(0)
        for k in ks:
            at = found[group].get(k)
            if at is not None:
                beyond = beyond + F.when(_bin(value, at.scale) > at.bin, 0).otherwise(1)
                if at not in listed:
                    listed.append(at)
            elif k < 1:
                beyond = beyond + 1
            by_rank = by_rank + F.when(F.col("_rank") <= k, 0).otherwise(1)
        level = F.when(inside, beyond).otherwise(level)
        rank_level = F.when(inside, by_rank).otherwise(rank_level)
    above = F.lit(0)
    for n, r in enumerate(listed):
        region = F.when(_in_group(keys, r.group) & (_bin(value, r.scale) == r.bin), n).otherwise(region)
        above = F.when(F.col("_region") == n, F.lit(r.above)).otherwise(above)
    tagged = df.withColumn("_region", region)
    sure = tagged.filter("_region is null").withColumn(out, level.cast("int")).drop("_region")
    if not listed:
        return sure
    edge = exact_rank(tagged.filter("_region is not null").withColumn("_value", value), [F.desc("_value"), *ties], (*keys, "_region"), "_rank")
    edge = edge.withColumn("_rank", F.col("_rank") + above).withColumn(out, rank_level.cast("int")).drop("_region", "_rank", "_value")
    return sure.unionByName(edge)
