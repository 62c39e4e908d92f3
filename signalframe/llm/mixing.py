"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, ``target / source_size``. Documents
are put in a fixed order, expected copies are summed up along it, one random offset is added per source, and a
document is emitted once for each whole number that its stretch of the sum crosses. The order rises by size to the
largest document and falls again: every stretch of neighbours carries its share of words, and what an offset
gains on the way up it loses on the way down, so the words taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.llm.common import row_hash, table, with_even_space, word_count
from signalframe.operators.windows import exact_rank, salted_join
from signalframe.session import durable, task_slots

#: Weights dealt to the sources in the order of their names, repeated.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST = 3
SEED = 7


def fraction(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source its weight, target, size and number of documents, from rows (source, size).

    All targets together are as large as all sources. A target above ``most`` times its source's size is
    cut to that, and the excess goes to the others by weight, until none is above. Sizes are combined
    before the shuffle, so what is sorted here has one row per source; each round of sharing sends
    two sums to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    named = sources.withColumn("_null", F.col("source").isNull())
    ranked = exact_rank(named, [F.col("_null"), F.col("source")], (), "_rank")
    dealt = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = durable(ranked.withColumn("weight", dealt.cast("long")).drop("_null", "_rank"))
    cap = F.col("source_size") * most
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, free = 0.0, -1
    while True:
        over = cap / F.col("weight") < F.lit(level)
        capped, left, n = ranked.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count(F.when(~over, 1)),
        ).first()
        if n == free or not left:
            break
        level, free = (total - capped) / left, n
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken, _h.

    ``size`` is the number of words, 0 for a null text. A null source is a source of its own, last in
    order. A source without words has target 0 and no copies. Equal rows stand next to each other in the
    order and may get different numbers of copies; ties are settled by MD5 of seed and id, then id, then
    text hash. Rerunning gives the same copies, whatever the partitioning. Other columns are not read.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_raw"))
    spaced = with_even_space(raw.withColumn("_h", row_hash(F.col("_raw"))), "_raw", "_t")
    rows = durable(spaced.select("doc_id", "source", word_count(F.col("_t")).alias("size"), "_h"))
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("size").desc(), F.col("_mixed"), F.col("doc_id").asc_nulls_last(), F.col("_h")]
    ranked = exact_rank(rows.withColumn("_mixed", mixed), order, ("source",), "_k").drop("_mixed")
    targets = source_targets(rows.select("source", "size"), weights, most).withColumn(
        "_u", fraction(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))
    )
    # A null source joins like any other.
    keyed = lambda df: df.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    joined = salted_join(keyed(ranked), keyed(targets).drop("source"), ["_s", "_n"], "_k", salts=task_slots(spark))
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    # Ranks by size 1, 2, 3, ... stand in the middle, right of it, left of it, ...
    middle = F.floor((F.col("documents") + 1) / 2)
    place = middle + F.floor(F.col("_k") / 2) * F.when(F.col("_k") % 2 == 0, 1).otherwise(-1)
    upto = lambda k: F.floor(k * rate + F.col("_u"))
    copies = F.coalesce(upto(place) - upto(place - 1), F.lit(0)).cast("long")
    return joined.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_h"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Every row of ``docs`` as many times as the mix takes it, all columns kept.

    Rows that repeat id and text share one plan: the copies of all of them are summed up and emitted
    from one row.
    """
    plan = (
        mix_plan(docs, id_col, text_col, **settings)
        .groupBy(F.col("doc_id").alias("_id"), "_h")
        .agg(F.sum("copies").cast("int").alias("_copies"))
        .filter("_copies > 0")
    )
    # All columns of a row travel as one, so that none clashes with the key.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id0"), row_hash(F.col(text_col)).alias("_h0"))
    same = F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_h0") == F.col("_h"))
    one = Window.partitionBy("_id", "_h").orderBy("_h")
    return (
        keyed.join(plan, same)
        .withColumn("_n", F.row_number().over(one))
        .filter("_n = 1")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
),
s as (
  select source, cast(sum(size) as bigint) as source_size, count(*) as documents,
         list_element([5, 2, 1], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)) as weight
  from d group by source
),
o as (  -- sources by the level at which they are full
  select *, coalesce(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding), 0) as full_before,
         sum(weight) over (w rows between current row and unbounded following) as weight_left,
         (select sum(source_size) from s) as total
  from s window w as (order by 3 * source_size / weight, source nulls last)
),
l as (  -- the first source that is not full gives the level
  select min_by((total - full_before) / weight_left, 3 * source_size / weight) as level
  from o where (total - full_before) / weight_left <= 3 * source_size / weight
),
t as (
  select source, source_size, documents, least(cast(3 * source_size as double), weight * level) as target,
         cast(('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8)) as bigint) / 4294967296.0 as u
  from s, l
),
r as (
  select d.doc_id, d.size, t.source_size, t.target, t.u, t.documents, t.target / nullif(t.source_size, 0) as rate,
         row_number() over (partition by d.source order by d.size desc, md5('7:' || d.doc_id), d.doc_id) as n
  from d join t on d.source is not distinct from t.source
),
k as (  -- the largest in the middle, the next ones right and left of it in turn
  select *, (documents + 1) // 2 + (n // 2) * case when n % 2 = 0 then 1 else -1 end as k from r
)
select doc_id, size, source_size, target,
       cast(coalesce(floor(k * rate + u) - floor((k - 1) * rate + u), 0) as bigint) * size as taken
from k
"""
