"""Exact dedup by content sort.

Sampled splitters cut the rows into ranges of (content, id), each range is sorted externally, and each
row is compared in full with its neighbour. Equal texts then form one *run* of neighbouring rows, which
may go on over several ranges: a group of copies of any size is cut by id and spread over tasks like
any other rows. What continues over a boundary is settled on one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.llm.common import keep_rows, row_hash, table, with_even_space
from signalframe.session import durable, task_slots

#: Leading characters of a text in its sort key. The digest after them keeps the key short and equal
#: texts adjacent, so splitters stay small however long the texts are.
HEAD = 32


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, _h (hash of the raw text).

    Texts are equal when they are identical after each run of white space became one space; nothing is
    trimmed. Null counts as empty, so null and empty texts are copies of each other. The row with the
    smallest id stays; a null id is larger than any other. Of rows with the same text and id exactly one
    stays. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    raw = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"))
    rows = with_even_space(raw.withColumn("_h", row_hash(F.col("_raw"))), "_raw", "_t").drop("_raw")
    rows = rows.withColumn("_sha", F.unhex(F.sha2("_t", 256)))
    key = [F.substring("_t", 1, HEAD), F.col("_sha"), F.col("_id").asc_nulls_last()]
    ranges = rows.repartitionByRange(task_slots(docs.sparkSession), *key).withColumn("_p", F.spark_partition_id())

    # One group of this window is one range. The text stands behind its digest: rows of one digest that
    # differ would still be compared, and told apart, in full.
    w = Window.partitionBy("_p").orderBy(*key[:2], "_t", key[2], "_h")
    first = F.lag(F.lit(True)).over(w).isNull()
    runs = (
        ranges.withColumn("_first", first)
        .withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
        .withColumn("_start", ~F.col("_t").eqNullSafe(F.lag("_t").over(w)) | F.col("_first"))
        .withColumn("_run", F.sum(F.col("_start").cast("long")).over(w))
        .withColumn("_keep", F.last(F.when(F.col("_start"), F.struct("_id")), ignorenulls=True).over(w))
        .select(
            "_id", "_h", "_sha", "_p", "_run", "_keep", "_start",
            F.when(F.col("_first"), F.col("_t")).alias("_head"),
            F.when(F.col("_last"), F.col("_t")).alias("_tail"),
        )
        .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("_p", "_run")))
    )
    runs = durable(runs)

    # At most one row per range from here to the join: the digests of its first and last text, and its first and last run.
    digest = lambda text: F.max(F.when(F.col(text).isNotNull(), F.struct("_sha", F.octet_length(text).alias("_long"))))
    edges = runs.groupBy("_p").agg(
        F.max("_run").alias("_runs"),
        digest("_head").alias("_first_of"),
        digest("_tail").alias("_last_of"),
        F.min_by("_size", "_run").alias("_size_1"),
        F.max_by("_size", "_run").alias("_size_n"),
        F.max_by("_keep", "_run").alias("_keep_n"),
    )
    by_range = Window.orderBy("_p")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_q", F.when(F.col("_first_of") == F.lag("_last_of").over(by_range), F.lag("_p").over(by_range)))
    # Texts are fetched for neighbours whose digests agree only, each pair to a task of its own, and compared in full.
    agree = edges.filter("_q is not null").select("_p", "_q")
    heads = runs.filter("_head is not null").select("_p", "_head")
    tails = runs.filter("_tail is not null").select(F.col("_p").alias("_q"), "_tail")
    same = agree.join(heads, "_p").join(tails, "_q").select("_p", (F.col("_head") == F.col("_tail")).alias("_same"))
    edges = durable(edges.drop("_q", "_first_of", "_last_of").join(same, "_p", "left").withColumn("_on", F.coalesce("_same", F.lit(False))))
    begins = (F.col("_runs") > 1) | ~F.col("_on")  # the range's last run begins in it
    edges = edges.withColumn("_origin", F.last(F.when(begins, F.col("_p")), ignorenulls=True).over(before))
    parts = edges.filter(begins).select(F.col("_p").alias("_o"), F.col("_size_n").alias("_s"), "_keep_n").unionByName(
        edges.filter("_on").select(F.col("_origin").alias("_o"), F.col("_size_1").alias("_s"), F.lit(None).cast(edges.schema["_keep_n"].dataType).alias("_keep_n"))
    )
    whole = parts.groupBy("_o").agg(F.sum("_s").alias("_total"), F.first("_keep_n", ignorenulls=True).alias("_root"))
    ends = (
        edges.filter("_on").select(F.col("_origin").alias("_o"), F.col("_p").alias("_q"), F.lit(1).cast("long").alias("_r"), F.lit(True).alias("_cont"))
        .unionByName(edges.filter(begins).select(F.col("_p").alias("_o"), F.col("_p").alias("_q"), F.col("_runs").alias("_r"), F.lit(False).alias("_cont")))
        .join(whole, "_o")
        .drop("_o")
    )
    # Two rows per range at most, so the broadcast is bounded by the number of partitions.
    return (
        runs.join(F.broadcast(ends), (F.col("_p") == F.col("_q")) & (F.col("_run") == F.col("_r")), "left")
        .select(
            F.col("_id").alias("doc_id"),
            F.coalesce("_root", "_keep").getField("_id").alias("keep_id"),
            F.coalesce("_total", "_size").alias("group_size"),
            (F.col("_start") & ~F.coalesce("_cont", F.lit(False))).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
            "_h",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies, all columns kept; which row stays is told by ``exact_duplicates``."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), "_h")
    return keep_rows(docs, kept, id_col, text_col)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).drop("_h")


OP10_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by t order by doc_id) = 1 as kept, sha256(t) as text_sha256
from t window g as (partition by t)
"""
