"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``k`` smallest different XXH64 of a text's five-word shingles. The sketch of a
union is the bottom k of the sketches' union, so sketches of parts merge; from sketches alone follow
estimates of resemblance, containment and the number of different shingles. Expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.llm.common import row_hash, table, with_even_space
from signalframe.operators.windows import exact_rank

K, SHINGLE = 128, 5
NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other


def with_sketch(df: DataFrame, text_col: str, out: str = "sketch", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` and the sketch of ``text_col`` as ``out``.

    Words lie between white space and are taken unchanged; null and empty texts have an empty sketch. Fewer words
    than a shingle are one shingle.
    """
    words = F.array_remove(F.split("_even", " "), "")

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1)))
        each = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(each)), 1, k)).otherwise(F.array().cast("array<bigint>"))

    # The one-element array gives the words a name inside the expression, so that they are split once.
    made = F.get(F.transform(F.array(words), hashes), F.lit(0))
    return with_even_space(df, text_col, "_even").withColumn(out, made).drop("_even")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both; 1 for two empty sketches."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below ``k``."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``; 1 where ``a`` has none."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per ``keys`` from any number of parts.

    Parts are taken apart into hashes, repeats go and all but the k smallest of a key are dropped in each task before the
    shuffle (Spark's group limit), so a key with very many parts sends k hashes per task. A key whose sketches are all empty
    or null has an empty sketch.
    """
    hashes = parts.select(*keys, F.explode_outer(sketch).alias("_x")).distinct()
    smallest = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_last())
    return (
        hashes.withColumn("_n", F.row_number().over(smallest))
        .filter(F.col("_n") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_x")).alias(sketch))
    )


def as_text(sketch: Column) -> Column:
    """16 hex digits per hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, their likeness, and what follows from the sketches alone.

    n_shingles: estimated different shingles of the text; in_edited: the share of them estimated to be in the edited text;
    n_with_next: estimated different shingles of the text and the next document together, from their merged sketch.

    The edited text has the last quarter of its code points (rounded down) replaced by as many from the start of the
    next document, or all that it has; documents follow each other by id, then text hash, and the first comes after the
    last. Rows that repeat id and text are one document here and get equal results. A null id is larger than any
    other (and the same as the largest long). Null texts count as empty. An empty table gives an empty result; other columns
    are not read. Ids are longs.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), row_hash(F.col(text_col)).alias("_h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    keys = rows.select("_id", "_h", F.char_length("_text").cast("long").alias("_n")).distinct()
    ranked = exact_rank(keys, [F.col("_id"), F.col("_h")], (), "_rank")
    total = F.lit(max(ranked.count(), 1))
    before = ranked.select(
        F.col("_id").alias("_to_id"), F.col("_h").alias("_to_h"), F.floor(F.col("_n") / 4).cast("int").alias("_cut"),
        (F.col("_rank") % total + 1).alias("_rank"),
    )
    gives = ranked.join(before, "_rank").select("_id", "_h", "_to_id", "_to_h", "_cut")
    # Both sides read the same columns, so the documents are shuffled by key once; heads and sketches follow to the
    # document before.
    one = Window.partitionBy("_id", "_h").orderBy("_h")
    heads = rows.select("_id", "_h", "_text").join(gives, ["_id", "_h"]).withColumn("_one", F.row_number().over(one)).filter("_one = 1")
    heads = with_sketch(heads, "_text", "_next", k, shingle).select(
        F.col("_to_id").alias("_id"), F.col("_to_h").alias("_h"), F.left("_text", F.col("_cut")).alias("_head"), "_next"
    )
    joined = rows.select("_id", "_h", "_text").join(heads, ["_id", "_h"])
    n = F.char_length("_text")
    edited = joined.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.left("_text", n - F.floor(n / 4).cast("int")), "_head"))
    edited = with_sketch(with_sketch(edited, "_text", "_own", k, shingle), "_edited", "_new", k, shingle)
    return edited.select(
        F.nullif(F.col("_id"), F.lit(NO_ID)).alias("doc_id"), "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_new")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_new"), k).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_next"), k).alias("near_next"),
        distinct_shingles(F.col("_own"), k).alias("n_shingles"),
        containment(F.col("_own"), F.col("_new"), k).alias("in_edited"),
        distinct_shingles(merged(F.col("_own"), F.col("_next"), k), k).alias("n_with_next"),
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))
