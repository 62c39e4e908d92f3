"""Five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns
of ``docs``. ``run`` writes each result as Parquet in the shared folder and reads it again, which cuts
lineage: a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.bpe import encode
from signalframe.llm.common import table
from signalframe.llm.exact_dedup import exact_dedup
from signalframe.llm.language_crf import UNDETERMINED, identify, learn
from signalframe.llm.mixing import mix
from signalframe.llm.simhash import simhash_dedup
from signalframe.session import scratch_path

#: Documents whose words' labels have a lower mean probability than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words' languages are certain enough, be it one or several; all if there are no labels to learn from.

    The model is learned from this stage's own input.
    """
    model = learn(docs)
    if not model.languages:
        return docs
    # Columns go through under names that no output has.
    names = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    found = identify(rows, model, names["doc_id"], names["text"], ("lang_pred", "certainty"), tuple(names.values()))
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= LEAST_SCORE)
    return found.filter(sure).select(*(F.col(n).alias(c) for c, n in names.items()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: three-word shingles, two bits."""
    return simhash_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as many times as the mix of sources takes them."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text."""
    return encode(docs, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact), ("simhash_dedup", near), ("mix_sources", mixture), ("bpe_encode", tokens)]

#: A trained model, fingerprints by XXH64 and tokenizer merges have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
