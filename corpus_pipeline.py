"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on what the one before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.mixing import WORD, mix_sources, mixed_documents
from linkloom.llm.ngram_join import ngram_join
from linkloom.llm.packing import pack
from linkloom.llm.queries import tokenizer_path
from linkloom.llm.substring_dedup import substring_dedup
from linkloom.llm.toxicity import toxicity_scores, train
from linkloom.session import Scratch, temporary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from the labelled ones.

    A null or empty text has no words and is scored as such; a very long one is scored whole. Null ids and repeated rows are
    judged by their text like any other; an empty table, or no labels, lets everything through. All columns are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    scored = toxicity_scores(docs.withColumnRenamed("score", "__score"), train(docs, labels)).where("score < 0.5").drop("score")
    return scored.withColumnRenamed("__score", "score").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that of the smallest id (a null one last), then of the smallest hash of the text.

    Rows of one id are compared each by its own text; of rows that repeat id and text one stays. Null and blank texts are no
    copies of anything and all stay, repeated or not. A very long text is compared whole. Other columns are kept as they are, an
    empty table stays empty.
    """
    joined = ngram_join(docs, count_links=False)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = joined.where("n_shingles > 0").groupBy("group").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    blank = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0
    hashed = docs.withColumn("__text", F.xxhash64("text"))
    kept = hashed.where(~blank).join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).select(docs.columns).unionByName(docs.where(blank))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; texts that lose nothing stay as they are, and those left empty go.

    Null and blank texts hold no words and go with them. Null ids come after all others; rows that share an id are rows of their own, and
    rows that repeat id and text lose the same. A very long text is looked at whole. An empty table stays empty.
    """
    cut = substring_dedup(docs).where("kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, as documents: what is drawn twice comes twice, what is not drawn goes.

    A null source is a source of its own. Null and blank texts have no words to draw and go. Null ids, shared ids and repeated rows
    are documents of their own. A very long text may come in part. An empty table stays empty.
    """
    mixed = mixed_documents(docs, mix_sources(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece.

    A null or empty text is a piece of the end token; a very long one is cut. Null ids, shared ids and repeated rows are packed each
    for itself. An empty table has no pieces. Other columns are left behind.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_removal),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# SQL cannot express the first stage, whose trained model decides what the others see
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary():  # a stage's own scratch tables go once its rows are written
            docs = scratch.table(name, stage(spark, docs, sf_dir))
    return docs
