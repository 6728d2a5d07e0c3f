"""A training-data pipeline of five operators: quality rules, near-duplicates, PII, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read again as the next stage's docs. Rows are known by doc_id and a hash of
their text, so ids may be null, repeat, or stand for several texts. All stages but the last return the columns of documents, of whatever other names and types; the last returns each document of
the mix as token ids. Null texts have no words: the quality rules reject them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import jaccard_join, merge_replay, mixture, pii, quality
from touchline.llm.common import column, documents, prepare, scratch, small, unused


def keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text are among keys (doc_id, and text_key: the text's xxhash64)."""
    kept, key = unused(docs, "kept", "key")
    keys = small(keys.select(F.col("doc_id").alias(kept), F.col("text_key").alias(key)).distinct().checkpoint())
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(kept)) & (F.xxhash64("text") == F.col(key)), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep(docs, quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; of rows with the same id and text, the one whose other columns are the least (as JSON)."""
    chosen = jaccard_join.representatives(docs).checkpoint()
    kept = keep(docs, chosen.filter("NOT repeated"))
    if chosen.filter("repeated").isEmpty():
        return kept
    row = F.struct(*map(column, docs.columns))
    one = keep(docs, chosen.filter("repeated")).groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.mask(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixture.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens of each document of the mix."""
    return merge_replay.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mask_pii", mask_pii), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL can't express the log-likelihood ratio, the sketches or the merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
