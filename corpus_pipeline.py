"""A corpus pipeline of five stages; each works on all that its predecessor kept.

1. Quality classifier: documents that it rejects go.
2. N-gram Jaccard join: of each group of near copies the document with the least id stays.
3. Benchmark decontamination: contaminated documents go; passages in the others are replaced.
4. Secret scans: findings are replaced in the text.
5. Best-fit packing: what is left is packed into sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, near_duplicates, packing, quality, secrets
from flowloom.llm.common import columns, fresh, fresh_prefix, shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = fresh("__score", docs)
    model = quality.train(docs, quality.quality_labels(spark, sf_dir))
    return quality.score(docs, model, score).where(F.col(score) >= 0.5).select(*columns(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = fresh_prefix("__found_", docs)
    left = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), prefix=own)
    left = left.where(~F.col(f"{own}contaminated"))
    spans = F.col(f"{own}hit_spans")
    found = F.size(spans) > 0
    left = left.withColumn("text", F.when(found, decontaminate.without_spans(F.col("text"), spans)).otherwise(F.col("text")))
    return left.withColumn("n_chars", F.when(found & F.col("n_chars").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns(docs))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(docs, secrets.BlobLedger(spark))
    return found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.word_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", secrets_redacted),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
