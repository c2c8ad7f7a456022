"""From raw documents to packed training sequences: toxicity, quality, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemforge.llm import mixing, near_dup, packing, quality, toxicity
from stemforge.llm.queries import TOKEN_LIMIT, table, tokenizer_file
from stemforge.llm.shared import written

ARROW_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts pass through Python in batches of so many bytes at most: the stages share workers, whose memory is little. run puts the
    session's own setting back once all stages are written."""
    spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scored_like(docs, machine, threshold=0.5) == 0)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scored_like(docs, model, threshold=0.3) == 1)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, alpha=0.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), TOKEN_LIMIT)


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near_dup", one_of_each), ("mixing", mixed), ("packing", packed)]
#: No SQL has the tokenizer or the models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written in the shared folder and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(ARROW_SETTING)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(ARROW_SETTING, before)
    return docs
