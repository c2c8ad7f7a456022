"""One query per operator of this package, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.llm import chat, filter_audit, fingerprints, html_text, media, mixing, near_dup, oracles, packing, quality, spelling, token_counts, topk, toxicity
from stemforge.llm.shared import written

TOKEN_LIMIT = 4096


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), alpha=0.5, copy_col="copy", order_col="shuffle_key")
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written(token_counts.token_index(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), TOKEN_LIMIT), "prefix-index")
    whole = token_counts.prefix_tokens("prefix_index", F.lit(2**40))
    counted = index.select("doc_id", "n_bytes", whole.alias("n_tokens"), token_counts.prefix_within("prefix_index", F.lit(TOKEN_LIMIT)).alias("within_budget"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "within_budget")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")), threshold=0.5)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.conversation_calls(table(spark, sf_dir, "conversations"))
    linked = chat.link_tool_calls(calls, results, chat.TURN_TOOLS)
    return linked.select("conv_id", "call_id", "turn", "name", "level", "status", "line")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")), threshold=0.3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), TOKEN_LIMIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.damaged_words(table(spark, sf_dir, "documents"), every=199, least_length=6, least_count=5)
    return spelling.variant_groups(words, dominance=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dup, op2_mixing, op3_media, op4_token_counts, op5_toxicity, op6_topk, op7_chat, op8_html, op9_quality, op10_packing, op11_filter_audit, op12_fingerprints, op13_spelling, pipeline)}
ORACLE_SQL: dict[str, str] = {"op2_mixing": oracles.MIXING, "op6_topk": oracles.TOPK, "op7_chat": oracles.CHAT, "op11_filter_audit": oracles.FILTER_AUDIT}
