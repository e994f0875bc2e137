"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import oracles
from crestline.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public tokenizer file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.edit_fingerprints import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.mixing import mix_schedule

    return mix_schedule(table(spark, sf_dir, "documents"))


def op3_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.sharding import interleaved_shards

    return interleaved_shards(table(spark, sf_dir, "documents"), shards=16)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.license_scan import scan_licences

    return scan_licences(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.language_id import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.url_filters import default_log, filter_urls

    fetched = F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id, 366) AS INT))")
    told = filter_urls(table(spark, sf_dir, "pages"), default_log(spark), fetched)
    return told.withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op9_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.gru_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_block_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.chat_windows import conversation_digests, format_windows, read_windows

    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select(probe.columns).unionByName(probe)
    return conversation_digests(read_windows(format_windows(chats, tokenizer_path())))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crestline.llm.fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(text, 256)}
    return out.withColumns(digests).drop("output")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_edit_embedding,
            op2_temperature_mixing,
            op3_stratified_interleaving,
            op4_license_scan,
            op5_language_id,
            op6_sorted_projections,
            op7_simhash_covering,
            op8_url_temporal_lists,
            op9_gru_scoring,
            op10_linear_grouping,
            op11_block_lanczos,
            op12_budgeted_windows,
            op13_fill_in_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}
