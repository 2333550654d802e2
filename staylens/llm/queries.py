"""The registered queries of this package: each applies one operator, with production parameters,
to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import table
from staylens.llm.oracles import ORACLE_SQL  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.repeated_passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).drop("score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.licenses import scan_licenses

    total = F.aggregate("matches", F.lit(0).cast("long"), lambda a, n: a + n)
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", F.concat_ws(";", "licenses").alias("licenses"), total.alias("n_matches"), F.size("sentence_ids").alias("n_sentences"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.topk import top_k_queries

    return top_k_queries(table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.bpe import codec_digests

    return codec_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.conversations import damage, repair_conversations

    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.spelling import DAMAGE, spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"), damage=DAMAGE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_pack_documents, op3_near_duplicates, op4_repeated_passages, op5_url_filter, op6_quality,
        op7_licenses, op8_top_k, op9_mix_sources, op10_page_text, op11_bpe_codec, op12_conversation_repair,
        op13_spelling_groups)}
