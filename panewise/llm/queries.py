"""The registered queries of this subpackage, each over a whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panewise.llm import classifier, conversations, html_text, mixing, neighbours, periodic, pieces, pii, quality, simhash, token_counts, url_lists, warc


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over archives of all pages that were damaged by a rule."""
    return warc.salvaged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_lists.judge(url_lists.dated(pages), url_lists.drawn_list(pages))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(*conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic(periodic.planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_text": op5_html_text,
    "op6_neighbours": op6_neighbours,
    "op7_url_lists": op7_url_lists,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_conversations": op11_conversations,
    "op12_classifier": op12_classifier,
    "op13_periodic": op13_periodic,
    "warc_salvage": warc_salvage,
}

SQL: dict[str, str] = {
    "op2_quality_rules": quality.ASSESS_SQL,
    "op7_url_lists": url_lists.JUDGE_SQL,
    "op8_mixing": mixing.SCHEDULE_SQL,
    "op9_warc": warc.ROUND_TRIP_SQL,
    "op11_conversations": conversations.REPAIR_SQL,
    "op13_periodic": periodic.PERIODIC_SQL,
    "warc_salvage": warc.SALVAGED_SQL,
}
