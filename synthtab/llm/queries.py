"""The registered queries of the text operators: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthtab.llm import (
    decontamination, exact_dedup, language, lexical_search, line_dedup, near_dup, packing, sharding, source_audit,
    substring_dedup, token_count, token_files, url_filter,
)
from synthtab.llm.common import fresh_path, ship

WORDS = "word_bpe_49k.json"
END_ID = 2
SHARDS = 40

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def vocabulary(name: str = WORDS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), vocabulary(), END_ID, path)
    return token_files.read_tokens(spark, path).drop("file_no")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.span_report(table(spark, folder, "documents"), extend=True)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"), exact_words=line_dedup.ANY_LINE)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"), vocabulary(), limit=2048)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(), END_ID, capacity=4096)


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"), URL_RULES)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op8_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_groups(table(spark, folder, "documents"), words=4, percent=80)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(~language.held_out()).select("lang", "text"))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    tree = sharding.even_tree(SHARDS)
    return sharding.shard_report(table(spark, folder, "documents"), tree, sharding.grown(tree))


def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.source_audit(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_substring_dedup, op3_line_dedup, op4_token_counts, op5_packing, op6_url_filter,
        op7_exact_dedup, op8_near_dup, op9_language, op10_decontamination, op11_lexical_search, op12_hash_tree_shards,
        op13_source_audit,
    )
}
