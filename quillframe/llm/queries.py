"""The operators' queries over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anagrams, chat_format, decontaminate, html_text, line_dedup, near_dedup, packing, pii, quality, rules, url_filter, warc, word_tries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts are control strings.
_TRICKY = [(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.createDataFrame(_TRICKY, "conv_id long, turn long, role string, text string")
    return chat_format.digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.selectExpr("page_id", "url", "main_text as text", "cast(char_length(main_text) as long) as n_chars")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.selectExpr("doc_id", "__weight as log_weight", "__kept as kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op11_word_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tries.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anagrams.variants(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_packing, op3_near_dedup, op4_html_text, op5_url_filter, op6_quality_classifier, op7_pii, op8_decontaminate, op9_quality_rules, op10_line_dedup, op11_word_tries, op12_spelling_variants, op13_warc)}

ORACLE_SQL: dict[str, str] = {"op5_url_filter": url_filter.sql(), "op10_line_dedup": line_dedup.SQL, "op11_word_tries": word_tries.SQL, "op12_spelling_variants": anagrams.SQL, "op13_warc": warc.SQL}
