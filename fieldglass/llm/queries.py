"""The queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm.alignment import op12
from fieldglass.llm.common import table
from fieldglass.llm.compression import op9
from fieldglass.llm.langid import op13
from fieldglass.llm.lines import op10
from fieldglass.llm.media import op1
from fieldglass.llm.mixing import op3
from fieldglass.llm.near import op4
from fieldglass.llm.oracle import ORACLE
from fieldglass.llm.packing import op6
from fieldglass.llm.repeats import op7
from fieldglass.llm.rules import op8
from fieldglass.llm.secrets import op2
from fieldglass.llm.trie import op11
from fieldglass.llm.warc import op5


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(table(spark, sf_dir, "documents"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5(table(spark, sf_dir, "pages"))


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2(table(spark, sf_dir, "documents"))


def op10_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4(table(spark, sf_dir, "documents"))


def op7_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11(table(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interleaved_media": op1_interleaved_media,
    "op2_secret_scan": op2_secret_scan,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_recompression_dedup": op7_recompression_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_compression_quality": op9_compression_quality,
    "op10_line_alignment": op10_line_alignment,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_language_id": op13_language_id,
}
