"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, line_crf, minhash, mixing, periodic_runs, pii, prefix_trie, quality_gam, toxicity, vantage, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


@query("op5_minhash_dedup")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, threshold=80)


@query("op9_quality_gam")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, read(spark, sf_dir, "labels")))


@query("op3_toxic_segments")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return out.drop("passages")


@query("op4_byte_cnn_language")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@query("op10_line_crf")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = line_crf.judge(docs, line_crf.train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query("op8_qgram_decontamination")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op2_curriculum_mix")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.deal(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"), "positions")


@query("op7_content_warc", warc.ORACLE)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


@query("op6_pii_bootstrap")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


@query("op1_chat_windows")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.write_and_read(spark, chat.with_probe(read(spark, sf_dir, "conversations")))


@query("op11_vantage_simhash")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.near_duplicates(read(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.ORACLE)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), rebuild=True)


@query("op13_periodic_runs")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.runs(read(spark, sf_dir, "documents"), rewrite=True))
