"""The thin queries over the operators of this subpackage, and the SQL that some of them must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import collocations, common, decontaminate, html_text, language_model, line_dedup, minhash, oracle, quality, ranked_search, search, secret_scan, sentence_pieces, suffix_dedup, token_files

ORACLE_SQL = {
    "op1_suffix_dedup": oracle.OP1,
    "op2_minhash": oracle.OP2,
    "op4_line_dedup": oracle.OP4,
    "op5_topk_search": oracle.OP5,
    "op12_phrase_mining": oracle.OP12,
    "op13_ranked_search": oracle.OP13,
}


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(spark, common.documents(spark, sf_dir))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir), length=100).drop("kept_text")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir), k=3, percent=85)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(common.documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(common.documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.more_like_this(common.documents(spark, sf_dir))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return found.select("page_id", F.char_length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(common.documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(common.documents(spark, sf_dir)))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(common.documents(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash": op2_minhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_line_dedup": op4_line_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_quality": op6_quality,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_output": op8_token_output,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_secret_scan": op11_secret_scan,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_ranked_search": op13_ranked_search,
}
