"""A training-data pipeline over ``documents``: quality, repeated lines, near duplicates, test leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as Parquet in the shared
folder and gives them to the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, line_dedup, minhash, quality, sentence_pieces


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other text; long ones whole; rows that repeat a doc_id each by their own text. Rows
    without doc_id are scored too. All columns stay, whatever their names; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and text and n_chars change accordingly; a document of which nothing is left goes too.

    Documents that lose no line keep all their columns as they are, null and empty texts included, and so do rows without doc_id, which
    have no place among the lines. Long texts are cut whole. Of equal lines the one at the smallest (doc_id, line) stays, so there are no
    ties. Rows that repeat a doc_id are cut at the same line numbers, and each keeps its own other columns. Columns may
    have any names.
    """
    cut = line_dedup.dedup_lines(docs, carry=True)
    left = cut.where((F.col("n_removed") == 0) | (F.trim(F.translate("kept_text", "\n", " ")) != ""))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    own = {f.name: F.col("row").getField(f.name) for f in docs.schema}
    kept = [F.when(changed, new[f.name].cast(f.dataType)).otherwise(own[f.name]).alias(f.name) if f.name in new else own[f.name].alias(f.name) for f in docs.schema]
    return left.select(*kept).union(docs.where(F.col("doc_id").isNull()))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: the smallest doc_id.

    Documents without words are near nothing and stay, as do rows without doc_id. Rows that repeat a doc_id are one document with the links
    of all its texts: they stay or go together. Long texts are compared whole; columns may have any names.
    """
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go.

    Null and empty texts hold none and stay; long ones are searched whole; rows that repeat a doc_id each by their own text. Columns may have any
    names; an empty table stays empty.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, and the text decoded from them: doc_id, n_pieces, ids_crc32, ids, decoded, round_trip.

    A null text counts as empty and has no pieces; long texts are encoded whole; repeated rows each have theirs; rows without
    doc_id are left out, as no result could name them.
    """
    found = sentence_pieces.decode(sentence_pieces.encode(docs))
    return found.select("doc_id", "n_pieces", "ids_crc32", "ids", "decoded", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # the classifier and the sketches have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
