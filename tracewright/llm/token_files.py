"""Token-ID output: documents as Parquet lists of token ids, in ascending doc_id order, and selective reads of them.

Layout of a dataset: columns ``doc_id, part, local_start, n_tokens, ids``. ``part`` is the ordinal of the range of doc_ids
that one task wrote, ``local_start`` the number of ids before the document in its part. Ids are dictionary-encoded
(the vocabulary fits one dictionary page), the integer columns delta-encoded, row groups are small, and Parquet's page
index is written, so a reader can fetch the metadata columns alone, or the ids of a range of doc_ids, without reading
the rest.

Edge cases: a null or empty text has the end id alone; rows without doc_id are left out, as they have no place in the
order; rows that repeat a doc_id are all kept, next to each other; an empty table gives an empty dataset; further input
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import SLICE_BYTES, ByteEncoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"


def encode(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = 2) -> DataFrame:
    """Token ids of each whole text, ranges of doc_ids in order; ``end_id`` closes each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(tokenizer_file or common.tokenizer_path("byte_bpe_50k.json"))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of = batch.column("doc_id")
            for a, b, buf, offs in K.text_slices(batch.column("text"), SLICE_BYTES):
                ids, counts = encoder.encode(buf, offs)
                ids = np.insert(ids, np.cumsum(counts), np.int32(end_id))
                counts = counts + 1
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(counts.astype(np.int32)), K.row_lists(ids, counts, pa.int32())],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = common.id_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, SCHEMA)


def write(tokens: DataFrame, path: str, row_group_bytes: int = 8 << 20, page_bytes: int = 256 << 10) -> None:
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """Ids before each part, from the metadata columns alone; one row per part."""
    totals = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))


def digests(files: DataFrame) -> DataFrame:
    """Per document, from the files: where its ids start, how many they are, and the CRC-32 of them as little-endian 32-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offs = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    found = files.select("doc_id", "part", "local_start", "ids").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(part_starts(files))  # one row per written part
    return found.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or common.new_path(spark, "tokens")
    write(encode(docs), path)
    return digests(read(spark, path))
