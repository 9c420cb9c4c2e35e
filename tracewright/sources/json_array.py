"""Large JSON arrays read in parallel: byte ranges are parsed before it is known what they begin in.

Spark's text reader cuts a file into ranges and, with ``}`` as the line separator, into chunks. Whether a range begins inside a
string and how deep it begins depends on all ranges before it, so each range is read for both cases at once: the number of quotes
tells how a range changes the first, and its brackets how it changes the second if it begins outside or inside a string. These
are a few numbers a range; running sums over a file's ranges give each range's true start. In a second pass every range cuts
elements where the depth is 1. Elements that lie in one range go on from there; only the pieces of those that cross an edge
meet by a shuffle. No step holds more than a chunk and the element being read, and files may be in any store that Spark reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.shared import checkpointed

_MARK = re.compile(rb'\\.|["{}\[\],]', re.DOTALL)
_PACKED = ("gz", "bz2", "zst", "snappy", "lz4", "deflate")


def _chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, at (start of the range), size (of the file) and body (bytes up to a ``}``) in the order of the file within each range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("body"))


RANGE = "file string, at long, size long, n_bytes long, quotes long, deeper_out long, deeper_in long"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range, whatever it begins in."""
    now = None
    for batch in batches:
        for file, at, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[:2] != [file, at]:
                if now is not None:
                    yield _row(now)
                now = [file, at, size, 0, 0, 0, 0]
            body += b"}"
            now[3] += len(body)
            inside = now[4] % 2  # if the range began outside a string
            for m in _MARK.finditer(body):
                mark = m.group()
                if mark == b'"':
                    now[4] += 1
                    inside = 1 - inside
                elif mark in b"[{":
                    now[5 + inside] += 1
                elif mark in b"]}":
                    now[5 + inside] -= 1
    if now is not None:
        yield _row(now)


def _row(values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[f.split()[0] for f in RANGE.split(", ")])


PIECE = "file string, at long, nth long, first boolean, last boolean, final boolean, piece string"
_LOT = 512  # elements that are sent on together
MOST_RANGES = 100_000  # starts of ranges that are broadcast (about 10 MB); above, chunks meet them by a shuffle


def _with_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, at, depth, inside, body): bodies with the separators that they had in the file."""
    held = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None:
                ended = held[4] and held[:2] != row[:2]
                yield *held[:4], held[5] if ended else held[5] + b"}"
            held = row
    if held is not None:
        yield *held[:4], held[5] if held[4] else held[5] + b"}"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and parts of elements of each range: ``first`` if the element begins there, ``last`` if it ends there, ``final``
    if the array ends with it."""
    held: list[tuple] = []
    key, depth, inside, nth, begun, parts = None, 0, False, 0, False, []

    def put(last: bool, final: bool) -> None:
        nonlocal nth, parts
        held.append((*key, nth, begun, last, final, b"".join(parts).decode("utf-8", "replace")))
        nth, parts = nth + 1, []

    def lot() -> pa.RecordBatch:
        columns = [pa.array(c) for c in zip(*held, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PIECE.split(", ")])

    for file, at, start_depth, start_inside, body in _with_ends(batches):
        if key != (file, at):
            if parts:
                put(False, False)
            key, depth, inside, nth, begun, parts = (file, at), start_depth, start_inside, 0, False, []
        done = 0
        for m in _MARK.finditer(body):
            mark = m.group()
            if mark == b'"':
                inside = not inside
            elif inside or mark[:1] == b"\\":
                continue
            elif mark in b"[{":
                depth += 1
                if depth == 1:
                    if mark == b"{":
                        raise ValueError(f"not a JSON array: {file}")
                    done, begun = m.end(), True
            else:
                if depth == 1:  # the element ends at a comma or with the array
                    parts.append(body[done : m.start()])
                    put(True, mark != b",")
                    done, begun = m.end(), True
                if mark != b",":
                    depth = max(depth - 1, 0)
        if depth > 0:
            parts.append(body[done:])
        if len(held) >= _LOT:
            yield lot()
    if parts:
        put(False, False)
    if held:
        yield lot()


def reads(text: Column, alone: str = "r") -> Column:
    """Whether a text is one JSON value and nothing more: Spark's parser stops at a value's end, so the text is put where
    more would break the rest."""
    mark = f"mark-{uuid.uuid4().hex}"
    framed = F.try_parse_json(F.concat(F.lit(f'{{"{alone}":'), text, F.lit(f',"{mark}":0}}'))).cast("map<string, variant>")
    return F.coalesce(text.isNotNull() & (F.size(framed) == 2) & F.map_contains_key(framed, mark), F.lit(False))


def ranges_of(chunks: DataFrame) -> DataFrame:
    """file, at, depth, inside, bare: what each range begins in, and whether its last chunk had no separator."""
    ranges = chunks.mapInArrow(_ranges, RANGE)
    packed = F.regexp_extract("file", r"\.([a-z0-9]+)$", 1).isin(*_PACKED)
    ranges = ranges.withColumn("at", F.when(packed, F.raise_error(F.concat(F.lit("a packed file cannot be read in ranges: "), "file"))).otherwise(F.col("at")))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    parted = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    parted = parted.withColumn("deeper", F.when(F.col("inside"), F.col("deeper_in")).otherwise(F.col("deeper_out")))
    # Whether a file's last chunk had a separator follows from the bytes of all of them.
    bare = (F.sum("n_bytes").over(every) > F.col("size")) & (F.max("at").over(every) == F.col("at"))
    return parted.select("file", "at", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"), "inside", bare.alias("bare"))


def read_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, at, nth, record: the elements of the JSON arrays in ``path``, each as its JSON text; (at, nth) is their order in a file.

    A file that is cut off keeps all whole elements before the cut, and loses the one that is cut. Any other element that does not read is an
    error, and so is a document that is no array; ``json_io.read_records`` tells documents apart. Blank and empty files and
    empty arrays have no elements; what follows an array's end is left out unless it is another array.
    """
    chunks = _chunks(spark, path)
    starts = checkpointed(ranges_of(chunks))
    if starts.count() <= MOST_RANGES:
        met = chunks.join(F.broadcast(starts), ["file", "at"])  # keeps the chunks' order
    else:
        met = chunks.withColumn("turn", F.monotonically_increasing_id()).join(starts, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "turn")
    pieces = met.select("file", "at", "depth", "inside", "bare", "body").mapInArrow(_pieces, PIECE)
    pieces = pieces.withColumn("whole", F.col("first") & F.col("last"))
    # Parts of elements that cross edges: each belongs to the last one before it that begins an element.
    ordered = Window.partitionBy("file").orderBy("at", "nth")
    begin = F.last(F.when(F.col("first"), F.struct("at", "nth")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    parts = pieces.where("not whole").withColumn("begin", begin).groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("at", "nth", "piece"))).alias("parts"), F.bool_or("last").alias("last"), F.bool_or("final").alias("final"))
    joined = parts.select("file", "begin.at", "begin.nth", "final", "last", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("piece"))
    # A last element without its comma or bracket counts if it ends by itself; of a number one can't tell.
    crossing = joined.where(F.col("last") | (F.col("piece").rlike(r'^\s*[\[{"]') & reads(F.col("piece")))).drop("last")
    every = pieces.where("whole").select("file", "at", "nth", "final", "piece").union(crossing)
    blank = (F.trim(F.translate("piece", "\t\r\n", "   ")) == "") & F.col("final")
    fails = F.raise_error(F.concat(F.lit("JSON array does not read whole: "), "file", F.lit(": "), F.left("piece", F.lit(80))))
    return every.where(~blank).select("file", "at", "nth", F.when(reads(F.col("piece")), F.regexp_replace("piece", r"^\s+|\s+$", "")).otherwise(fails).alias("record"))
