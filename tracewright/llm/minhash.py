"""Near-duplicate documents by SetSketch registers (Ertl, 2021), confirmed on full shingle sets.

A document's set holds its distinct word shingles. Each register keeps the truncated, exponentially spaced minimum of
one hash over the set, so sketches of parts merge by the maximum of each register. Runs of registers are the bands of
a locality-sensitive index; for each candidate pair the similarity is estimated jointly from how many registers are
greater, less or equal (maximum likelihood, with the set sizes known), and pairs that can reach the threshold are
confirmed on their full sets. There are as many bands as leave a pair at the threshold without a shared bucket once in a
million.

No group is expanded into all its pairs. Equal sets are one class. Each class is first compared with one pivot, the
most typical member of its buckets (the one whose buckets are fullest), and what is confirmed is joined to components.
Of the rest, only members of one bucket in different components matter. They meet in blocks: members of a bucket, split
into chunks, against chunks of those outside the bucket's largest component, dealt by bucket and part of it. Inside a
task a pair is judged in the first bucket that it shares, by a bitmap of each set, which bounds the intersection from
above, and by the joint estimate; only pairs that pass leave the task, to be confirmed. So every pair that shares a
bucket is judged once and one round is enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.components import components

PER_BAND = 6
MISSED = 1e-6
BITS = 8192  # of the bitmap of a set
CHUNK, PART = 64, 16  # members of a bucket in a chunk on average, chunks of a bucket in a part
HOT_CLASSES, HOT_ROWS = 100_000, 1_000  # a class of copies is hot if it holds over one row in HOT_CLASSES and HOT_ROWS more
MOST = 512  # registers that have a hash
BASE, RATE, TOP = 1.02, 20.0, 32766  # spacing of the registers, rate of their exponentials, largest value
_SALT = np.random.default_rng(7).integers(1, 1 << 62, MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def n_bands(percent: int) -> int:
    return min(MOST // PER_BAND, math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** PER_BAND)))


def registers(values: np.ndarray, firsts: np.ndarray, count: int) -> np.ndarray:
    """Registers of consecutive non-empty sets; ``firsts`` are the places where the sets begin. One row per set."""
    out = np.empty((len(firsts), count), np.int16)
    scale = 2.0**-64
    for i in range(count):
        least = np.minimum.reduceat(values * _SALT[i], firsts)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) * scale) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    bands = regs.shape[1] // PER_BAND
    keys = np.tile(K.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(regs), 1))
    for j in range(PER_BAND):
        keys = K.mix(keys * np.uint64(0xD1342543DE82EF95) + regs[:, j::PER_BAND].astype(np.uint64))
    return keys


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Maximum-likelihood similarity of each pair from its register comparisons and set sizes, on a grid."""
    more, less = (regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1)
    same = regs_a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best, out = np.full(len(u), -np.inf), np.zeros(len(u))
    chance = lambda x: np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12)
    for s in range(steps + 1):
        j = most * s / steps
        up, down = chance(u - v * j), chance(v - u * j)
        score = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        out = np.where(score > best, j, out)
        best = np.maximum(best, score)
    return out


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, _, _, firsts = K.word_hashes(buf, offs)
    ends = firsts.tolist()
    return [np.unique(K.shingles(hashes[s:e], k)) for s, e in zip(ends[:-1], ends[1:], strict=True)]


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(K.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def sketches(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """Per document: set size, two fingerprints of the whole set, registers and a bitmap (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                sets = shingle_sets(buf, offs, k)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                one, two = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                regs, bits = [None] * (b - a), [None] * (b - a)
                if len(full):
                    flat = np.concatenate(sets)
                    firsts = np.cumsum(sizes[full]) - sizes[full]
                    one[full] = np.add.reduceat(K.mix(flat), firsts)
                    two[full] = np.add.reduceat(K.mix(flat ^ np.uint64(0xA0761D6478BD642F)), firsts)
                    for i, row in zip(full.tolist(), registers(flat, firsts, bands * PER_BAND), strict=True):
                        regs[i], bits[i] = row.tobytes(), bitmap(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(K.signed(one)), pa.array(K.signed(two)), pa.array(regs, pa.binary()), pa.array(bits, pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "regs", "bits"],
                )

    return common.id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, regs binary, bits binary")


def _registers_of(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), -1)


def buckets(reps: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles) of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = K.signed(band_keys(_registers_of(batch.column("regs"))))
                ids = np.repeat(batch.column("doc_id").to_numpy(), keys.shape[1])
                sizes = np.repeat(batch.column("n_shingles").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(sizes)], names=["key", "doc_id", "n_shingles"])

    return reps.select("doc_id", "n_shingles", "regs").mapInArrow(run, "key long, doc_id long, n_shingles long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, bands: int = 0) -> DataFrame:
    """Shingle sets, and registers if ``bands`` are asked for, of the rows with words of the documents named in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                sets = shingle_sets(buf, offs, k)
                lengths = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets)
                regs = [None] * (b - a)
                if bands and len(flat):
                    full = np.flatnonzero(lengths)
                    for i, row in zip(full.tolist(), registers(flat, np.cumsum(lengths[full]) - lengths[full], bands * PER_BAND), strict=True):
                        regs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), K.row_lists(K.signed(flat), lengths, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "hashes", "regs"])

    return common.id_text(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes array<long>, regs binary").where(F.size("hashes") > 0)


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs a, b whose full sets have 100 * intersection >= percent * union.

    The joint estimate goes first: a pair more than five standard errors below the threshold is not compared in full.
    """
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    sets = common.staged(full_sets(docs, ids, k, n_bands(percent)), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            regs = [_registers_of(batch.column(c)) for c in ("ra", "rb")]
            n_a, n_b = (np.diff(batch.column(c).offsets.to_numpy()).astype(np.float64) for c in ("sa", "sb"))
            slack = _slack(percent, regs[0].shape[1])
            likely = (estimate(*regs, n_a, n_b) >= percent / 100 - slack) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            keep = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(likely).tolist():
                shared = len(np.intersect1d(batch.column("sa")[i].values.to_numpy(), batch.column("sb")[i].values.to_numpy(), assume_unique=True))
                keep[i] = 100 * shared >= percent * (n_a[i] + n_b[i] - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("sa"), F.col("regs").alias("ra"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("sb"), F.col("regs").alias("rb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "ra", "rb")
    links = common.staged(both.mapInArrow(run, "a long, b long"), "links")
    common.drop_staged(sets)
    return links


def _spread(placed: DataFrame) -> DataFrame:
    """Rows of keys that more than one component holds."""
    keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return placed.join(keys, "key", "left_semi")


def _slack(percent: int, count: int) -> float:
    """Five standard errors of an estimate from ``count`` registers, and a step of its grid."""
    return 5 * math.sqrt(percent / 100 * (1 - percent / 100) / count) + 1 / 64


def _blocks(open_rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """(key, heads, members): chunks of each bucket's members against chunks of those outside its largest component."""
    comps = open_rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = comps.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most")).select("key", "n", F.col("most.n").alias("inner"), F.col("most.comp").alias("most"))
    rows = open_rows.join(sizes, "key").join(sketched, "doc_id")
    one = F.struct("doc_id", "comp", "n_shingles", "regs", "bits")
    chunk = lambda n: F.pmod(F.xxhash64("doc_id"), F.ceil(n / CHUNK)).cast("int")
    members = rows.groupBy("key", chunk(F.col("n")).alias("chunk")).agg(F.collect_list(one).alias("members"))
    parts = F.sequence(F.lit(0), F.floor((F.ceil(F.col("n") / CHUNK) - 1) / PART).cast("int"))
    heads = rows.where("comp <> most").groupBy("key", "n", chunk(F.col("n") - F.col("inner")).alias("chunk")).agg(F.collect_list(one).alias("heads"))
    heads = heads.select("key", F.explode(parts).alias("part"), "heads")
    return members.withColumn("part", F.floor(F.col("chunk") / PART).cast("int")).join(heads, ["key", "part"]).select("key", "heads", "members")


class _Side:
    """The sketches of a column of chunks, flat, and where each chunk begins."""

    def __init__(self, chunks: pa.ListArray):
        self.first = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        rows = chunks.flatten()
        self.ids, self.comps, self.sizes = (rows.field(c).to_numpy() for c in ("doc_id", "comp", "n_shingles"))
        self.regs = _registers_of(rows.field("regs"))
        self.keys = K.signed(band_keys(self.regs))
        self.bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(rows), -1)
        self.over = self.sizes - np.bitwise_count(self.bits).sum(1)  # shingles that share a bit with another of their set


def _judged(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of different components that may reach the threshold, each from the first bucket that it shares."""

    def likely(key: int, one: _Side, two: _Side, at: slice, to: slice) -> tuple[np.ndarray, np.ndarray]:
        n_a, n_b = one.sizes[at, None], two.sizes[None, to]
        fits = (one.comps[at, None] != two.comps[None, to]) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
        same = one.keys[at, None, :] == two.keys[None, to, :]
        fits &= same.any(2) & (one.keys[np.arange(at.start, at.stop)[:, None], same.argmax(2)] == key)
        i, j = np.nonzero(fits)
        i, j = i + at.start, j + to.start
        shared = np.bitwise_count(one.bits[i] & two.bits[j]).sum(1) + np.minimum(one.over[i], two.over[j])
        good = 100 * shared >= percent * (one.sizes[i] + two.sizes[j] - shared)
        i, j = i[good], j[good]
        near = estimate(one.regs[i], two.regs[j], one.sizes[i].astype(np.float64), two.sizes[j].astype(np.float64)) >= percent / 100 - _slack(percent, one.regs.shape[1])
        return one.ids[i[near]], two.ids[j[near]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                one, two = _Side(batch.column("heads")), _Side(batch.column("members"))
                found = [likely(key, one, two, slice(*one.first[r : r + 2].tolist()), slice(*two.first[r : r + 2].tolist())) for r, key in enumerate(batch.column("key").to_pylist())]
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _by_class(rows: DataFrame, classes: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` left joined to one row per class; the keys named in ``hot`` (HOT_CLASSES at most) meet their class where their rows
    are, as one of them may hold a third of all rows, and null keys meet nothing."""
    hot = hot.select(*keys)
    some = rows.where(F.col(keys[0]).isNotNull())
    there = some.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(classes.join(F.broadcast(hot), keys, "left_semi")), keys, "left")
    others = some.join(F.broadcast(hot), keys, "left_anti").join(classes, keys, "left")
    none = rows.where(F.col(keys[0]).isNull())
    for c in classes.columns:
        if c not in keys:
            none = none.withColumn(c, F.lit(None).cast(classes.schema[c].dataType))
    return there.unionByName(others).unionByName(none)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Words are runs of bytes outside space and 0x09-0x0D after A-Z are lower-cased; a text shorter than ``k`` words has
    its whole sequence as its only shingle. Documents whose sets have 100 * intersection >= ``percent`` * union are
    linked. Null or empty texts have no shingles and no links. Rows without doc_id are left out; rows that repeat a
    doc_id are one node of the link graph and each keep a row; an empty table gives an empty result; other columns are
    ignored.
    """
    drawn = common.staged(sketches(docs, k, n_bands(percent)), "sketches")
    by_set = ["n_shingles", "f1", "f2"]
    classes = drawn.where("n_shingles > 0").groupBy(*by_set).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = common.staged(classes, "classes")
    hot = classes.where(F.col("n") > drawn.count() // HOT_CLASSES + HOT_ROWS)
    full = drawn.select("doc_id", F.col("n_shingles").alias("size"), F.when(F.col("n_shingles") > 0, F.col("n_shingles")).alias("n_shingles"), "f1", "f2")
    members = _by_class(full, classes.drop("n"), by_set, hot).drop("n_shingles").withColumnRenamed("size", "n_shingles")
    members = members.withColumn("least", F.min("rep").over(Window.partitionBy("doc_id")))
    members = common.staged(members.select("doc_id", "n_shingles", F.coalesce("rep", "least").alias("rep"), "least"), "members")
    same_id = members.where("least < rep").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    reps = drawn.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    reps = common.staged(reps.select("doc_id", "n_shingles", "regs", "bits"), "reps")
    common.drop_staged(drawn)
    rows = buckets(reps)
    rows = common.staged(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
    # A member's pivot is the most typical document that it shares a bucket with: the one whose own buckets are fullest.
    typical = rows.groupBy("doc_id").agg(F.sum("n").alias("fill")).select("doc_id", F.struct("fill", -F.col("doc_id"), "doc_id").alias("rank"))
    heads = rows.join(typical, "doc_id").groupBy("key").agg(F.max("rank").alias("rank"))
    own = rows.join(heads, "key").where(F.col("doc_id") != F.col("rank.doc_id")).groupBy("doc_id").agg(F.max("rank").alias("rank"))
    tested = own.select(F.least("doc_id", "rank.doc_id").alias("a"), F.greatest("doc_id", "rank.doc_id").alias("b")).distinct()
    comp = components(confirmed(common.staged(tested, "tested"), docs, k, percent).union(same_id))
    placed = rows.select("key", "doc_id").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    open_rows = common.staged(_spread(placed), "open")
    pairs = common.staged(_judged(_blocks(open_rows, reps), percent), "pairs")
    if not pairs.isEmpty():
        comp = components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).union(confirmed(pairs, docs, k, percent)))
    found = _by_class(members.select("doc_id", "n_shingles", "rep"), comp.withColumnRenamed("node", "rep"), ["rep"], hot.select("rep").distinct()).select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
