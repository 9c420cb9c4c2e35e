"""Ranked lexical search by pair-bound MaxScore: exact best documents of each item of a query set.

An index of shards is written once: each shard has the postings of some megabytes of texts. The terms of an item are put in
pairs, the heaviest with the next. In a first round every shard intersects the two lists of each pair and keeps, beside the
terms' own maxima, the largest joint impact. A document with both terms is bounded by that joint maximum and one with
either alone by that term's, so a pair's bound is the largest of the three: never above the sum of two independent maxima and
often near half of it. The sums of bounds tell what a shard can hold at best; the sums of joint impacts of documents in the
lists are lower bounds of their scores, and the k-th largest over all shards is a threshold that the whole corpus shares. In the second
round only shards whose bound reaches an item's threshold are read for it. There, units (pairs or single terms) are in order
of their bounds: those whose sum stays below the threshold cannot carry a document alone, so candidates come from the
others, and each further unit is added for those candidates only that can still reach the threshold.

Scores are whole numbers with global statistics, so the merge of shards is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import runs_of

SHARD_BYTES = 8 << 20  # text under one index; a longer document is indexed alone
LOT_TERMS = 50_000  # about so many terms of items meet a shard at once
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_codes(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of lower-cased texts, and the term and row of each occurrence."""
    low = K.LOWER[buf]
    starts, ends, rows = K.cut_words(low, offs, _APART)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.ascontiguousarray(low[~_APART[low]])
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), rows


INDEX = "shard long, n_docs long, n_terms long, terms array<string>, df array<long>, ids binary, lengths binary, cut binary, row binary, tf binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 5]


def _raw(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def index_rows(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """One row per shard of (doc_id, text) rows, of ``limit`` bytes of text: postings by term, rows ascending, and the documents' ids and lengths."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, buf, offs in K.text_slices(batch.column(1), limit):
            terms, code, row = term_codes(buf, offs)
            n = b - a
            pair, tf = np.unique(code.astype(np.int64) * n + row, return_counts=True)
            df = np.bincount(pair // n, minlength=len(terms))
            lengths = np.bincount(row, minlength=n)
            made += 1
            cells = [part << 32 | made, int((lengths > 0).sum()), len(code), terms, df, _raw(ids[a:b], "<i8"), _raw(lengths, "<i4"), _raw(np.concatenate([[0], np.cumsum(df)]), "<i4"), _raw(pair % n, "<i4"), _raw(tf, "<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, _KINDS, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])


def index_of(docs: DataFrame, limit: int) -> DataFrame:
    return common.bucketed(common.id_text(docs).mapInArrow(lambda batches: index_rows(batches, limit), INDEX), "shard", "ranked_index", dealt=True)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of all items; rows that repeat an item_id are one item."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, buf, offs in K.text_slices(batch.column(1)):
                terms, code, row = term_codes(buf, offs)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + row], pa.int64()), terms.take(pa.array(code))], names=["item_id", "term"])

    texts = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def term_weight(n: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


class Shard:
    """Postings of one shard; impacts are worked out for terms that are asked for, once each."""

    def __init__(self, row: dict[str, pa.Scalar], n_docs: int, n_terms: int):
        numbers = {c: np.frombuffer(row[c].as_buffer(), "<i8" if c == "ids" else "<i4") for c in ("ids", "lengths", "cut", "row", "tf")}
        self.ids, self.cut, self.row, self.tf = numbers["ids"], numbers["cut"], numbers["row"], numbers["tf"]
        self.m = 75 + (25 * numbers["lengths"].astype(np.int64) * n_docs) // n_terms
        self.known: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.sheet = np.zeros(len(self.ids), np.int64)

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that hold a term, their impacts without its weight, and the largest of these."""
        if place not in self.known:
            span = slice(self.cut[place], self.cut[place + 1])
            rows, tf = self.row[span], self.tf[span].astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * self.m[rows])
            self.known[place] = rows, impact, int(impact.max())
        return self.known[place]

    def pair(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents with both of two (term, weight), and their joint impacts."""
        (rows_a, impact_a, _), (rows_b, impact_b, _) = self.postings(a[0]), self.postings(b[0])
        if len(rows_a) > len(rows_b):
            (rows_a, impact_a, a), (rows_b, impact_b, b) = (rows_b, impact_b, b), (rows_a, impact_a, a)
        self.sheet[rows_a] = impact_a
        met = self.sheet[rows_b]
        self.sheet[rows_a] = 0
        both = np.flatnonzero(met)
        return rows_b[both], met[both] * a[1] + impact_b[both] * b[1]

    def bound(self, unit: list[tuple[int, int]], total: np.ndarray) -> int:
        """The most that a unit's terms add to a score; joint impacts are added to ``total``."""
        most = max(self.postings(p)[2] * w for p, w in unit)
        if len(unit) == 2:
            rows, joint = self.pair(*unit)
            if len(rows):
                total[rows] += joint
                most = max(most, int(joint.max()))
        return most

    def best(self, units: list[list[tuple[int, int]]], bounds: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of the best k documents with ``least`` or more (ties by smaller id)."""
        order = np.argsort(bounds, kind="stable")
        sums = np.cumsum(bounds[order])
        n_weak = int(np.searchsorted(sums, least, "left"))  # units that cannot reach ``least`` together
        score = np.zeros(len(self.ids), np.int64)
        for u in order[n_weak:]:
            for place, weight in units[u]:
                rows, impact, _ = self.postings(place)
                score[rows] += impact * weight
        rows = np.flatnonzero(score)
        for i in range(n_weak, -1, -1):
            found = score[rows]
            if len(rows) > k:
                least = max(least, int(np.partition(found, -k)[-k]))
            rows = rows[found + (sums[i - 1] if i else 0) >= least]
            if i:
                for place, weight in units[order[i - 1]]:
                    others, impact, _ = self.postings(place)
                    self.sheet[others] = impact
                    score[rows] += self.sheet[rows] * weight
                    self.sheet[others] = 0
        best = rows[np.lexsort((self.ids[rows], -score[rows]))[:k]]
        return score[best], best


def units_of(asked: list[dict]) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """Item -> unit -> its (term's place, weight) in a shard."""
    out: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for term in asked:
        for use in term["uses"]:
            out.setdefault(use["item_id"], {}).setdefault(use["unit"], []).append((term["place"], use["weight"]))
    return out


def _cells(batch: pa.RecordBatch, i: int) -> dict[str, pa.Scalar]:
    return {n: batch.column(c)[i] for c, n in enumerate(batch.schema.names)}


BOUNDS = "shard long, lot int, item_id long, most long, units array<long>, least array<long>"


def _bounds(n_docs: int, n_terms: int, k: int):
    """First round: for each item and shard the bounds of its units (in the order of their numbers) and the best k lower bounds of scores."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cells = _cells(batch, i)
                shard, found = Shard(cells, n_docs, n_terms), []
                for item, units in units_of(cells["asked"].as_py()).items():
                    total = np.zeros(len(shard.ids), np.int64)
                    bounds = [shard.bound(units[u], total) for u in sorted(units)]
                    least = total[total > 0]
                    if len(least) > k:
                        least = np.partition(least, -k)[-k:]
                    found.append({"shard": cells["shard"].as_py(), "lot": cells["lot"].as_py(), "item_id": item, "most": sum(bounds), "units": bounds, "least": least.tolist()})
                yield pa.RecordBatch.from_pylist(found, _schema(BOUNDS))

    return run


FOUND = "item_id long, doc_id long, score long"


def _best(n_docs: int, n_terms: int, k: int):
    """Second round: the best k documents of each item that is still asked of a shard."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cells = _cells(batch, i)
                shard, found = Shard(cells, n_docs, n_terms), []
                units = units_of(cells["asked"].as_py())
                for left in cells["items"].as_py():
                    own = units[left["item_id"]]
                    score, rows = shard.best([own[u] for u in sorted(own)], np.array(left["units"], np.int64), max(left["least"], 1), k)
                    found += [{"item_id": left["item_id"], "doc_id": d, "score": s} for d, s in zip(shard.ids[rows].tolist(), score.tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist(found, _schema(FOUND))

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _ranked(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents that score highest for each item: item_id, rank, doc_id, score, equal scores by smaller doc_id.

    Null and empty texts have no terms: such documents are not counted and such items find nothing; items and documents
    without id are left out. Rows that repeat a doc_id are documents of their own (an id can then stand at several ranks);
    rows that repeat an item_id are one item. Texts of any length are read whole; empty tables give an empty result. Other
    columns are not read. The index has one row per shard, in buckets by shard, and is never shuffled.
    """
    index = index_of(docs, SHARD_BYTES)
    wanted = common.staged(item_terms(items), "ranked_items")
    n_docs, n_terms, lots = _totals(index, wanted)
    local = index.select("shard", F.posexplode(F.arrays_zip("terms", "df")).alias("place", "of")).select("shard", "place", F.col("of.terms").alias("term"), F.col("of.df").alias("df"))
    met = common.staged(local.join(wanted.select("term").distinct(), "term"), "ranked_met")
    weight = term_weight(F.lit(n_docs), F.col("df"))
    weighed = wanted.join(met.groupBy("term").agg(F.sum("df").alias("df")), "term").select("item_id", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("weight"), "term")) - 1
    uses = weighed.withColumn("unit", F.floor(turn / 2).cast("int")).withColumn("lot", F.pmod(F.xxhash64("item_id"), F.lit(lots)).cast("int"))
    uses = uses.groupBy("term", "lot").agg(F.collect_list(F.struct("item_id", "weight", "unit")).alias("uses"))
    asked = common.staged(met.join(uses, "term").groupBy("shard", "lot").agg(F.collect_list(F.struct("place", "uses")).alias("asked")), "ranked_asked")
    data = index.select("shard", "ids", "lengths", "cut", "row", "tf")
    with common.row_by_row(docs.sparkSession):
        bounds = common.staged(data.join(asked.hint("shuffle_hash"), "shard").mapInArrow(_bounds(n_docs, n_terms, k), BOUNDS), "ranked_bounds")
    left = still_asked(bounds, k).groupBy("shard", "lot").agg(F.collect_list(F.struct("item_id", "units", "least")).alias("items")).join(asked, ["shard", "lot"])
    with common.row_by_row(docs.sparkSession):
        found = common.staged(data.join(left.hint("shuffle_hash"), "shard").mapInArrow(_best(n_docs, n_terms, k), FOUND), "ranked_found")
    common.drop_bucketed(index)
    common.drop_staged(wanted, met, asked, bounds)
    return _ranked(found, "item_id", [F.desc("score"), F.col("doc_id")], k).select("item_id", "rank", "doc_id", "score")


def still_asked(bounds: DataFrame, k: int) -> DataFrame:
    """Items and shards whose bound reaches the item's threshold ``least``: its k-th largest lower bound over all shards."""
    lower = _ranked(bounds.select("item_id", F.explode("least").alias("score")), "item_id", [F.desc("score")], k)
    shared = lower.where(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
    return bounds.drop("least").join(shared, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(1))).where(F.col("most") >= F.col("least"))


def _totals(index: DataFrame, wanted: DataFrame) -> tuple[int, int, int]:
    """Documents with terms, all their terms, and lots in which items are asked: three numbers."""
    docs = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return docs[0] or 0, max(docs[1] or 0, 1), 1 + wanted.count() // LOT_TERMS
