"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) runs of non-space bytes. A test item's runs of ``seed`` words are the seeds; a document that
shares seeds covering enough of an item is tiled against it: the longest common run of unmarked words is found with
running Karp-Rabin hashes, marked on both sides, and so on down to ``seed`` words. The marked share of the item is its
coverage, so passages whose parts were reordered count in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import runs_of

BROADCAST_BYTES = 32 << 20  # test sets up to this size are held by every task; larger ones are joined
RESULT = "doc_id long, item_id long, matched long, item_words long"


class Items:
    """Test items as word hashes, with their seeds sorted."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        self.seed = seed
        column = pa.array([t or "" for t in texts], pa.string())
        self.ids, self.words = np.array(ids, np.int64), []
        for _, _, buf, offs in K.text_slices(column):
            hashes, _, _, first = K.word_hashes(buf, offs)
            self.words += [hashes[s:e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.by_size = {}
        for size in sorted({min(seed, len(w)) for w in self.words} - {0}):
            own = [i for i, w in enumerate(self.words) if min(seed, len(w)) == size]
            runs = [K.shingles(self.words[i], size) for i in own]
            flat = np.concatenate(runs)
            item = np.repeat(np.array(own), [len(r) for r in runs])
            place = np.concatenate([np.arange(len(r)) for r in runs])
            order = np.argsort(flat, kind="stable")
            screen = np.zeros(1 << 20, bool)
            screen[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[size] = (flat[order], item[order], place[order], screen)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and item place of each seed found in the rows' words (``first``: the rows' first words)."""
        out = []
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, (seeds, item, place, screen) in self.by_size.items():
            if len(hashes) < size:
                continue
            runs = K.shingles(hashes, size)
            at = np.flatnonzero(screen[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)] & (rows[: len(runs)] == rows[size - 1 :]))
            lo, hi = np.searchsorted(seeds, runs[at], "left"), np.searchsorted(seeds, runs[at], "right")
            each = runs_of(lo, hi - lo)
            out.append((np.repeat(rows[at], hi - lo), item[each], place[each], np.full(len(each), size)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        row, item, place, size = (np.concatenate(x) for x in zip(*out, strict=True))
        step = np.arange(self.seed)
        covered = (place[:, None] + step)[step[None, :] < size[:, None]]
        return np.repeat(row, size), np.repeat(item, size), covered


def tile(item: np.ndarray, text: np.ndarray, least: int) -> int:
    """Words of ``item`` covered by greedy tiles of at least ``least`` words from ``text``."""
    least = min(least, len(item))
    sums_i, sums_t = K.prefix_sums(item), K.prefix_sums(text)
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    size = min(len(item), len(text))
    while size >= least > 0:
        open_i, open_t = _windows(free_i, size), _windows(free_t, size)
        if len(open_i) and len(open_t):
            hash_i, hash_t = K.span_hash(sums_i, open_i, open_i + size), K.span_hash(sums_t, open_t, open_t + size)
            same = np.isin(hash_t, hash_i)
            if same.any():
                by_hash: dict = {}
                for h, j in zip(hash_t[same].tolist(), open_t[same].tolist(), strict=True):
                    by_hash.setdefault(h, []).append(j)
                for h, i in zip(hash_i.tolist(), open_i.tolist(), strict=True):
                    for j in by_hash.get(h, ()):
                        if free_i[i : i + size].all() and free_t[j : j + size].all() and (item[i : i + size] == text[j : j + size]).all():
                            free_i[i : i + size] = free_t[j : j + size] = False
                            break
        size -= 1
    return int((~free_i).sum())


def _windows(free: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[size:] - total[:-size] == size) if len(free) >= size else np.zeros(0, np.int64)


def best_matches(items: Items, ids: np.ndarray, buf: np.ndarray, offs: np.ndarray, percent: int) -> list[tuple]:
    """(doc_id, item_id, matched, item_words) of every item that a row covers to ``percent`` or more."""
    hashes, _, _, first = K.word_hashes(buf, offs)
    row, item, place = items.hits(hashes, first)
    if not len(row):
        return []
    order = np.lexsort((place, item, row))
    row, item, place = row[order], item[order], place[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    new_place = fresh | np.concatenate([[True], place[1:] != place[:-1]])
    begin = np.flatnonzero(fresh)
    seen = np.add.reduceat(new_place.astype(np.int64), begin)
    out = []
    for r, i, n in zip(row[begin].tolist(), item[begin].tolist(), seen.tolist(), strict=True):
        words = items.words[i]
        if 100 * n >= percent * len(words):
            matched = tile(words, hashes[first[r] : first[r + 1]], items.seed)
            if 100 * matched >= percent * len(words):
                out.append((int(ids[r]), int(items.ids[i]), matched, len(words)))
    return out


def _table(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "matched", "item_words"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def _too_large(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES


def _collected(items: DataFrame) -> list[tuple[int, str]]:
    """At most BROADCAST_BYTES of text; callers check."""
    return sorted((r["item_id"], r["text"]) for r in items.collect())


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, matched, item_words of every pair whose coverage reaches ``percent``."""
    texts, items = common.id_text(docs), _items(benchmark)
    if _too_large(items):
        return _joined_leaks(texts, items, seed, percent)
    held = _collected(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items([i for i, _ in held], [t for _, t in held], seed)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                yield _table(best_matches(known, ids[a:b], buf, offs, percent))

    return texts.mapInArrow(run, RESULT)


def _seeds(rows: DataFrame, name: str, seed: int) -> DataFrame:
    """Distinct (name, size, hash) of all runs of up to ``seed`` words; shorter ones serve items shorter than a seed."""
    whole = name == "item_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(name).to_numpy()
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                hashes, _, _, first = K.word_hashes(buf, offs)
                for i, s, e in zip(ids[a:b].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    sizes = [min(seed, e - s)] if whole else range(1, min(seed, e - s) + 1)
                    for size in (x for x in sizes if x):
                        h = np.unique(K.shingles(hashes[s:e], size))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), size, np.int32)), pa.array(K.signed(h))], names=[name, "size", "hash"])

    return rows.select(name, "text").mapInArrow(run, f"{name} long, size int, hash long")


def _joined_leaks(texts: DataFrame, items: DataFrame, seed: int, percent: int) -> DataFrame:
    """For test sets too large to hold: pairs that share a seed come from a join, and each is tiled on its own."""
    shared = _seeds(items, "item_id", seed).join(_seeds(texts, "doc_id", seed), ["size", "hash"])
    pairs = shared.select("doc_id", "item_id").distinct()
    rows = pairs.join(items.withColumnRenamed("text", "item_text"), "item_id").join(texts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, item, text, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item_text")), strict=True):
                for _, _, buf, offs in K.text_slices(pa.array([text])):
                    yield _table(best_matches(Items([item], [other], seed), np.array([doc]), buf, offs, percent))

    return rows.select("doc_id", "item_id", "text", "item_text").mapInArrow(run, RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_items (items covered to ``percent``), item_id (the best covered, smallest id on ties),
    matched and item_words (of that item), contaminated.

    Items shorter than ``seed`` words must appear whole; items without words, and rows of the benchmark with a null in
    either column, match nothing. Null or empty texts match nothing. Rows without doc_id are left out; rows that repeat
    a doc_id share its verdict; empty tables give an empty result or no matches; other columns are ignored.
    """
    found = leaks(docs, benchmark, seed, percent)
    order = F.struct((F.col("matched") / F.col("item_words")).alias("share"), (-F.col("item_id")).alias("turn"), "item_id", "matched", "item_words")
    best = found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.max(order).alias("best"))
    every = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return every.join(best, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best.item_id", "best.matched", "best.item_words", F.col("best").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with all columns, that cover no test item to ``percent``."""
    items = _items(benchmark)
    if _too_large(items):
        gone = leaks(docs, benchmark, seed, percent).select(F.col("doc_id").alias("__gone")).distinct()
        return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    held = _collected(items)

    def make():
        known = Items([i for i, _ in held], [t for _, t in held], seed)

        def test(_ids, texts):
            good = np.ones(len(texts), bool)
            for a, b, buf, offs in K.text_slices(texts):
                for row, *_ in best_matches(known, np.arange(a, b), buf, offs, percent):
                    good[row] = False
            return good

        return test

    return common.keep_rows(docs, make)
