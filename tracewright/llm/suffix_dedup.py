"""Exact removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes (a window) owns one anchor: the start of the least-hashed 32-byte string inside it. Equal windows
have equal anchors at equal places, so an array of the suffixes that start at anchors, about one byte in 35, finds
every repeat. An entry of the array is an anchor with the run of window starts it serves; its key is the hash of its
32 bytes and then the hash of the whole span of bytes that its windows cover.

New batches get sorted arrays of their own; adjacent equal entries of a batch are repeats at once, and only the first
of each goes on. Batches meet in shards dealt by key: each shard holds levels whose sizes grow geometrically, a new
array is merged with the level of its size, and each merge scan marks the later of two equal entries. Where one anchor
string stands in different spans, only part of a run of windows may repeat: these windows go, each with its own hash,
through the same index a second time. A key that fills a third of the corpus therefore sends one entry per batch.

Hashes: an entry matches on 64 bits of its anchor and 64 bits of its span, a window on 64 bits that mix its hash with its
anchor's and 32 bits of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import runs_of

GRAM = 32
BLOCK = 2 << 20  # window starts handled at once
BATCH = 1 << 20  # entries of one suffix array before it is sorted and sent on
ENTRY, REPEAT, MIXED = 0, 1, 2
ROWS = "k long, c long, doc_id long, span long"


def pack(start: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
    """Window starts [start, start + count) and a kind in one integer."""
    return (start.astype(np.int64) << 26) | (count.astype(np.int64) << 2) | kind


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return span >> 26, (span >> 2) & 0xFFFFFF


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, span hash, row, first window start in the row, and number of windows, of each entry of a slice."""
    parts = [_anchors_in(buf[s : s + BLOCK + length - 1], s, offs, length) for s in range(0, max(1, len(buf) - length + 1), BLOCK)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors_in(buf: np.ndarray, base: int, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    n = len(buf) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    sums = K.byte_sums(buf)
    _, down = K.powers(len(sums))
    gram = K.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    mask = np.uint64((1 << 23) - 1)
    least = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    wide, need = 1, length - GRAM + 1
    while 2 * wide <= need:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if need > wide:
        least = np.minimum(least[: n], least[need - wide :])
    at = (least[:n] & mask).astype(np.int64)
    inside = np.ones(n, bool)
    for edge in (offs[np.searchsorted(offs, base, "right") : np.searchsorted(offs, base + len(buf), "left")] - base).tolist():
        inside[max(0, edge - length + 1) : edge] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    own = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, anchor = starts[new], own[new]
    count = np.diff(np.append(new, len(starts)))
    span = K.mix(K.span_hash(sums, lo, lo + count - 1 + length) + (anchor - lo).astype(np.uint64))
    rows = np.searchsorted(offs, lo + base, "right") - 1
    return gram[anchor], span, rows, lo + base - offs[rows], count


def _merged(doc: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjoining or overlapping runs of window starts of one document joined to one (kept under the count that fits)."""
    if not len(doc):
        return doc, span
    start, count = unpack(span)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + count)[order]
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(end + group * (np.int64(1) << 37)) - group * (np.int64(1) << 37)
    first = np.flatnonzero(fresh | np.concatenate([[True], start[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    size = reach[last] - start[first]
    if size.max() > 0xFFFFFF:  # a removed run of over 16 MB stays in its pieces
        return doc, pack(start, end - start, REPEAT)
    return doc[first], pack(start[first], size, REPEAT)


def sorted_array(k: np.ndarray, c: np.ndarray, doc: np.ndarray, span: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """Sort entries by key and place; the first of each key, and as (doc, span) those that also stand earlier."""
    order = np.lexsort((span, doc, c, k))
    k, c, doc, span = k[order], c[order], doc[order], span[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    of = first[np.cumsum(head) - 1] if len(k) else first
    later = ~head & ((doc != doc[of]) | (span != span[of]))  # the same place twice is no repeat
    return (k[first], c[first], doc[first], span[first]), (doc[later], span[later])


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns], names=["k", "c", "doc_id", "span"])


def _send(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One batch's array: its first entries, then its repeats, dealt by place rather than by key."""
    if not parts:
        return
    first, (doc, span) = sorted_array(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    yield _batch(*first)
    doc, span = _merged(doc, span)
    yield _batch(K.mix(doc.astype(np.uint64) * np.uint64(31) + span.astype(np.uint64)), np.zeros(len(doc), np.int64), doc, span)


def entries(docs: DataFrame, length: int) -> DataFrame:
    """The anchors of all texts, repeats within one batch already found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, _, buf, offs in K.text_slices(batch.column("text")):
                k, c, row, start, count = anchors(buf, offs, length)
                parts.append((k, c, ids[a + row], pack(start, count, ENTRY)))
                held += len(k)
                if held >= BATCH:
                    yield from _send(parts)
                    parts, held = [], 0
        yield from _send(parts)

    return docs.mapInArrow(run, ROWS)


class LevelIndex:
    """Levels of sorted arrays; an array joins the level of its size, and so on upwards, like a binary counter."""

    def __init__(self):
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}

    def add(self, *entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Insert a batch; returns (doc, span) of entries that the merge scans showed to stand earlier elsewhere."""
        array, found = sorted_array(*entry)
        all_found = [found]
        while (level := max(0, int(len(array[0])).bit_length())) in self.levels:
            array, found = sorted_array(*(np.concatenate(x) for x in zip(self.levels.pop(level), array, strict=True)))
            all_found.append(found)
        self.levels[level] = array
        return tuple(np.concatenate(x) for x in zip(*all_found, strict=True))

    def close(self) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
        """Merge all levels into one array."""
        if not self.levels:
            return sorted_array(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return sorted_array(*(np.concatenate(x) for x in zip(*self.levels.values(), strict=True)))


def verdicts(rows: DataFrame, mixed: bool) -> DataFrame:
    """Shards of the index: repeats, and if ``mixed`` the first entries of anchors that stand in different spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, waiting, held = LevelIndex(), [], 0
        none = np.zeros(0, np.int64)

        def add():
            doc, span = index.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            return _batch(none[:0], none, none, none) if not len(doc) else _batch(np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), doc, unpack_kind(span, REPEAT))

        for batch in batches:
            k, c, doc, span = (batch.column(x).to_numpy() for x in ("k", "c", "doc_id", "span"))
            entry = (span & 3) == ENTRY
            if not entry.all():
                yield _batch(k[~entry], c[~entry], doc[~entry], span[~entry])
            if entry.any():
                waiting.append((k[entry].view(np.uint64), c[entry].view(np.uint64), doc[entry], span[entry]))
                held += int(entry.sum())
            if held >= BATCH // 8:
                yield add()
                waiting, held = [], 0
        if waiting:
            yield add()
        (k, c, doc, span), (late_doc, late_span) = index.close()
        yield _batch(np.zeros(len(late_doc), np.int64), np.zeros(len(late_doc), np.int64), late_doc, unpack_kind(late_span, REPEAT))
        if mixed and len(k):
            same = k[1:] == k[:-1]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield _batch(k[several], c[several], doc[several], unpack_kind(span[several], MIXED))

    return rows.repartition("k").mapInArrow(run, ROWS)


def unpack_kind(span: np.ndarray, kind: int) -> np.ndarray:
    return (span & ~np.int64(3)) | kind


def window_entries(texts: DataFrame, length: int) -> DataFrame:
    """One entry per window of the mixed spans; ``texts`` has doc_id, text and spans (array of struct k, span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(), batch.column("spans")
            first = lists.offsets.to_numpy()
            flat = lists.values
            keys, spans = flat.field("k").to_numpy().view(np.uint64), flat.field("span").to_numpy()
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                key, span = keys[first[a] : first[b]], spans[first[a] : first[b]]
                row = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))
                start, count = unpack(span)
                each = np.repeat(np.arange(len(span)), count)
                where = runs_of(start, count)
                row, place = row[each], (where + offs[row[each]])
                fits = place + length <= offs[row + 1]
                each, where, row, place = each[fits], where[fits], row[fits], place[fits]
                window = K.span_hash(K.byte_sums(buf), place, place + length)
                parts.append((K.mix(key[each] ^ window), window & np.uint64(0xFFFFFFFF), ids[a + row], pack(where, np.ones(len(where), np.int64), ENTRY)))
                held += len(where)
                if held >= BATCH:
                    yield from _send(parts)
                    parts, held = [], 0
        yield from _send(parts)

    return texts.mapInArrow(run, ROWS)


def digests(texts: DataFrame, length: int) -> DataFrame:
    """``texts`` has doc_id, text and spans (array of long, null without repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            size = np.diff(lists.offsets.to_numpy())
            first = lists.offsets.to_numpy()
            spans = lists.values.to_numpy(zero_copy_only=False)
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                removed = np.zeros(len(buf) + 1, np.int32)
                start, count = unpack(spans[first[a] : first[b]].astype(np.int64))
                row = np.repeat(np.arange(b - a), size[a:b])
                np.add.at(removed, np.minimum(offs[row] + start, offs[row + 1]), 1)
                np.add.at(removed, np.minimum(offs[row] + start + count + length - 1, offs[row + 1]), -1)
                gone = np.cumsum(removed[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offs[:-1][offs[:-1] < len(buf)]
                begins[inner] = gone[inner]
                runs = np.concatenate([[0], np.cumsum(begins)])
                kept = buf[~gone].tobytes()
                ends = offs - total[offs]
                texts_left = [kept[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(offs)),
                        pa.array(np.diff(total[offs])),
                        pa.array(np.diff(runs[offs])),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts_left], pa.string()),
                        pa.array([x.decode("utf-8", "replace") for x in texts_left], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept_text.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or same document
    and earlier start), judged on the input. Texts are UTF-8 bytes, null is empty, matches never cross documents;
    texts shorter than ``length`` are kept whole. ``kept_text`` shows a character cut by a removal as U+FFFD. Rows
    that repeat a doc_id are one document: the same place in two of them is no repeat, and removals apply to each.
    Rows without doc_id are left out; an empty table gives an empty result; other columns are ignored.
    """
    texts = common.id_text(docs)
    judged = common.staged(verdicts(entries(texts, length), mixed=True), "verdicts")
    kind = F.col("span").bitwiseAND(3)
    mixed = judged.where(kind == MIXED).groupBy("doc_id").agg(F.collect_list(F.struct("k", "span")).alias("spans"))
    windows = verdicts(window_entries(texts.join(mixed, "doc_id").select("doc_id", "text", "spans"), length), mixed=False)
    found = judged.where(kind == REPEAT).select("doc_id", "span").union(windows.select("doc_id", "span"))
    spans = found.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    return digests(texts.join(spans, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans")), length)
