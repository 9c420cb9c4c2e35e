"""SentencePiece BPE encoding and decoding by suffix-array matching.

Texts are cut where no piece can reach across: before each run of spaces and around line feeds. The distinct units of
a batch are concatenated and their suffixes sorted; every piece of the vocabulary is looked up in that array by binary
search, and its range of occurrences becomes edges (position, length, piece), stored by position. The relaxation
follows the model's own rule: of all neighbouring symbols whose union is an edge, those of the best score merge first,
leftmost on ties, until none is left; characters without an edge fall back to their bytes. The vocabulary file is read
with the public library; the library's own encoder serves only as a check in the tests.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import ChunkCache, runs_of

MARK = "▁".encode()  # stands for a space in pieces
KEY = 16  # bytes of a suffix that are sorted; longer pieces are compared further
BATCH_BYTES = 192 << 10  # text of one suffix array
IDS_AT_ONCE = 1 << 17  # ids decoded together; a longer document is decoded alone
LONG = 128  # symbols of a unit beyond which it is relaxed with a heap
_codecs: dict = {}


class PieceCodec:
    """Vocabulary of one model file with its encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        shown = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode().replace(MARK, b" ") for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[shown[i][0]] = i
        score = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.empty(n, np.int64)
        self.rank[np.lexsort((np.arange(n), -score))] = np.arange(n)
        normal = [i for i in range(n) if shown[i] and not model.is_byte(i)]
        self.piece_ids = np.array(normal, np.int32)
        self.pieces = [shown[i] for i in normal]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.longest = int(self.lengths.max())
        self.low = np.array([p[:KEY].ljust(KEY, b"\0") for p in self.pieces], f"S{KEY}")
        self.high = np.array([p[:KEY].ljust(KEY, b"\xff") for p in self.pieces], f"S{KEY}")
        self.out_len = np.array([len(p) for p in shown], np.int64)
        self.out_first = np.cumsum(self.out_len) - self.out_len
        self.out_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.cache = ChunkCache(lambda chunks: self._encode_units(chunks.to_pylist()), 200_000)

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def edges(self, text: np.ndarray) -> np.ndarray:
        """Table [position, length] of piece ids, -1 where no piece stands, from the sorted suffixes of ``text``.

        It is as wide as the longest piece that occurs."""
        n = len(text)
        padded = np.concatenate([text, np.full(KEY, 0xFF, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, KEY)[:n]
        halves = np.ascontiguousarray(windows).view(">u8").astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        keys = np.ascontiguousarray(windows[order]).view(f"S{KEY}").ravel()
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.flatnonzero(hi > lo)
        width = int(self.lengths[found].max(initial=1)) + 1
        table = np.full((n, width), -1, np.int32)
        short = found[self.lengths[found] <= KEY]
        count = hi[short] - lo[short]
        table[order[runs_of(lo[short], count)], np.repeat(self.lengths[short], count)] = np.repeat(self.piece_ids[short], count)
        raw = text.tobytes()
        for p in found[self.lengths[found] > KEY].tolist():
            for at in order[lo[p] : hi[p]].tolist():
                if raw.startswith(self.pieces[p], at):
                    table[at, self.lengths[p]] = self.piece_ids[p]
        return table

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts, a, size = [], [], 0, 0
        for b in range(len(units) + 1):
            if b == len(units) or (size and size + len(units[b]) > BATCH_BYTES):
                if b > a:
                    x, y = self._encode_batch(units[a:b])
                    flat.append(x)
                    counts.append(y)
                a, size = b, 0
            if b < len(units):
                size += len(units[b]) + 1
        return np.concatenate(flat), np.concatenate(counts)

    def _encode_batch(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
        table = self.edges(text)
        stop = np.cumsum([len(u) + 1 for u in units]) - 1  # places of the separators
        starts = np.flatnonzero((text & 0xC0) != 0x80)  # characters and separators
        unit = np.searchsorted(stop, starts, "left")
        sizes = np.bincount(unit, minlength=len(units)) - 1
        long = sizes > LONG
        done = [self._relax_long(table, starts[unit == u]) for u in np.flatnonzero(long).tolist()]
        work, unit = starts[~long[unit]], unit[~long[unit]]
        while len(work):
            work, unit, over = self._relax_round(table, work, unit)
            done.append(over)
        symbols = np.sort(np.concatenate(done)) if done else starts
        inner = text[symbols] != 0xFF
        length = np.diff(np.append(symbols, len(text)))[inner]
        symbols = symbols[inner]
        most = table.shape[1] - 1
        ids = np.where(length <= most, table[symbols, np.minimum(length, most)], -1)
        count = np.where(ids >= 0, 1, length)
        out = self.byte_id[text[runs_of(symbols, count)]]
        out[(np.cumsum(count) - count)[ids >= 0]] = ids[ids >= 0]
        owner = np.searchsorted(stop, symbols, "left")
        return out, np.bincount(owner, weights=count, minlength=len(units)).astype(np.int64)

    def _relax_round(self, table: np.ndarray, work: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the best pair of each unit still at work; symbols of units without a pair are returned as finished."""
        end = np.append(work[2:], [0, 0])
        length = end - work
        pair = np.zeros(len(work), bool)
        pair[:-2] = unit[:-2] == unit[2:]  # the third entry is at most the unit's separator
        pair &= length < table.shape[1]
        ids = np.full(len(work), -1, np.int32)
        ids[pair] = table[work[pair], length[pair]]
        rank = np.where(ids >= 0, self.rank[ids], np.int64(1) << 40)
        key = (rank << 22) | np.arange(len(work))
        firsts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(key, firsts)
        live = best < (np.int64(1) << 61)
        keep = np.ones(len(work), bool)
        keep[(best[live] & ((1 << 22) - 1)) + 1] = False
        going = np.repeat(live, np.diff(np.append(firsts, len(work))))
        return work[keep & going], unit[keep & going], work[~going]

    def _relax_long(self, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The same rule for one unit, its last start the separator, with a heap of candidate pairs."""
        n = len(starts) - 1
        place, after, before, alive = starts.tolist(), list(range(1, n + 2)), list(range(-1, n)), [True] * (n + 1)
        heap: list = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j >= n:
                return
            length = place[after[j]] - place[i]
            if length < table.shape[1] and (found := int(table[place[i], length])) >= 0:
                heapq.heappush(heap, (int(self.rank[found]), i, j, length))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, length = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or after[i] != j or place[after[j]] - place[i] != length:
                continue
            alive[j] = False
            after[i] = after[j]
            if after[i] <= n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return starts[np.array(alive)]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and how many each row has; a row that is not empty gets a space in front."""
        n = len(offs) - 1
        if len(buf) == 0:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        if MARK in (raw := buf.tobytes()):
            rows = [raw[s:e].replace(MARK, b" ") for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            buf = np.frombuffer(b"".join(rows), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        full = np.flatnonzero(np.diff(offs))
        buf = np.insert(buf, offs[full], np.uint8(32))
        offs = offs + np.concatenate([[0], np.cumsum(np.diff(offs) > 0)])
        space, feed = buf == 32, buf == 10
        head = np.zeros(len(buf), bool)
        head[offs[full]] = True
        head[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        starts = np.flatnonzero(head)
        ids, length = self.cache.encode(buf, starts)
        rows = np.searchsorted(offs, starts, "right") - 1
        return ids, np.bincount(rows, weights=length, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids, without the space that encoding put in front."""
        size = self.out_len[ids]
        raw = self.out_bytes[runs_of(self.out_first[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[s + (raw[s : s + 1] == b" " and s < e) : e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, text, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model_file or common.tokenizer_path("piece_bpe_32k.model"))
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                ids, counts = codec.encode(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("text").slice(a, b - a), K.row_lists(ids, counts, pa.int32())], names=["doc_id", "text", "ids"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """Adds n_pieces, ids_crc32 (of the ids as little-endian 32-bit words) and decoded to doc_id, text, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model_file or common.tokenizer_path("piece_bpe_32k.model"))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column("ids")
            offs = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offs, offs[a] + IDS_AT_ONCE, "right")) - 1)
                own, at = flat[offs[a] : offs[b]].astype("<u4"), offs[a : b + 1] - offs[a]
                crc = [zlib.crc32(own[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                texts = codec.decode(own.astype(np.int64), np.diff(at))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("ids"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "n_pieces", "ids_crc32", "decoded"])
                a = b

    return encoded.mapInArrow(run, "doc_id long, text string, ids array<int>, n_pieces long, ids_crc32 long, decoded string")


def piece_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32, round_trip (the decoded text is the text).

    A null or empty text has no pieces and is restored as the empty text. U+2581 is the model's own mark of a space and
    comes back as a space. Rows without doc_id are left out; repeated rows each have a result; an empty table gives an
    empty result; other columns are ignored.
    """
    found = decode(encode(docs, model_file), model_file)
    return found.select("doc_id", "n_pieces", "ids_crc32", (F.col("decoded") == F.col("text")).alias("round_trip"))
