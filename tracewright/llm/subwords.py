"""Byte-level BPE encoding of whole texts with the ``tokenizers`` library, each distinct chunk of text encoded once.

A chunk is a piece of text at whose ends the byte-level pre-tokenizer always breaks: before a run of ASCII white
space, before that run's last character, after it unless it is a space, and between a letter (ASCII or Latin-1) and ASCII
punctuation other than an apostrophe. So chunks encode alike alone and in their text. Rows that hold other Unicode white
space or the text of a special token are encoded whole instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewright.llm import kernels as K

_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
_ODD_STARTS = [*(bytes([b]) for b in (*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3)), b"<|"]
SLICE_BYTES = 4 << 20  # text encoded at once; a longer document is encoded alone
MOST_CHUNKS = 400_000  # chunks that a worker remembers, the first that it meets; with their ids about 20 MB
MOST_BYTES = 8 << 20
JOINED_BYTES = 8 << 10  # new chunks that the library gets as one text
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_encoders: dict = {}


class ChunkCache:
    """Ids of distinct chunks; the first ones that this worker meets are remembered, within a bound of bytes."""

    def __init__(self, encode_many: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = MOST_CHUNKS):
        self.encode_many, self.most = encode_many, most
        self.known = pa.array([], pa.binary())
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and the start and length in it of each of the distinct ``chunks``."""
        if len(self.known) == 0:
            at = np.full(len(chunks), -1)
        else:
            at = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy()
        at = at.astype(np.int64)
        new = np.flatnonzero(at < 0)
        ids, ends = self.ids, self.ends
        if len(new):
            fresh = chunks.take(pa.array(new))
            flat, counts = self.encode_many(fresh)
            at[new] = len(ends) - 1 + np.arange(len(new))
            ends = np.concatenate([ends, ends[-1] + np.cumsum(counts)])
            ids = np.concatenate([ids, flat.astype(np.int32)])
            if len(self.known) + len(fresh) <= self.most and self.known.nbytes + fresh.nbytes <= MOST_BYTES:
                self.known, self.ids, self.ends = pa.concat_arrays([self.known, fresh]), ids, ends
        return ids, ends[at], ends[at + 1] - ends[at]

    def encode(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks that begin at ``starts``, the first at 0, one after another, and how many each chunk has."""
        offs = np.append(starts, len(buf)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        pool, first, length = self.lookup(found.dictionary)
        back = found.indices.to_numpy()
        first, length = first[back], length[back]
        return pool[runs_of(first, length)], length


def parts_of(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a binary array."""
    offs = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8) if chunks.buffers()[2] is not None and chunks.buffers()[2].size else np.zeros(0, np.uint8)
    return offs.astype(np.int64) - int(offs[0]), data[offs[0] : offs[-1]]


class ByteEncoder:
    """One tokenizer of the ``tokenizers`` library behind a cache of chunks."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache = ChunkCache(self._encode_many)

    @classmethod
    def of(cls, path: str, plain: bool = False) -> ByteEncoder:
        """The worker's encoder for this file: Spark reuses workers, so tasks share what was met before. With ``plain`` a
        special token's string is ordinary text."""
        if (path, plain) not in _encoders:
            _encoders[path, plain] = cls(path, plain)
        return _encoders[path, plain]

    def _ids_of(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _encode_many(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of words are joined by line feeds, each of which is a token of its own between them, and cut apart there again."""
        n = len(chunks)
        offs, data = parts_of(chunks)
        counts = np.zeros(n, np.int64)
        blank = K.SPACE[data[np.maximum(offs[1:] - 1, 0)]] if len(data) else np.ones(n, bool)
        plain, white = np.flatnonzero(~blank), np.flatnonzero(blank)
        out: list = [None] * 2
        if len(plain):
            size = offs[plain + 1] - offs[plain]
            joined = np.full(int(size.sum()) + len(plain), 10, np.uint8)
            ends = np.cumsum(size + 1)
            joined[runs_of(ends - size - 1, size)] = data[runs_of(offs[plain], size)]
            raw = joined.tobytes()
            cuts = np.unique(np.append(ends[np.minimum(np.searchsorted(ends, np.arange(JOINED_BYTES, len(raw), JOINED_BYTES)), len(ends) - 1)], len(raw)))
            flat = np.fromiter(chain.from_iterable(self._ids_of([raw[s:e] for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)])), np.int32)
            feeds = np.flatnonzero(flat == self.feed[0])
            if len(feeds) != len(plain):
                raise ValueError("the tokenizer does not keep line feeds apart")
            counts[plain] = np.diff(feeds, prepend=-1) - 1
            out[0] = np.delete(flat, feeds)
        if len(white):
            found = self._ids_of([data[offs[i] : offs[i + 1]].tobytes() for i in white.tolist()])
            counts[white] = [len(x) for x in found]
            out[1] = np.fromiter(chain.from_iterable(found), np.int32)
        if out[1] is None:
            return out[0] if out[0] is not None else np.zeros(0, np.int32), counts
        if out[0] is None:
            return out[1], counts
        flat = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        flat[runs_of(first[plain], counts[plain])] = out[0]
        flat[runs_of(first[white], counts[white])] = out[1]
        return flat, counts

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and how many each row has."""
        raw = buf.tobytes()
        found = _ODD.finditer(raw) if any(x in raw for x in _ODD_STARTS) else ()  # the pattern is slow, and most texts have none of its first bytes
        odd = np.unique([int(np.searchsorted(offs, m.start(), "right")) - 1 for m in found]).astype(np.int64)
        if not len(odd):
            return self._plain(buf, offs)
        size = np.diff(offs)
        size[odd] = 0
        ids, counts = self._plain(buf[runs_of(offs[:-1], size)], np.concatenate([[0], np.cumsum(size)]))
        plain = np.split(ids, np.cumsum(counts)[:-1])
        whole = self._ids_of([raw[offs[r] : offs[r + 1]] for r in odd.tolist()])
        for r, x in zip(odd.tolist(), whole, strict=True):
            plain[r] = np.array(x, np.int32)
            counts[r] = len(x)
        return np.concatenate(plain), counts

    def _plain(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        if len(buf) == 0:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        starts = chunk_starts(buf, offs)
        ids, length = self.cache.encode(buf, starts)
        rows = np.searchsorted(offs, starts, "right") - 1
        return ids, np.bincount(rows, weights=length, minlength=n).astype(np.int64)


def chunk_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the chunks of rows; see the head of this module."""
    space, letter, punct = K.SPACE[buf], _ASCII_LETTER[buf], _PUNCT[buf]
    accent = (buf[:-1] == 0xC3) & ~np.isin(buf[1:], (0x97, 0xB7))  # first byte of a Latin-1 letter
    ends, begins = letter.copy(), letter
    ends[1:] |= accent
    begins[:-1] |= accent
    row = np.zeros(len(buf) + 1, bool)
    row[offs] = True
    head = row[:-1].copy()
    head[1:] |= (space[1:] & ~space[:-1]) | (ends[:-1] & punct[1:]) | (punct[:-1] & begins[1:])
    last = np.zeros(len(buf), bool)  # the last white space before a word of the same row
    last[:-1] = space[:-1] & ~space[1:] & ~row[1:-1]
    head |= last
    head[1:] |= last[:-1] & (buf[:-1] != 32)
    return np.flatnonzero(head)


def runs_of(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0]+1, ... for ``length[0]`` places, then the next run."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = length > 0
    first, length = first[keep], length[keep]
    step = np.ones(total, np.int64)
    step[0] = first[0]
    step[np.cumsum(length)[:-1]] = first[1:] - (first[:-1] + length[:-1] - 1)
    return np.cumsum(step)
