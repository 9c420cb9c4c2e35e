"""Language-model scoring of whole documents by a small causal self-attention model on subword ids.

Text is the sequence of its lower-cased words and one end. Words are written as subword ids of a public byte-level
vocabulary, the leading space included, so a word sequence has one id sequence and a word one run of ids, known by a
64-bit hash. The network gives each id as the probability of its class, from masked self-attention over the ids before
it, times that of its member of the class, from the same hidden state (an adaptive softmax: two small products in place of one over
all members), times the id's share of its member. The most frequent ids are classes of their own; the next ones are members of their
own of classes by frequency and by whether they begin a word; the others share members by the same.

A word's probability is (1 - x) * c / N + x * n. c of N training tokens are this word, and n is the network's probability of its ids
and of a beginning after them, given that a word begins there; so words that training never met are spelt by the network alone, and the
probabilities of all words and the end add up to at most 1. x is the one of WEIGHTS that makes all training
documents most probable, each word's count without that word itself.

All counts (words, and ids by class) cover every training document, and the attention weights, which start from the
class frequencies, are trained in numpy on the windows of every training document, once each. Training documents are dealt
by a hash of doc_id into units of about UNIT_BYTES of text, and units into ROUNDS rounds; a round makes local steps
in each of its units, whose documents are in order of doc_id, and a Spark aggregation averages the units' weights in whole
numbers. So the weights depend on the documents only, not on how they are partitioned.
A document is cut into overlapping windows; a window's first ids are context only (before a document's start, ends), so each id is scored
once, with ``CONTEXT`` ids before it at least where the document has them. Scores from other partitionings differ by rounding
of single precision only.

Texts are encoded once, to ids of 16 bits that all later steps read. Word counts go back to the documents by blocks:
documents are cut into ranges of doc_id, the distinct words of each range meet their corpus counts in one shuffle by
word, and a cogroup brings each block's words and ids together. Inside a block about SLICE_IDS ids are at work at a time.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K
from tracewright.llm.subwords import SLICE_BYTES, ByteEncoder, parts_of, runs_of

LENGTH, CONTEXT = 32, 8  # ids of a window, and how many of them a later window repeats
DIM, CLASSES, OWN, INPUTS = 16, 64, 48, 1024
MEMBERS, LEVELS = 64, 8  # members of each class that is not one id; members, of the last class of either kind, that ids share by frequency
GROUPS = CLASSES - OWN
VOCABULARY = 50_257
END = VOCABULARY  # id of a document's end
BLOCK_BYTES, UNIT_BYTES = 8 << 20, 4 << 20
SLICE_IDS = 1 << 18
ROUNDS, STEPS = 3, 80
SCALE = 1 << 20  # weights are averaged in whole numbers of this part
_SHAPES = {"E": (INPUTS, DIM), "P": (LENGTH, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "U": (DIM, CLASSES), "b": (CLASSES,), "M": (GROUPS, DIM + 1, MEMBERS)}
_ID = np.random.default_rng(20250301).integers(1, 1 << 63, VOCABULARY, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def spaced_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of rows, each with one space in front, as bytes and row offsets."""
    low = K.LOWER[buf]
    starts, ends, rows = K.cut_words(low, offs)
    size = ends - starts
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    first = np.cumsum(size + 1) - size
    out[runs_of(first, size)] = low[runs_of(starts, size)]
    return out, np.concatenate([[0], np.cumsum(np.bincount(rows, weights=size + 1, minlength=len(offs) - 1).astype(np.int64))])


def id_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about SLICE_IDS ids: (first row, end row, ids, offsets from 0)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    offs, data = parts_of(column)
    offs, ids, a = offs // 2, data.view("<u2"), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE_IDS, "right")) - 1)
        yield a, b, ids[offs[a] : offs[b]].astype(np.int64), offs[a : b + 1] - offs[a]
        a = b


def word_hashes(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in the ids of rows, and their hashes."""
    starts = np.flatnonzero(begins[ids])
    if len(starts) == 0:
        return starts, np.zeros(0, np.uint64)
    return starts, K.span_hash(K.prefix_sums(_ID[ids]), starts, np.append(starts[1:], len(ids)))


def with_ends(ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows with an end after each, and the rows' offsets."""
    return np.insert(ids, offs[1:], END), offs + np.arange(len(offs))


class Classes:
    """Class of each id, its member of the class, log10 share of the id within the member, and the row of the input table that stands for it."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        counts = counts.astype(np.float64)
        order = np.lexsort((np.arange(len(counts)), -counts))
        order = order[order != END]
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(order))
        level = np.clip(np.floor(np.log2(counts.sum() + 2) - np.log2(counts + 1) - 6), 0, LEVELS - 1).astype(np.int64)
        most = GROUPS // 2 * MEMBERS  # members of the classes of one kind
        self.of, self.member = np.minimum(rank, OWN - 1), np.zeros(len(counts), np.int64)
        for kind in (0, 1):
            some = order[OWN - 1 :][begins[order[OWN - 1 :]] == kind]
            place = np.where(np.arange(len(some)) < most - LEVELS, np.arange(len(some)), most - LEVELS + level[some])
            self.of[some], self.member[some] = OWN + GROUPS // 2 * kind + place // MEMBERS, place % MEMBERS
        self.of[END] = OWN - 1
        at = self.of * MEMBERS + self.member
        size = np.bincount(at, minlength=CLASSES * MEMBERS)
        total = np.bincount(at, weights=counts, minlength=CLASSES * MEMBERS)
        self.share = np.log10((counts + 0.5) / (total + 0.5 * size)[at])
        self.row = np.where(rank < INPUTS - CLASSES, rank, INPUTS - CLASSES + self.of)
        self.row[END] = INPUTS - CLASSES + OWN - 1
        flag = np.bincount(self.of, weights=np.append(begins[:-1], 1), minlength=CLASSES)
        self.begins = (flag > 0).astype(np.float32)
        whole, inner = np.bincount(self.of, weights=counts, minlength=CLASSES), total.reshape(CLASSES, MEMBERS)[OWN:] + 0.5
        self.prior = np.log((whole + 0.5) / (whole + 0.5).sum()).astype(np.float32)
        self.inner = np.log(inner / inner.sum(1, keepdims=True)).astype(np.float32)


def start_weights(prior: np.ndarray, inner: np.ndarray | float = 0, seed: int = 5) -> dict[str, np.ndarray]:
    """``prior`` and ``inner`` are the log frequencies of the classes and, in each that is not one id, of its members."""
    rng = np.random.default_rng(seed)
    out = {k: rng.normal(0, 0.1 if k in "EP" else 0.25, s).astype(np.float32) for k, s in _SHAPES.items()}
    out["U"][:], out["M"][:] = 0, 0
    out["b"], out["M"][:, DIM] = prior.copy(), inner
    return out


def _blas():
    """numpy's own OpenBLAS with the ending of its functions' names, or None."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("libscipy_openblas*"):
        lib = ctypes.CDLL(str(path))
        for end in ("64_", ""):
            if hasattr(lib, f"scipy_openblas_set_num_threads{end}"):
                return lib, end
    return None


def one_thread() -> None:
    """One thread for this worker's products. Spark sets as many as the executor has cores, and with products as small as these a second one
    doubles the CPU time and saves none. Without that library nothing changes."""
    found = _blas()
    if found:
        getattr(found[0], f"scipy_openblas_set_num_threads{found[1]}")(1)


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES])


def views(values: np.ndarray) -> dict[str, np.ndarray]:
    """Weights in ``values``, which change with it."""
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s)
        at += n
    return out


_CAUSAL = np.tri(LENGTH, dtype=np.float32)
_MOST = np.float32(60)  # bound of a logit, so that exponentials stay finite without a search for the largest
_TINY = np.float32(1e-30)
_LOG10 = np.float32(1 / np.log(10))
_BOUNDS = np.full(1 << 14, _MOST)  # numpy takes the smaller of two arrays several times faster than that of an array and a number


def _bounded_exponentials(z: np.ndarray) -> np.ndarray:
    """exp of logits, in their place, none above the bound; a part at a time, which stays in cache."""
    values = z.reshape(-1)
    for s in range(0, len(values), len(_BOUNDS)):
        part = values[s : s + len(_BOUNDS)]
        np.minimum(part, _BOUNDS[: len(part)], out=part)
        np.exp(part, out=part)
    return z


def attend(w: dict[str, np.ndarray], rows: np.ndarray, last: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Hidden states of the ``last`` places of windows of input rows [n, LENGTH]; place i sees the inputs up to i, that is the ids before i."""
    n = len(rows)
    x = w["E"].take(rows, 0)
    x += w["P"]
    every = np.ones((n, LENGTH, 3 * DIM + 1), x.dtype)  # queries, keys, values, and a column that sums the weights
    np.matmul(x.reshape(-1, DIM), np.hstack([w["Q"] / np.float32(DIM**0.5), w["K"], w["V"]]), out=every.reshape(-1, 3 * DIM + 1)[:, :-1])
    q, k, v = every[:, LENGTH - last :, :DIM], every[:, :, DIM : 2 * DIM], every[:, :, 2 * DIM :]
    a = _bounded_exponentials(q @ k.transpose(0, 2, 1))
    a *= _CAUSAL[LENGTH - last :]
    mixed = a @ v
    mixed, total = mixed[:, :, :DIM] / mixed[:, :, DIM:], mixed[:, :, DIM:]
    h = (mixed.reshape(-1, DIM) @ w["O"]).reshape(mixed.shape)
    h += x[:, LENGTH - last :]
    return h, x, q, k, v[:, :, :DIM], a, total, mixed


AT_ONCE = 1024  # hidden states whose class probabilities are at work at once: they stay in cache


def _may_pass(hidden: np.ndarray, layer: np.ndarray) -> bool:
    """Whether a logit may pass the bound: none is above the product of the longest vectors plus the largest constant."""
    longest = np.sqrt((np.square(hidden) @ np.ones(DIM, hidden.dtype)).max(initial=0))
    return not float(longest) * float(np.sqrt(np.square(layer[:DIM]).sum(0).max())) + float(layer[DIM].max()) < _MOST


def _exponentials(wide: np.ndarray, layer: np.ndarray, space: np.ndarray, bounded: bool) -> np.ndarray:
    """exp of the logits of all classes, in ``space``; ``wide`` are hidden states with a last column of ones."""
    z = np.matmul(wide, layer, out=space[: len(wide)])
    return _bounded_exponentials(z) if bounded else np.exp(z, out=z)


def _widened(hidden: np.ndarray) -> np.ndarray:
    wide = np.ones((len(hidden), DIM + 1), hidden.dtype)
    wide[:, :DIM] = hidden
    return wide


def class_log10(w: dict[str, np.ndarray], hidden: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of class ``of``, and of any class that begins a word, at each hidden state [m, DIM]."""
    wide, layer = _widened(hidden), np.vstack([w["U"], w["b"]])
    both, bounded = np.stack([np.ones(CLASSES, layer.dtype), w["begins"]], 1), _may_pass(hidden, layer)
    space, parts = np.empty((AT_ONCE, CLASSES), layer.dtype), np.empty((len(wide), 3), layer.dtype)
    for s in range(0, len(wide), AT_ONCE):
        z = _exponentials(wide[s : s + AT_ONCE], layer, space, bounded)
        parts[s : s + AT_ONCE, :2] = z @ both
        parts[s : s + AT_ONCE, 2] = z[np.arange(len(z)), of[s : s + AT_ONCE]]
    parts += _TINY
    np.log(parts, out=parts)
    parts *= _LOG10
    return parts[:, 2] - parts[:, 0], parts[:, 1] - parts[:, 0]


def _by_group(of: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The places ``deep``, whose class has members, in order of class, and the run of each class that is there: (group, first, end)."""
    group = of[deep] - OWN
    deep = deep[np.argsort(group.astype(np.uint8), kind="stable")]
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return deep, [(g, s, e) for g, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if e > s]


def _member_exponentials(w: dict[str, np.ndarray], wide: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """exp of the logits of all members of its class at each hidden state; ``wide`` in order of class, with a last column of ones."""
    z, layers = np.empty((len(wide), MEMBERS), wide.dtype), w["M"]
    for g, s, e in runs:
        np.matmul(wide[s:e], layers[g], out=z[s:e])
    return _bounded_exponentials(z)


def member_log10(w: dict[str, np.ndarray], hidden: np.ndarray, of: np.ndarray, member: np.ndarray) -> np.ndarray:
    """log10 probability of each ``member`` of class ``of`` at each hidden state [m, DIM]; 0 in classes of one id."""
    out = np.zeros(len(of), hidden.dtype)
    deep, runs = _by_group(of, np.flatnonzero(of >= OWN))
    z = _member_exponentials(w, _widened(hidden[deep]), runs)
    own, total = z[np.arange(len(deep)), member[deep]] + _TINY, z @ np.ones(MEMBERS, z.dtype) + _TINY
    out[deep] = (np.log(own) - np.log(total)) * _LOG10
    return out


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, of: np.ndarray, valid: np.ndarray, member: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradient of the mean cross-entropy over the valid ones of the last places of windows, that of the members included if they are given."""
    last = of.shape[1]
    h, x, q, k, v, a, sums, mixed = attend(w, rows, last)
    a /= sums
    wide, layer, goal, ok = _widened(h.reshape(-1, DIM)), np.vstack([w["U"], w["b"]]), of.ravel(), valid.ravel()
    back = np.hstack([w["U"].T, np.ones((CLASSES, 1), layer.dtype)])  # the last column sums
    bounded = _may_pass(wide[:, :DIM], layer)
    share = ok * layer.dtype.type(1 / max(1, np.count_nonzero(ok)))
    space, outer, down = np.empty((min(AT_ONCE, len(wide)), CLASSES), layer.dtype), np.zeros_like(layer), -back.take(goal, 0)[:, :DIM] * share[:, None]
    for s in range(0, len(wide), AT_ONCE):
        some = wide[s : s + AT_ONCE]
        z = _exponentials(some, layer, space, bounded)
        both = z @ back
        total = both[:, DIM] + _TINY
        part = (share[s : s + AT_ONCE] / total)[:, None]
        both *= part
        down[s : s + AT_ONCE] += both[:, :DIM]
        z[np.arange(len(z)), goal[s : s + AT_ONCE]] -= total
        outer += (some * part).T @ z
    g = {"U": outer[:DIM], "b": outer[DIM], "M": np.zeros_like(w["M"])}
    if member is not None:
        deep, runs = _by_group(goal, np.flatnonzero((goal >= OWN) & ok))
        some, more, inner = wide[deep], np.empty((len(deep), DIM), layer.dtype), w["M"]
        z = _member_exponentials(w, some, runs)
        own, total = (np.arange(len(z)), member.ravel()[deep]), z @ np.ones(MEMBERS, z.dtype) + _TINY
        z[own] -= total
        some *= (share[deep] / total)[:, None]
        for i, s, e in runs:
            np.matmul(some[s:e].T, z[s:e], out=g["M"][i])
            np.matmul(z[s:e], inner[i, :DIM].T, out=more[s:e])
        more *= some[:, DIM:]
        down[deep] += more
    dh = down.reshape(h.shape)
    g["O"] = mixed.reshape(-1, DIM).T @ down
    dm = (down @ w["O"].T).reshape(h.shape)
    ds = dm @ v.transpose(0, 2, 1)
    ds -= ((dm * mixed).reshape(-1, DIM) @ np.ones(DIM, h.dtype)).reshape(*of.shape, 1)
    ds *= a
    each = np.zeros((*rows.shape, 3 * DIM), h.dtype)  # gradients of queries (scaled like them), keys and values
    np.matmul(ds, k, out=each[:, LENGTH - last :, :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=each[:, :, DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), dm, out=each[:, :, 2 * DIM :])
    each, scale = each.reshape(-1, 3 * DIM), np.float32(DIM**-0.5)
    both = x.reshape(-1, DIM).T @ each
    g["Q"], g["K"], g["V"] = both[:, :DIM] * scale, both[:, DIM : 2 * DIM], both[:, 2 * DIM :]
    dx = (each @ np.hstack([w["Q"] * scale, w["K"], w["V"]]).T).reshape(x.shape)
    dx[:, LENGTH - last :] += dh
    g["P"] = dx.sum(0)
    g["E"] = np.zeros_like(w["E"])
    np.add.at(g["E"].ravel(), (rows.reshape(-1, 1) * DIM + np.arange(DIM)).ravel(), dx.ravel())
    return g


def local_steps(w: dict[str, np.ndarray], rows: np.ndarray, of: np.ndarray, valid: np.ndarray, member: np.ndarray, seed: int, rate: float, batch: int = 32) -> dict[str, np.ndarray]:
    """One pass of Adam over the windows, ``batch`` at a step, or up to four times as many where STEPS steps remain."""
    values = flat(w)
    w, one, two, down = views(values), np.zeros_like(values), np.zeros_like(values), np.empty_like(values)
    order = np.random.default_rng(seed).permutation(len(rows))
    batch = min(4 * batch, max(batch, len(rows) // STEPS))
    for step, pick in enumerate(np.array_split(order, max(1, len(rows) // batch)), 1):
        g = flat(gradients(w, rows[pick], of[pick], valid[pick], member[pick]))
        one *= 0.9  # ten times the mean of the gradients
        one += g
        two *= 0.99  # a hundred times that of their squares
        g *= g
        two += g
        np.sqrt(two, out=down)
        size = 0.1 * (1 - 0.99**step) ** -0.5
        down += 1e-8 / size
        np.divide(one, down, out=down)
        down *= 0.1 * rate / (1 - 0.9**step) / size
        values -= down
    return w


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places [n, LENGTH] in the id stream, whether a place is scored there, and each window's row; every id is scored once, and
    CONTEXT places come before its first window's first one: those are before its row."""
    stride = LENGTH - CONTEXT
    count = np.maximum(1, -(-np.diff(offs) // stride))
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (offs[row] + nth * stride)[:, None] + np.arange(-CONTEXT, stride)
    return place, (place < offs[row + 1][:, None]) & (np.arange(LENGTH) >= CONTEXT), row


def inputs(classes: Classes, ids: np.ndarray, offs: np.ndarray, place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Input row at each place of windows: that of the id before it, or of an end at a document's start and before it."""
    rows = classes.row[ids]
    return np.where(place <= offs[row][:, None], classes.row[END], rows[np.clip(place - 1, 0, len(ids) - 1)])


def stream_scores(w: dict[str, np.ndarray], classes: Classes, ids: np.ndarray, offs: np.ndarray, at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each id, and of a word's beginning at its place."""
    place, scored, row = windows(offs)
    before, of, member = inputs(classes, ids, offs, place, row), classes.of[ids], classes.member[ids]
    w = w | {"begins": classes.begins}
    score, begin = np.empty(len(ids)), np.empty(len(ids))
    for s in range(0, len(place), at_once):
        ok = np.flatnonzero(scored[s : s + at_once, CONTEXT:])
        at = place[s : s + at_once, CONTEXT:].ravel()[ok]
        hidden = attend(w, before[s : s + at_once], LENGTH - CONTEXT)[0].reshape(-1, DIM)
        hidden = hidden if len(ok) == len(hidden) else hidden[ok]
        found, begin[at] = class_log10(w, hidden, of[at])
        score[at] = found + member_log10(w, hidden, of[at], member[at])
    return score + classes.share[ids], begin


WEIGHTS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)  # shares of the network in a word's probability to choose from


def word_parts(score: np.ndarray, begin: np.ndarray, starts: np.ndarray, is_end: np.ndarray, counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of each word, an end being one: by its count, by that without one training token of it, and by the network.

    The network's probability of a word is that of its ids given that a word begins there, times that of another
    beginning after it (after an end nothing is asked). ``starts`` are the words' places in the id stream; the counts are
    of ``total`` tokens.
    """
    sums = np.concatenate([[0.0], np.cumsum(score)])
    after = np.append(starts[1:], len(score))
    spelt = sums[after] - sums[starts] - begin[starts] + np.where(is_end, 0.0, np.append(begin, 0.0)[after])
    return counts / max(total, 1), np.maximum(counts - 1, 0) / max(total - 1, 1), 10.0 ** np.maximum(spelt, -300.0)


def mixed_log10(counted: np.ndarray, spelt: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """log10 probability of each row [rows, WEIGHTS] of words whose first ones stand at ``heads``."""
    return np.stack([np.add.reduceat(np.log((1 - x) * counted + x * spelt), heads) for x in WEIGHTS], 1) / np.log(10)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def encoded(texts: DataFrame, path: str | None) -> DataFrame:
    """doc_id, train, size (bytes of text), ids (16-bit subword ids of the words, without the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(path or common.tokenizer_path("byte_bpe_50k.json"), plain=True)
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch.column("text"), SLICE_BYTES):
                ids, counts = encoder.encode(*spaced_words(buf, offs))
                ends = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("train").slice(a, b - a), pa.array(np.diff(offs)), column], names=["doc_id", "train", "size", "ids"])

    return texts.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train")).mapInArrow(run, "doc_id long, train boolean, size long, ids binary")


def _in_blocks(found: DataFrame, size: int) -> DataFrame:
    """Adds ``block``, a range of doc_ids of about BLOCK_BYTES of text."""
    blocks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES + 1)
    bounds = sorted(set(found.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(np.array(bounds), batch.column(0).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["doc_id", "train", "ids", "block"])

    return found.select("doc_id", "train", "ids").mapInArrow(place, "doc_id long, train boolean, ids binary, block int")


def _vocabulary(blocked: DataFrame, begins: np.ndarray) -> DataFrame:
    """(block, hash, n): the distinct words of each block with their training count there; block -1 counts subword ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = np.zeros(VOCABULARY, np.int64), {}, 0

        def out(keep: dict) -> Iterator[pa.RecordBatch]:
            for block, parts in keep.items():
                h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                uniq, back = np.unique(h, return_inverse=True)
                yield _rows(block, K.signed(uniq), np.bincount(back, weights=n).astype(np.int64))

        for batch in batches:
            train, block = batch.column("train").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            for a, b, ids, offs in id_slices(batch.column("ids")):
                starts, hashes = word_hashes(ids, begins)
                row = np.searchsorted(offs, starts, "right") - 1
                seen += np.bincount(ids[np.repeat(train[a:b], np.diff(offs))], minlength=VOCABULARY)
                learn, of = train[a:b][row], block[a:b][row]
                for one in np.unique(block[a:b]).tolist():
                    uniq, back = np.unique(hashes[of == one], return_inverse=True)
                    held.setdefault(one, []).append((uniq, np.bincount(back, weights=learn[of == one], minlength=len(uniq)).astype(np.int64)))
                    size += len(uniq)
                if size > 1_000_000:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)
        some = np.flatnonzero(seen)
        yield _rows(-1, some, seen[some])

    return blocked.select("ids", "train", "block").mapInArrow(run, "block int, hash long, n long")


def _rows(block: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block, np.int32)), pa.array(h), pa.array(n)], names=["block", "hash", "n"])


def _unit_steps(now: dict[str, np.ndarray], classes: Classes, turn: int):
    """Local steps over one unit's documents in order of doc_id, and of their ids where it repeats."""

    def run(key, table):
        one_thread()
        again = np.array([zlib.crc32(x) for x in table["ids"].to_pylist()], np.int64)
        table = table.take(pa.array(np.lexsort((again, table["doc_id"].to_numpy()))))
        w, seen = now, 0
        for _, _, ids, offs in id_slices(table["ids"]):
            ids, offs = with_ends(ids, offs)
            place, scored, row = windows(offs)
            goal = ids[np.minimum(place[:, CONTEXT:], len(ids) - 1)]
            w = local_steps(w, inputs(classes, ids, offs, place, row), classes.of[goal], scored[:, CONTEXT:], classes.member[goal], turn, 0.02 / (1 + turn))
            seen += len(ids)
        whole = np.rint(flat(w).astype(np.float64) * SCALE).astype(np.int64)
        return pa.table([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole), pa.array(np.full(len(whole), seen))], names=["i", "v", "n"])

    return run


def _trained(lists: DataFrame, classes: Classes, units: int) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds of local steps; ``lists`` has doc_id and ids of all training documents."""
    weights = start_weights(classes.prior, classes.inner)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(units)).cast("int")
    for turn in range(ROUNDS):
        part = lists.withColumn("unit", unit).where(F.col("unit") % ROUNDS == turn).select("unit", "doc_id", "ids")
        each = part.groupBy("unit").applyInArrow(_unit_steps(weights, classes, turn), "i int, v long, n long")
        mean = each.groupBy("i").agg(F.sum((F.col("v").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
        found = sorted(mean.collect())  # one row per weight
        if found:
            weights = views((np.array([int(r["v"]) / int(r["n"]) for r in found]) / SCALE).astype(np.float32))
    return weights


def _best_weight(found: DataFrame) -> int:
    """Place in WEIGHTS under which the training documents are most probable; the last one without any."""
    fits = found.where("train").agg(*[F.sum(F.col("fit")[i]).alias(f"f{i}") for i in range(len(WEIGHTS))]).first()
    return len(WEIGHTS) - 1 if fits[0] is None else int(np.argmax(np.round(fits, 3)))


def score(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram log10 probability of the words and the end, ``score`` the model's log10
    probability of the same text. Documents with crc32(doc_id as text) mod 7 = 2 are held out of all learning. A null
    or empty text has the end as its only token; a very long text is scored whole, in windows. Without training documents all counts
    are zero and the model keeps its start weights and the last of WEIGHTS. Rows without doc_id are left out; repeated rows are
    each counted and scored; an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer_file
    found = common.staged(encoded(common.id_text(docs), path), "lm-ids")
    total = found.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(F.col("train"), F.col("size"))), F.lit(0)).alias("train"), F.count_if("train").alias("docs")).first()
    n_docs = total["docs"]
    begins = _begins(path)
    blocked = _in_blocks(found, total["size"])
    by_word = Window.partitionBy(F.col("block") < 0, "hash")
    kinds = _vocabulary(blocked, begins > 0)
    vocabulary = common.staged(kinds.withColumn("c", F.sum("n").over(by_word)).withColumn("turn", F.row_number().over(by_word.orderBy("block"))), "vocabulary")
    ids = vocabulary.where("block < 0").select("hash", "c").distinct().toPandas()  # at most one row per id of the vocabulary
    sums = vocabulary.where("block >= 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.count_if((F.col("turn") == 1) & (F.col("c") > 0)), F.lit(0)).alias("v")).first()
    n_tokens, n_words = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    counts = np.zeros(VOCABULARY + 1, np.int64)
    counts[ids["hash"].to_numpy()] = ids["c"].to_numpy()
    counts[END] = n_docs
    classes = Classes(counts, begins)
    weights = _trained(found.where("train").select("doc_id", "ids"), classes, ROUNDS * (total["train"] // (ROUNDS * UNIT_BYTES) + 1))
    per_token = float(np.log10(n_tokens + n_words + 1))
    heads_word = begins > 0
    heads_word[END] = True

    def slice_scores(ids: np.ndarray, offs: np.ndarray, known: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        _, hashes = word_hashes(ids, heads_word[:END])
        c = np.zeros(len(hashes), np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            c = np.where(known[near] == hashes, count[near], 0)
        ids, offs = with_ends(ids, offs)
        starts = np.flatnonzero(heads_word[ids])
        is_end = ids[starts] == END
        every = np.full(len(starts), n_docs, np.int64)
        every[~is_end] = c
        heads = np.searchsorted(starts, offs[:-1])
        words = np.diff(np.append(heads, len(starts)))
        score, begin = stream_scores(weights, classes, ids, offs)
        counted, without, spelt = word_parts(score, begin, starts, is_end, every, n_tokens)
        base = np.add.reduceat(np.log10(every + 1.0), heads) - words * per_token
        return words, np.add.reduceat((every > 0).astype(np.int64), heads), base, mixed_log10(counted, spelt, heads), mixed_log10(without, spelt, heads)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        one_thread()
        known = right["hash"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, count = known[order], right["c"].to_numpy()[order]
        out = [slice_scores(ids, offs, known, count) for _, _, ids, offs in id_slices(left["ids"])]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.zeros((0, len(WEIGHTS)))] * 2
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        plain = [pa.array(x, t) for x, t in zip(columns[:3], kinds, strict=True)]
        each = [K.row_lists(x.ravel(), np.full(len(x), len(WEIGHTS)), pa.float64()) for x in columns[3:]]
        return pa.table([left["doc_id"], left["train"], *plain, *each], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "scores", "fit"])

    words = vocabulary.where("block >= 0").select("block", "hash", "c")
    scored = blocked.select("block", "doc_id", "ids", "train").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, scores array<double>, fit array<double>")
    scored = common.staged(scored, "lm-scores")
    at = _best_weight(scored)
    scored = scored.withColumn("score", F.col("scores")[at])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _begins(path: str | None) -> np.ndarray:
    """1 for ids that begin a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or common.tokenizer_path("byte_bpe_50k.json"))
    out = np.zeros(VOCABULARY + 1, np.int64)
    for i in range(min(tokenizer.get_vocab_size(), VOCABULARY)):
        out[i] = (tokenizer.id_to_token(i) or "").startswith("Ġ")
    return out
