"""Document quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated output.

Every word belongs to two vocabularies of hashed buckets: its letters, and its form (last bytes, case, punctuation,
digits, repetition). Each bucket has a fixed sparse ternary index vector; a bucket's word vector is the sum of the
index vectors of its neighbours in the fitting texts, shifted by their distance, plus its own. A document is the mean of its words'
vectors with a few counts beside them. The network is trained with Adam in numpy and its logits are divided by a
temperature chosen on rows that training did not see.

The classifier is fitted in one task on at most ``max_rows`` labelled rows, those of the smallest hashes, taken over all files;
scoring covers every row. Only the text is an input of a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm import kernels as K

WORDS, FORMS = 1 << 11, 1 << 12
DIM = 32
_UPPER, _LOWER, _DIGIT, _OTHER = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT[48:58] = 1
_OTHER[33:127] = 1
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), 44, 46]] = 0


def buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, form bucket, length and whether it repeats the word before, of each word; and the rows' first words."""
    hashes, starts, ends, first = K.word_hashes(buf, offs)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (first,)
    size = ends - starts
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    padded = np.concatenate([buf, np.zeros(1, np.uint8)])
    count = lambda table: np.add.reduceat(table[padded], cuts)[0::2]
    upper, digit, other = count(_UPPER), count(_DIGIT), count(_OTHER)
    tail = np.zeros(len(starts), np.uint64)
    for back in (1, 2):
        tail = tail * np.uint64(256) + np.where(size >= back, K.LOWER[buf[np.maximum(ends - back, 0)]], 0).astype(np.uint64)
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper >= size, 2, 3)))
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    shape = case + 4 * np.minimum(digit, 2) + 12 * np.minimum(other, 3) + 48 * np.minimum(size // 4, 7) + 384 * again
    form = K.mix(tail * np.uint64(1009) + shape.astype(np.uint64)) % np.uint64(FORMS)
    return (hashes % np.uint64(WORDS)).astype(np.int64), form.astype(np.int64), size, again, first


def index_vectors(n: int, seed: int, marks: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for _ in range(marks):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return out


def _histogram(bucket: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    return np.bincount(row * size + bucket, minlength=rows * size).reshape(rows, size).astype(np.float64)


def pooled(buf: np.ndarray, offs: np.ndarray, word_vectors: np.ndarray, form_vectors: np.ndarray, at_once: int = 256) -> np.ndarray:
    """Features of each row; rows without words get zeros."""
    word, form, size, again, first = buckets(buf, offs)
    out = np.zeros((len(offs) - 1, 2 * DIM + 5), np.float32)
    for a in range(0, len(offs) - 1, at_once):
        b = min(a + at_once, len(offs) - 1)
        f, s = first[a : b + 1] - first[a], slice(first[a], first[b])
        n = np.maximum(np.diff(f), 1)[:, None].astype(np.float32)
        words, forms = _histogram(word[s], f, WORDS), _histogram(form[s], f, FORMS)
        row = np.repeat(np.arange(b - a), np.diff(f))
        total = lambda x: np.bincount(row, weights=x[s], minlength=b - a)[:, None] / n  # noqa: B023,E731
        counts = [np.log1p(np.diff(f))[:, None], total(size), total(again), (words > 0).sum(1)[:, None] / np.minimum(n, WORDS), words.max(1)[:, None] / n]
        out[a:b] = np.round(np.hstack([words @ word_vectors / n, forms @ form_vectors / n, *counts]), 5)
    return out


@dataclass
class Model:
    word_vectors: np.ndarray
    form_vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8).astype(np.float64)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        logits = self.logits(pooled(buf, offs, self.word_vectors, self.form_vectors)).astype(np.float64)
        return np.round(1 / (1 + np.exp(-np.clip(logits / self.temperature, -40, 40))), 6)  # sums of other batches differ further down


class _Neighbours:
    """Random indexing: each bucket's own index vector plus the rolled mean of its neighbours' in the same row.

    Texts are added slice by slice, so only a slice's words are held. The sums are of small whole numbers and exact.
    """

    def __init__(self, index: np.ndarray, reach: int = 2):
        self.index, self.reach = index, reach
        self.total, self.seen = np.zeros(index.shape), np.zeros(len(index))

    def add(self, bucket: np.ndarray, first: np.ndarray) -> None:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for step in range(1, self.reach + 1):
            same = row[step:] == row[:-step]
            one, two = bucket[:-step][same], bucket[step:][same]
            for here, there, shift in ((one, two, step), (two, one, -step)):
                pairs, n = np.unique(here * len(self.index) + there, return_counts=True)
                if len(pairs):
                    here, there = pairs // len(self.index), pairs % len(self.index)
                    begin = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
                    self.total[here[begin]] += np.add.reduceat(np.roll(self.index, shift, 1)[there] * n[:, None].astype(np.float32), begin)
                    self.seen[here[begin]] += np.add.reduceat(n, begin)

    def vectors(self) -> np.ndarray:
        return self.index + (self.total / np.maximum(self.seen, 1)[:, None]).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, seed: int = 11, hidden: int = 24, epochs: int = 80) -> Model:
    """Train on the given rows; a fifth of them choose the temperature and the best epoch."""
    column = pa.array(texts, pa.string())
    words, forms = _Neighbours(index_vectors(WORDS, seed)), _Neighbours(index_vectors(FORMS, seed + 1))
    for _, _, buf, offs in K.text_slices(column):
        word, form, _, _, first = buckets(buf, offs)
        words.add(word, first)
        forms.add(form, first)
    word_vectors, form_vectors = words.vectors(), forms.vectors()
    parts = [pooled(buf, offs, word_vectors, form_vectors) for _, _, buf, offs in K.text_slices(column)]
    x = np.vstack(parts) if parts else np.zeros((0, 2 * DIM + 5), np.float32)
    y = labels.astype(np.float32)
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32))
    rate = float((y.sum() + 1) / (len(y) + 2))
    model = Model(word_vectors, form_vectors, mean, scale, rng.normal(0, 0.2, (x.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 0.2, hidden).astype(np.float32), float(np.log(rate / (1 - rate))), 1.0)
    if len(y) < 20 or y.min() == y.max():  # too little to learn from: the base rate for every text
        model.w2[:] = 0
        return model
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = np.clip((x - mean) / scale, -8, 8)
    params = [model.w1, model.b1, model.w2, np.array([model.b2], np.float32)]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, kept, step = np.inf, None, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            hiddens = np.tanh(z[batch] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-(hiddens @ params[2] + params[3]))) - y[batch]) / len(batch)
            back = error[:, None] * params[2] * (1 - hiddens**2)
            grads = [z[batch].T @ back + 1e-4 * params[0], back.sum(0), hiddens.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        loss = _loss(np.tanh(z[held] @ params[0] + params[1]) @ params[2] + params[3], y[held])
        if loss < best:
            best, kept = loss, [p.copy() for p in params]
    model.w1, model.b1, model.w2, model.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = model.logits(x[held])
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logits / t, y[held])))
    return model


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 48_000_000) -> Model:
    """Fit on rows whose crc32(doc_id as text) mod 5 is not 0: the ``max_rows`` of the smallest hashes of doc_id, fewer if their
    texts pass ``max_chars`` in all."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(max_rows)
    rows = common.id_text(docs).join(F.broadcast(known), "doc_id")  # at most max_rows rows of three numbers
    sizes = rows.select("turn", "doc_id", F.char_length("text").alias("n")).orderBy("turn", "doc_id").collect()
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > max_chars and last is not None:
            rows = rows.where(F.col("turn") <= last)
            break
        last = r["turn"]
    model = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_rows, "model binary").first()  # in a task, as the bounded sample's words need more room than the driver should give
    return pickle.loads(model["model"]) if model else fit([], np.zeros(0, np.int64))


def _fit_rows(table: pa.Table) -> pa.Table:
    found = sorted(zip(*(table[c].to_pylist() for c in ("turn", "doc_id", "text", "quality")), strict=True))
    return pa.table({"model": pa.array([pickle.dumps(fit([r[2] for r in found], np.array([r[3] for r in found], np.int64)))], pa.binary())})


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in K.text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(model.score(buf, offs), pa.float64())], names=["doc_id", "score"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    A null or empty text is scored from zero features. Labels that are null are not learned from; of several labels of
    a document the larger counts. Without enough labels of both kinds every text gets the base rate. Rows without
    doc_id are left out; repeated rows are each scored, equal texts alike; an empty table gives an empty result; other columns are
    never read.
    """
    model = fitted(docs, labels, max_rows)
    found = scores(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """Rows of ``docs``, with all columns, whose text scores ``threshold`` or more."""
    model = fitted(docs, labels, max_rows)

    def test(_ids, texts):
        return np.concatenate([model.score(buf, offs) >= threshold for _, _, buf, offs in K.text_slices(texts)])

    return common.keep_rows(docs, lambda: test)
