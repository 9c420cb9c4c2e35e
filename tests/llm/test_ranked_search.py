"""Exact scores against plain arithmetic; bounds never below what they bound."""

import math
import random
import re
from collections import Counter

import pytest
from cases import LOWER, PASSAGE, TEXTS

from tracewright.llm import ranked_search as R


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    of = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    big_n, big_l = sum(bool(c) for _, c in of), sum(c.total() for _, c in of)
    df = Counter(t for _, c in of for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(text))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in of:
            if not c:
                continue
            m = 100 - 25 + (25 * c.total() * big_n) // big_l
            s = sum(n * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in q.items() if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "日本", "a1", "X"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 10, 40])))) for i in range(n)]
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(n // 3)]  # copies tie
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(15)] + [(20 + i, docs[i * 7][1].upper()) for i in range(10)]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "shard"), [(1, 20, 1 << 24), (2, 3, 400), (3, 1, 1), (4, 20, 3000)])
def test_search_against_plain_arithmetic(spark, monkeypatch, seed, k, shard):
    monkeypatch.setattr(R, "SHARD_BYTES", shard)
    monkeypatch.setattr(R, "LOT_TERMS", 40)
    docs, items = corpus(seed, 120)
    found = R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, items, k)


def test_odd_rows_and_clashing_columns(spark, docs):
    items = [(1, PASSAGE), (2, None), (3, ""), (4, "lorem LOREM Ipsum"), (5, "no such-words"), (None, PASSAGE), (1, "seven tall men"), (6, "b"), (7, "日本語; ünïcödé")]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, shard long")
    more = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    found = sorted(tuple(r) for r in R.search(every, rows, 5).collect())
    assert found == brute(TEXTS + [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], items, 5)
    assert {i for i, *_ in found} == {1, 4, 6, 7}
    assert R.search(docs.where("false"), rows).count() == 0
    assert R.search(docs, rows.where("false")).count() == 0


def test_a_shared_bound_skips_shards(spark, monkeypatch):
    """Three copies of an item fix its threshold, so shards without its heavier terms are not read for it."""
    monkeypatch.setattr(R, "SHARD_BYTES", 1)
    docs = [(i, "rare gem stone") for i in range(3)] + [(10 + i, "stone common words") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = R.index_of(frame, 1)
    assert index.count() == 43
    R.common.drop_bucketed(index)
    kept = []
    usual = R.still_asked
    monkeypatch.setattr(R, "still_asked", lambda bounds, k: kept.append((bounds.count(), usual(bounds, k).count())) or usual(bounds, k))
    found = R.search(frame, spark.createDataFrame([(1, "rare gem stone")], "item_id long, text string"), 3)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, [(1, "rare gem stone")], 3)
    assert kept == [(43, 3)]


def test_pair_bounds_hold():
    rng = random.Random(7)
    docs, items = corpus(9, 80)
    import numpy as np
    import pyarrow as pa

    class Here:
        def partitionId(self):
            return 0

    before, R.TaskContext.get = R.TaskContext.get, staticmethod(lambda: Here())
    try:
        ids, texts = zip(*docs, strict=True)
        batch = next(R.index_rows([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])], 1 << 24))
    finally:
        R.TaskContext.get = before
    row = R._cells(batch, 0)
    names = {t: i for i, t in enumerate(row["terms"].as_py())}
    shard = R.Shard(row, row["n_docs"].as_py(), row["n_terms"].as_py())
    for _ in range(200):
        pair = [(names[t], rng.randint(1, 900)) for t in rng.sample(sorted(names), 2)]
        total = np.zeros(len(ids), np.int64)
        most = shard.bound(pair, total)
        score = np.zeros(len(ids), np.int64)
        for place, weight in pair:
            rows, impact, _ = shard.postings(place)
            score[rows] += impact * weight
        assert score.max() == most and (total <= score).all()
