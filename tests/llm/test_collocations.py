"""Phrases against plain counting, at every length and with many shards."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import LOWER, TEXTS

from tracewright.llm import collocations as C


def brute(rows, least, longest=5, top=2000):
    total, count = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    out = []
    cand = {x: a for x, a in count.items() if a >= least and len(x[1]) > 1}
    inside = set()
    for (lang, ws), b in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if b >= cand[lang, ws[i : i + k]]:
                    inside.add((lang, ws[i : i + k]))
    for (lang, ws), a in cand.items():
        if (lang, ws) in inside:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, ws[:k]] * count[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), count[lang, ws[:k]], count[lang, ws[k:]], total[lang]))
    ranked, nth = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        nth[lang] += 1
        if nth[lang] <= top:
            ranked.append((lang, nth[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def corpus(seed, n, words, lengths):
    rng = random.Random(seed)
    some = ["the", "of", "a", "Ünï", "日本", "b", "ab", "the\x0bx", "q\x00", "É"] + [f"w{i}" for i in range(words)]
    fixed = [" ".join(rng.choice(some) for _ in range(rng.randint(2, 7))) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(some) + rng.choice(["", "", "", ".", ",", "!", "\n", "\t"]) for _ in range(rng.randint(0, lengths))]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(parts)))
    return rows


@pytest.mark.parametrize(("least", "longest", "top", "shard", "sent"), [(3, 5, 2000, 1 << 24, 300), (2, 5, 7, 300, 0), (2, 2, 2000, 500, 9), (4, 3, 5, 1, 9999), (2, 7, 2000, 2000, 0)])
def test_phrases_against_plain_counting(spark, monkeypatch, least, longest, top, shard, sent):
    """``sent``: how many frequent phrases are few; with 0 every level meets its shards by a shuffle."""
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    monkeypatch.setattr(C, "MOST_SENT", sent)
    rows = corpus(least + longest, 120, 8, 30)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = [tuple(r) for r in C.phrases(docs, least, longest, top).collect()]
    assert sorted(found) == brute(rows, least, longest, top)
    assert len(found) > 8


def test_the_same_texts_of_the_other_operators(spark, docs):
    found = sorted(tuple(r) for r in C.phrases(docs.select("*", docs["n_chars"].alias("a"), docs["lang"].alias("phrase")), least=3).collect())
    assert found == brute([("en" if i % 2 else None, t) for i, t in TEXTS], 3) and any(a == 699 for _, _, _, a, *_ in found)


def test_empty_and_blank_tables(spark, no_docs):
    assert C.phrases(no_docs, 1).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\n"), ("de", "one")], "lang string, text string")
    assert C.phrases(blank, 1).count() == 0


def test_exact_arithmetic_beyond_64_bits(spark):
    big = 10**15
    row = spark.createDataFrame([(7 * big, 9 * big, [7 * big + 1, 8 * big], [8 * big + 3, 7 * big + 5])], "a long, n long, heads array<long>, tails array<long>")
    left, right, score = C._score(row["n"], row["a"], row["heads"], row["tails"])
    found = row.select(left.alias("l"), right.alias("r"), score.alias("score")).first()
    cuts = [(1000 * 7 * big * 9 * big // (x * y), k, x, y) for k, (x, y) in enumerate([(7 * big + 1, 8 * big + 3), (8 * big, 7 * big + 5)])]
    assert (found["score"], found["l"], found["r"]) == (min(cuts)[0], *min(cuts)[2:])


def test_ranks_of_a_score_that_ties(spark):
    rows = [("en", "b a. b a. a c. a c. é z. é z. zz z. zz z")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert [tuple(r) for r in C.phrases(docs, 2).orderBy("rank").collect()] == brute(rows, 2)


def test_planes_and_parts():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 62), 1 << 62, 500)
    assert (C.from_planes(C.planes(x)) == x).all() and len(C.planes(x)) == 4000
    part = C.part_of(np.arange(100_000), np.arange(100_000) // 7, 64)
    assert np.bincount(part, minlength=64).min() > 1200  # even, whatever the ids
    a, b = rng.integers(0, 1 << 50, 300), rng.integers(0, 1 << 50, 300)
    assert (C.matches(a, b, a[::-1], b[::-1]) == np.arange(299, -1, -1)).all() and (C.matches(a, b, a, b + 1) < 0).all()


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_intervals_of_both_orders_hold_all_places(depth):
    rng = np.random.default_rng(depth)
    ids = np.concatenate([[0], rng.integers(0, 4, 300), [0]]).astype(np.int32)
    order = C.depth_order(ids, depth)
    heads = [tuple(np.roll(ids, -i)[:depth]) for i in order]
    assert heads == sorted(heads)
    symbols = C.transform(ids, depth)
    assert sorted(symbols) == sorted(ids) and sorted(C.walk(symbols)) == list(range(len(ids)))
