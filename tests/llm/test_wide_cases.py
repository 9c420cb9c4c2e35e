"""Held-out figures, independent tilings, very long texts and large classes of copies."""

import random
import zlib

import pytest
from cases import TEXTS, words
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, line_dedup, minhash, quality, sentence_pieces, suffix_dedup, token_files


def test_large_classes_of_copies_meet_their_class_by_broadcast(spark, docs, monkeypatch):
    usual = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "HOT_ROWS", 1)
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == usual
    monkeypatch.setattr(minhash, "HOT_ROWS", 0)
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == usual


def _greedy_tiles(item, text, least):
    """Words of ``item`` in tiles, by comparing words at every pair of places."""
    free_i, free_t = [True] * len(item), [True] * len(text)
    for size in range(min(len(item), len(text)), min(least, len(item)) - 1, -1):
        for i in range(len(item) - size + 1):
            for j in range(len(text) - size + 1):
                if all(free_i[i : i + size]) and all(free_t[j : j + size]) and item[i : i + size] == text[j : j + size]:
                    free_i[i : i + size] = free_t[j : j + size] = [False] * size
                    break
    return free_i.count(False)


def test_leaks_against_tiling_of_words(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([1, 3, 5, 9, 20, 31])))) for i in range(14)]
    texts = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(items)[1].split()
            cut = rng.randint(0, len(w))
            parts += rng.choice([w, w[cut:] + w[:cut], w[: cut // 2] + ["other"] + w[cut // 2 :], w[cut:]])
        texts.append((d, " ".join(parts)))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    expected = set()
    for d, text in texts:
        for i, item in items:
            n, matched = len(words(item)), _greedy_tiles(words(item), words(text), 5)
            if 100 * matched >= 80 * n:
                expected.add((d, i, matched, n))
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == expected
    assert len(expected) > 20 and any(m < n for _, _, m, n in expected)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.classify(common.documents(spark, sf), labels).where("held_out")
    rows = [(r["score"], r["predicted"], r["quality"]) for r in scored.join(labels.select("doc_id", "quality"), "doc_id").where("quality is not null").collect()]
    good, bad = ([s for s, _, q in rows if q == x] for x in (1, 0))
    assert len(good) >= 10 and len(bad) >= 10
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(p == q for _, p, q in rows) / len(rows) > 0.9
    assert abs(sum(s for s, _, _ in rows) / len(rows) - len(good) / len(rows)) < 0.1  # calibrated on the whole


LONG = " ".join(f"w{random.Random(i).randrange(1 << 40)}" for i in range(20_000)) + "\n" + "A line of its own stands here at the end of the text\nA line of its own stands here at the end of the text"


def test_very_long_texts(spark):
    rows = [(1, LONG), (2, LONG), (3, LONG + " more"), (4, "short"), (5, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    w = words(LONG)
    assert near[1] == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}), 1) and [near[i][1] for i in (2, 3, 4, 5)] == [1, 1, 4, 1]
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[1]["n_bytes"] == len(LONG) and cut[1]["n_removed"] == 0 and cut[2]["n_removed"] == cut[5]["n_removed"] == len(LONG)
    assert cut[3]["n_removed"] == len(LONG) and cut[3]["kept_text"] == " more"
    lines = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[1] == (3, 1) and lines[2] == lines[5] == (3, 3) and lines[4] == (1, 0)
    bench = spark.createDataFrame([(9, "a LINE of its own stands here at the end")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()} == {1, 2, 3, 5}
    back = sentence_pieces.decode(sentence_pieces.encode(docs)).select("doc_id", "decoded").collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == dict(rows)


def test_token_counts_of_very_long_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode(LONG, add_special_tokens=False).ids + [2]
    docs = spark.createDataFrame([(1, LONG), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_output(spark, docs).collect()}
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert found == {1: (0, len(ids), crc(ids)), 2: (len(ids), 1, crc([2]))}


@pytest.mark.parametrize("lost", ["text", "doc_id"])
def test_columns_that_hold_only_nulls(spark, lost):
    docs = spark.createDataFrame([(i, t) for i, t in TEXTS if t], "doc_id long, text string").withColumn(lost, F.lit(None).cast("string" if lost == "text" else "long"))
    n = 0 if lost == "doc_id" else docs.count()
    assert minhash.near_duplicates(docs).count() == n
    assert suffix_dedup.remove_repeats(docs).where("n_removed = 0").count() == n
    assert line_dedup.dedup_lines(docs).count() == n


def test_words_whose_sums_of_powers_agree_are_told_apart(spark):
    """A long word of two letters in the order of Thue and Morse and its complement have the same polynomial hash modulo 2**64 under every base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, f"{one} x y"), (5, f"{two} x y")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
