import hashlib
import math
import struct
import zlib
from collections import Counter

import pytest
from cases import TEXTS, words

from tracewright.llm import decontaminate, html_text, language_model, line_dedup, minhash, quality, search, sentence_pieces, suffix_dedup, token_files

BY_ID = dict(TEXTS)


def by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def with_odd_rows(spark, docs):
    """A null id and a repeated row besides the texts."""
    more = [(None, "nobody", None, None, None, None, None), (5, BY_ID[5], "en", "src2", 1, "h", 1)]
    return docs.union(spark.createDataFrame(more, docs.schema))


def test_suffix_dedup_against_all_windows(spark, docs, no_docs):
    n = 100
    seen, expected = set(), {}
    for i, text in sorted(BY_ID.items()):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if (w := raw[p : p + n]) in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        expected[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    found = by(suffix_dedup.remove_repeats(docs))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found.items()} == expected
    assert sum(e[1] for e in expected.values()) > 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(with_odd_rows(spark, docs)).count() == len(TEXTS) + 1


def test_suffix_levels_grow_geometrically():
    import numpy as np

    index = suffix_dedup.LevelIndex()
    late = 0
    for b in range(8):
        k = np.arange(100, dtype=np.uint64) + np.uint64(50 * b)
        late += len(index.add(k, k, np.full(100, b), np.zeros(100, np.int64))[0])
    array, (doc, _) = index.close()
    assert len(array[0]) == 450 and late + len(doc) == 350 and (array[2][:50] == 0).all()
    assert len(index.levels) <= 4


def _near(k, percent):
    sets = {}
    for i, t in BY_ID.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, docs, no_docs, k, percent):
    found = by(minhash.near_duplicates(docs, k, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == _near(k, percent)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    if k == 3:
        assert minhash.near_duplicates(no_docs, k, percent).count() == 0
        assert minhash.near_duplicates(with_odd_rows(spark, docs), k, percent).count() == len(TEXTS) + 1


def test_near_duplicates_of_a_repeated_id_with_different_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(50, a), (50, b), (50, ""), (60, a + " end"), (61, b + " end"), (70, c), (75, c), (75, d), (76, d + " end"), (80, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(tuple(r) for r in found) == [(50, 50)] * 3 + [(60, 50), (61, 50), (70, 70), (75, 70), (75, 70), (76, 70), (80, 80)]


def test_sketches_merge_and_estimate():
    import numpy as np

    from tracewright.llm import kernels as K

    x = K.mix(np.arange(1, 4001, dtype=np.uint64))
    draw = lambda v: minhash.registers(v, np.array([0]), 256)
    assert (np.maximum(draw(x[:1500]), draw(x[1000:])) == draw(x)).all()
    a, b = x[:3000], x[1000:]
    guess = minhash.estimate(draw(a), draw(b), np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(guess - 0.5) < 0.12


def test_sentence_pieces_against_the_library(spark, docs, no_docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by(sentence_pieces.encode(docs))
    assert {i: list(r["ids"]) for i, r in found.items()} == {i: model.encode(t or "") for i, t in BY_ID.items()}
    assert all(r["round_trip"] for r in sentence_pieces.piece_digests(docs).collect())
    assert sentence_pieces.piece_digests(no_docs).count() == 0
    assert sentence_pieces.piece_digests(with_odd_rows(spark, docs)).count() == len(TEXTS) + 1


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _allowed(a, b):
    n = min(len(a), len(b))
    return 0 if n < 15 else 1 if n < 40 else 2


def _lines_kept(texts):
    earlier, out = [], {}
    for i, text in sorted(texts.items()):
        kept = []
        for line in (text or "").split("\n"):
            near = any(line == e or (abs(len(line) - len(e)) <= _allowed(line, e) and _edits(line, e) <= _allowed(line, e)) for e in earlier)
            if not line.strip(" ") or not near:
                kept.append(line)
            if line.strip(" "):
                earlier.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_against_all_pairs(spark, docs, no_docs):
    assert {i: r["kept_text"] for i, r in by(line_dedup.dedup_lines(docs)).items()} == _lines_kept(BY_ID)
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert line_dedup.dedup_lines(with_odd_rows(spark, docs)).count() == len(TEXTS) + 1


def test_line_dedup_finds_every_edit_position(spark):
    base = "the rain in spain stays mainly in the plain, they say"
    near = [base[:p] + "#" + base[p:] for p in range(0, len(base), 5)] + [base[:p] + base[p + 1 :] for p in range(0, len(base), 4)]
    near += [base[:p] + "#" + base[p + 1 : 30] + "%" + base[31:] for p in range(0, 25, 3)] + [base[1:] + "?", "?" + base[:-1]]
    texts = dict(enumerate([base, *near, base[:20] + "####" + base[24:]]))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {i: r["kept_text"] for i, r in by(line_dedup.dedup_lines(rows)).items()}
    assert found == _lines_kept(texts)
    assert found[1] == "" and found[len(texts) - 1] != ""


def test_line_dedup_of_short_lines_and_of_a_shared_phrase(spark):
    """Copies one edit apart at 13 to 41 characters, and many lines with the same first half that are no copies."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts, shared = {}, word(30)
    for i, n in enumerate(range(13, 44)):
        one = word(n)
        p = rng.randrange(n)
        texts[3 * i], texts[3 * i + 1], texts[3 * i + 2] = one, one[:p] + "#" + one[p + rng.randint(0, 1) :], one[:p] + one[p + 1 :] + "?"
    for i in range(200, 320):
        texts[i] = shared + word(30)
        if i % 10 == 0:
            texts[i + 1000] = texts[i - i % 20][:40] + "!" + texts[i - i % 20][41:]
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {i: r["kept_text"] for i, r in by(line_dedup.dedup_lines(rows)).items()}
    assert found == _lines_kept(texts) and sum(t == "" for t in found.values()) > 40


def test_bit_parallel_edit_distance(spark):
    import random

    rng, rows = random.Random(2), []
    for _ in range(1500):
        a = "".join(rng.choice("ab日é😀"[: rng.randint(2, 5)]) for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "c", "😀"])
        rows.append((a, "".join(b)))
    found = line_dedup.edit_distance(spark.createDataFrame(rows, "x string, y string"), "x", "y").collect()
    assert all(min(r["distance"], 3) == min(_edits(r["x"], r["y"]), 3) for r in found)


def test_search_against_exhaustive_scores(spark, docs, no_docs):
    tf = {i: Counter(words(t)) for i, t in BY_ID.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)

    def score(w, i):
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * sum(tf[i].values()) / mean))

    expected = set()
    for q in (i for i in tf if i % 20 == 0):
        weights = sorted((round(score(w, q), 6) for w in tf[q] if df[w] >= 2), reverse=True)[:25]
        asked = [w for w in tf[q] if df[w] >= 2 and round(score(w, q), 6) >= weights[-1]]
        total = {}
        for w in asked:
            for i in tf:
                if w in tf[i]:
                    total.setdefault(i, []).append(score(w, i))
        best = sorted(((-round(math.fsum(v) * 1e6), i) for i, v in total.items()))[:3]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in search.more_like_this(docs, k=3, terms=25, min_df=2).select("query_id", "rank", "doc_id", "score_micro").collect()} == expected
    assert search.more_like_this(no_docs).count() == 0


def test_search_with_all_words_against_exhaustive_scores(spark):
    texts = {i: " ".join(f"w{(i * j) % (7 + i % 13)}x{j % 31}" for j in range(1, 90)) for i in range(60)} | {100: "rare only here", 101: "rare only here", 120: None, 140: ""}
    tf = {i: Counter(words(t)) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    score = lambda w, i: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * sum(tf[i].values()) / mean))
    expected = set()
    for q in (i for i in tf if i % 20 == 0):
        total = {i: math.fsum(score(w, i) for w in tf[q] if w in tf[i]) for i in tf if tf[q].keys() & tf[i].keys()}
        best = sorted((-round(s * 1e6), i) for i, s in total.items())[:10]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {tuple(r) for r in search.more_like_this(docs).select("query_id", "rank", "doc_id", "score_micro").collect()}
    assert found == expected
    assert {r[2] for r in found if r[0] == 100} == {100, 101} and max(len(c) for c in tf.values()) > 25


def test_block_max_pruning_is_exact():
    import random

    import numpy as np

    random.seed(3)
    for _ in range(60):
        n, m = random.randint(1, 400), random.randint(1, 6)
        lists = [sorted(random.sample(range(n), random.randint(1, n))) for _ in range(m)]
        row = np.array([r for x in lists for r in x], np.int32)
        score = np.array([random.choice([0.5, 1.0, 2.5]) * random.choice([random.random(), 1.0]) for _ in row])
        ids = np.array(random.sample(range(10_000), n))
        weight = np.array([random.choice([0.1, 1.0, 3.0]) for _ in range(m)])
        index = search.ShardIndex(ids, np.arange(m).astype(np.uint64), np.cumsum([0, *map(len, lists)]), row, score)
        total = {}
        for t, r, s in zip(np.repeat(np.arange(m), [len(x) for x in lists]), row, score, strict=True):
            total.setdefault(int(ids[r]), []).append(s * weight[t])
        k = random.choice([1, 3, 10])
        expected = sorted((-round(math.fsum(v) * 1e6), d) for d, v in total.items())[:k]
        assert [(-s, d) for s, d in index.top(np.arange(m), weight, k)] == expected


def test_many_queries_at_once_are_exact():
    """Frequent and rare terms, copies, floors from other shards, and many queries of one chunk against sums in plain loops."""
    import random

    import numpy as np

    random.seed(5)
    for n in (1, 40, 700):
        held = [sorted(random.sample(range(n), max(1, n // random.choice([1, 2, 5, 40, 400])))) for _ in range(60)]
        held = [x if n < 40 else sorted({*x, *range(20, 36)}) for x in held[:30]] + held[30:]  # rows 20 to 35 are copies in half of the terms
        row = np.array([r for x in held for r in x], np.int32)
        score = np.array([1.25 if 20 <= r < 36 else random.random() for r in row])
        ids = np.array(random.sample(range(10_000), n))
        index = search.ShardIndex(ids, np.arange(60).astype(np.uint64), np.cumsum([0, *map(len, held)]), row, score)
        asks = [sorted(random.sample(range(60), random.randint(0, 30))) for _ in range(90)]
        weight = [np.array([random.choice([0.1, 1.0, 3.0]) for _ in a]) for a in asks]
        floor, expected = np.array([random.choice([0, 0, 2_000_000, 9_000_000]) for _ in asks]), []
        for a, w, least in zip(asks, weight, floor, strict=True):
            total = {}
            for t, x in zip(a, w, strict=True):
                for p in range(index.cut[t], index.cut[t + 1]):
                    total.setdefault(int(ids[row[p]]), []).append(score[p] * x)
            best = sorted((-round(math.fsum(v) * 1e6), d) for d, v in total.items())[:10]
            expected.append([(-s, d) for s, d in best if -s >= least])
        found = index.best(np.array([t for a in asks for t in a], np.int64), np.concatenate(weight), np.cumsum([0, *map(len, asks)]), 10, floor)
        assert [[x for x in f if x[0] >= least] for f, least in zip(found, floor, strict=True)] == expected


def test_queries_of_other_words_leave_a_shard_unsearched(monkeypatch):
    """Queries whose terms cannot reach their floor in a shard, each at its highest, cost no product there; the others find what they did."""
    import numpy as np

    held = [list(range(t % 3, 300, 3)) for t in range(20)]
    row = np.array([r for x in held for r in x], np.int32)
    index = search.ShardIndex(np.arange(300), np.arange(20).astype(np.uint64), np.cumsum([0, *map(len, held)]), row, np.ones(len(row)))
    asks, floor = [[0, 3, 6, 9], [1], [2, 5], [], [4, 7]], np.array([0, 1_000_100, 2_000_000, 0, 9_000_000])
    at, first = np.array([t for a in asks for t in a], np.int64), np.cumsum([0, *map(len, asks)])
    searched, best = [], search.ShardIndex._best
    monkeypatch.setattr(search.ShardIndex, "_best", lambda self, at, weight, first, k, floor: searched.append(len(floor)) or best(self, at, weight, first, k, floor))
    found = index.best(at, np.ones(len(at)), first, 2, floor)
    assert sum(searched) == 2 and found == [[(4_000_000, 0), (4_000_000, 3)], [], [(2_000_000, 2), (2_000_000, 5)], [], []]


def test_search_in_many_shards_and_lots(spark, monkeypatch):
    """Texts of two languages and many lengths, copies, and one doc_id with a row in each language, dealt to small shards and lots."""
    monkeypatch.setattr(search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(search, "QUERY_TERMS", 60)
    text = lambda i: " ".join(f"{'ab'[i % 2]}{(i * i * j) % (11 + i % 5)}" if j % 3 else ("the", "der")[i % 2] for j in range(1, 4 + i % 90))
    rows = [(i, text(i)) for i in range(240)] + [(1000 + i, text(40)) for i in range(25)] + [(2000, text(88)), (2000, text(89)), (2020, None), (2040, "")]
    docs = [(i, Counter(words(t))) for i, t in rows]
    df = Counter(w for _, c in docs for w in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    score = lambda w, c: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    expected = set()
    for q in {i for i, _ in docs if i % 20 == 0} - {2000}:
        asked = {w for i, c in docs if i == q for w in c}
        best = sorted((-round(math.fsum(score(w, c) for w in asked & c.keys()) * 1e6), i) for i, c in docs if asked & c.keys())[:10]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    found = {tuple(r) for r in search.more_like_this(spark.createDataFrame(rows, "doc_id long, text string")).select("query_id", "rank", "doc_id", "score_micro").collect()}
    assert {r for r in found if r[0] != 2000} == expected
    assert sorted(r[1] for r in found if r[0] == 2000) == list(range(1, 11))  # asks as one, whatever lots its rows are dealt to


def test_a_lot_keeps_its_best_across_shards(monkeypatch):
    """Only k documents a query leave a chain of shards, however many it meets, in whatever chunks; like queries ask once."""
    import random

    import numpy as np

    random.seed(11)
    monkeypatch.setattr(search, "HITS", 50)
    monkeypatch.setattr(search, "CELLS", 2000)
    asks = [sorted(random.sample(range(80), random.randint(1, 30))) for _ in range(12)]
    asks.append(asks[3])
    df = np.arange(80) + 1
    start = np.cumsum([0, *map(len, asks)]).astype(np.int32)
    lot = search.Lot(np.arange(13) * 20, start, np.array([t for a in asks for t in a], np.int32), np.arange(80).astype(np.uint64), df, 1000, 10)
    weight, total = search._idf(1000, df), [{} for _ in asks]
    for shard in range(9):
        n = random.randint(1, 200)
        held = [sorted(random.sample(range(n), max(1, n // random.choice([1, 5, 40])))) for _ in range(80)]
        row = np.array([r for x in held for r in x], np.int32)
        score = np.array([random.choice([0.5, random.random()]) for _ in row])
        ids = np.array(random.sample(range(shard * 1000, shard * 1000 + 1000), n))
        cut = np.cumsum([0, *map(len, held)])
        lot.search(search.ShardIndex(ids, np.arange(80).astype(np.uint64), cut, row, score))
        for a, sums in zip(asks, total, strict=True):
            for t in a:
                for p in range(cut[t], cut[t + 1]):
                    sums.setdefault(int(ids[row[p]]), []).append(score[p] * weight[t])
    expected = {(q * 20, d, m) for q, sums in enumerate(total) for m, d in [(-x, d) for x, d in sorted((-search.micro(math.fsum(v)), d) for d, v in sums.items())[:10]]}
    found = list(zip(*(x.tolist() for x in lot.found()), strict=True))
    assert len(found) == 130 and set(found) == expected and len(lot.askers) == 12


def test_quality_learns_and_calibrates(spark):
    clean = [" ".join(f"w{(i * j) % 83}ing" for j in range(1, 40)) for i in range(1, 150)]
    junk = [" ".join(f"W{(i * j) % 83}ING###" for j in range(1, 40)) for i in range(1, 80)]
    rows = list(enumerate(clean + junk)) + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(clean))) for i, _ in rows[:-2]] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = by(quality.classify(docs, labels))
    held = [i for i, r in found.items() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    good = [found[i]["predicted"] == int(i < len(clean)) for i in held if i < 900]
    assert len(good) > 20 and sum(good) / len(good) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert found[900]["score"] == found[901]["score"]
    base = by(quality.classify(docs, labels.where("false")))
    assert len({r["score"] for r in base.values()}) == 1
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_token_files_against_the_tokenizer(spark, docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by(token_files.token_output(spark, docs, str(tmp_path / "tokens")))
    start = 0
    for i, text in sorted(BY_ID.items()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    files = token_files.read(spark, str(tmp_path / "tokens"))
    some = files.where("doc_id between 5 and 7").select("doc_id", "n_tokens")
    assert some.count() == 3 and "ids" not in some.inputFiles()[0]
    assert token_files.token_output(spark, no_docs).count() == 0
    assert token_files.token_output(spark, with_odd_rows(spark, docs)).count() == len(TEXTS) + 1


def test_language_model_counts_and_probabilities(spark, docs, no_docs):
    tokens = {i: [*words(t), None] for i, t in BY_ID.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    found = by(language_model.score(docs))
    for i, t in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    assert language_model.score(no_docs).count() == 0


def test_attention_is_trained_on_all_training_documents(spark, docs, monkeypatch):
    seen = []
    trained = language_model._trained
    monkeypatch.setattr(language_model, "_trained", lambda lists, classes, units: (seen.extend(len(r["ids"]) // 2 + 1 for r in lists.collect()), trained(lists, classes, units))[1])
    monkeypatch.setattr(language_model, "SLICE_IDS", 50)
    language_model.score(docs)
    train = [i for i in BY_ID if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(seen) == len(train) and sum(n == 1 for n in seen) == sum(not words(BY_ID[i]) for i in train)


def test_attention_gradients_against_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_model.start_weights(np.zeros(language_model.CLASSES, np.float32)).items()}
    w["U"] = rng.normal(0, 0.3, w["U"].shape)
    rows, of = rng.integers(0, language_model.INPUTS, (2, language_model.LENGTH)), rng.integers(0, language_model.CLASSES, (2, language_model.LENGTH))
    valid = np.ones((2, language_model.LENGTH), bool)

    def loss():
        z = language_model.attend(w, rows)[0] @ w["U"] + w["b"]
        z = z - z.max(2, keepdims=True)
        return -np.mean(np.take_along_axis(z - np.log(np.exp(z).sum(2, keepdims=True)), of[:, :, None], 2))

    g = language_model.gradients(w, rows, of, valid)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        if name == "E":
            at = (rows[0, 3], 2)
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        down = loss()
        w[name][at] += 1e-5
        assert math.isclose(g[name][at], (up - down) / 2e-5, rel_tol=2e-3, abs_tol=2e-6), name


def test_logits_are_bounded_only_where_they_may_pass_the_bound():
    import numpy as np

    rng = np.random.default_rng(2)
    w = language_model.start_weights(np.zeros(language_model.CLASSES, np.float32)) | {"begins": np.ones(language_model.CLASSES, np.float32)}
    hidden, of = rng.normal(0, 1, (300, language_model.DIM)).astype(np.float32), rng.integers(0, language_model.CLASSES, 300)
    for size in (0.3, 40.0):
        w["U"] = rng.normal(0, size, w["U"].shape).astype(np.float32)
        layer, logits = np.vstack([w["U"], w["b"]]), hidden.astype(np.float64) @ w["U"]
        assert language_model._may_pass(hidden, layer) == (size > 1) and (logits.max() > 60) == (size > 1)
        bounded = np.minimum(logits, 60)
        expected = (bounded[np.arange(300), of] - np.log(np.exp(bounded).sum(1))) / np.log(10)
        found, begin = language_model.class_log10(w, hidden, of)
        assert np.isfinite(found).all() and np.abs(begin).max() < 1e-3 and np.allclose(found[expected > -20], expected[expected > -20], atol=1e-3)
    assert language_model._may_pass(np.full((1, language_model.DIM), np.nan, np.float32), layer)


def test_members_of_classes_gradients_and_probabilities():
    """Every member counts: gradients of the two-step loss, probabilities that add up to 1, and padding that gives none."""
    import numpy as np

    lm, rng = language_model, np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in lm.start_weights(np.zeros(lm.CLASSES, np.float32)).items()}
    w["U"], w["M"] = rng.normal(0, 0.3, w["U"].shape), rng.normal(0, 0.3, w["M"].shape)
    last = lm.LENGTH - lm.CONTEXT
    rows, of, member = rng.integers(0, lm.INPUTS, (2, lm.LENGTH)), rng.integers(0, lm.CLASSES, (2, last)), rng.integers(0, lm.MEMBERS, (2, last))
    valid = np.ones((2, last), bool)
    valid[1, 20:] = False
    of[0, 0], of[1, 20] = lm.OWN, lm.CLASSES - 1

    def parts(h, c):
        z = h @ w["U"] + w["b"]
        inner = np.append(h, 1) @ w["M"][c - lm.OWN] if c >= lm.OWN else np.zeros(1)
        return z - np.log(np.exp(z).sum()), inner - np.log(np.exp(inner).sum())

    def loss():
        out = []
        for h, c, m, ok in zip(lm.attend(w, rows)[0][:, lm.CONTEXT :].reshape(-1, lm.DIM), of.ravel(), member.ravel(), valid.ravel(), strict=True):
            outer, inner = parts(h, c)
            out += [-outer[c] - (inner[m] if c >= lm.OWN else 0)] if ok else []
        return np.mean(out)

    g = lm.gradients(w, rows, of, valid, member)
    for name, at in [("M", (0, 3, member[0, 0])), ("M", (0, lm.DIM, member[0, 0])), ("E", (rows[0, 3], 2)), ("Q", (1, 2)), ("K", (3, 4)), ("V", (5, 6)), ("P", (9, 1)), ("U", (2, of[0, 0]))]:
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        down = loss()
        w[name][at] += 1e-5
        assert math.isclose(g[name][at], (up - down) / 2e-5, rel_tol=2e-3, abs_tol=2e-6), name
    hidden = rng.normal(0, 1, (lm.MEMBERS, lm.DIM))
    hidden[:] = hidden[0]
    found = lm.member_log10(w, hidden, np.full(lm.MEMBERS, lm.CLASSES - 1), np.arange(lm.MEMBERS))
    assert abs((10**found).sum() - 1) < 1e-6 and np.allclose(found, parts(hidden[0], lm.CLASSES - 1)[1] / np.log(10), atol=1e-5)


def test_a_thousand_ids_are_members_of_their_own():
    import numpy as np

    begins = language_model._begins(None)
    counts = np.random.default_rng(4).zipf(1.3, language_model.VOCABULARY + 1).clip(0, 10**6)
    classes = language_model.Classes(counts, begins)
    place = classes.of * language_model.MEMBERS + classes.member
    assert (np.bincount(place)[place] == 1).sum() > 1000
    kinds = {(int(c), int(b)) for i, (c, b) in enumerate(zip(classes.of, begins, strict=True)) if i != language_model.END}
    assert len(kinds) == len({c for c, _ in kinds})  # words begin in all ids of a class or in none
    total = np.bincount(place, weights=10**classes.share)
    assert np.allclose(total[total > 0], 1)


def test_a_task_of_the_model_has_one_thread_for_products(spark):
    def threads(_):
        lib, end = language_model._blas()
        language_model.one_thread()
        yield getattr(lib, f"scipy_openblas_get_num_threads{end}")()

    if language_model._blas():
        assert spark.sparkContext.parallelize([0], 1).mapPartitions(threads).collect() == [1]


def test_context_lowers_held_out_loss(spark, monkeypatch):
    """Which word follows the eighth "x" is told only by words nine places back."""
    texts = [(i, " ".join(["x"] * 8 + [("apple", "stone", "river")[i % 3]]) + " " + " ".join((["x"] * 8 + [("apple", "stone", "river")[i % 3]]) * 5)) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)

    def loss():
        rows = language_model.score(docs).where("held_out").collect()
        return -sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows), -sum(r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)

    with_context, counts_only = loss()
    monkeypatch.setattr(language_model, "_trained", lambda lists, classes, units, trained=language_model._trained: {k: v * 0 if k in "OV" else v for k, v in trained(lists, classes, units).items()})
    without, _ = loss()
    assert with_context < without and with_context < 0.6 * counts_only


def test_scores_do_not_follow_the_partitioning(spark, docs):
    one, other = by(language_model.score(docs)), by(language_model.score(docs.repartition(5)))
    assert all(abs(one[i]["score"] - other[i]["score"]) < 1e-3 for i in one)


def test_word_probabilities_add_up_to_at_most_one():
    """Over all one-id words after a document's start, an end behind each: counts and spelling mixed at every weight."""
    import numpy as np

    rng = np.random.default_rng(1)
    begins = language_model._begins(None)
    counts = rng.integers(0, 5, language_model.VOCABULARY + 1)
    classes = language_model.Classes(counts, begins)
    w = language_model.start_weights(classes.prior)
    w["U"] = rng.normal(0, 0.3, w["U"].shape).astype(np.float32)
    first = np.flatnonzero(begins)
    ids = np.concatenate([np.stack([first, np.full(len(first), language_model.END)], 1).ravel(), [language_model.END]])
    offs = np.append(np.arange(0, 2 * len(first) + 1, 2), 2 * len(first) + 1)
    score, begin = language_model.stream_scores(w, classes, ids, offs)
    starts = np.arange(len(ids))
    every = np.where(ids == language_model.END, counts[language_model.END], counts[ids])
    counted, _, spelt = language_model.word_parts(score, begin, starts, ids == language_model.END, every, int(counts[first].sum() + counts[language_model.END]))
    kept = np.append(np.arange(0, 2 * len(first), 2), len(ids) - 1)  # each word once, and the end at a document's start
    assert spelt[kept].sum() <= 1 + 1e-3 and abs(counted[kept].sum() - 1) < 1e-9


def test_every_place_has_its_context():
    import numpy as np

    offs = np.array([0, 500])
    place, scored, _ = language_model.windows(offs)
    before = (place - place[:, :1])[scored]
    assert (before >= np.minimum(place[scored], 8)).all()


def test_windows_score_each_place_once():
    import numpy as np

    offs = np.cumsum([0, 1, 32, 33, 57, 200])
    place, scored, row = language_model.windows(offs)
    assert sorted(place[scored].tolist()) == list(range(offs[-1]))
    assert (np.searchsorted(offs, place[scored], "right") - 1 == np.repeat(row, scored.sum(1))).all()


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank"), (2, "nothing like this is anywhere at all in here"), (3, "a b"), (4, None), (5, ""), (6, "seven tall men watch from the wooden bridge above it. near the old river bank while")]


def test_decontamination_and_reordered_passages(spark, docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = by(decontaminate.contamination(docs, bench))
    hits = {i: r["item_id"] for i, r in found.items() if r["contaminated"]}
    assert hits == {0: 1, 1: 1, 8: 3, 9: 3, 20: 1, 21: 1}
    assert found[0]["n_items"] == 2 and found[0]["matched"] == found[0]["item_words"] == 14
    assert found[2]["item_id"] is None and not found[2]["contaminated"]
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(BY_ID) - set(hits)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.where("false")).collect())


def test_large_test_sets_are_joined(spark, docs, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    held = {tuple(r) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == held and held


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><h1>A &amp; B</h1><p>one<p>two <b>bold</b>
 x<br>y<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>d</ol><table><tr><th>Name<th>N<tr><td>alpha<td>1</table>
<div hidden>h</div><div style="display: none">h</div><pre> k
  m</pre><script>var a="</p>";</script>end<!-- c --></body>"""
TEXT = "A & B\n\none\n\ntwo bold x\ny\n\n- a\n- b\n  - c\n\n3. d\n\nName   N\nalpha  1\n\n k\n  m\n\nend"


def test_html_layout(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (5, "u", "<" * 50 + "a" + "<div>" * 3000 + "deep"), (6, "u", "a < b &nbsp;&lt;i&gt;")]
    found = by(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert found[1]["text"] == TEXT
    assert found[2]["text"] == found[3]["text"] == "" and found[None]["text"] == "x"
    assert found[5]["text"].endswith("deep") and found[6]["text"] == "a < b  <i>"


def test_html_layout_at_any_depth():
    for depth in (50, 130, 20_000):
        for tag in ("span", "div"):
            page = f"<{tag}>" * depth + "a<div hidden>no</div><svg>no</svg><template>no</template><ul><li>b<li>c</ul><table><tr><td>d<td>e</table><b>f</b>" + f"</{tag}>" * depth + "g"
            tail = "fg" if tag == "span" else "f\ng"
            assert html_text.visible_text(page) == "a\n\n- b\n- c\n\nd  e\n\n" + tail


def test_unclosed_tags_take_linear_time_and_breaks_make_blank_lines():
    import time

    began = time.time()
    assert html_text.visible_text("x>" + "<a " * 100_000).startswith("x>")
    assert html_text.visible_text("<p>a" + "<!-- " * 100_000) == "a"
    assert time.time() - began < 20
    assert html_text.visible_text("a<br>b<br><br>c<br><br><br>d") == "a\nb\n\nc\n\nd"


def test_components_against_union_find(spark):
    import random

    from tracewright.llm.components import components

    random.seed(5)
    pairs = [(i, i + 1) for i in range(100, 130)] + [(200, 300 + i) for i in range(20)] + [(random.randint(400, 440), random.randint(400, 440)) for _ in range(40)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    expected = {x: root(x) for x in parent}
    found = components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
