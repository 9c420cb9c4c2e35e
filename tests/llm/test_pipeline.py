"""Each stage of the pipeline against a plain version, on documents with awkward rows and columns that carry the operators' own names."""

import random
import zlib
from itertools import combinations

import corpus_pipeline as P
import numpy as np
import pytest
from cases import PASSAGE, TEXTS, words
from pyspark.sql import functions as F
from test_operators import _lines_kept
from test_wide_cases import _greedy_tiles

from tracewright.llm import common, quality

SF = "/root/testdata/sf0.001"
#: Names that the stages' operators use themselves.
CLASHING = ["kept_text", "n_lines", "n_removed", "row", "gone", "every", "kept", "component_id", "n_shingles", "score", "predicted", "held_out", "item_id", "line_no", "key", "rep", "least", "doc", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def rows_of(texts):
    return [(i, t, f"l{n % 5}", f"s{n}", None if t is None else len(t), *[f"{c}{n}" for c in CLASHING]) for n, (i, t) in enumerate(texts)]


def table(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


AWKWARD = TEXTS + [(None, PASSAGE), (None, None), (5, BODY := TEXTS[5][1]), (90, "x " * 30_000)]


def test_lines(spark):
    docs = table(spark, AWKWARD)
    out = P.line_deduplication(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    kept = _lines_kept({i: t for i, t in AWKWARD if i is not None})
    expected = []
    for r in rows_of(AWKWARD):
        i, text = r[:2]
        if i is None or kept[i] == (text or ""):
            expected.append(r)
        elif kept[i].strip(" \n"):
            expected.append((i, kept[i], *r[2:4], len(kept[i]), *r[5:]))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


def test_repeated_ids_keep_their_own_columns(spark):
    texts = [(1, "one text that stands alone here"), (2, "some text of the first row of two"), (2, "other text two"), (2, "other text two\nother text two")]
    out = P.line_deduplication(spark, table(spark, texts), SF)
    assert {r["source"]: r["text"] for r in out.collect()}["s2"] == "other text two"
    assert {r["lang"] for r in out.collect()} <= {f"l{i}" for i in range(4)}


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(8)]
    texts = [(i, " ".join(w if rng.random() > 0.012 else "new" for w in rng.choice(base).split())) for i in range(60)] + AWKWARD[:6] + [(None, "a b c d e f")]
    texts = [(n if i is not None else None, t) for n, (i, t) in enumerate(texts)]
    sets = {i: {tuple(words(t)[p : p + 5]) for p in range(max(1, len(words(t)) - 4))} if words(t) else set() for i, t in texts if i is not None}
    group = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = group[a], group[b]
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    docs = table(spark, texts)
    out = P.near_deduplication(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for r in rows_of(texts) if r[0] is None or group[r[0]] == r[0]], key=str)
    assert 10 < sum(group[i] != i for i in group)


def test_leaks(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(4)
    texts = []
    for n in range(40):
        w = words(rng.choice(items)[1])
        cut = rng.randint(0, len(w))
        texts.append((n, " ".join(["before", *w[cut:], "between", *w[: rng.choice([cut, cut // 2])]])))
    texts += AWKWARD[:5] + [(None, items[0][1])]
    clean = []
    for r in rows_of(texts):
        hit = any(100 * _greedy_tiles(words(t), words(r[1]), 5) >= 80 * len(words(t)) for _, t in items)
        if not hit:
            clean.append(r)
    docs = table(spark, texts)
    out = P.decontamination(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    assert sorted(map(tuple, out.collect()), key=str) == sorted(clean, key=str)
    assert 5 < len(clean) < len(texts) - 5


def test_quality(spark):
    from tracewright.llm import quality

    docs = common.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wide = docs.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASHING])
    kept = P.quality_classifier(spark, wide, SF)
    assert kept.schema.names == wide.schema.names
    good = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in kept.collect()} == good and 0 < len(good) < docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    wrong = [i for i, q in truth.items() if (i in good) != (q == 1)]
    assert len(wrong) < 0.1 * len(truth)


def test_pieces(spark):
    import public_tokenizers  # noqa: F401

    texts = [(i, t) for i, t in AWKWARD if i != 5]
    out = {r["doc_id"]: r for r in P.sentencepiece(spark, table(spark, texts), SF).collect()}
    assert {i: r["decoded"] for i, r in out.items()} == {i: t or "" for i, t in texts if i is not None}
    assert all(r["n_pieces"] == len(r["ids"]) for r in out.values())


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_tables_without_rows(spark, stage):
    assert stage(spark, table(spark, AWKWARD).where("false"), SF).count() == 0


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The driver takes the model, not the labelled texts."""
    n = 60
    docs = spark.createDataFrame([(i, ("good text of words " if i % 2 else "xq zzv qqk ") * (1 + i % 5)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    known = [(r["turn"], i, r["text"], i % 2) for i, r in enumerate(docs.select("text", F.xxhash64("doc_id").alias("turn")).orderBy("doc_id").collect()) if zlib.crc32(str(i).encode()) % 5]
    plain = quality.fit([r[2] for r in sorted(known)], np.array([r[3] for r in sorted(known)], np.int64))

    def here(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(quality, "fit", here)
    model = quality.fitted(docs, labels)
    for name in ("word_vectors", "form_vectors", "w1", "w2"):
        assert np.allclose(getattr(model, name), getattr(plain, name), atol=1e-4)
