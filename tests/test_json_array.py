"""Arrays read in ranges against a plain parser, cut at every place; folders of mixed formats."""

import json
import random

import pyarrow as pa
import pytest

from tracewright.sources import json_array, json_io

TRICKY = [{"a": 'x}],{"y"\\'}, [1, [2, {"b": "}"}]], "s, ] [ \" \\\\", 12, None, True, {}, [], {"é": "日本}"}, -1.5e3]
TEXTS = [json.dumps(TRICKY), json.dumps(TRICKY, indent=2, ensure_ascii=False), "\n " + json.dumps(TRICKY, ensure_ascii=False) + " \n", "[]", " [ ] ", "", "[{}]", json.dumps([TRICKY] * 3)]


def _batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _by_hand(text, cuts):
    """The two passes over chunks that belong to ranges beginning at ``cuts``, with plain running sums between them."""
    data = text.encode()
    chunks, at = [], 0
    for body in data.split(b"}"):
        chunks.append((at, body))
        at += len(body) + 1
    if chunks[-1][1] == b"":
        chunks.pop()
    if not chunks:
        return []
    own = [(max(c for c in cuts if c <= start), body) for start, body in chunks]
    rows = [("f", at, len(data), body) for at, body in own]
    ranges = [r for b in json_array._ranges(iter([_batch(rows, ["file", "at", "size", "body"])])) for r in b.to_pylist()]
    bare = sum(r["n_bytes"] for r in ranges) > len(data)
    starts, depth, quotes = {}, 0, 0
    for r in ranges:
        inside = quotes % 2 == 1
        starts[r["at"]] = (depth, inside, bare and r is ranges[-1])
        depth += r["deeper_in"] if inside else r["deeper_out"]
        quotes += r["quotes"]
    met = [("f", at, *starts[at], body) for at, body in own]
    found, open_ = [], None
    for b in json_array._pieces(iter([_batch(met, ["file", "at", "depth", "inside", "bare", "body"])])):
        for p in b.to_pylist():
            open_ = p["piece"] if p["first"] else open_ + p["piece"]
            if p["last"] and not (p["final"] and open_.strip() == ""):
                found.append(json.loads(open_))
    return found


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_ranges_cut_at_every_place(text):
    whole = json.loads(text)
    for cut in range(1, len(text.encode()) + 1):
        assert _by_hand(text, [0, cut]) == whole
    rng = random.Random(3)
    for _ in range(200):
        assert _by_hand(text, [0, *rng.sample(range(1, len(text) + 50), 5)]) == whole


def _read(spark, path):
    return [json.loads(r["record"]) for r in json_array.read_array(spark, path).orderBy("file", "at", "nth").collect()]


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_arrays_in_ranges_of_any_size(spark, tmp_path, size):
    for n, text in enumerate(TEXTS):
        (tmp_path / f"{n}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        assert _read(spark, str(tmp_path)) == [x for t in TEXTS if t for x in json.loads(t)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [9, 1 << 20])
def test_cut_tails_keep_what_came_before(spark, tmp_path, size):
    items = [{"n": i, "t": "}, {"} for i in range(4)]
    text = json.dumps(items)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for cut in (1, 5, 20, 23, 24, 25, 26, 40, len(text) - 3, len(text) - 2, len(text) - 1):
            path = tmp_path / f"{cut}.json"
            path.write_text(text[:cut])
            decoder, at, expected = json.JSONDecoder(), 1, []
            while at < cut:
                try:
                    item, at = decoder.raw_decode(text[:cut], at)
                except ValueError:
                    break
                expected.append(item)
                at += 2
            assert _read(spark, str(path)) == expected, cut
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_array_far_larger_than_a_range_by_shuffle_and_by_broadcast(spark, tmp_path, monkeypatch):
    items = [{"n": i, "text": "x}" * (i % 50), "deep": {"k": [i, {}]}} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert _read(spark, str(tmp_path)) == items
        monkeypatch.setattr(json_array, "MOST_RANGES", 0)
        assert _read(spark, str(tmp_path)) == items
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ['[{"a": 1} {"a": 2}]', '[{"a": 1}, {"b" 2}, 3]', '{"a": [1, 2]}', "[1,, 2]"])
def test_documents_that_are_no_arrays_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="does not read whole|not a JSON array"):
        json_array.read_array(spark, str(tmp_path)).collect()


def test_folders_of_mixed_formats_give_all_records(spark, tmp_path):
    (tmp_path / "a b.jsonl").write_text('{"n": 1}\n\n{"n": 2} trailing\n{"n": 3}\nbroken\n[4]')
    (tmp_path / "b.json").write_text(json.dumps([{"n": 5}, {"n": 6}], indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"trajectory": [7]}, indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"other": 8}))
    (tmp_path / "e.json").write_text('[{"n": 9}]\n[{"n": 10}]')
    (tmp_path / "f.json").write_text('{"trajectory": 11}')
    (tmp_path / "g.json").write_text(" \n")
    found = sorted(json.dumps(json.loads(r["record"])) for r in json_io.read_records(spark, str(tmp_path)).collect())
    assert found == sorted(map(json.dumps, [{"n": 1}, {"n": 3}, [4], {"n": 5}, {"n": 6}, {"trajectory": [7]}, [{"n": 9}], [{"n": 10}], {"trajectory": 11}]))
    kinds = {r["file"].rsplit("/", 1)[1]: r["kind"] for r in json_io.formats(spark, str(tmp_path)).collect()}
    assert kinds == {"a%20b.jsonl": "lines", "b.json": "array", "c.json": "object", "d.json": "object", "e.json": "lines", "f.json": "object"}
