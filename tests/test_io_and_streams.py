import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import formatting, joins, metrics, trajectory
from tracewright.sources import json_io
from tracewright.streaming import steps


def _put(path, text):
    path.write_text(text)
    return str(path)


def _records(df):
    return sorted((json.loads(r["record"]) for r in df.collect()), key=str)


def test_records_of_array_object_and_lines(spark, tmp_path):
    two = [{"trajectory": [1]}, {"trajectory": [2]}]
    assert _records(json_io.read_records(spark, _put(tmp_path / "a.json", json.dumps(two, indent=1)))) == two
    assert _records(json_io.read_records(spark, _put(tmp_path / "o.json", json.dumps(two[0])))) == two[:1]
    assert _records(json_io.read_records(spark, _put(tmp_path / "x.json", '{"other": 1}'))) == []
    assert _records(json_io.read_records(spark, _put(tmp_path / "l.jsonl", json.dumps(two[0]) + "\nbroken\n\n" + json.dumps(two[1])))) == two
    assert _records(json_io.read_records(spark, _put(tmp_path / "e.json", ""))) == []


def test_broken_documents_are_errors(spark, tmp_path):
    for n, text in enumerate(('[{"trajectory": [1]} {"trajectory": [2]}]', '{"trajectory": [1],\n"a":\n[2]\n')):
        with pytest.raises(Exception, match="does not read whole"):
            json_io.read_records(spark, _put(tmp_path / f"{n}.json", text)).collect()
    cut = json_io.read_records(spark, _put(tmp_path / "cut.json", '[{"trajectory": [1]},\n{"trajectory": [2]},\n{"trajectory": [3]}'))
    assert _records(cut) == [{"trajectory": [n]} for n in (1, 2, 3)]
    lines = json_io.read_records(spark, _put(tmp_path / "l.jsonl", 'broken\n{"a": 1}\n{"a": 2}'))
    assert _records(lines) == [{"a": 1}, {"a": 2}]


def test_unwrap(spark):
    rows = [('{"data": [{"a": 1}, {"a": 2}]}',), ('{"k1": {"trajectory": [1]}, "k2": {"trajectory": [2]}}',), ('{"a": 3}',)]
    assert _records(json_io.unwrap(spark.createDataFrame(rows, "record string"))) == sorted([{"a": 1}, {"a": 2}, {"trajectory": [1]}, {"trajectory": [2]}, {"a": 3}], key=str)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "x"), (2, float("nan"), "y"), (3, None, None)], "id long, v double, k string")
    json_io.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(r["id"] for r in json_io.read_lines(spark, str(tmp_path / "lines"), "id long, v double").collect()) == [1, 3]
    json_io.write_by_key(rows, "k", str(tmp_path / "keys"))
    assert sorted(p.name for p in (tmp_path / "keys").iterdir() if p.is_dir()) == ["k=x", "k=y"]
    json_io.write_split(rows, F.col("id") > 1, str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["side=false", "side=true"]
    for _ in range(2):
        json_io.append_new(rows.select("id"), str(tmp_path / "log"), ["id"], "id long")
    assert spark.read.schema("id long").json(str(tmp_path / "log")).count() == 3


def test_streamed_states_agree_with_batch(spark, tmp_path):
    rows = [(t, p, f'{{"s": {p}}}' if p % 3 == 0 and p else None) for t in (1, 2) for p in range(8)]
    for n, part in enumerate((rows[:4] + rows[8:12], rows[4:8] + rows[12:])):
        spark.createDataFrame(part, "trajectory long, position long, state string").coalesce(1).write.json(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema("trajectory long, position long, state string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    out = steps.carry_forward(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    batch = trajectory.carry_forward(spark.createDataFrame(rows, "trajectory long, position long, state string"), ["trajectory"], ["position"], "state")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("trajectory", "position", "state_before", "state_after").collect()} == {tuple(r) for r in batch.select("trajectory", "position", "state_before", "state_after").collect()}


def test_streamed_append_and_route(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "id long, k string").write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, k string").json(str(tmp_path / "in"))
    for n in range(2):
        steps.append_unseen(stream(), ["id"], str(tmp_path / "sink"), str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3
    steps.route(stream(), "k", str(tmp_path / "routed"), str(tmp_path / "cpr")).awaitTermination(120)
    assert {"k=a", "k=b"} <= {p.name for p in (tmp_path / "routed").iterdir()}


def test_small_operators(spark):
    one = spark.range(1)
    made = one.select(formatting.normalized(F.lit("a\\qb\\n\r")).alias("n"), formatting.section(F.lit("# A\nx\n\n# B\ny"), "A").alias("s"), formatting.score(F.lit("Usefulness: 7"), "Usefulness").alias("u"), formatting.numbered_list(F.array(F.lit("a"), F.lit("b"))).alias("l")).first()
    assert (made["n"], made["s"], made["u"], made["l"]) == ("a\\\\qb\\n", "x", 7, "1. a\n2. b")
    counts = spark.createDataFrame([(3,), (4,), (5,), (6,)], "n int")
    assert metrics.upper_median(counts, "n").first()[0] == 5
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    new = spark.createDataFrame([(2, "new")], "id long, v string")
    assert {tuple(r) for r in joins.merge_retried(old, new, ["id"]).collect()} == {(1, "old"), (2, "new")}
    single = spark.createDataFrame([(1, (5,), None), (2, None, [(6,), (7,)]), (3, None, [])], "id long, step_detail struct<x:int>, trajectory array<struct<x:int>>")
    assert sorted((r["id"], r["step_detail"]["x"]) for r in trajectory.single_or_all(single, "step_detail", "trajectory").collect()) == [(1, 5), (2, 6), (2, 7)]
