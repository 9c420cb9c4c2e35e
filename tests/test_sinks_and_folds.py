"""Streams with keyed state, sinks with a commit, and saves that keep types."""

import datetime
import decimal
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators import differences, trajectory
from tracewright.sources import array_sink, json_io, typed_json
from tracewright.streaming import folds, ledger


def _drained(query, n):
    """Stop the query once it has read ``n`` rows; one with timers never rests by itself."""
    until = time.time() + 60
    while time.time() < until and query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < n:
        time.sleep(0.2)
    error = query.exception()
    query.stop()
    assert error is None, error


STEPS = "trajectory long, position long, state string, done boolean"


def _batches(spark, folder, parts, since=0):
    for n, part in enumerate(parts, since):
        spark.createDataFrame(part, STEPS).coalesce(1).write.json(f"{folder}/{n}")
        time.sleep(0.05)


def test_folded_steps_agree_with_batch_over_batches_and_a_restart(spark, tmp_path):
    rows = [(t, p, json.dumps({"s": p * t, "n": {"k": p // 3}}) if (p + t) % 3 else None, False) for t in (1, 2, 3) for p in range(12)]
    rows += [(4, 0, '{"a": 1}', True), (4, 1, '{"a": 2}', False)]
    source, out, point = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run(n):
        steps = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).json(f"{source}/*")
        _drained(folds.fold_steps(steps).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).start(), n)

    by_position = [[r for r in rows if lo <= r[1] < lo + 4] for lo in (0, 4, 8)]
    _batches(spark, source, by_position[:2])
    run(sum(map(len, by_position[:2])))
    _batches(spark, source, [by_position[2], [(1, 3, '{"late": 1}', False), (1, 12, None, True), (1, 0, '{"again": 1}', False)]], 2)
    run(len(by_position[2]) + 3)
    found = [r.asDict() for r in spark.read.parquet(out).collect()]
    told = {(r["trajectory"], r["position"]): r for r in found if r["outcome"] == "step"}
    frame = spark.createDataFrame([r[:3] for r in rows if r[0] < 4], "trajectory long, position long, state string")
    batch = trajectory.carry_forward(frame, ["trajectory"], ["position"], "state").withColumn("id", F.col("trajectory") * 100 + F.col("position"))
    expected = differences.attach(batch, "id", "state_before", "state_after").collect()
    assert len(expected) == 36
    for r in expected:
        mine = told[r["trajectory"], r["position"]]
        if (r["trajectory"], r["position"]) == (1, 0):
            continue  # begun anew after its end
        assert (mine["state_before"], mine["state_after"], mine["change_count"]) == (r["state_before"], r["state_after"], r["change_count"])
        assert [(c["path"], c["type"], c["note"]) for c in json.loads(mine["changes"])] == [(c["path"], c["type"], c["note"]) for c in r["changes"]]
    outcomes = sorted((r["trajectory"], r["position"], r["outcome"]) for r in found if r["outcome"] != "step")
    assert outcomes == [(1, 0, "late"), (1, 3, "late"), (1, 12, "ended"), (4, 0, "ended")]
    assert (told[4, 1]["state_before"], told[4, 1]["state_after"]) == (None, '{"a": 2}')


def test_idle_trajectories_expire(spark, tmp_path):
    _batches(spark, str(tmp_path / "in"), [[(1, 0, '{"a": 1}', False)]])
    steps = spark.readStream.schema(STEPS).json(f"{tmp_path}/in/*")
    query = folds.fold_steps(steps, idle_ms=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    found = []
    while time.time() < until and query.isActive and "expired" not in found:
        time.sleep(1)
        if (tmp_path / "out" / "_spark_metadata").exists():
            found = [r["outcome"] for r in spark.read.schema(folds.STEPS).parquet(str(tmp_path / "out")).collect()]
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    assert sorted(found) == ["expired", "step"] and state == 0


def test_appends_read_their_own_batch_only(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, k string, v long")
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    for n in range(20):
        part = [(n * 10 + i, None if i == 3 else "k", n) for i in range(10)] + [(max(n * 10 - 5, 0), "k", -1)]
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{source}/{n:02d}")

    def run(checkpoint, name, where=source):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{where}/*")
        query = ledger.append_once(rows, ["id", "k"], sink, str(tmp_path / checkpoint), name)
        query.awaitTermination(300)
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    read = run("cp1", "one")
    assert len(read) == 20 and max(read) == 11  # the batch, whatever the sink holds
    held = lambda: sorted((r["id"], r["k"]) for r in ledger.read_sink(spark, sink, schema).collect())
    first = held()
    assert len(first) == 200 == len(set(first))
    assert run("cp1", "one") == [] and held() == first  # nothing new
    spark.createDataFrame([(5, "k", 9), (1000, "k", 9), (3, None, 9)], schema).coalesce(1).write.json(str(tmp_path / "more/0"))
    run("cp2", "two", str(tmp_path / "more"))  # a new checkpoint knows what the sink holds
    assert held() == sorted([*first, (1000, "k")], key=str) or set(held()) == {*first, (1000, "k")}


def test_one_array_file_from_many_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('t"é\n'), F.col("id").cast("string"))).alias("text"), F.array(F.col("id"), F.lit(None)).alias("a.b"))
    path = str(tmp_path / "all.json")
    array_sink.write_array(rows.repartition(7), path, [F.col("id").desc()])
    expected = [{"id": i, "text": f't"é\n{i}' if i % 3 else None, "a.b": [i, None]} for i in reversed(range(5000))]
    assert json.loads((tmp_path / "all.json").read_text()) == expected
    assert (tmp_path / "all.json").read_text() == json.dumps(expected, indent=2, ensure_ascii=False) + "\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["all.json"]
    array_sink.write_array(rows.where("false"), path)
    assert json.loads((tmp_path / "all.json").read_text()) == []


def test_a_failed_job_leaves_the_target_as_it_was(spark, tmp_path):
    path = tmp_path / "all.json"
    path.write_text("[1]")
    bad = spark.range(100).repartition(5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop here"):
        array_sink.write_array(bad, str(path))
    assert path.read_text() == "[1]" and sorted(p.name for p in tmp_path.iterdir()) == ["all.json"]


def test_a_task_that_outlives_its_failed_job_leaves_nothing(tmp_path, monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)
        taskAttemptId = staticmethod(lambda: 1)

    monkeypatch.setattr(array_sink.TaskContext, "get", staticmethod(Task))
    writer = array_sink.ArrayWriter({"path": str(tmp_path / "a.json")})
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([('{"n": 0}',)]))
    assert not list(tmp_path.iterdir())


def test_parts_of_failed_attempts_are_left_out(tmp_path, monkeypatch):
    class Task:
        part, attempt = 0, 0

        def partitionId(self):
            return self.part

        def taskAttemptId(self):
            return self.attempt

    task = Task()
    monkeypatch.setattr(array_sink.TaskContext, "get", staticmethod(lambda: task))
    writer = array_sink.ArrayWriter({"path": str(tmp_path / "a.json"), "indent": "0"})

    def broken():
        yield ('{"n": 0}',)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    messages = []
    for part, rows in ((1, ['{"n": 2}', '{"n": 3}']), (2, []), (0, ['{"n": 0}', '{"n": 1}'])):
        task.part, task.attempt = part, 10 + part
        messages.append(writer.write(iter([(r,) for r in rows])))
    writer.commit([*messages, None])
    assert json.loads((tmp_path / "a.json").read_text()) == [{"n": n} for n in range(4)]
    assert [p.name for p in tmp_path.iterdir()] == ["a.json"]


TYPED = T.StructType(
    [
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("at", T.TimestampType()),
        T.StructField("tags", T.ArrayType(T.StringType()), metadata={"as": "set"}),
        T.StructField("pair", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.DecimalType(5, 1))]), metadata={"as": "tuple"}),
        T.StructField("grid", T.MapType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]), T.ArrayType(T.DecimalType(6, 3)))),
        T.StructField("by_day", T.MapType(T.TimestampType(), T.StringType())),
        T.StructField("plain", T.MapType(T.IntegerType(), T.MapType(T.StringType(), T.BooleanType()))),
        T.StructField("deep", T.ArrayType(T.StructType([T.StructField("n", T.DoubleType()), T.StructField("s", T.ArrayType(T.LongType()), metadata={"as": "set"})]))),
    ]
)


def test_types_that_json_lacks_survive_a_save(spark, tmp_path):
    day = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [
        (decimal.Decimal("12.50"), day, ["b", "a", "b"], (7, decimal.Decimal("1.5")), {(1, 2): [decimal.Decimal("0.125"), None]}, {day: "d"}, {3: {"t": True, "n": None}}, [(0.5, [3, 1, 3]), None]),
        (None, None, None, None, None, None, None, None),
        (decimal.Decimal("0.00"), day.replace(microsecond=0), [], (None, None), {}, {}, {}, []),
    ]
    frame = spark.createDataFrame(rows, TYPED)
    typed_json.save_typed(frame, str(tmp_path / "saved"))
    back = typed_json.load_typed(str(tmp_path / "saved"), spark, TYPED)
    assert back.schema.simpleString() == frame.schema.simpleString()
    plain = lambda r: r.asDict(recursive=True)
    expected = [plain(r) for r in frame.collect()]
    expected[0]["tags"], expected[0]["deep"][0]["s"] = ["a", "b"], [1, 3]
    assert sorted(map(plain, back.collect()), key=str) == sorted(expected, key=str)
    first = next(json.loads(t) for t in (r["record"] for r in typed_json.typed_texts(frame).collect()) if "12.50" in t)
    assert first["price"] == {"__type__": "decimal", "value": "12.50"} and first["at"] == {"__type__": "datetime", "value": day.isoformat()}
    assert first["tags"] == {"__type__": "set", "items": ["a", "b"]} and first["pair"]["items"][0] == 7
    assert first["grid"] == {"__type__": "dict", "items": [[{"__type__": "key", "value": {"i": 1, "j": 2}}, [{"__type__": "decimal", "value": "0.125"}, None]]]}
    assert first["plain"] == {"3": {"n": None, "t": True}}


def test_counts_beside_the_write(spark, tmp_path):
    path = str(tmp_path / "lines")
    (tmp_path / "in.jsonl").write_text('{"env": "a", "n": 1}\nbroken\n{"env": "b", "n": 2}\n{"env": "a", "n": null}\n\n{"n": "x"}\n')
    rows, read = json_io.read_lines_counted(spark, str(tmp_path / "in.jsonl"), "env string, n long")
    written = json_io.write_counted(rows, path, "env")
    again = spark.read.json(path)
    assert written == {"rows": again.count(), "environments": again.select("env").where("env is not null").distinct().count()} == {"rows": 3, "environments": 2}
    assert read.get == {"lines": 5, "bad": 2}


def test_wrapped_records_keep_their_keys(spark):
    rows = [(1, '{"data": [{"a": 1}, {"a": 2}]}'), (2, '{"k1": {"trajectory": [1]}, "k2": {"trajectory": [2]}}'), (3, '{"a": 3}'), (4, '{"samples": []}'), (5, "[1]"), (6, "{}")]
    found = json_io.unwrapped(spark.createDataFrame(rows, "id long, record string"))
    told = sorted((r["id"], r["place"], r["key"], r["record"]) for r in found.collect())
    assert told == [(1, 0, None, '{"a":1}'), (1, 1, None, '{"a":2}'), (2, 0, "k1", '{"trajectory":[1]}'), (2, 1, "k2", '{"trajectory":[2]}'), (3, 0, None, '{"a": 3}'), (5, 0, None, "[1]"), (6, 0, None, "{}")]


def test_lines_without_numbers_that_json_lacks(spark, tmp_path):
    schema = "id long, s struct<v: double, a: array<double>>, m map<string, double>"
    rows = [(1, (0.5, [1.0]), {"k": 1.0}), (2, (float("nan"), []), {}), (3, (None, [1.0, float("inf")]), None), (4, None, {"k": float("-inf")}), (5, None, None)]
    json_io.write_lines(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 5]
