"""Small cases of the curation and formatting operators that no query shows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.operators import curation, formatting


def test_padded_ids_with_payload_over_many_ranges(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload")).repartition(7)
    found = formatting.padded_ids(rows, ["k"], width=3)
    numbers = found.select("k", F.col("sample_id").cast("long").alias("n"), F.length("sample_id").alias("w"))
    assert numbers.agg(F.countDistinct("n"), F.min("n"), F.max("n"), F.min("w")).first()[:] == (200_000, 1, 200_000, 3)
    first = [r["n"] for r in numbers.orderBy("k").limit(50).collect()]
    assert first == list(range(1, 51))
    assert formatting.padded_ids(rows.where("false"), ["k"]).count() == 0


def test_guard_fails_on_unknown_environments_and_other_classes(spark):
    envs = spark.createDataFrame([(1, "A", "x")], "env long, cls string, code string")
    ok = curation.guarded(spark.createDataFrame([(1, "A")], "env long, cls string"), envs, "env", "cls").collect()
    assert [tuple(r) for r in ok] == [(1, "A", "x")]
    for bad in [(2, "A"), (1, "B"), (None, "A")]:
        with pytest.raises(PySparkException):
            curation.guarded(spark.createDataFrame([bad], "env long, cls string"), envs, "env", "cls").collect()


def test_lists_offsets_and_reasons(spark):
    row = spark.range(1).select(
        curation.zipped(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit("a"), F.lit("b"))).alias("z"),
        formatting.reason_or_skip(F.array().cast("array<int>"), F.lit("why")).alias("skipped"),
        formatting.reason_or_skip(F.array(F.lit(1)), F.lit("why")).alias("kept"),
        formatting.introduction(F.lit("shop"), F.array(F.lit("r1"), F.lit("r2"))).alias("intro"),
        formatting.markdown_row(F.lit(1), F.lit(None)).alias("row"),
        formatting.stats_line(F.lit("t"), [F.lit(3), F.lit(None).cast("int")]).alias("stats"),
        formatting.stamp(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("stamp"),
        formatting.checklist(F.lit("no list")).alias("none"),
        curation.finished_talking(F.lit("user"), F.lit("bye ###STOP###")).alias("stop"),
    ).first()
    assert [tuple(x) for x in row["z"]] == [(1, "a"), (2, "b")]
    assert (row["skipped"], row["kept"], row["none"], row["stop"]) == ("", "why", [], True)
    assert row["intro"] == "# Environment Information\n\n## Brief Introduction:  \nshop\n\n## Environment Rules / Constraints:  \n- r1\n- r2\n"
    assert (row["row"], row["stats"], row["stamp"]) == ("| 1 | - |", "t | 3 | 0", "20240506_070809")
    ten = spark.range(10)
    assert [r[0] for r in curation.resumed(ten, "id", 3, 2).collect()] == [3, 4] and curation.resumed(ten, "id", 8, 0).count() == 2
    assert curation.one_task(ten, "id", "s").collect() == curation.one_task(ten.repartition(3), "id", "s").collect()
    assert [r[0] for r in curation.restored(ten.orderBy(F.desc("id")), "id").collect()] == list(range(10))


def test_task_info_and_dropped_fields(spark):
    rows = spark.createDataFrame([(1, None, "t"), (2, '{"own": 1}', "t")], "task_id long, task_info string, trajectory string")
    assert [r["task_info"] for r in curation.task_info(rows).orderBy("task_id").collect()] == ['{"task_id":1}', '{"own": 1}']
    nested = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")).alias("s"))
    assert curation.without_fields(nested, "s", "b").first()["s"].asDict() == {"a": 1}


def test_failed_finishes(spark):
    rows = spark.createDataFrame([(1, "Finish", "failed"), (1, "Finish", "success"), (1, "go", "x"), (2, "Finish", None)], "id long, name string, result string")
    assert {r["id"]: r["n_failed"] for r in curation.failed_finishes(rows, "id", F.col("name"), F.col("result")).collect()} == {1: 1, 2: 1}


def test_first_user_turn(spark):
    turns = spark.createDataFrame([([("user", "do it"), ("ai", "ok")],)], "t array<struct<from: string, value: string>>")
    assert turns.select(formatting.first_user_turn(F.col("t"))).first()[0] == "do it"
