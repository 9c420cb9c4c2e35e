"""Queries on nested states: checks, differences and unnesting, over states that are put together from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import checks, class_facts, differences
from tracewright.operators.shared import shared_folder
from tracewright.plans.catalogue import query, table
from tracewright.sources import json_io, typed_json


def user_states(events: DataFrame, name: str) -> DataFrame:
    """user_id and a JSON state: counts, largest value and keys of each type of event, and the last event."""
    k = F.get_json_object("props", "$.k").cast("long")
    each = events.groupBy("user_id", "event_type").agg(
        F.struct(F.count("*").alias("n"), F.max("value").alias("top"), F.sort_array(F.collect_set(k)).alias("keys")).alias("of"),
        F.max(F.struct("event_id", F.col("event_type").alias("type"), k.alias("k"))).alias("last"),
    )
    whole = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "of"))).alias("by"), F.max("last").alias("last"))
    return whole.select("user_id", F.to_json(F.struct(F.col("user_id").alias("user"), "by", F.struct("last.type", "last.k").alias("last"))).alias(name))


#: env, check, number of the rule, mode, path, quantifier, operator, literal
CHECKS = [
    ("even", "all_seen_twice", 1, "all", ["by", "*", "n"], "all", "ge", "2"),
    ("even", "no_errors", 1, "all", ["by", "error"], "none", "exists", None),
    ("even", "rich_or_late", 1, "any", ["by", "purchase", "top"], "any", "gt", "50.5"),
    ("even", "rich_or_late", 2, "any", ["last", "k"], "any", "ge", "50"),
    ("odd", "has_seven", 1, "all", ["by", "*", "keys", "*"], "any", "eq", "7.0"),
    ("odd", "views_grew", 1, "all", ["by", "view", "n"], "any", "changed", None),
    ("odd", "views_grew", 2, "all", ["last", "type"], "all", "type", '"string"'),
    ("odd", "unlike", 1, "all", ["last", "type"], "any", "lt", "5"),
    ("odd", "new_kinds", 1, "all", ["by", "*"], "any", "added", None),
    ("odd", "kept_user", 1, "all", ["user"], "all", "same", None),
]


@query("""with e as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
 t as (select user_id, event_type, count(*) as n, count(*) filter (event_id % 3 = 0) as n0, max(value) as top, bool_or(k = 7) as seven from e group by all),
 l as (select user_id, arg_max(k, event_id) as k, bool_or(event_id % 3 = 0) as known from e group by user_id),
 u as (select user_id, min(n) as least, count(*) filter (event_type = 'error') as errors, max(top) filter (event_type = 'purchase') as rich, bool_or(seven) as seven,
   count(*) filter (event_type = 'view' and n0 > 0 and n <> n0) as grew, count(*) filter (n0 = 0) as fresh from t group by user_id),
 c as (select u.*, l.k, known from u join l using (user_id)),
 r as (select user_id, 'all_seen_twice' as check_id, least >= 2 as passed from c where user_id % 2 = 0
  union all select user_id, 'no_errors', errors = 0 from c where user_id % 2 = 0 union all select user_id, 'rich_or_late', coalesce(rich > 50.5, false) or k >= 50 from c where user_id % 2 = 0
  union all select user_id, 'has_seven', seven from c where user_id % 2 = 1 union all select user_id, 'views_grew', grew > 0 from c where user_id % 2 = 1
  union all select user_id, 'unlike', null from c where user_id % 2 = 1 union all select user_id, 'new_kinds', fresh > 0 from c where user_id % 2 = 1 union all select user_id, 'kept_user', known from c where user_id % 2 = 1)
 select user_id, string_agg(check_id || case when passed is null then '?' when passed then '+' else '-' end, ' ' order by check_id) as results, count(*) as n_checks, count(*) filter (passed) as n_passed,
 count(*) filter (passed is null) as n_failed_to_run, round(count(*) filter (passed) / count(*), 4) as reward from r group by user_id""")
def q53_state_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check items on the final states of all users, against their states before, and the rewards."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    final, initial = user_states(events, "final"), user_states(events.where("event_id % 3 = 0"), "initial")
    states = final.join(initial, "user_id", "left").select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("env"), "initial", "final")
    found = checks.check_results(states, spark.createDataFrame(CHECKS, checks.RULE))
    told = F.concat("check_id", F.coalesce(F.when(F.col("passed"), "+").when(~F.col("passed"), "-"), F.lit("?")))
    listed = found.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(told)), " ").alias("results"))
    return listed.join(checks.rewards(found), "id").select(F.col("id").alias("user_id"), "results", "n_checks", "n_passed", "n_failed_to_run", "reward")


@query("""with k as (select user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, event_id % 3 = 0 as early from events),
 t as (select user_id, event_type, count(*) filter (early) as n0, count(*) as n from k group by all)
 select event_type, count(*) filter (n0 = 0) as n_added, count(*) filter (n0 > 0 and n <> n0) as n_grown, cast(coalesce(sum(n - n0) filter (n0 > 0), 0) as bigint) as growth
 from t where user_id in (select user_id from k where early) group by event_type""")
def q56_nested_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of all users' nested states: kinds of events that are new, and by how much counts of known ones grew."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    both = user_states(events.where("event_id % 3 = 0"), "before").join(user_states(events, "after"), "user_id")
    found = differences.changes(both, "before", "after").where(F.element_at("steps", 1) == "by")
    kind, leaf = F.element_at("steps", 2).alias("event_type"), F.try_element_at("steps", F.lit(3))
    grown = (F.col("type") == "modified") & (leaf == "n")
    told = found.select(kind, (F.col("type") == "added").alias("added"), F.coalesce(grown, F.lit(False)).alias("grown"), F.regexp_extract("note", r"^increased by (\d+)$", 1).try_cast("long").alias("by"))
    kinds = events.join(both.select("user_id"), "user_id", "left_semi").select("event_type").distinct()
    summed = told.groupBy("event_type").agg(F.count_if("added").alias("n_added"), F.count_if("grown").alias("n_grown"), F.sum(F.when(F.col("grown"), F.col("by"))).alias("growth"))
    return kinds.join(summed, "event_type", "left").select("event_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_added", "n_grown", "growth")])


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type from events""")
def q57_mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a folder of JSON lines and of arrays, each format told by its file."""
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    folder = f"{shared_folder(spark)}/tracewright/mixed-{uuid.uuid4().hex}"
    record = F.to_json(F.struct("event_id", "k", "event_type"))
    lines = rows.where("event_id % 2 = 0").select(record.alias("value"))
    lines.write.text(f"{folder}/lines")
    # Arrays of some thousand elements each, one text a file: written by task, so that each file is a whole array.
    arrays = rows.where("event_id % 2 = 1").groupBy(F.floor(F.col("event_id") / 2000).alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("part").text(f"{folder}/arrays")
    found = json_io.read_records(spark, [f"{folder}/lines", *[f"{folder}/arrays/*"]])
    return found.select(F.from_json("record", "event_id long, k long, event_type string").alias("r")).select("r.*")


@query("""select cast(o_orderkey as bigint) as o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, cast(o_orderdate as date) as day, o_orderpriority from orders""")
def q58_typed_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals, timestamps and maps with struct keys through a typed save and back."""
    orders = table(spark, sf_dir, "orders")
    key = F.struct(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    rows = orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("decimal(14, 2)").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"), F.create_map(key, F.col("o_totalprice").cast("decimal(14, 2)")).alias("m"))
    back = typed_json.typed_rows(typed_json.typed_texts(rows), rows.schema)
    return back.select("o_orderkey", (F.element_at(F.map_values("m"), 1).cast("decimal(16, 2)") * 100).cast("long").alias("cents"), F.col("at").cast("date").alias("day"), F.element_at(F.map_keys("m"), 1)["p"].alias("o_orderpriority"))


@query("""select user_id, case when user_id % 3 = 1 then event_type end as key, count(*) as n, cast(sum(case when user_id % 3 < 2 then 1 else 0 end * cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total
 from (select *, row_number() over (partition by user_id, event_type order by event_id) as nth from events) where user_id % 3 = 0 or (user_id % 3 = 1 and nth = 1) group by all
 union all select distinct user_id, null, 1, 0 from events where user_id % 3 = 2""")
def q59_unwrapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of wrappers of three shapes, with the keys that held them."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    listed = events.where("user_id % 3 = 0").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct("k")).alias("items"))).alias("record"))
    first = events.where("user_id % 3 = 1").groupBy("user_id", "event_type").agg(F.min_by(F.struct(F.struct("k").alias("trajectory")), "event_id").alias("s"))
    keyed = first.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "s")))).alias("record"))
    plain = events.where("user_id % 3 = 2").select("user_id").distinct().select("user_id", F.to_json(F.struct("user_id")).alias("record"))
    found = json_io.unwrapped(listed.union(keyed).union(plain))
    k = F.coalesce(F.get_json_object("record", "$.k"), F.get_json_object("record", "$.trajectory.k")).cast("long")
    return found.groupBy("user_id", "key").agg(F.count("*").alias("n"), F.coalesce(F.sum(k), F.lit(0)).alias("total"))


@query("""with k as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
 t as (select user_id, event_type, count(*) filter (event_id % 3 = 0) as n0, count(*) as n1, count(*) filter (event_id % 10 > 0) as n2,
   max(value) filter (event_id % 3 = 0) as top0, max(value) as top1, max(value) filter (event_id % 10 > 0) as top2,
   list_sort(list_distinct(list(k) filter (event_id % 3 = 0))) as keys0, list_sort(list_distinct(list(k))) as keys1, list_sort(list_distinct(list(k) filter (event_id % 10 > 0))) as keys2 from k group by all),
 l as (select user_id, arg_max(event_type, event_id) filter (event_id % 3 = 0) as e0, arg_max(event_type, event_id) as e1, arg_max(event_type, event_id) filter (event_id % 10 > 0) as e2,
   arg_max(k, event_id) filter (event_id % 3 = 0) as k0, arg_max(k, event_id) as k1, arg_max(k, event_id) filter (event_id % 10 > 0) as k2 from k group by user_id having count(*) filter (event_id % 3 = 0) > 0 and count(*) filter (event_id % 10 > 0) > 0),
 u as (select user_id, bool_and(coalesce(n2 = n1 and top2 = top1 and keys2 = keys1, false)) as same,
   bool_and(case when n0 = 0 then coalesce(n2 = n1 and top2 = top1 and keys2 = keys1, false) else (n0 = n1 or coalesce(n2 = n1, false)) and (top0 = top1 or coalesce(top2 = top1, false)) and (keys0 = keys1 or coalesce(keys2 = keys1, false)) end) as found from t group by user_id)
 select user_id, found and (e0 = e1 or e2 = e1) and (k0 = k1 or k2 = k1) as by_path, same and e2 = e1 and k2 = k1 as strict from u join l using (user_id)""")
def q60_state_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted states of all users against the true ones: by the true changes' paths, and in full."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    states = user_states(events.where("event_id % 3 = 0"), "before").join(user_states(events, "after"), "user_id").join(user_states(events.where("event_id % 10 > 0"), "predicted"), "user_id")
    return differences.state_matches(states, "user_id", "before", "after", "predicted")


@query("""with s as (select s_suppkey, s_suppkey % 3 as kind from supplier)
 select cast(s_suppkey as bigint) as s_suppkey, 'stock' as state, 'Dict[str, int]' as type, case when kind = 2 then 'look ' else '' end || 'take_' || s_suppkey as used_by, 'take_' || s_suppkey as modified_by,
 case kind when 0 then 'PASS' when 1 then 'FAIL' else 'WARN' end as verdict from s""")
def q61_class_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes written for every supplier: the state's type, who reads and changes it, and the verdict on a method's return."""
    key = F.col("s_suppkey").cast("long")
    answer = F.element_at(F.array(F.lit('{"success": True}'), F.lit('{"ok": 1}'), F.lit("found")), (key % 3 + 1).cast("int"))
    more = F.when(key % 3 == 2, "\n    def look(self):\n        return self.stock\n").otherwise("")
    source = F.format_string("class Shop%d:\n    def __init__(self, stock):\n        self.stock: Dict[str, int] = stock\n\n    def take_%d(self, name: str):\n        found = self.stock.pop(name)\n        return %s\n%s", key, key, answer, more)
    found = class_facts.facts(table(spark, sf_dir, "supplier").select(key.alias("s_suppkey"), source.alias("src")), "s_suppkey", "src")
    states = class_facts.states(found, "s_suppkey").select("s_suppkey", "state", "type", F.array_join("used_by", " ").alias("used_by"), F.array_join("modified_by", " ").alias("modified_by"))
    verdicts = class_facts.returns(found, "s_suppkey").where("function like 'take%'").select("s_suppkey", F.col("status").alias("verdict"))
    return states.join(verdicts, "s_suppkey")
