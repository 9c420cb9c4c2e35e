"""Registry of the engine's queries and of the SQL that each must agree with.

The driver's tables stand in for the engine's records: ``events`` for step logs (a user is a trajectory, props its state),
``conversations`` for messages, ``orders`` and ``lineitem`` for samples and steps, ``supplier``, ``part`` and ``nation`` for
environments and tools, ``documents`` with ``labels`` and ``benchmark`` for source tasks, scores and hold-out sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import udfs
from tracewright.operators import dedup, differences, filters, formatting, joins, metrics, sampling, trajectory

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STEPS_SQL = """
with s as (select *, case when event_type in ('purchase','signup') then props end as cfg from events),
c as (select *, row_number() over w as step,
        last_value(cfg ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before
      from s window w as (partition by user_id order by ts, event_id)),
d as (select *, coalesce(cfg, before) as after, cast(json_extract_string(before,'$.k') as bigint) as kb,
        cast(json_extract_string(coalesce(cfg, before),'$.k') as bigint) as ka from c)
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    numbered = trajectory.number_steps(events.withColumn("cfg", F.when(F.col("event_type").isin("purchase", "signup"), F.col("props"))), ["user_id"], ["ts", "event_id"])
    return trajectory.carry_forward(numbered, ["user_id"], ["ts", "event_id"], "cfg", "before", "after")


def _delta() -> tuple:
    before, after = (F.get_json_object(c, "$.k").cast("long") for c in ("before", "after"))
    changed = F.when(after.isNull() & before.isNull(), 0).when(before.isNull() | (after != before), 1).otherwise(0)
    return before, after, changed


@query(_STEPS_SQL + """select event_type, case when before is null then 'unknown' when ka = kb then 'same' when ka > kb then 'up' else 'down' end as bucket,
 count(*) as n, cast(sum(coalesce(ka,0)) as bigint) as total_after, cast(max(step) as bigint) as last_step from d group by all""")
def q01_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State carried forward between steps, then outcome buckets."""
    before, after, _ = _delta()
    bucket = F.when(F.col("before").isNull(), "unknown").when(after == before, "same").when(after > before, "up").otherwise("down")
    steps = _steps(spark, sf_dir)
    return steps.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.coalesce(after, F.lit(0))).alias("total_after"), F.max("step").cast("long").alias("last_step"))


@query("""select o_orderkey, count(*) as n_steps, cast(sum(l_linenumber) as bigint) as line_sum, cast(max(l_partkey) as bigint) as max_part
 from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def q02_explode_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps gathered per sample in order, exploded again, counted."""
    steps = table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    nested = trajectory.regroup_steps(steps, ["o_orderkey"], "l_linenumber", ["l_partkey"])
    flat = trajectory.explode_steps(nested, "trajectory")
    return flat.groupBy("o_orderkey").agg(F.count("*").alias("n_steps"), F.sum(F.col("step_detail.l_linenumber").cast("long")).alias("line_sum"), F.max("step_detail.l_partkey").alias("max_part"))


@query("""select n_name, l_returnflag, count(*) as n, cast(sum(l_linenumber) as bigint) as line_sum from lineitem
 left join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = s_nationkey where l_suppkey is not null group by all""")
def q03_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their environment: unmatched ones kept, those without a key dropped."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber")
    with_env = joins.enrich(lines, table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey", ["s_nationkey"])
    named = with_env.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return named.groupBy("n_name", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("line_sum"))


@query("""select d.doc_id, d.lang from documents d where not exists (select 1 from labels l where l.toxic = 1 and l.doc_id = d.doc_id)""")
def q04_exclude_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").where("toxic = 1")
    return joins.exclude(table(spark, sf_dir, "documents").select("doc_id", "lang"), held, "doc_id")


_NULLED = "case when doc_id % 7 = 0 then null else doc_id end"


@query(f"""with d as (select doc_id as id, {_NULLED} as doc_id from documents) select id, true as lenient,
 (doc_id is not null) as strict from d where not exists (select 1 from labels l where l.toxic = 1 and l.doc_id = d.doc_id)""")
def q05_exclude_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys survive the lenient exclusion and fall to the one that wants a key."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_NULLED).alias("doc_id"))
    held = table(spark, sf_dir, "labels").where("toxic = 1")
    lenient, strict = joins.exclude(docs, held, "doc_id"), joins.exclude(docs, held, "doc_id", F.col("doc_id").isNotNull())
    return lenient.select("id", F.lit(True).alias("lenient")).join(strict.select("id", F.lit(True).alias("strict")), "id", "left").select("id", "lenient", F.coalesce("strict", F.lit(False)).alias("strict"))


@query("""select e.user_id, cast(e.step as bigint) as step, e.event_type, f.event_type as next_type from
 (select *, row_number() over (partition by user_id order by ts, event_id) as step from events) e join
 (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as step from events) f on e.user_id = f.user_id and e.step = f.step where e.event_type = 'error'""")
def q06_composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results matched with steps on (sample, step)."""
    steps = trajectory.number_steps(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"])
    later = steps.select("user_id", (F.col("step") - 1).alias("step"), F.col("event_type").alias("next_type"))
    return joins.matched(steps.where("event_type = 'error'"), later, ["user_id", "step"]).select("user_id", F.col("step").cast("long").alias("step"), "event_type", "next_type")


@query("""select event_type, source, count(*) as n from (
 select event_id, event_type, 'old' as source from events where not (event_type = 'error' and event_id % 2 = 0)
 union all select event_id, event_type, 'retried' from events where event_type = 'error' and event_id % 2 = 0) group by all""")
def q07_merge_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed results, half of them retried: new rows in place of old ones, the others stay."""
    old = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit("old").alias("source"))
    failed = old.where("event_type = 'error'")
    retried = joins.to_retry(old, failed, ["event_id"]).where("event_id % 2 = 0").withColumn("source", F.lit("retried"))
    return joins.merge_retried(old, retried, ["event_id"]).groupBy("event_type", "source").agg(F.count("*").alias("n"))


@query("""select event_id from events e where not exists (select 1 from events d where d.event_id = e.event_id and d.event_id % 3 = 0) order by event_id limit 100""")
def q08_pending_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 steps that no checkpoint holds (the cap is the feature)."""
    events = table(spark, sf_dir, "events").select("event_id")
    return joins.pending(events, events.where("event_id % 3 = 0"), ["event_id"]).orderBy("event_id").limit(100)


@query("""select doc_id, regexp_matches(text, '^[A-Za-z0-9\\s.,?!;:''"()\\[\\]{}\\-_*/\\\\@#$%^&+=<>|~`]*$') as english,
 regexp_matches(lower(text), 'image|photo|picture|video|audio|sound|speech|clip') as media,
 (contains(text,'Role definition:') or contains(text,'USD') or contains(text,'ETH') or contains(text,'Bitcoin') or contains(text,'Ethereum') or contains(text,'@')
  or contains(text,'.com') or contains(text,'http:') or contains(text,'https:')) as marker from documents where text is not null""")
def q09_source_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, media and marker tests of source tasks."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", filters.is_english(text).alias("english"), filters.names_media(text).alias("media"), filters.has_marker(text).alias("marker"))


@query("""with t as (select conv_id, count(*) filter (where role = 'assistant') as n from conversations group by conv_id),
 r as (select n, row_number() over (order by n) as rn, count(*) over () as total from t)
 select (select n from r where rn = floor(total / 2) + 1) as upper_median, (select cast(sum(n) as bigint) from t) as n_turns, (select count(*) from t) as n_conversations""")
def q10_turn_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filters.turns(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")
    sums = counts.agg(F.sum("n_assistant").alias("n_turns"), F.count("*").alias("n_conversations"))
    return metrics.upper_median(counts, "n_assistant").join(sums)


@query("""with t as (select conv_id, count(*) filter (where role = 'assistant') as n, max_by(text, turn) filter (where role = 'assistant') as last from conversations group by conv_id)
 select count(*) as n_all, count(*) filter (where n between 1 and 29) as in_band, count(*) filter (where n between 1 and 29 and length(last) > 40) as long_enough,
 count(*) filter (where n between 1 and 29 and length(last) > 40 and not starts_with(last, 'Error:')) as no_error from t""")
def q11_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations pass each filter and all before it, in one pass."""
    rows = filters.turns(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")
    last = F.col("last_assistant")
    return filters.funnel(rows, [("in_band", F.col("n_assistant").between(1, 29)), ("long_enough", F.char_length(last) > 40), ("no_error", ~filters.is_error(last))])


_CASES = "case l_returnflag when 'A' then 'pass' when 'N' then 'warning' else 'fail' end"


@query("with c as (select l_suppkey as unit, " + _CASES + " as status, l_linestatus = 'F' as positive from lineitem) select unit, count(*) as total_count, "
 + ", ".join(f"count(*) filter (where status = '{s}') as {s}_count" for s in ("pass", "warning", "fail"))
 + ", count(*) filter (where positive) as positive_count, count(*) filter (where not positive) as negative_count, "
 + ", ".join(f"count(*) filter (where {t} and status = '{s}') as {n}_{s}_count" for n, t in (("positive", "positive"), ("negative", "not positive")) for s in ("pass", "warning", "fail"))
 + " from c group by grouping sets ((unit), ())")
def q12_test_case_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve counters of test cases per tool and over all."""
    return metrics.test_cases(table(spark, sf_dir, "lineitem"), "l_suppkey", F.expr(_CASES), F.col("l_linestatus") == "F")


@query("with c as (select l_suppkey, count(*) as total, count(*) filter (where " + _CASES + " <> 'fail') as good from lineitem group by 1) select l_suppkey, total, good from c where good * 100 >= total * 66")
def q13_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools whose unrounded share of cases that did not fail reaches the gate."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.expr(_CASES) != "fail").alias("good"))
    return counts.where(filters.at_least(F.col("good"), F.col("total"), 66))


_LABEL_SQL = _STEPS_SQL + """, l as (select *, case when event_type = 'error' then 'first_success_false'
  when dc = 0 then case event_id % 3 when 0 then 'first_change0_args0' when 1 then 'first_change0_args1' end
  when dc between 1 and 2 then 'second_simple_' || dc when dc between 3 and 6 then 'second_medium_' || dc when dc between 7 and 12 then 'second_difficult_7_12' end as label
  from (select *, abs(ka - coalesce(kb, ka)) % 14 as dc from d))
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, _ = _delta()
    change = F.abs(after - F.coalesce(before, after)) % 14
    success = F.when(F.col("event_type") == "error", False).otherwise(True)
    return _steps(spark, sf_dir).withColumn("label", trajectory.classify(success, change, F.col("event_id") % 3))


@query(_LABEL_SQL + "select label, count(*) as n, count(distinct user_id) as n_env from l group by label")
def q14_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of steps by outcome, number of changes and arguments."""
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_env"))


@query(_LABEL_SQL + """, leaves(leaf, branch) as (values """ + ", ".join(f"('{k}','{v}')" for k, v in metrics.LEAVES.items()) + """),
 f as (select leaf, branch, coalesce(n,0) as n, coalesce(fh,0) as fh, coalesce(sh,0) as sh from leaves left join
  (select label, count(*) as n, count(*) filter (where event_id % 2 = 0) as fh, count(*) filter (where event_id % 5 = 0) as sh from l group by label) c on c.label = leaf)
 select coalesce(leaf, branch, 'overall') as category, cast(sum(n) as bigint) as n, cast(sum(fh) as bigint) as feedback_hits, cast(sum(sh) as bigint) as state_hits
 from f group by grouping sets ((branch, leaf), (branch), ())""")
def q15_category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, branches and total of the category tree, zero rows included."""
    return metrics.category_tree(_labelled(spark, sf_dir), "label", F.col("event_id") % 2 == 0, F.col("event_id") % 5 == 0)


@query(_LABEL_SQL + """select label, count(*) as n, count(*) filter (where event_id % 2 = 0) as feedback_hits, count(*) filter (where event_id % 5 = 0) as state_hits
 from l where event_id % 11 <> 0 group by label""")
def q16_recount_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary recomputed after a merge: failed rows leave the denominator."""
    rows = _labelled(spark, sf_dir).withColumn("error", F.when(F.col("event_id") % 11 == 0, "timeout"))
    return metrics.hits(rows, ["label"], F.col("event_id") % 2 == 0, F.col("event_id") % 5 == 0, "error")


@query(_LABEL_SQL + """, p as (select label, count(*) as n, round(100 * cast(count(*) filter (where event_id % 5 = 0) as double) / count(*), 1) as pct from l group by label)
 select cast(round(sum(pct * n) * 1000 / sum(n)) as bigint) as overall, cast(sum(n) as bigint) as weights from p""")
def q17_published_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of published per-stratum percentages (one decimal) weighted by the strata's rows, in thousandths."""
    told = _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 5 == 0).alias("hits"))
    rows = told.select("n", F.round(F.lit(100) * F.col("hits").cast("double") / F.col("n"), 1).alias("pct"))
    return rows.agg(F.round(F.sum(F.col("pct") * F.col("n")) * 1000 / F.sum("n")).cast("long").alias("overall"), F.sum("n").cast("long").alias("weights"))


@query("""select l_orderkey, count(*) filter (where l_returnflag = 'A') as n_passed, count(*) as n_checks from lineitem group by l_orderkey""")
def q18_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks passed over checks made; a check that could not run counts below only."""
    passed = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    return metrics.reward(table(spark, sf_dir, "lineitem"), ["l_orderkey"], passed)



@query("""with r as (select event_id, user_id, md5('s1:' || event_id) as t, row_number() over (partition by user_id order by md5('s1:' || event_id)) as nth from events where event_type = 'error')
 select event_id, user_id from r order by case when nth = 1 then 0 else 1 end, t limit 200""")
def q19_coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 that covers as many environments as it can (the quota is the feature)."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id")
    return sampling.coverage_sample(rows, "user_id", "event_id", 200, "s1")


def stratum_sql(name: str, test: str, quota: int, before: list[str], seed: str, source: str = "events") -> str:
    """One stratum's part of a WITH clause: first rows of environments that no stratum before has used, then other rows."""
    used = " union ".join(f"select user_id from {b}" for b in before)
    fresh = f"user_id not in ({used})" if before else "true"
    return f"""{name} as (select event_id, user_id, '{name}' as stratum from (select *, md5('{seed}:{name}:' || event_id) as t,
     row_number() over (partition by user_id order by md5('{seed}:{name}:' || event_id)) as nth from {source} where {test})
     order by case when nth = 1 and {fresh} then 0 else 1 end, t limit {quota})"""


_STRATA = [("failure", "event_type = 'error'", 20), ("same0", "event_type = 'view'", 40), ("same1", "event_type = 'click'", 40), ("simple", "event_type = 'signup'", 25), ("medium", "event_type = 'purchase'", 50)]


@query("with " + ", ".join(stratum_sql(n, t, q, [x[0] for x in _STRATA[:i]], "s2") for i, (n, t, q) in enumerate(_STRATA)) + " " + " union all ".join(f"select * from {n}" for n, _, _ in _STRATA))
def q20_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of strata filled in turn, environments taken once counting as used from then on."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    picked = sampling.strata(rows, "user_id", "event_id", [(n, F.expr(t), q) for n, t, q in _STRATA], "s2")
    return picked.select("event_id", "user_id", "stratum")


@query("""with l as (select *, lag(props) over (partition by user_id order by ts, event_id) as prev from events),
 k as (select *, cast(json_extract_string(prev,'$.k') as bigint) as o, cast(json_extract_string(props,'$.k') as bigint) as n from l)
 select event_id, case when prev is null then 'added' when o <> n then 'modified' end as type,
  case when prev is not null and n > o then 'increased by ' || (n - o) when prev is not null and n < o then 'decreased by ' || (o - n) end as note,
  cast(case when prev is null or o <> n then 1 else 0 end as bigint) as change_count from k""")
def q21_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of consecutive states, with notes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "props")
    steps = trajectory.previous_state(events, ["user_id"], ["ts", "event_id"], "props", "prev")
    found = differences.attach(steps.select("event_id", "prev", "props"), "event_id", "prev", "props")
    first = F.get("changes", F.lit(0))
    return found.select("event_id", first["type"].alias("type"), first["note"].alias("note"), F.col("change_count").cast("long").alias("change_count"))


@query("""select event_id, cast(len(json_keys(props)) as bigint) as n_args, 'do(' || '{"k": ' || json_extract_string(props,'$.k') || '})' as call from events""")
def q22_action_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument count and call text of an action."""
    action = F.concat(F.lit('{"name": "do", "arguments": '), F.col("props"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", action.alias("action"))
    return rows.select("event_id", differences.argument_count(F.col("action")).cast("long").alias("n_args"), differences.call_text(F.col("action")).alias("call"))


@query("""with k as (select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events)
 select event_id, (event_id % 3 <> 1 or k = -1) as by_path, event_id % 3 = 0 as strict, event_id % 2 = 0 as feedback from k""")
def q23_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted changes applied and compared: by the true changes' paths, in full, and feedback by meaning.

    The true step sets b to k. Predictions: right; wrong value; right with a further wrong change, which only the full
    comparison minds.
    """
    k = F.get_json_object("props", "$.k")
    before, after = F.lit('{"a": 1}'), F.concat(F.lit('{"a": 1, "b": '), k, F.lit("}"))
    right = F.concat(F.lit('{"path": "b", "type": "add", "after": '), k, F.lit("}"))
    wrong = F.lit('{"path": "b", "type": "add", "after": -1}')
    more = F.concat(right, F.lit(', {"path": "a", "type": "modify", "after": 9}'))
    case = F.col("event_id") % 3
    predicted = F.concat(F.lit("["), F.when(case == 0, right).when(case == 1, wrong).otherwise(more), F.lit("]"))
    said = F.when(F.col("event_id") % 2 == 0, F.lit("{'success': True, 'n': 1}")).otherwise(F.lit('{"success": true, "n": 2}'))
    rows = table(spark, sf_dir, "events").select("event_id", before.alias("before"), after.alias("after"), predicted.alias("predicted"), said.alias("said"))
    found = rows.withColumn("m", udfs.state_matches("before", "after", udfs.apply_predicted("before", "predicted")))
    return found.select("event_id", "m.by_path", "m.strict", udfs.feedback_matches("said", F.lit('{"n": 1.0, "success": true}')).alias("feedback"))


@query("""select conv_id, turn, role = 'assistant' as lenient, case when role = 'assistant' then true when role = 'user' then false end as strict from conversations""")
def q24_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and lenient outcomes of observations in several notations."""
    role = F.col("role")
    said = F.when(role == "assistant", "{'success': True}").when(role == "user", '```json\n{"success": false}\n```').otherwise("operation failed")
    lenient = F.when(role == "user", '{"success": false}').otherwise(said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), lenient.alias("lenient"))
    return rows.select("conv_id", "turn", udfs.lenient_success("lenient", F.lit(None).cast("boolean")).alias("lenient"), udfs.success("said").alias("strict"))


@query("select distinct source, text from documents")
def q25_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(table(spark, sf_dir, "documents"), ["source", "text"])


@query("""select doc_id, quality, source from (select d.doc_id, quality, source, row_number() over (partition by trim(text) order by quality desc, toxic asc, d.doc_id) as nth
 from documents d join labels l on l.doc_id = d.doc_id) where nth = 1""")
def q26_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per text: best score, then the other score, then the smallest id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    best = dedup.keep_best(rows, F.trim("text"), [F.col("quality").desc(), F.col("toxic"), F.col("doc_id")])
    return best.select("doc_id", "quality", "source")


@query("""with e as (select vec_id, label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings),
 m as (select label, i, avg(cast(x as double)) as m from e group by all),
 d as (select e.label, e.vec_id, round(sqrt(sum((cast(x as double) - m) * (cast(x as double) - m))), 9) as d from e join m on m.label = e.label and m.i = e.i group by all),
 r as (select *, row_number() over (partition by label order by d, vec_id) as nth, count(*) over (partition by label) as n from d) select label, vec_id, n from r where nth = 1""")
def q27_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector nearest to the mean of its cluster."""
    return dedup.representatives(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")


@query("""select d.doc_id, 'Predict the result.' as instruction, replace(replace(text, chr(13), ''), chr(0), '') as input,
 regexp_replace(trim('{"quality": ' || quality || ', "toxic": ' || toxic || ', }'), ',\\s*([}\\]])', '\\1', 'g') as output from documents d join labels l on l.doc_id = d.doc_id""")
def q29_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction, input and output of a training row, text and JSON cleaned."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    target = F.concat(F.lit('{"quality": '), F.col("quality").cast("string"), F.lit(', "toxic": '), F.col("toxic").cast("string"), F.lit(", }"))
    return rows.select("doc_id", *formatting.training_row("Predict the result.", formatting.normalized(F.col("text")), formatting.without_trailing_commas(target)))


@query("""select event_id, printf('%03d', row_number() over (order by event_id)) as sample_id from events""")
def q30_padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-padded sequential ids; wider numbers stay whole."""
    return formatting.padded_ids(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query("""select page_id, case when regexp_matches(html, '(?is)<title>.*?</title>') then trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) end as title from pages""")
def q31_tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", formatting.tagged(F.col("html"), "title").alias("title"))


@query("""select event_id, cast(count(*) filter (where event_type = 'error') over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as n_errors from events""")
def q32_running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return metrics.running_counts(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "n_errors").select("event_id", "n_errors")


@query("""select doc_id, quality, toxic from labels where quality >= 1 and toxic >= 0""")
def q33_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where((F.col("quality") >= 1) & (F.col("toxic") >= 0)).select("doc_id", "quality", "toxic")


@query("""select l_suppkey, list_sort(list(distinct l_returnflag)) as flags, cast(min(l_orderkey) as bigint) as first_seen from lineitem group by l_suppkey""")
def q34_sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted set per key with the order of first sight."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"), F.min("l_orderkey").alias("first_seen"))


@query("""with o as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as i from lineitem),
 p as (select *, row_number() over (partition by s_nationkey order by s_suppkey) as i from supplier)
 select l_suppkey, l_orderkey, cast(o.i as bigint) as i, s_name from o join p on p.s_nationkey = l_suppkey % 25 and p.i = o.i where o.i <= 3""")
def q35_positional_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th configuration of an environment goes with its i-th task, the first three of each (the number is the feature)."""
    tasks = trajectory.number_steps(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "i")
    configs = trajectory.number_steps(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), ["s_nationkey"], ["s_suppkey"], "i")
    paired = tasks.where("i <= 3").withColumn("s_nationkey", (F.col("l_suppkey") % 25).cast("int")).join(configs, ["s_nationkey", "i"])
    return paired.select("l_suppkey", "l_orderkey", F.col("i").cast("long").alias("i"), "s_name")


from tracewright.plans import curation as _curation  # noqa: E402, F401  registers its queries here
from tracewright.plans import selection as _selection  # noqa: E402, F401
from tracewright.plans import states as _states  # noqa: E402, F401
