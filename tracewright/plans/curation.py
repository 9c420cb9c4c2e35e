"""Queries on the selection and description of samples, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import curation, formatting, metrics, trajectory
from tracewright.plans.catalogue import query, table


@query("""select event_id, case event_id % 4 when 0 then 'e' when 1 then 'x' when 2 then 's' else 'v' end || user_id as env_id,
 case event_id % 4 when 0 then '{"success": true}' when 1 then '{"success": false}' when 2 then 'none' else '' end as observation_content,
 cast(case event_id % 4 when 0 then user_id % 9 when 2 then 4 end as integer) as change_count, cast(case when event_id % 4 = 0 then 2 else 0 end as integer) as args_count,
 case event_id % 4 when 0 then true when 1 then false end as success from events""")
def q36_sample_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment, observation, change and argument counts and outcome from samples of four shapes."""
    shapes = [
        r'{"env_id": "e%d", "change_count": "%d", "step_detail": {"observation": {"content": "{\"success\": true}"}, "action": {"name": "f", "arguments": {"a": 1, "b": 2}}}}',
        r'{"env_code": "", "environment": "x%d", "observation": "{\"success\": false}", "change_count": "n%d"}',
        r'{"step_detail": {"env": "s%d", "observation": "none", "config_change": {"change_count": 4}, "action": {"name": "f%d", "arguments": {}}}}',
        r'{"step_detail": {}, "env": "v%d", "step": %d, "observation": {"content": null}}',
    ]
    user = F.col("user_id").cast("long")
    text = F.element_at(F.array(*[F.format_string(s, user, user % 9) for s in shapes]), (F.col("event_id") % 4 + 1).cast("int"))
    found = curation.metadata(table(spark, sf_dir, "events").select("event_id", text.alias("sample")), "sample")
    return found.select("event_id", "env_id", "observation_content", "change_count", "args_count", "success")


_SAID = """case when role <> 'assistant' then text when conv_id % 4 = 0 then '<think>a</think> Task Completed' when conv_id % 4 = 1 then text
 when conv_id % 4 = 2 then '<think>plan</think><tool_call>{"name": "f", "arguments": {"q": 1}}</tool_call>' else '<think>open Task Completed' end"""


@query("""with c as (select conv_id, count(*) filter (role = 'assistant') as n from conversations group by conv_id),
 p as (select conv_id % 4 as shape, n, conv_id % 4 in (0, 2) or n = 0 as formed, n between 1 and 29 as band from c)
 select count(*) as n_all, count(*) filter (formed) as formed, count(*) filter (formed and band) as in_band, count(*) filter (formed and band and shape = 0) as finished,
 count(*) filter (formed and n between 3 and 29) as reference_band, count(*) filter (band and shape = 3) as unclosed from p""")
def q37_completion_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, number of turns and completion of conversations, counted after each filter."""
    said = table(spark, sf_dir, "conversations").withColumn("text", F.expr(_SAID))
    own = F.col("role") == "assistant"
    each = said.groupBy("conv_id").agg(F.count_if(own).alias("n"), F.coalesce(F.bool_and(F.when(own, curation.well_formed(F.col("text")))), F.lit(True)).alias("formed"), F.max_by("text", F.when(own, F.col("turn"))).alias("last"))
    band = F.col("n").between(1, 29)
    finished = curation.finished_alone(F.col("last"))
    return each.agg(
        F.count("*").alias("n_all"),
        F.count_if("formed").alias("formed"),
        F.count_if(F.col("formed") & band).alias("in_band"),
        F.count_if(F.col("formed") & band & finished).alias("finished"),
        F.count_if(F.col("formed") & F.col("n").between(3, 29)).alias("reference_band"),
        F.count_if(band & F.col("last").contains("<think>") & ~F.col("formed") & ~finished).alias("unclosed"),
    )


@query("""select doc_id, doc_id % 6 as changes from documents d where doc_id % 6 > 2 and doc_id % 5 <> 0
 and (doc_id % 7 = 0 or not exists (select 1 from labels l where l.toxic = 1 and l.doc_id = d.doc_id))""")
def q38_exclude_with_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absent key drops the sample, a null key stays, a held-out key goes, and so do samples of two changes or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 6).alias("changes"))
    text = F.when(F.col("doc_id") % 5 == 0, F.lit('{"other": 1}')).when(F.col("doc_id") % 7 == 0, F.lit('{"task_id": null}')).otherwise(F.format_string('{"task_id": %d}', "doc_id"))
    held = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("task_id"))
    return curation.exclude_keyed(docs.withColumn("sample", text), held, "task_id", "sample", F.col("changes")).select("doc_id", "changes")


_TREE = """with r as (select *, (l_linenumber + l_quantity) % 13 as d from lineitem),
 c as (select cast(d as bigint) as d, l_tax > 0.02 as f, l_discount > 0.03 as s, case when d = 0 then case when l_returnflag = 'A' then 'first_success_false' when l_returnflag = 'N' then 'first_change0_args0' else 'first_change0_args1' end
  when d <= 2 then 'second_simple_' || cast(d as bigint) when d <= 6 then 'second_medium_' || cast(d as bigint) else 'second_difficult_7_12' end as leaf from r),
 e as (select unnest([leaf, split_part(leaf, '_', 1), case when leaf like 'second%' then split_part(leaf, '_', 2) end, case when leaf like '%difficult%' then 'difficult_' || d end, 'overall']) as category, f, s from c)
 select category, count(*) as n, count(*) filter (f) as feedback_hits, count(*) filter (s) as state_hits,
 100 * cast(count(*) filter (f) as double) / count(*) as feedback_pct, 100 * cast(count(*) filter (s) as double) / count(*) as state_pct from e where category is not null group by category"""


@query(_TREE)
def q39_full_category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, tiers, change counts of the difficult tier, branches and the total, with percentages."""
    d = ((F.col("l_linenumber") + F.col("l_quantity")) % 13).cast("int")
    lines = table(spark, sf_dir, "lineitem").select(d.alias("d"), (F.col("l_tax") > 0.02).alias("f"), (F.col("l_discount") > 0.03).alias("s"), "l_returnflag")
    arguments = F.when(F.col("l_returnflag") == "N", 0).otherwise(1)
    success = ~((F.col("d") == 0) & (F.col("l_returnflag") == "A"))
    labelled = lines.withColumn("leaf", trajectory.classify(success, F.col("d"), arguments))
    return metrics.full_tree(labelled, "leaf", "d", "f", "s")


@query("""with t as (select p_brand as unit, p_size % 4 as s, p_size % 3 > 0 as pos from part),
 c as (select unit, count(*) as n, count(*) filter (s <> 3) as ok, count(*) filter (pos) as np, count(*) filter (pos and s <> 3) as okp, count(*) filter (s < 2) as pass from t group by rollup(unit))
 select unit, round(cast(ok as double) / n, 2) as not_fail_acc, case when np > 0 then round(cast(okp as double) / np, 2) end as positive_not_fail_acc, round(cast(pass as double) / n, 2) as pass_acc from c""")
def q40_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of passed and not failed test cases per unit and over all."""
    s = F.col("p_size") % 4
    raw = F.when(s == 2, " Warning ").when(s == 1, None).otherwise(F.when(s == 0, "PASS").otherwise("no"))
    status = metrics.normal_status(raw, s == 1)
    return metrics.accuracies(metrics.test_cases(table(spark, sf_dir, "part"), "p_brand", status, F.col("p_size") % 3 > 0))


@query("""select c_nationkey as nation, count(*) as n, cast(sum(cast(c_custkey % 5 as bigint)) as bigint) as total, round(cast(count(*) filter (c_custkey % 5 > 2) as double) / count(*), 4) as ratio,
 cast(count(*) filter (c_custkey % 5 > 2) as bigint) as n_passed, round(sum(case when c_custkey % 7 = 0 then 0 else (c_custkey % 5) * 0.25 end) / count(*), 4) as avg_score from customer group by c_nationkey""")
def q41_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks passed over all checks to four places, and mean checkpoint scores with checks that could not run."""
    value = F.col("c_custkey") % 5
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), value.cast("long").alias("v"), (F.col("c_custkey") % 7 != 0).alias("ran"))
    ratio = metrics.reward_ratio(rows, ["nation"], F.col("v") > 2)
    scored = metrics.checkpoint_scores(rows, ["nation"], F.col("ran"), F.col("v") * 0.25).select("nation", "avg_score")
    total = rows.groupBy("nation").agg(F.sum("v").alias("total"))
    return ratio.join(scored, "nation").join(total, "nation").select("nation", F.col("n_checks").alias("n"), "total", "ratio", "n_passed", "avg_score")


@query("""select count(*) as n, round(sum(cast(o_orderkey % 3 as double)) * 100 / count(*), 2) as avg_score from orders having count(*) > 0""")
def q42_mean_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_reward(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).cast("double").alias("reward")), "reward")


@query("""with c as (select count(*) filter (role = 'assistant') as turns from conversations group by conv_id), n as (select turns, row_number() over (order by turns) as nth, count(*) over () as total from c)
 select turns, count(*) as n, (select round(avg(turns), 2) from c) as mean, (select turns from n where nth = total // 2 + 1) as upper_median from c group by turns""")
def q43_turn_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations per number of assistant turns, with mean and upper median."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("turns"))
    return metrics.histogram(turns, "turns")


@query("""select doc_id, case when doc_id % 2 = 0 then rtrim(text) else text end as task, case when doc_id % 3 = 0 then text else chr(10) || 'why ' || doc_id || chr(10) || chr(10) || text end as output, 'fn' || doc_id as tool,
 '**' || source || '**: ' || coalesce(case when doc_id % 2 = 0 then lang end, 'None') as title from (select * replace (trim(regexp_replace(text, '[^A-Za-z ]', 'x', 'g')) || 'q' as text) from documents where text is not null)""")
def q44_task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task cut out of a transcript, a reason in front of an output, a tool's name, a text to be embedded."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("said", F.concat(F.trim(F.regexp_replace("text", "[^A-Za-z ]", "x")), F.lit("q")))
    request = F.when(F.col("doc_id") % 2 == 0, "\nGenerate API Request: x").otherwise("\nAI: ok\nUser: more")
    dialogue = F.concat(F.lit("Generate.\nUser:"), F.col("said"), request)
    reason = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("why "), F.col("doc_id").cast("string")))
    title = formatting.titled(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    call = F.concat(F.lit("fn"), F.col("doc_id").cast("string"), F.lit('({"a": 1})'))
    return docs.select("doc_id", formatting.task_of_dialogue(dialogue).alias("task"), formatting.with_reason(F.col("said"), reason).alias("output"), formatting.tool_name(call).alias("tool"), title.alias("title"))


@query("""select p_partkey, case p_partkey % 6 when 0 then true when 1 then true when 4 then true else false end as valid, p_partkey % 6 = 4 as ended from part""")
def q45_action_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known methods with object arguments, chats with content, and actions that end the work."""
    kind = F.col("p_partkey") % 6
    name = F.when(kind.isin(0, 1, 2), "book").when(kind == 3, "fly").otherwise("chat_with_user")
    arguments = F.when(kind == 0, '{"a": 1}').when(kind == 2, "[1]").when(kind == 3, "{}").when(kind == 4, '{"content": "Task Completed"}').when(kind == 5, '{"text": 1}')
    valid = curation.valid_action(name, F.array(F.lit("book"), F.lit("cancel")), arguments)
    ended = curation.ends_by_action(name, F.get_json_object(arguments, "$.content"))
    return table(spark, sf_dir, "part").select("p_partkey", valid.alias("valid"), ended.alias("ended"))


@query("""select s_suppkey, n_name, cast(n_regionkey as bigint) as region from supplier join nation on n_nationkey = s_nationkey""")
def q46_guarded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with their environment; an unknown one or another class fails the job."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("env"), (F.col("n_nationkey") % 3).alias("kind"), "n_name", F.col("n_regionkey").cast("long").alias("region"))
    scenarios = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("env"), (F.col("s_nationkey") % 3).alias("kind"))
    return curation.guarded(scenarios, nations, "env", "kind").select("s_suppkey", "n_name", "region")


@query("""select o_orderkey, cast(o_custkey as bigint) as o_custkey, case when o_custkey % 3 > 0 then c_name end as c_name from orders left join customer on c_custkey = o_custkey""")
def q47_task_of_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested tasks by id, null where they belong to another environment."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("task"), (F.col("o_custkey") % 3 + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).cast("long").alias("env"))
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("task"), (F.col("c_custkey") % 3).cast("long").alias("env"), "c_name")
    return curation.task_of(asked, tasks, "env", "task").select("o_orderkey", F.col("task").alias("o_custkey"), "c_name")


@query("""with l as (select doc_id, [ 'a' || doc_id, 'b' || doc_id ] as items from documents)
 select doc_id, items as rules, case when doc_id % 2 = 0 then items else [] end as checklist, 'one' || doc_id as entity, 'x, y' as attributes from l""")
def q48_list_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, checklist items and entities out of sectioned text."""
    n = F.col("doc_id").cast("string")
    items = F.concat(F.lit("- a"), n, F.lit("\n- b"), n, F.lit(" \n"))
    listed = F.concat(F.lit("<think>- no</think>\n# CheckList\n"), items, F.lit("# Next\n- z"))
    listed = F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.concat(F.lit("# Other\n"), items))
    blocks = F.concat(F.lit("Intro\n- Entity: one"), n, F.lit("\n- Attributes: x, y\n- Description: d\n- Entity: two\n- Attributes: z\n- Description: e"))
    first = formatting.entities(blocks).getItem(0)
    return table(spark, sf_dir, "documents").select("doc_id", formatting.rules(items).alias("rules"), formatting.checklist(listed).alias("checklist"), first["entity"].alias("entity"), first["attributes"].alias("attributes"))


@query("""select cast(c_custkey as bigint) as c_custkey, cast((row_number() over (partition by c_nationkey order by c_custkey) - 1) // 16 as bigint) as batch from customer""")
def q49_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size batches within each group."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_nationkey")
    return curation.batches(rows, ["c_nationkey"], ["c_custkey"], 16).select("c_custkey", "batch")


@query("""select cast(p_size % 3 as bigint) as stratum, count(*) as n, count(distinct case when p_size % 10 > 0 then p_brand end) as n_envs from part group by rollup(p_size % 3)""")
def q50_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct environments of each stratum and over all."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("long").alias("stratum"), F.when(F.col("p_size") % 10 > 0, F.col("p_brand")).alias("env"))
    return curation.coverage(rows, "env", "stratum")


@query("""select cast(o_orderkey as bigint) as o_orderkey, o_orderpriority, 's_' || lpad(cast(row_number() over (order by o_orderkey) as varchar), cast(greatest(3, length(cast(row_number() over (order by o_orderkey) as varchar))) as integer), '0') as sample_id from orders""")
def q51_padded_ids_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential ids for rows that carry further columns."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority")
    return formatting.padded_ids(rows, ["o_orderkey"], prefix="s_")


@query("""with e as (select c_custkey, c_nationkey % 4 as kind from customer) select cast(c_custkey as bigint) as c_custkey,
 case kind when 0 then ['users'] when 1 then ['sessions', 'users'] when 2 then ['posts', 'sessions', 'users'] else ['posts'] end as parts, cast(case when kind = 3 then 1 else 5 end as integer) as most from e""")
def q52_relevant_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a state that a tool's name points to, large ones cut to their first five entries."""
    entries = lambda n: F.create_map(*[x for i in range(n) for x in (F.lit(f"k{i}"), F.lit(i))])
    state = F.create_map(F.lit("users"), entries(7), F.lit("sessions"), entries(3), F.lit("posts"), entries(1))
    kind = F.col("c_nationkey") % 4
    tool = F.when(kind == 0, "get_User").when(kind == 1, "open_session").when(kind == 2, "ping").otherwise("list_posts")
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), curation.relevant_parts(tool, state).alias("s"))
    return found.select("c_custkey", F.array_sort(F.map_keys("s")).alias("parts"), F.array_max(F.transform(F.map_values("s"), lambda m: F.size(m))).alias("most"))
