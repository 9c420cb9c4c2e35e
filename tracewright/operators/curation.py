"""Selection and description of samples: metadata with fallbacks, completion, actions, guarded lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import udfs

# Where a sample's environment may stand, in order, and the marks of finished conversations.
ENV_PATHS = ("env_code", "env_id", "env", "environment", "step_detail.env_code", "step_detail.env_id", "step_detail.env")
DONE, STOP = "Task Completed", "###STOP###"
# Top-level parts of a state that a tool's name points to.
STATE_PARTS = {
    "user": ["users"],
    "session": ["sessions", "users"],
    "post": ["posts"],
    "comment": ["comments", "posts"],
    "subreddit": ["subreddits"],
    "task": ["tasks"],
    "project": ["projects", "tasks"],
    "station": ["stations"],
    "observation": ["observations", "stations"],
    "aqi": ["aqi_records", "stations", "observations"],
}


def _filled(value: Column) -> Column:
    """Null for what counts as empty: no text, false, zero, an empty list or object."""
    return F.when(~value.isin("", "false", "0", "0.0", "[]", "{}"), value)


def metadata(samples: DataFrame, sample: str) -> DataFrame:
    """Adds env_id, observation_content, change_count, args_count and success of a sample given as JSON text.

    The environment is the first filled one of ENV_PATHS. A filled ``step_detail`` object holds the observation, the
    action and a change count that the sample itself lacks; without it the sample's own observation counts. What is no
    whole number is no change count.
    """
    at = lambda path: F.get_json_object(sample, f"$.{path}")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(sample), f"$.{path}", "variant")), F.lit("VOID"))
    detailed = kind("step_detail").startswith("OBJECT") & (kind("step_detail") != "OBJECT<>")
    content = lambda path: F.when(kind(path).startswith("OBJECT"), at(f"{path}.content")).otherwise(at(path))
    observation = F.when(detailed, content("step_detail.observation")).otherwise(content("observation"))
    count = F.coalesce(at("change_count"), F.when(detailed, at("step_detail.config_change.change_count")))
    found = samples.withColumns({"env_id": F.coalesce(*[_filled(at(p)) for p in ENV_PATHS]), "observation_content": F.coalesce(_filled(observation), F.lit("")), "change_count": count.try_cast("int")})
    action = F.when(detailed, at("step_detail.action"))
    return found.withColumn("args_count", F.coalesce(udfs.argument_count(action), F.lit(0))).withColumn("success", udfs.success(observation))


def task_info(samples: DataFrame, info: str = "task_info", leave: tuple[str, ...] = ("trajectory",)) -> DataFrame:
    """``info`` as JSON text: the sample's own one, else all its other columns but ``leave``."""
    others = [c for c in samples.columns if c not in (info, *leave)]
    built = F.to_json(F.struct(*others))
    return samples.withColumn(info, F.coalesce(F.col(info), built) if info in samples.columns else built)


def without_fields(rows: DataFrame, struct: str, *fields: str) -> DataFrame:
    return rows.withColumn(struct, F.col(struct).dropFields(*fields))


def well_formed(text: Column) -> Column:
    """An assistant message with a closed thought and, besides it, a text or a complete call with name and arguments."""
    thought = text.rlike("(?is)<think>.*?</think>")
    rest = F.regexp_replace(text, "(?is)<think>.*?</think>", "")
    call = F.regexp_extract(rest, r"(?s)<tool_call>(.*?)</tool_call>", 1)
    called = rest.contains("<tool_call>")
    complete = F.get_json_object(call, "$.name").isNotNull() & F.get_json_object(call, "$.arguments").startswith("{")
    return F.coalesce(thought & F.when(called, F.coalesce(complete, F.lit(False))).otherwise(F.trim(F.translate(rest, "\n\t\r", "   ")) != ""), F.lit(False))


def finished_alone(last_assistant: Column) -> Column:
    """The last assistant message has a thought, and says DONE between its end and the next one."""
    after = F.get(F.split(last_assistant, "</think>", -1), F.lit(1))
    return F.coalesce(last_assistant.contains("<think>") & after.contains(DONE), F.lit(False))


def finished_talking(kind: Column, content: Column) -> Column:
    """The final observation is the user's and says STOP."""
    return F.coalesce((kind == "user") & content.contains(STOP), F.lit(False))


def failed_finishes(actions: DataFrame, by: str, name: Column, result: Column) -> DataFrame:
    """Per trajectory: ``Finish`` calls whose result does not speak of success."""
    return actions.groupBy(by).agg(F.count_if((name == "Finish") & ~F.coalesce(result.contains("success"), F.lit(False))).alias("n_failed"))


def exclude_keyed(samples: DataFrame, held_out: DataFrame, key: str, sample: str, change_count: Column, above: int = 2) -> DataFrame:
    """Samples (JSON text in ``sample``) with more than ``above`` changes whose key is present and not held out; a present null is not held out."""
    present = F.array_contains(F.json_object_keys(sample), key)
    keyed = samples.where(present & (change_count > above)).withColumn("__key", F.get_json_object(sample, f"$.{key}"))
    held = held_out.select(F.col(key).cast("string").alias("__key")).where("__key is not null").distinct()
    return keyed.join(held, "__key", "left_anti").drop("__key")


def valid_action(name: Column, methods: Column, arguments: Column) -> Column:
    """The name is a method or ``chat_with_user``, the arguments (JSON text, absent: none) an object, and a chat has content."""
    chat = name == "chat_with_user"
    text = F.coalesce(arguments, F.lit("{}"))
    keys = F.json_object_keys(text)
    is_object = keys.isNotNull() & F.ltrim(text).startswith("{")
    return F.coalesce((F.array_contains(methods, name) | chat) & is_object & (~chat | F.array_contains(keys, "content")), F.lit(False))


def ends_by_action(name: Column, content: Column) -> Column:
    """Single-turn work ends when the agent tells the user that it is done."""
    return F.coalesce((name == "chat_with_user") & content.contains(DONE), F.lit(False))


def ends_by_observation(name: Column, observation: Column) -> Column:
    """Conversations end when the user's answer says STOP."""
    return F.coalesce((name == "chat_with_user") & observation.contains(STOP), F.lit(False))


def guarded(scenarios: DataFrame, environments: DataFrame, key: str, same: str) -> DataFrame:
    """Inner join on a unique key that fails the job on an unknown key or where the column ``same`` differs."""
    right = environments.withColumnsRenamed({c: f"__{c}" for c in environments.columns})
    joined = scenarios.join(right, F.col(key) == F.col(f"__{key}"), "left")
    fault = F.when(F.col(f"__{key}").isNull(), F.concat(F.lit("no environment "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    fault = fault.when(~F.col(same).eqNullSafe(F.col(f"__{same}")), F.concat(F.lit("another class in "), F.col(key).cast("string")))
    checked = joined.withColumn(key, F.when(fault.isNull(), F.col(key)).otherwise(F.raise_error(fault)))
    others = [F.col(f"__{c}").alias(c) for c in environments.columns if c not in (key, same)]
    return checked.select(*scenarios.columns, *others)


def task_of(requests: DataFrame, tasks: DataFrame, env: str, task: str) -> DataFrame:
    """Requested tasks by id, with a null task where it belongs to another environment."""
    known = tasks.withColumnRenamed(env, "__env")
    joined = requests.join(known, task, "left")
    kept = [F.when(F.col("__env") == F.col(env), F.col(c)).alias(c) for c in tasks.columns if c not in (env, task)]
    return joined.select(*requests.columns, *kept)


def zipped(first: Column, second: Column) -> Column:
    """Pairs of two lists up to the end of the shorter one."""
    n = F.least(F.size(first), F.size(second))
    return F.slice(F.arrays_zip(first, second), 1, n)


def restored(rows: DataFrame, ordinal: str) -> DataFrame:
    """Results in the order of their inputs."""
    return rows.orderBy(ordinal)


def resumed(rows: DataFrame, ordinal: str, offset: int = 0, limit: int = 1) -> DataFrame:
    """Rows from ``offset`` on, at most ``limit`` of them; 0 is no limit."""
    later = rows.orderBy(ordinal).offset(offset)
    return later.limit(limit) if limit else later


def one_task(tasks: DataFrame, id_column: str, seed: str) -> DataFrame:
    """One task, the first in the order of md5(seed:id)."""
    return tasks.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string"))), id_column).limit(1)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int, name: str = "batch") -> DataFrame:
    """Number of the fixed-size batch of each row within its group."""
    return rows.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def relevant_parts(tool: Column, state: Column, most: int = 5) -> Column:
    """Parts of a state (map of name to map) that the tool's name points to, all without a hint; of each the first ``most`` entries by key."""
    wanted = F.flatten(F.array(*[F.when(F.lower(tool).contains(word), F.array(*map(F.lit, parts))).otherwise(F.array().cast("array<string>")) for word, parts in STATE_PARTS.items()]))
    chosen = F.map_filter(state, lambda k, _: (F.size(wanted) == 0) | F.array_contains(wanted, k))
    cut = lambda m: F.map_from_entries(F.slice(F.array_sort(F.map_entries(m)), 1, most))
    return F.transform_values(chosen, lambda _, m: F.when(F.size(m) > most, cut(m)).otherwise(m))


def coverage(samples: DataFrame, env: str, by: str) -> DataFrame:
    """Per stratum and over all (null): rows and distinct environments, null ones not counted."""
    return samples.rollup(by).agg(F.count("*").alias("n"), F.countDistinct(env).alias("n_envs"))
