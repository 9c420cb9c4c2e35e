"""Queries on samples and clusters whose results are defined row by row: the full set of strata, and k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import clusters, dedup, sampling
from tracewright.plans.catalogue import query, stratum_sql, table

#: Name, test and quota of each stratum, in the order in which they are filled.
STRATA = [
    ("failure", "event_type = 'error'", 20),
    ("same_args0", "event_type <> 'error' and changes = 0 and args = 0", 40),
    ("same_args1", "event_type <> 'error' and changes = 0 and args = 1", 40),
    ("simple_1", "event_type <> 'error' and changes = 1", 25),
    ("simple_2", "event_type <> 'error' and changes = 2", 25),
    ("medium_3", "event_type <> 'error' and changes = 3", 50),
    ("medium_4", "event_type <> 'error' and changes = 4", 50),
    ("medium_5", "event_type <> 'error' and changes = 5", 50),
    ("medium_6", "event_type <> 'error' and changes = 6", 50),
    ("difficult", "event_type <> 'error' and changes between 7 and 12", 50),
]
_SAMPLES = "(select *, cast(json_extract_string(props, '$.k') as bigint) % 15 as changes, cast(event_id % 3 as bigint) as args from events)"
_PICKED = "with " + ", ".join(stratum_sql(n, t, q, [x[0] for x in STRATA[:i]], "s7", _SAMPLES) for i, (n, t, q) in enumerate(STRATA))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return events.select("event_id", "user_id", "event_type", (F.get_json_object("props", "$.k").cast("long") % 15).alias("changes"), (F.col("event_id") % 3).alias("args"))


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strata(_samples(spark, sf_dir), "user_id", "event_id", [(n, F.expr(t), q) for n, t, q in STRATA], "s7")


@query(_PICKED + " " + " union all ".join(f"select * from {n}" for n, _, _ in STRATA))
def q54_all_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strata of the sample with their quotas (quotas are the feature), environments claimed in turn."""
    return _picked(spark, sf_dir).select("event_id", "user_id", "stratum")


@query(_PICKED + ", p as (" + " union all ".join(f"select * from {n}" for n, _, _ in STRATA) + ") select coalesce(stratum, 'all') as stratum, count(*) as n, count(distinct user_id) as n_envs from p group by rollup(stratum)")
def q55_sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and environments of each stratum of the sample and of the whole."""
    told = _picked(spark, sf_dir).rollup("stratum").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_envs"))
    return told.select(F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", "n_envs")


K, ROUNDS = 10, 3


def _kmeans_sql() -> str:
    """Farthest-first seeds and rounds of k-means written out one after another."""
    parts = ["e as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)", "s0 as materialized (select 0 as c, v from e order by vec_id limit 1)"]
    for i in range(1, K):
        far = f"(select e.vec_id, any_value(e.v) as v, min(round(list_distance(e.v, s.v), 9)) as d from e cross join s{i - 1} s group by e.vec_id)"
        parts.append(f"s{i} as materialized (select * from s{i - 1} union all select {i}, v from (select v from {far} where d > 0 order by d desc, vec_id limit 1))")
    now = f"s{K - 1}"
    near = "select vec_id, v, c from (select e.vec_id, e.v, s.c, row_number() over (partition by e.vec_id order by round(list_distance(e.v, s.v), 9), s.c) as nth from e cross join {} s) where nth = 1"
    for r in range(ROUNDS):
        parts.append(f"a{r} as materialized ({near.format(now)})")
        means = f"(select c, list(m order by i) as v from (select c, i, round(avg(x), 9) as m from (select c, unnest(v) as x, unnest(range(len(v))) as i from a{r}) group by c, i) group by c)"
        parts.append(f"m{r} as materialized (select o.c, coalesce(n.v, o.v) as v from {now} o left join {means} n on n.c = o.c)")
        now = f"m{r}"
    return "with " + ", ".join([*parts, f"f as materialized ({near.format(now)})"])


@query(
    _kmeans_sql()
    + """, u as (select c, vec_id, unnest(v) as x, unnest(range(len(v))) as i from f), m as (select c, i, avg(x) as m from u group by c, i),
 d as (select u.c, vec_id, round(sqrt(sum((x - m) * (x - m))), 9) as d from u join m on m.c = u.c and m.i = u.i group by u.c, vec_id)
 select vec_id, n from (select vec_id, count(*) over (partition by c) as n, row_number() over (partition by c order by d, vec_id) as nth from d) where nth = 1"""
)
def q28_cluster_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative per k-means cluster, and how many rows it stands for."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    clustered = clusters.kmeans(rows, "embedding", "vec_id", K, ROUNDS)
    return dedup.representatives(clustered, "cluster", "embedding", "vec_id").select("vec_id", "n")
