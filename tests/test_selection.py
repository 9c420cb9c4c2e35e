"""Strata and clusters against plain versions."""

import hashlib
import math
import random

import pytest
from oracle import difference
from pyspark.sql import functions as F

from tracewright.operators import clusters, sampling
from tracewright.plans import catalogue


def plain_strata(rows, quotas, seed):
    used, out = set(), []
    for name, test, quota in quotas:
        turn = lambda r: hashlib.md5(f"{seed}:{name}:{r['id']}".encode()).hexdigest()  # noqa: B023, E731
        own = sorted((r for r in rows if test(r)), key=turn)
        picked, seen = [], set()
        for r in own:
            env = "unknown" if r["env"] is None else str(r["env"])
            if env in seen:
                continue
            seen.add(env)
            if env not in used and len(picked) < quota:
                picked.append(r)
        for r in own:
            if len(picked) < quota and r not in picked:
                picked.append(r)
        used |= {"unknown" if r["env"] is None else str(r["env"]) for r in picked}
        out += [(r["id"], name) for r in picked]
    return sorted(out)


@pytest.mark.parametrize(("n", "envs", "quota"), [(0, 1, 5), (40, 3, 5), (400, 7, 20), (400, 300, 12), (300, 40, 200), (60, 60, 0)])
def test_strata_against_a_plain_greedy_choice(spark, n, envs, quota):
    rng = random.Random(n + envs)
    rows = [{"id": i, "env": rng.choice([None, *range(envs)]), "c": rng.choice([None, 0, 1, 1, 2, 3])} for i in range(n)]
    frame = spark.createDataFrame([(r["id"], r["env"], r["c"], {"k": r["id"]}) for r in rows], "id long, env long, c int, m map<string, long>").repartition(5)
    quotas = [("a", "c = 1", quota), ("b", "c >= 1", quota // 2), ("c", "c = 0", quota), ("d", "c <> 2", 3)]
    tests = {"a": lambda r: r["c"] == 1, "b": lambda r: (r["c"] or 0) >= 1, "c": lambda r: r["c"] == 0, "d": lambda r: r["c"] is not None and r["c"] != 2}
    found = sampling.strata(frame, "env", "id", [(name, F.expr(t), q) for name, t, q in quotas], "s")
    assert found.columns == ["id", "env", "c", "m", "stratum"]
    assert sorted((r["id"], r["stratum"]) for r in found.collect()) == plain_strata(rows, [(name, tests[name], q) for name, _, q in quotas], "s")


def plain_kmeans(points, k, rounds):
    ids = sorted(points)
    dist = lambda a, b: round(math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), 9)
    centers = [points[ids[0]]]
    while len(centers) < k:
        d, i = max((min(dist(points[i], c) for c in centers), -i) for i in ids)
        if d <= 0:
            break
        centers.append(points[-i])
    near = lambda p: min((dist(p, c), n) for n, c in enumerate(centers))[1]
    for _ in range(rounds):
        own = {n: [points[i] for i in ids if near(points[i]) == n] for n in range(len(centers))}
        centers = [[round(sum(x) / len(x), 9) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centers)]
    return {i: near(points[i]) for i in ids}


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (4, 0), (4, 3), (9, 2)])
def test_kmeans_against_plain_rounds(spark, k, rounds):
    rng = random.Random(k)
    points = {i: [rng.gauss(5 * (i % 4), 1.5), rng.gauss(3 * (i % 3), 1)] for i in range(60)}
    odd = [(100, None), (101, []), (102, [float("nan"), 1.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame([*points.items(), *odd], "id long, v array<double>").repartition(4)
    found = {r["id"]: r["cluster"] for r in clusters.kmeans(frame, "v", "id", k, rounds).collect()}
    assert found == plain_kmeans(points, k, rounds) | {100: None, 101: None, 102: None, None: None}


def test_kmeans_of_few_and_no_vectors(spark):
    same = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert {r["cluster"] for r in clusters.kmeans(same, "v", "id", 5).collect()} == {0}
    assert clusters.kmeans(same.where("false"), "v", "id", 5).count() == 0


@pytest.mark.parametrize("name", ["q28_cluster_dedup", "q54_all_strata", "q55_sample_report"])
def test_queries_on_more_data(spark, name):
    assert difference(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.01") == ""
