"""Facts and declarative checks against a plain reading of nested states."""

import json
import random

import pytest
from oracle import difference
from pyspark.sql import functions as F

from tracewright.operators import checks, facts
from tracewright.plans import catalogue


def walk(value, path=()):
    yield path, value
    parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for step, part in parts:
        yield from walk(part, (*path, str(step)))


STATE = {"users": {"u1": {"name": "Ann", "age": 30, "tags": ["a", "b"]}, "u2": {"name": "", "age": 17.0, "tags": []}}, "n": None, "ok": True, "list": [[1, 2], {"x": "y"}]}


def test_facts_of_nested_states(spark):
    rows = spark.createDataFrame([(1, json.dumps(STATE)), (2, "[1]"), (3, "not json"), (4, None), (5, "7")], "id long, s string").withColumn("s", F.try_parse_json("s"))
    found = facts.described(facts.flattened(rows, "s", 9)).collect()
    for i, value in ((1, STATE), (2, [1]), (5, 7)):
        mine = {tuple(r["path"]): json.loads(r["text"]) for r in found if r["id"] == i}
        assert mine == dict(walk(value))
    assert {r["id"] for r in found} == {1, 2, 5}
    kinds = {tuple(r["path"]): (r["kind"], r["number"]) for r in found if r["id"] == 1}
    assert kinds["users", "u2", "age"] == ("number", 17.0) and kinds["n",] == ("null", None) and kinds["ok",] == ("boolean", None) and kinds["list", "0"] == ("array", None)
    shallow = facts.flattened(rows, "s", 1).where("id = 1").count()
    assert shallow == 5


def plain(op, value, literal, before, known):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    kind = lambda x: {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
    if op == "exists":
        return True
    if op in ("eq", "ne"):
        same = value == literal and kind(value) == kind(literal)
        return same if op == "eq" else not same
    if op in ("lt", "le", "gt", "ge"):
        if (number(value) and number(literal)) or (isinstance(value, str) and isinstance(literal, str)):
            return {"lt": value < literal, "le": value <= literal, "gt": value > literal, "ge": value >= literal}[op]
        return None
    if op == "type":
        return kind(value) == literal
    if op == "nonempty":
        return value is not None and (bool(value.strip(" ")) if isinstance(value, str) else bool(value) if isinstance(value, (dict, list)) else True)
    if op in ("contains", "starts", "ends"):
        if not isinstance(value, str) or not isinstance(literal, str):
            return None
        return {"contains": literal in value, "starts": value.startswith(literal), "ends": value.endswith(literal)}[op]
    if op == "added":
        return not known
    if op == "changed":
        return known and before != value
    return known and before == value


def verdict(rules, initial, final):
    was = dict(walk(initial)) if initial is not None else {}
    now = list(walk(final)) if final is not None else []
    out = []
    for _, _, _, _, path, quantifier, op, literal in rules:
        literal = None if literal is None else json.loads(literal)
        met = [(p, v) for p, v in now if len(p) == len(path) and all(s in ("*", q) for s, q in zip(path, p, strict=True))]
        told = [plain(op, v, literal, was.get(p), p in was) for p, v in met]
        if op not in checks.KNOWN or None in told:
            out.append(None)
        else:
            out.append({"any": any(told), "all": bool(told) and all(told), "none": not any(told)}[quantifier])
    if None in out:
        return None
    return any(out) if rules[0][3] == "any" else all(out)


def test_checks_against_a_plain_evaluator(spark):
    rng = random.Random(5)
    other = json.loads(json.dumps(STATE))
    other["users"]["u3"] = {"name": "Bob", "age": 30}
    other["users"]["u1"]["age"] = 31
    del other["ok"]
    states = {1: ("a", STATE, other), 2: ("a", None, STATE), 3: ("b", other, other), 4: ("a", STATE, None), 5: ("b", STATE, {"users": {}}), 6: ("c", STATE, STATE)}
    paths = [["users", "*", "age"], ["users", "*"], ["users", "u3"], ["ok"], ["list", "*", "*"], ["*"], [], ["users", "*", "tags", "*"], ["users", "u1", "name"], ["none", "x"]]
    literals = ["30", "30.0", '"Ann"', '"a"', "null", "true", '"object"', '"number"', "[1,2]", '""']
    rules = []
    for env in ("a", "b"):
        for c in range(80):
            mode = rng.choice(["all", "any"])
            rules += [(env, f"c{c}", r, mode, rng.choice(paths), rng.choice(["any", "all", "none"]), rng.choice([*checks.KNOWN, "eq", "ge", "odd"]), rng.choice(literals)) for r in range(rng.randint(1, 3))]
    frame = spark.createDataFrame([(i, e, None if a is None else json.dumps(a), None if b is None else json.dumps(b)) for i, (e, a, b) in states.items()] + [(None, "a", "1", "1"), (9, None, "1", "1")], "id long, env string, initial string, final string")
    found = {(r["id"], r["check_id"]): r["passed"] for r in checks.check_results(frame, spark.createDataFrame(rules, checks.RULE)).collect()}
    expected = {}
    for i, (env, a, b) in states.items():
        for c in {r[1] for r in rules if r[0] == env}:
            expected[i, c] = verdict([r for r in rules if r[0] == env and r[1] == c], a, b)
    assert found == expected
    assert {True, False, None} == set(found.values())
    paid = {r["id"]: r for r in checks.rewards(spark.createDataFrame([(i, c, p) for (i, c), p in found.items()], "id long, check_id string, passed boolean")).collect()}
    assert paid[1]["n_checks"] == 80 and paid[1]["reward"] == round(sum(bool(p) for (i, _), p in expected.items() if i == 1) / 80, 4)
    assert checks.check_results(frame.where("false"), spark.createDataFrame(rules, checks.RULE)).count() == 0
    assert checks.check_results(frame, spark.createDataFrame([], checks.RULE)).count() == 0


@pytest.mark.parametrize("name", ["q53_state_checks"])
def test_queries_on_more_data(spark, name):
    assert difference(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.01") == ""
