"""Differences found by walking two states together, against a plain recursive comparison."""

import json
import random

from tracewright.operators import differences


def plain(before, after, prefix=()):
    before, after = (x if isinstance(x, dict) else {} for x in (before, after))
    number = lambda x: isinstance(x, (int, float))
    for key in sorted({*before, *after}):
        path = (*prefix, key)
        b, a = before.get(key), after.get(key)
        if key not in before or key not in after:
            yield ".".join(path), "added" if key not in before else "removed", None
        elif isinstance(b, dict) and isinstance(a, dict):
            yield from plain(b, a, path)
        elif number(b) and number(a):
            if b != a:
                yield ".".join(path), "modified", f"increased by {a - b}" if a > b else f"decreased by {b - a}"
        elif json.dumps(b, sort_keys=True) != json.dumps(a, sort_keys=True):
            yield ".".join(path), "modified", None


def state(rng, depth=0):
    if depth < 3 and rng.random() < 0.55:
        return {rng.choice(["a", "b", "c", "d.e", "é", "z z"]): state(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([0, 1, 7, -3, 2.5, True, False, None, "x", 'q"u[o}te', "", [], [1, {"k": "{"}], {}, 10**17])


def test_changes_against_a_plain_recursion(spark):
    rng = random.Random(2)
    pairs = [(i, state(rng), state(rng)) for i in range(300)] + [(900 + i, s := state(rng), s) for i in range(20)]
    rows = [(i, json.dumps(b), json.dumps(a)) for i, b, a in pairs] + [(1000, None, '{"a": 1}'), (1001, "not json", '{"a": {"b": 2}}'), (1002, None, None), (1003, "[1]", "{}")]
    frame = spark.createDataFrame(rows, "id long, before string, after string").repartition(4)
    found = {r["id"]: r for r in differences.attach(frame, "id", "before", "after").collect()}
    assert len(found) == len(rows)
    for i, b, a in [*pairs, (1000, None, {"a": 1}), (1001, None, {"a": {"b": 2}}), (1002, None, None), (1003, [1], {})]:
        assert [(c["path"], c["type"], c["note"]) for c in found[i]["changes"]] == list(plain(b, a)), (b, a)
        assert found[i]["change_count"] == len(found[i]["changes"])
    told = found[1001]["changes"][0]
    assert (told["before"], told["after"]) == (None, '{"b":2}')
    assert differences.changes(frame.where("false"), "before", "after").count() == 0


def test_depth_of_texts(spark):
    texts = [None, "5", '"[{"', "{}", '{"a": [1, {"b": "]}"}]}', '[[[]]]', '{"x\\"{": 1}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(differences.nesting(rows["t"])).collect()] == [0, 0, 0, 1, 3, 3, 1]


def test_calls(spark):
    actions = [{"name": "do", "arguments": {"b": 1, "a": ["x, y: \"z\"", {"k": None}]}}, {"name": "f", "arguments": {}}, {"name": "g"}, {"name": "h", "arguments": [1, 2]}]
    rows = spark.createDataFrame([(n, json.dumps(a)) for n, a in enumerate(actions)], "n long, a string")
    found = [(r["c"], r["k"]) for r in rows.select("n", differences.call_text(rows["a"]).alias("c"), differences.argument_count(rows["a"]).alias("k")).orderBy("n").collect()]
    assert found == [(f"{a['name']}({json.dumps(a.get('arguments', {}))})", len(a.get("arguments", {}))) for a in actions]
