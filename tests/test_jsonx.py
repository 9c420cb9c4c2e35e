import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewright.functions import jsonx as J


@pytest.mark.parametrize(
    ("before", "after", "expected"),
    [
        ({"x": 1}, {"x": 3}, [("x", "modified", "increased by 2")]),
        ({"x": 5}, {"x": 3}, [("x", "modified", "decreased by 2")]),
        ({}, {"u": {"p": 1, "q": 2}}, [("u", "added", None)]),
        ({"u": {"p": 1}}, {"u": {}}, [("u.p", "removed", None)]),
        ({"l": [1]}, {"l": [1, 2]}, [("l", "modified", None)]),
        ({"l": [1]}, {"l": [1.0]}, [("l", "modified", None)]),
        ({"k": None}, {"k": None}, []),
        ({}, {"k": None}, [("k", "added", None)]),
        ({"b": True}, {"b": False}, [("b", "modified", "decreased by 1")]),
        (None, None, []),
    ],
)
def test_changes(before, after, expected):
    assert [(p, t, n) for p, t, _, _, n in J.changes(before, after)] == expected


def test_changes_by_value_take_equal_numbers_as_equal():
    assert J.changes({"l": [1], "b": 1}, {"l": [1.0], "b": True}, as_text=False) == []


@pytest.mark.parametrize(
    ("before", "after", "predicted", "by_path", "strict"),
    [
        ({"a": 1}, {"a": 2}, [("a", "modify", 2)], True, True),
        ({"a": 1, "b": 1}, {"a": 2, "b": 1}, [("a", "modify", 2), ("b", "modify", 9)], True, False),
        ({"a": 1, "b": 1}, {"a": 1}, [("b", "delete", None)], False, True),
        ({"a": 1}, {"a": 1}, [("a", "modify", 9)], True, False),
        ({"u": {}}, {"u": {"p": 1}}, [("u.p", "add", 1)], True, True),
    ],
)
def test_state_match(before, after, predicted, by_path, strict):
    state = J.apply_all(before, [{"path": p, "type": t, "after": v} for p, t, v in predicted])
    assert J.state_match(before, after, state) == (by_path, strict)


@pytest.mark.parametrize(
    ("content", "terminated", "expected"),
    [
        ("{'success': True}", None, True),
        ('{"success": false}', None, False),
        ('{"succeed": true}', None, True),
        ("{}", None, False),
        ("result success: 1", None, True),
        ("Task completed", None, True),
        ("operation unsuccessful", None, True),
        ("operation failed", None, False),
        ("hello", True, True),
        ("hello", None, False),
        (None, None, False),
    ],
)
def test_lenient_success(content, terminated, expected):
    assert J.lenient_success(content, terminated) is expected


@pytest.mark.parametrize(
    ("text", "simple", "robust"),
    [
        ('```json\n{"a":1}\n```', {"a": 1}, {"a": 1}),
        ('x {"a":1} y', {"a": 1}, {"a": 1}),
        ('x {"a":{"b":1}} y', None, {"a": {"b": 1}}),
        ('{"a":1,}', {"a": 1}, {"a": 1}),
        ('<think>{"z":0}</think>{"a":1}', {"z": 0}, {"a": 1}),
        ("nothing", None, None),
        (None, None, None),
    ],
)
def test_extract(text, simple, robust):
    assert J.extract_simple(text) == simple
    assert J.extract_robust(text) == robust


def test_parse_response_and_action():
    found = J.parse_response('<think>why</think> hi <tool_call>{"name": "f", "arguments": "{\\"x\\": 1}"}</tool_call>')
    assert found["ok"] and found["reasoning"] == "why" and found["content"] == "hi"
    assert J.parse_action(found) == {"name": "f", "arguments": {"x": 1}}
    assert not J.parse_response("<think>open")["ok"] and not J.parse_response("<tool_call>{")["ok"]
    assert J.parse_action(J.parse_response("hello"))["name"] == "chat_with_user"
    assert J.parse_action(J.parse_response("")) is None


def test_apply_grows_lists_and_refuses_bad_paths():
    state = {"l": []}
    assert J.apply(state, "l.2", 5, "add") and state == {"l": [None, None, 5]}
    assert not J.apply(state, "l.x", 1, "add") and not J.apply(state, "", 1, "add") and not J.apply(state, "l.9", None, "delete")


values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda v: st.lists(v, max_size=2) | st.dictionaries(st.sampled_from("abc"), v, max_size=3), max_leaves=8)
states = st.dictionaries(st.sampled_from("abc"), values, max_size=3)


@given(states, states)
def test_changes_rebuild_the_state(before, after):
    out = json.loads(json.dumps(before))
    for path, kind, _, new, _ in J.changes(before, after):
        assert J.apply(out, path, new, kind)
    assert J.canonical(out) == J.canonical(after)


@given(states)
def test_no_changes_of_a_state_with_itself(state):
    assert J.changes(state, state) == [] and J.nested_diff(state, state) == {}
