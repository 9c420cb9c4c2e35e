"""Arrow-batched column functions over JSON texts, for what SQL functions cannot express (recursion, tolerant reading)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from tracewright.functions import jsonx


def _record(kind, *names: str) -> StructType:
    out = StructType()
    for name in names:
        out = out.add(name, kind)
    return out


CHANGES = ArrayType(_record(StringType(), "path", "type", "before", "after", "note"))
MATCHES = _record(BooleanType(), "by_path", "strict")
RESPONSE = StructType().add("ok", BooleanType())
for _name in ("reasoning", "tool_call", "content", "error"):
    RESPONSE = RESPONSE.add(_name, StringType())


def _read(text):
    """A JSON text as an object; what does not read counts as absent."""
    if text is None:
        return None
    found = jsonx.first_that_reads(text, json.loads)
    return None if found is jsonx.ABSENT else found


def _text(value):
    return None if value is None else jsonx.dumps(value)


def _change_rows(before, after, as_text):
    return [{"path": p, "type": t, "before": _text(b), "after": _text(a), "note": n} for p, t, b, a, n in jsonx.changes(_read(before), _read(after), as_text)]


@F.pandas_udf(CHANGES)
def state_changes(before: pd.Series, after: pd.Series) -> pd.Series:
    """Ordered changes, structures compared by JSON text, notes on numbers."""
    return pd.Series([_change_rows(b, a, True) for b, a in zip(before, after, strict=True)])


@F.pandas_udf(CHANGES)
def state_changes_by_value(before: pd.Series, after: pd.Series) -> pd.Series:
    """Ordered changes, everything but objects compared by value (1 equals 1.0 and true)."""
    return pd.Series([_change_rows(b, a, False) for b, a in zip(before, after, strict=True)])


@F.pandas_udf(StringType())
def nested_state_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    read = lambda x: v if isinstance(v := _read(x), dict) else {}
    return pd.Series([jsonx.dumps(jsonx.nested_diff(read(o), read(n))) for o, n in zip(old, new, strict=True)])


@F.pandas_udf(StringType())
def apply_predicted(before: pd.Series, predicted: pd.Series) -> pd.Series:
    """State text after the predicted changes (a JSON list)."""
    return pd.Series([jsonx.dumps(jsonx.apply_all(_read(b), _read(p))) for b, p in zip(before, predicted, strict=True)])


@F.pandas_udf(MATCHES)
def state_matches(before: pd.Series, after: pd.Series, predicted_state: pd.Series) -> pd.DataFrame:
    rows = [jsonx.state_match(_read(b), _read(a), _read(p)) for b, a, p in zip(before, after, predicted_state, strict=True)]
    return pd.DataFrame(rows, columns=["by_path", "strict"])


@F.pandas_udf(BooleanType())
def feedback_matches(predicted: pd.Series, true: pd.Series) -> pd.Series:
    """Both texts read alike, compared by value."""
    return pd.Series([jsonx.to_object(p) == jsonx.to_object(t) for p, t in zip(predicted, true, strict=True)], dtype="boolean")


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return pd.Series([_text(jsonx.extract_simple(t)) for t in text])


@F.pandas_udf(StringType())
def extract_json_robust(text: pd.Series) -> pd.Series:
    return pd.Series([_text(jsonx.extract_robust(t)) for t in text])


@F.pandas_udf(BooleanType())
def success(observation: pd.Series) -> pd.Series:
    """Strict outcome of an observation's text."""
    return pd.Series([jsonx.success_of(o) for o in observation], dtype="boolean")


@F.pandas_udf(BooleanType())
def lenient_success(content: pd.Series, terminated: pd.Series) -> pd.Series:
    return pd.Series([jsonx.lenient_success(c, None if pd.isna(t) else bool(t)) for c, t in zip(content, terminated, strict=True)], dtype="boolean")


@F.pandas_udf(IntegerType())
def argument_count(action: pd.Series) -> pd.Series:
    return pd.Series([jsonx.argument_count(_read(a)) for a in action], dtype="int32")


@F.pandas_udf(StringType())
def call_text(action: pd.Series) -> pd.Series:
    return pd.Series([jsonx.call_text(v if isinstance(v := _read(a), dict) else a) for a in action])


@F.pandas_udf(RESPONSE)
def parse_response(text: pd.Series) -> pd.DataFrame:
    rows = [jsonx.parse_response(t or "") for t in text]
    return pd.DataFrame([(r["ok"], r["reasoning"], _text(r["tool_call"]), r["content"], r["error"]) for r in rows], columns=["ok", "reasoning", "tool_call", "content", "error"])
