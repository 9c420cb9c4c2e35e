"""Tolerant JSON reading, state differences and predicted-change application for one record.

Small pure-Python helpers; ``udfs`` applies them to Arrow batches. States are JSON texts, and results that hold values of any
shape are JSON texts again, so nothing depends on a schema.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

ABSENT = object()
#: Separators that degenerate model output repeats, in the order in which they are looked for.
JUNK = (r"\tNdrFc", r"\{EIF\{", r"EIF\{")
_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
_SHORT_OBJECT = re.compile(r"\{[\s\S]*?\}")


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def canonical(value: Any) -> str:
    """JSON text with sorted keys; 1 and 1.0 differ in it."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def first_that_reads(text: str, *readers: Callable[[str], Any]) -> Any:
    """Result of the first reader that accepts the text, else ABSENT."""
    for read in readers:
        try:
            return read(text)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
    return ABSENT


def extract_simple(text: Any) -> Any:
    """Fenced block (JSON, then Python literal), whole text, then the shortest braced piece; None where none reads."""
    if not isinstance(text, str):
        return None
    fence = _FENCE.search(text)
    steps = [(fence[1].strip(), (json.loads, ast.literal_eval))] if fence else []
    steps.append((text, (json.loads,)))
    if piece := _SHORT_OBJECT.search(text):
        steps.append((piece[0], (json.loads, ast.literal_eval)))
    for source, readers in steps:
        if (found := first_that_reads(source, *readers)) is not ABSENT:
            return found
    return None


def balanced_objects(text: str) -> Iterator[str]:
    """Top-level braced pieces, braces inside double-quoted strings not counted."""
    depth = start = 0
    for m in re.finditer(r'"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|[{}]', text):
        mark = m[0]
        if mark == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : m.end()]


def _without_trailing_commas(text: str) -> Any:
    return json.loads(re.sub(r",\s*([}\]])", r"\1", text))


def first_object(text: str) -> Any:
    """First balanced object that reads, trailing commas forgiven; None where none does."""
    for piece in balanced_objects(text):
        if (found := first_that_reads(piece, json.loads, _without_trailing_commas)) is not ABSENT:
            return found
    return None


def extract_robust(text: Any) -> Any:
    """As ``extract_simple`` for weak models: reasoning and repeated junk cut away, then the first balanced object."""
    if not isinstance(text, str):
        return None
    text = re.sub(r"<think>[\s\S]*?(?:</think>|\Z)", "", text, flags=re.IGNORECASE)
    cut = next((m.start() for p in JUNK if (m := re.search(p, text))), len(text))
    text = text[:cut]
    sources = [text]
    if fence := _FENCE.search(text):
        block = fence[1].strip()
        if (found := first_object(block)) is not None:
            return found
        if (found := first_that_reads(block, json.loads)) is not ABSENT:
            return found
    for source in sources:
        if (found := first_object(source)) is not None:
            return found
    found = first_that_reads(text, json.loads, ast.literal_eval)
    return None if found is ABSENT else found


def to_object(value: Any, extract: Callable[[Any], Any] = extract_simple) -> Any:
    """Whatever a text can be read as, quotes around it forgiven; else the value itself."""
    if not isinstance(value, str):
        return value
    stripped = value.strip()
    quoted = len(stripped) > 1 and stripped[0] == stripped[-1] and stripped[0] in "\"'"
    for text in (value, stripped[1:-1]) if quoted else (value,):
        if (found := extract(text)) is not None:
            return found
        if (found := first_that_reads(text, ast.literal_eval)) is not ABSENT:
            return found
    return value


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float))


def _leaf_change(old: Any, new: Any, as_text: bool) -> tuple[bool, str | None]:
    """Whether two present values differ, and the note on numbers. ``as_text``: structures are compared by canonical text
    and numbers get a note; otherwise everything is compared by value, so 1 equals 1.0 and true."""
    if not as_text:
        return old != new, None
    if isinstance(old, (dict, list)) or isinstance(new, (dict, list)):
        return canonical(old) != canonical(new), None
    if old == new:
        return False, None
    if _is_number(old) and _is_number(new):
        return True, f"decreased by {old - new}" if new < old else f"increased by {new - old}"
    return True, None


def changes(before: Any, after: Any, as_text: bool = True) -> list[tuple[str, str, Any, Any, str | None]]:
    """(path, type, before, after, note) of every change, in order of keys; an added or removed subtree is one change."""
    found = []
    stack = [("", before if isinstance(before, dict) else {}, after if isinstance(after, dict) else {}, None)]
    while stack:
        prefix, old, new, ready = stack.pop()
        if ready is not None:
            found.append(ready)
            continue
        level = []
        for key in sorted(old.keys() | new.keys()):
            path = f"{prefix}.{key}" if prefix else key
            o, n = old.get(key, ABSENT), new.get(key, ABSENT)
            if o is ABSENT:
                level.append((path, None, None, (path, "added", None, n, None)))
            elif n is ABSENT:
                level.append((path, None, None, (path, "removed", o, None, None)))
            elif isinstance(o, dict) and isinstance(n, dict):
                level.append((path, o, n, None))
            else:
                differs, note = _leaf_change(o, n, as_text)
                if differs:
                    level.append((path, None, None, (path, "modified", o, n, note)))
        stack.extend(reversed(level))
    return found


def nested_diff(old: dict, new: dict, ignored: tuple = ()) -> dict:
    """Nested {added} / {removed} / {changed: {old, new}}; unchanged parts left out, ``ignored`` keys of the top level too."""
    out = {}
    for key in sorted(old.keys() | new.keys()):
        if key in ignored:
            continue
        o, n = old.get(key, ABSENT), new.get(key, ABSENT)
        if o is ABSENT:
            out[key] = {"added": n}
        elif n is ABSENT:
            out[key] = {"removed": o}
        elif isinstance(o, dict) and isinstance(n, dict):
            if inner := nested_diff(o, n):
                out[key] = inner
        elif o != n:
            out[key] = {"changed": {"old": o, "new": n}}
    return out


def _index(step: Any) -> int | None:
    try:
        return int(step)
    except (TypeError, ValueError):
        return None


def apply(state: Any, path: Any, value: Any, kind: Any) -> bool:
    """Carry out one predicted change in place; False where the path leads nowhere.

    Missing objects on the way are made, lists grow as far as needed; ``delete`` and ``removed`` take away, any other
    kind sets.
    """
    steps = list(path) if isinstance(path, list) else str(path).split(".") if path else []
    if not steps:
        return False
    for step in steps[:-1]:
        if isinstance(state, dict):
            state = state.setdefault(step, {})
        elif isinstance(state, list) and (i := _index(step)) is not None and i >= -len(state):
            state.extend({} for _ in range(i + 1 - len(state)))
            state = state[i]
        else:
            return False
    last, takes_away = steps[-1], kind in ("delete", "removed")
    if isinstance(state, dict):
        if takes_away:
            return state.pop(last, ABSENT) is not ABSENT
        state[last] = value
        return True
    if not isinstance(state, list) or (i := _index(last)) is None:
        return False
    if takes_away:
        if not 0 <= i < len(state):
            return False
        state.pop(i)
        return True
    if i < -len(state):
        return False
    state.extend([None] * (i + 1 - len(state)))
    state[i] = value
    return True


def look_up(state: Any, path: str) -> Any:
    for step in path.split("."):
        if not isinstance(state, dict) or step not in state:
            return ABSENT
        state = state[step]
    return state


def apply_all(before: Any, predicted: Any) -> Any:
    """State after every well-formed predicted change (objects with path, type and value or after)."""
    state = json.loads(dumps(before)) if isinstance(before, (dict, list)) else {}
    for change in predicted if isinstance(predicted, list) else []:
        if isinstance(change, dict):
            value = change.get("after", change.get("value"))
            apply(state, change.get("path"), value, change.get("type"))
    return state


def state_match(before: Any, after: Any, predicted_state: Any) -> tuple[bool, bool]:
    """(every true change is found in the predicted state, the predicted state is the true one).

    The first asks only for the true changes' paths: further wrong changes do not count against it, and a removed path
    counts as found only if it still holds null.
    """
    true = changes(before, after, as_text=False)
    found = all((got := look_up(predicted_state, path)) is not ABSENT and got == new for path, _, _, new, _ in true)
    return found, predicted_state == (after if isinstance(after, dict) else {})


def success_of(observation: Any) -> bool | None:
    """The ``success`` field of an observation (text, or object with content), where it is true or false."""
    content = observation.get("content") if isinstance(observation, dict) else observation
    parsed = to_object(content) if content is not None and isinstance(observation, (dict, str)) else None
    found = parsed.get("success") if isinstance(parsed, dict) else None
    return found if isinstance(found, bool) else None


#: Words that settle an outcome when nothing else does, in the order in which they are looked for.
GOOD_WORDS = ("completed", "task completed", "finished", "success", "succeeded")
BAD_WORDS = ("failed", "error", "unsuccess", "failed to")


def lenient_success(content: Any, terminated: bool | None = None) -> bool:
    """Outcome by structure, then by a ``success: …`` fragment, then by words, then by ``terminated``."""
    text = str(content) if content is not None else "{}"
    parsed = content
    if isinstance(content, str) or content is None:
        start = text.strip()
        parsed = first_that_reads(start, ast.literal_eval, json.loads) if start[:1] in ("{", "[") else None
    if isinstance(parsed, dict):
        found = parsed.get("success", parsed.get("succeed", False))
        return found.lower() in ("true", "1", "yes") if isinstance(found, str) else bool(found)
    if m := re.search(r"['\"]?success['\"]?\s*:\s*(True|False|true|false|1|0)", text):
        return m[1].lower() in ("true", "1")
    low = text.lower()
    if any(w in low for w in GOOD_WORDS):
        return True
    return False if any(w in low for w in BAD_WORDS) else terminated is True


def argument_count(action: Any) -> int:
    if not isinstance(action, dict):
        return 0
    held = action.get("arguments") or action.get("args") or {}
    if not isinstance(held, (dict, list)):
        held = first_that_reads(str(held), json.loads)
    return len(held) if isinstance(held, (dict, list)) else 0


def call_text(action: Any) -> str:
    """``name({json arguments})``; arguments in a fenced block are unwrapped."""
    if not isinstance(action, dict):
        return str(action)
    held = action.get("arguments") or action.get("args") or {}
    if isinstance(held, str) and (fence := _FENCE.search(held)):
        inner = first_that_reads(fence[1].strip(), json.loads, ast.literal_eval)
        held = held if inner is ABSENT else inner
    return f"{action.get('name') or action.get('action') or 'call'}({dumps(held)})"


def parse_response(text: str) -> dict:
    """Reasoning, tool call and remaining text of a tagged model response, and whether its tags are in order."""
    text = text.strip()
    out = {"ok": True, "reasoning": None, "tool_call": None, "content": None, "error": None}
    think = re.search(r"[<@]think[>@]\s*(.*?)[<@]/think[>@]", text, re.S | re.I)
    if think:
        out["reasoning"] = think[1].strip()
    elif re.search(r"[<@]think[>@]", text, re.I):
        out.update(ok=False, error="think block is not closed")
    call = re.search(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", text, re.S)
    if call is None and "<tool_call>" in text and "</tool_call>" not in text:
        out.update(ok=False, error="tool call is not closed")
    out["content"] = text[think.end() if think else 0 : call.start() if call else len(text)].strip()
    if call:
        parsed = first_that_reads(call[1], json.loads)
        if not isinstance(parsed, dict) or not {"name", "arguments"} <= parsed.keys():
            out.update(ok=False, error="tool call does not read or lacks a field")
        else:
            out["tool_call"] = parsed
    return out


def parse_action(response: dict) -> dict | None:
    """Action of a parsed response: the tool call if there is one, else the text as a message to the user."""
    call = response.get("tool_call")
    if call:
        held = call["arguments"]
        if isinstance(held, str):
            held = first_that_reads(held, json.loads)
            if held is ABSENT:
                return None
        return {"name": call["name"], "arguments": held}
    return {"name": "chat_with_user", "arguments": {"content": response["content"]}} if response.get("content") else None
