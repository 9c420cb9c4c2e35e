"""Flat facts of generated source: one small function that parses a text and says what stands where; nothing is executed.

What the facts mean together (who uses what, verdicts, schemas) is worked out in ``operators.class_facts`` by grouping.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: kind: parsed, class, function, parameter, call, read, write, attribute or return; ``shape`` is the syntax of ``text``.
FACT = StructType([StructField(n, StringType()) for n in ("kind", "class", "function", "name")])
FACT = FACT.add("place", IntegerType()).add("text", StringType()).add("shape", StringType()).add("more", ArrayType(StringType()))
#: Methods that change a container in place.
MUTATORS = frozenset("append extend insert update clear pop remove discard setdefault".split())


def _parsed(source: str | None) -> ast.Module | None:
    """A text that is one string literal is the source that it quotes."""
    text, tree = (source or "").strip(), None
    for _ in range(2):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        match tree.body:
            case [ast.Expr(value=ast.Constant(value=str(quoted)))]:
                text = quoted
            case _:
                break
    return tree


def _attribute(node: ast.AST | None) -> str | None:
    """The attribute of ``self`` that a chain of members, items and calls begins with."""
    while node is not None and not (isinstance(node, ast.Attribute) and getattr(node.value, "id", "") == "self"):
        node = getattr(node, "value", None) or getattr(node, "func", None)
    return node.attr if node is not None else None


def _shown(node: ast.AST | None) -> tuple[str | None, str | None]:
    return (None, None) if node is None else (ast.unparse(node), type(node).__name__)


def _of_function(owner: str, item: ast.FunctionDef, lines: list[str]) -> Iterator[tuple]:
    name = item.name
    body = "\n".join(lines[item.lineno - 1 : item.end_lineno])
    yield "function", owner, name, name, item.lineno, *_shown(item.returns), [(ast.get_docstring(item) or "").strip(), body]
    given = item.args
    late = [None] * (len(given.args) - len(given.defaults)) + given.defaults[-len(given.args) or len(given.defaults) :]
    kinds = {"positional-only": given.posonlyargs, "positional-or-keyword": given.args, "vararg": [given.vararg], "kwonly": given.kwonlyargs, "kwarg": [given.kwarg]}
    defaults = {"positional-or-keyword": late, "kwonly": given.kw_defaults}
    place = 0
    for kind, some in kinds.items():
        for i, p in enumerate(some):
            if p is not None:
                default = defaults[kind][i] if kind in defaults else None
                yield "parameter", owner, name, p.arg, place, *_shown(p.annotation), [kind, *(x or "" for x in _shown(default))]
                place += 1
    for node in ast.walk(item):
        changed: list = []
        if isinstance(node, (ast.Assign, ast.Delete)):
            changed = node.targets
        elif isinstance(node, ast.AugAssign):
            changed = [node.target]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            changed = [node.func.value] if node.func.attr in MUTATORS else []
            if getattr(node.func.value, "id", "") == "self":
                yield "call", owner, name, node.func.attr, node.lineno, None, None, []
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load) and getattr(node.value, "id", "") == "self":
            yield "read", owner, name, node.attr, node.lineno, None, None, []
        elif isinstance(node, ast.Return):
            keys = [k.value for k in node.value.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)] if isinstance(node.value, ast.Dict) else []
            yield "return", owner, name, None, node.lineno, *_shown(node.value), keys
        for target in changed:
            if (state := _attribute(target)) is not None:
                yield "write", owner, name, state, node.lineno, None, None, []


def _attributes(owner: str, function: str, nodes: Iterator[ast.AST]) -> Iterator[tuple]:
    """Names that a class body, or members of ``self`` that ``__init__``, gives a type or a value."""
    for node in nodes:
        annotated = isinstance(node, ast.AnnAssign)
        if annotated or isinstance(node, ast.Assign):
            for target in [node.target] if annotated else node.targets:
                own = isinstance(target, ast.Attribute) and getattr(target.value, "id", "") == "self" if function else isinstance(target, ast.Name)
                if own:
                    yield "attribute", owner, function, target.attr if function else target.id, node.lineno, *_shown(node.annotation if annotated else node.value), ["annotated" if annotated else "assigned"]


def facts_of(source: str | None) -> list[tuple]:
    """All facts of a source; none if it does not parse or is empty. Nested functions belong to the one around them, except for their returns."""
    tree = _parsed(source)
    if tree is None or not source:
        return []
    out: list[tuple] = [("parsed", None, None, None, 0, None, None, [])]
    lines = ast.unparse(tree).split("\n") if source.strip()[:1] in "'\"" else source.strip().split("\n")
    for item in tree.body:
        if isinstance(item, ast.FunctionDef):
            out += _of_function("", item, lines)
        elif isinstance(item, ast.ClassDef):
            out.append(("class", item.name, None, item.name, item.lineno, None, None, []))
            out += _attributes(item.name, "", iter(item.body))
            for member in item.body:
                if isinstance(member, ast.FunctionDef):
                    out += _of_function(item.name, member, lines)
                    if member.name == "__init__":
                        out += _attributes(item.name, "__init__", ast.walk(member))
    return out


@F.pandas_udf(ArrayType(FACT))
def source_facts(source: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(FACT.names, fact, strict=True)) for fact in facts_of(s)] for s in source])
