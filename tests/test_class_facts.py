import json

from pyspark.sql import functions as F

from tracewright.functions import source_facts as S
from tracewright.operators import class_facts as C

SOURCE = '''
import os

class Other:
    pass

class Shop:
    name: str
    limit = 5

    def __init__(self, items: typing.Dict[str, int]):
        self.items: Dict[str, int] = items
        self.log = []
        self.hidden = self.load()

    def buy(self, who: Optional[str], n=1, *rest, flag: bool = False, when=make.now(), **more) -> Dict[str, Any]:
        """Buy."""
        self.items[who] = n
        self.log.append(who)
        self.check(who)
        return {"success": True, "data": n}

    def check(self, who):
        if self.limit > 3:
            return {"ok": 1}
        del self.extra.deep[who]
        return who

def alone(a: "Shop", b: int | None = None):
    return
'''


def _table(spark):
    return spark.createDataFrame([(1, SOURCE), (2, "broken("), (3, None), (4, repr("def f():\n    return 1")), (5, "")], "id long, src string")


def test_methods_and_parameters(spark):
    found = C.facts(_table(spark), "id", "src")
    methods = {r["function"]: r for r in C.methods(found, "id").where("id = 1").collect()}
    buy, check = methods["buy"], methods["check"]
    assert set(methods) == {"buy", "check"}
    assert (buy["calls"], buy["reads"], buy["writes"]) == (["check"], ["check", "items", "log"], ["items", "log"])
    assert (check["reads"], check["writes"]) == (["extra", "limit"], ["extra"])
    assert buy["returns"] == "Dict[str, Any]" and buy["doc"] == "Buy." and buy["source"].lstrip().startswith("def buy") and check["returns"] is None
    rows = C.parameters(found, "id").where("id = 1").orderBy("function", "place").collect()
    told = {f: [(r["name"], r["type"], r["default"], r["kind"]) for r in rows if r["function"] == f] for f in ("buy", "alone", "__init__")}
    assert told["buy"] == [
        ("self", None, None, "positional-or-keyword"),
        ("who", "Optional[str]", None, "positional-or-keyword"),
        ("n", None, "1", "positional-or-keyword"),
        ("rest", None, None, "vararg"),
        ("flag", "bool", "False", "kwonly"),
        ("when", None, "now(...)", "kwonly"),
        ("more", None, None, "kwarg"),
    ]
    assert told["alone"] == [("a", "str", None, "positional-or-keyword"), ("b", "unknown", "None", "positional-or-keyword")]
    assert told["__init__"][1][:2] == ("items", "Dict[str, int]")


def test_states(spark):
    states = {r["state"]: r for r in C.states(C.facts(_table(spark), "id", "src"), "id").where("id = 1 and class = 'Shop'").collect()}
    assert {s: r["type"] for s, r in states.items()} == {"name": "str", "limit": "int", "items": "Dict[str, int]", "log": "unknown", "hidden": "unknown", "check": None, "extra": None}
    assert (states["items"]["used_by"], states["items"]["modified_by"]) == (["buy"], ["buy"])
    assert (states["limit"]["used_by"], states["limit"]["modified_by"], states["extra"]["modified_by"]) == (["check"], [], ["check"])


def test_returns_and_validity(spark):
    table = _table(spark)
    found = C.facts(table, "id", "src")
    told = sorted((r["function"], r["status"], r["message"]) for r in C.returns(found, "id").where("id = 1").collect())
    assert told == [("alone", "FAIL", "returns nothing"), ("buy", "PASS", "success,data"), ("check", "FAIL", "no success key"), ("check", "WARN", "variable who")]
    lone = spark.createDataFrame([(1, 'def f():\n    return {"success": 1}\ndef g():\n    return f()')], "id long, src string")
    strict = sorted((r["function"], r["status"], r["message"]) for r in C.returns(C.facts(lone, "id", "src"), "id", strict=True).collect())
    assert strict == [("f", "WARN", "success without data, message or error"), ("g", "WARN", "Call")]
    valid = {r["id"]: (r["parses"], r["has_function"]) for r in C.validity(table, "id", "src").collect()}
    assert valid == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, True), 5: (False, False)}
    assert S.facts_of("class A:\n    def f(self): pass")[1][:2] == ("class", "A")


def test_schemas(spark):
    types = [("a", "str"), ("b", "Optional[int]"), ("c", "list"), ("d", "Custom"), ("e", "Any"), ("f", "Optional[List[int]]"), ("g", "List[List[float]]"), ('h"', None)]
    rows = spark.createDataFrame([(1, "f", n, name, kind) for n, (name, kind) in enumerate([("self", None), *types])], "id long, function string, place int, name string, type string")
    said = spark.createDataFrame([(1, "f", 'say "x"'), (1, "none", None)], "id long, function string, description string")
    made = {r["function"]: json.loads(r["schema"]) for r in C.tool_schemas(rows, "id", said).collect()}
    assert made["none"] == {"type": "function", "function": {"name": "none", "description": "", "parameters": {"type": "object", "properties": {}, "required": []}}}
    given = made["f"]["function"]["parameters"]
    assert made["f"]["function"]["description"] == 'say "x"' and given["required"] == ["a", "c", "d", "e", "g", 'h"']
    assert given["properties"] == {
        "a": {"type": "string"},
        "b": {"type": ["integer", "null"]},
        "c": {"type": "array", "items": {}},
        "d": {"type": "object"},
        "e": {},
        "f": {"type": ["array", "null"], "items": {"type": "integer"}},
        "g": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}},
        'h"': {"type": "object"},
    }


def test_no_sources(spark):
    none = _table(spark).where("false")
    assert C.validity(none, "id", "src").count() == 0 and C.methods(C.facts(none, "id", "src"), "id").select(F.col("id")).count() == 0
