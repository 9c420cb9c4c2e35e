"""Sources of environments against plain text handling."""

import re

from pyspark.sql import functions as F

from tracewright.operators import environments as E

SOURCES = [
    "import json\n\nclass Item:\n    x: int\n\nclass Shop(Base):\n    pass\n\nclass Shop2 :\n    '''doc'''\n    def __init__(self):\n        import re\n        self.a = 1\n\n    def buy(self, n):\n        from os import path\n        import json\n        return n\n\n    async def sell(self):\n        return None\n",
    "class Only(Base):\n    def __init__(self, state):\n        self.state = state\n",
    "class None1:\n    pass\n",
    "",
]


def name_of(source):
    head = source.split("def __init__")[0]
    found = re.findall(r"class\s+(\w+)\s*:", head)
    return found[-1] if found else head.split("class ")[-1].split(":")[0].strip()


def hoist(source):
    lines = source.splitlines()
    own = [x.strip() for x in lines if re.match(r"(import .+|from .+ import .+)", x.strip())]
    rest = [x for x in lines if not re.match(r"(import .+|from .+ import .+)", x.strip())]
    first = list(dict.fromkeys(own))
    return "\n".join([*first, *([""] if first else []), *rest]).strip() + "\n"


def test_names_definitions_and_imports(spark):
    rows = spark.createDataFrame([(n, s) for n, s in enumerate(SOURCES)], "n long, s string")
    found = rows.select("n", E.class_name(F.col("s")).alias("name"), E.hoisted(F.col("s")).alias("hoisted"), E.class_definition(F.col("s"), E.class_name(F.col("s"))).alias("definition")).orderBy("n").collect()
    assert [r["name"] for r in found] == [name_of(s) for s in SOURCES]
    assert [r["hoisted"] for r in found] == [hoist(s) for s in SOURCES]
    assert found[0]["definition"] == SOURCES[0].split("def buy")[0]
    assert found[1]["definition"] == SOURCES[1] and found[2]["definition"] is None


def test_assembly(spark):
    definition = "class A:\n    '''doc'''\n\n    def __init__(self):\n        self.a = 1\n\n    def last(self):\n        pass"
    methods = ["def one(self):\n    return 1\n", "  def two(self):\n\n    return 2"]
    row = spark.createDataFrame([(definition, methods), ("class B:\n    pass", methods), ("class C:\n    def __init__(self):\n        pass\n", [])], "d string, m array<string>")
    found = [r[0] for r in row.select(E.assembled(F.col("d"), F.col("m"))).collect()]
    assert found[0] == "class A:\n    '''doc'''\n\n    def __init__(self):\n        self.a = 1\n\n\n    def one(self):\n        return 1\n\n    def two(self):\n\n        return 2\n\n    def last(self):\n        pass"
    assert found[1] is None and found[2] == "class C:\n    def __init__(self):\n        pass\n"


def test_sources_of_functions_and_ordered_cases(spark, tmp_path):
    envs = spark.createDataFrame([("e", SOURCES[0]), ("f", SOURCES[1]), (None, "x")], "env string, s string")
    cases = spark.createDataFrame([("e", "buy", 2, "b"), ("e", "buy", 1, "z"), ("e", "buy", 1, "a"), ("e", "sell", 1, None), ("f", "gone", 1, "q")], "env string, fn string, step int, what string")
    told = {(r["env"], r["fn"], r["what"]): r["function_source"] for r in E.with_sources(cases, envs, "env", "fn", "s").collect()}
    assert told["e", "buy", "b"] == "    def buy(self, n):\n        from os import path\n        import json\n        return n"
    assert told["e", "sell", None] == "    async def sell(self):\n        return None" and told["f", "gone", "q"] is None
    listed = {(r["env"], r["fn"]): [c["what"] for c in r["cases"]] for r in E.ordered_cases(cases.repartition(5), ["env", "fn"], ["step"], ["what"]).collect()}
    assert listed == {("e", "buy"): ["a", "z", "b"], ("e", "sell"): [None], ("f", "gone"): ["q"]}
    E.write_sources(envs, "env", "s", str(tmp_path / "src"))
    assert sorted(p.name for p in (tmp_path / "src").iterdir() if p.is_dir()) == ["env=e", "env=f"]


def test_ends_and_members(spark):
    rows = [("conversation", "chat_with_user", "x", "bye ###STOP###", True), ("conversation", "chat_with_user", "Task Completed", "go on", False), ("conversation", "buy", "", "###STOP###", False), ("single", "chat_with_user", "Task Failed.", None, True), ("single", "chat_with_user", None, None, False), ("any_message", "chat_with_user", None, None, True), ("any_message", "buy", "Task Completed", None, False), ("other", "chat_with_user", "Task Completed", "###STOP###", False), (None, None, None, None, False)]
    frame = spark.createDataFrame(rows, "mode string, name string, content string, observation string, expected boolean")
    assert all(r["e"] == r["expected"] for r in frame.select("expected", E.ended(*[F.col(c) for c in ("mode", "name", "content", "observation")]).alias("e")).collect())
    texts = spark.createDataFrame([('{"a": null}', True), ('{"b": {"a": 1}}', False), ("[1]", False), (None, False), ("a", False)], "t string, expected boolean")
    assert all(r["h"] == r["expected"] for r in texts.select("expected", E.has_member(F.col("t"), "a").alias("h")).collect())
