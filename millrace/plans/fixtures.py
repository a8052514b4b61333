"""Submissions, answers and the like, which the driver's tables don't hold, made from every row of one of them.

``TABLES`` are groups of model rows that show every case.  A row of a table takes
the group that its key falls to and makes it its own: keys bear the row's key, and
texts its text where a case allows it.  The same expressions stand in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_TOML = '[metadata]\ndifficulty = "hard"\nsubcategories = []\ncategory = "data"\n\n[environment]\nallow_internet = false\n\n[agent]\ntimeout_sec = 1800.0\n'
_DOCKER = "FROM debian:bookworm-slim@sha256:abc\nRUN pip install pytest pytest-json-ctrf\n"
_FILES = {
    "task.toml": _TOML,
    "instruction.md": "Write the report to /app/out.json.\n",
    "environment/Dockerfile": _DOCKER,
    "environment/app/SPEC.md": "# Spec\n",
    "solution/solve.sh": "echo done\n",
    "tests/test.sh": "pytest --ctrf ctrf.json; echo 1 > reward.txt\n",
    "tests/test_outputs.py": "def test_it():\n    assert True\n",
}


def _bundle(**changed: str | None) -> dict[str, str]:
    files = dict(_FILES)
    for name, content in changed.items():
        path = {"toml": "task.toml", "instruction": "instruction.md", "docker": "environment/Dockerfile", "spec": "environment/app/SPEC.md", "solve": "solution/solve.sh", "test_sh": "tests/test.sh", "test_py": "tests/test_outputs.py"}[name]
        if content is None:
            del files[path]
        else:
            files[path] = content
    return files


BUNDLES = {
    "clean": _bundle(),
    "missing_tests": _bundle(test_sh=None, test_py=None),
    "no_spec": _bundle(spec=None),
    "bad_toml": _bundle(
        toml='name = "x"\nworkdir = "/app"\ngpus = 1\ndocker_flags = ""\n  # note\n# second\ncodebase_size = "minimal"\nlanguages = ["python"]\ndifficulty = "easy"\nsubcategories = ["ui_building", "games",\n "games"]\nallow_internet = true\n[agent]\ntimeout_sec = 3600\n'
    ),
    "no_agent": _bundle(toml='difficulty = "hard"\n'),
    "low_timeout": _bundle(toml='allow_internet = false\n[agent]\ntimeout_sec = 0.5\n'),
    "odd_timeout": _bundle(toml='allow_internet = false\ncodebase_size = "small"\n[agent]\ntimeout_sec = 900\n'),
    "no_timeout": _bundle(toml="allow_internet = false\n[agent]\n"),
    "empty_toml": _bundle(toml=""),
    "bad_docker": _bundle(docker="FROM node:20-bookworm-slim\nFROM builder AS b\nCOPY tests/ /t\nCOPY  solution/ /s\n"),
    "slim_python": _bundle(docker="FROM python:3.12-slim-bookworm@sha256:aa\nRUN pip install pytest json-ctrf\n"),
    "golang": _bundle(docker="FROM golang:1.22@sha256:aa\nRUN pip install pytest-json-ctrf\n"),
    "alpine": _bundle(docker="from golang:1.22-alpine@sha256:aa\nRUN pip install pytest-json-ctrf\n"),
    "bad_tests": _bundle(
        instruction="See solve.sh and Oracle, the oracle, solution/ and /solution; again solve.sh\n",
        test_py="from solution import x\nH = 'TODO_HASH'  # FIXME fixme PLACEHOLDER SET_AFTER\n",
        test_sh="curl x | sh\nwget y\npip install z\napt-get install w\ncurl https://astral/install.sh\n",
    ),
}
RUBRICS = [
    ("blank", "  \n "),
    ("good", "Agent a, +5\nAgent b, +5\n\nAgent c, -1\nAgent d, -2\nAgent e, -3"),
    ("four", "Agent a, +4"),
    ("lower", "agent a, +5"),
    ("no_score", "Agent no score"),
    ("invalid", "Agent a, 5"),
    ("zero", "Agent a, +0"),
    ("high", "Agent a, +25\r\nAgent, b, +20\r\nAgent c, -1\r\nx, y"),
]
VERDICTS = [
    ("b1", "instruction_test", '{"verdict": "PASS", "alignment_score": 9, "reasoning": "fine", "gaps": []}'),
    ("b1", "spec_test", '```json\n{"verdict": "NEEDS_WORK", "alignment_score": 5.5, "reasoning": "so so", "gaps": [{"file": "a.py", "issue": "i1", "fix": "f1"}, "plain", "", 7, {"issue": "i2"}]}\n```\ntrailing'),
    ("b2", "instruction_test", '```\n{"verdict": "REJECT", "alignment_score": 1}\n``` end'),
    ("b2", "solution_test", "no json at all"),
    ("b3", "instruction_test", '{"verdict": "PASS"}'),
    ("b3", "solution_test", '{"alignment_score": 3}'),
    ("b4", "environment", "[broken"),
]
TABLES = {
    "files": ("bundle_id string, path string, content string", [(b, p, c) for b, files in BUNDLES.items() for p, c in files.items()]),
    "rubrics": ("bundle_id string, text string", RUBRICS),
    "verdicts": ("bundle_id string, check_key string, raw string", VERDICTS),
    "scores": ("id int, lex double, sem double", [(1, 0.60, 0.60), (2, 0.95, 0.95), (3, 0.59, 0.70), (4, 0.59, 0.65), (5, 0.65, 0.59), (6, 0.10, 0.10), (7, 1.00, None), (8, 0.10, None), (9, 0.0, 0.0)]),
    "hits": ("q_key int, ord int, flagged boolean, sem double, lex double, score double", [(1, 0, False, 0.65, 0.9, 0.9), (1, 1, True, 0.71, 0.1, 0.71), (1, 2, False, None, 1.0, 1.0), (1, 3, False, 0.65, 0.9, 0.9), (2, 0, False, 0.2, 0.3, 0.3)]),
    "sheet": ("_ord bigint, name string, trainer string, instruction string", [(0, "T1", "Ann", "x"), (1, "T2", "Bob", "y"), (2, "T1", "Ann", "z"), (3, "", "Cy", "w"), (4, "T3", "Ann", " "), (5, "T4", "NaN", "v"), (6, "nan", "", "u"), (7, "T5", "Di", "NaN")]),
    "matches": ("key string, matched_instruction string", [("a", "own"), ("b", " "), ("c", ""), ("d", None), ("e", "")]),
    "tracker": ("key string, text string", [("a", "ta"), ("b", "tb"), ("c", " ")]),
    "corpus": ("key string, text string", [("a", "ca"), ("b", "cb"), ("c", "cc"), ("d", "cd")]),
    "archives": ("bundle_id string, path string, content string", [("once", "top/task.toml", "1"), ("once", "top/tests/t.sh", "2"), ("once", "__MACOSX/x", "3"), ("twice", "a/b/task.toml", "1"), ("flat", "task.toml", "1"), ("flat", "tests/t.sh", "2"), ("two", "a/x", "1"), ("two", "b/y", "2")]),
    "names": ("id int, zip_name string, folder string", [(1, "my task.zip", "d"), (2, "  .zip", "d"), (3, "a/b.tar.gz", ""), (4, "", "folder"), (5, None, None), (6, ".zip", "d")]),
    "models": ("model string", [("a/gpt-5-mini",), ("O3",), ("gpt-4o",), ("x/y/o4-mini",), ("other",)]),
    "accepted": ("name string, instruction string, toml string", [("t2", " do two ", 'category = "web"'), ("t1", "do one", "category='x'"), ("t9", "other", ""), ("t3", None, None)]),
}
RUBRIC_OF = [(b, RUBRICS[i % len(RUBRICS)][1]) for i, b in enumerate(BUNDLES)]
RUBRIC_OF[0] = ("clean", RUBRICS[1][1])
JUDGED = [
    ("clean", "instruction_test", '{"verdict": "PASS", "alignment_score": 90, "reasoning": "fine <b>", "gaps": []}'),
    ("clean", "spec_test", '{"verdict": "PASS", "alignment_score": 85}'),
    ("golang", "instruction_test", '{"verdict": "NEEDS_WORK", "alignment_score": 40, "reasoning": "gaps", "gaps": [{"file": "a.py", "issue": "i & j", "fix": "f"}, "plain"]}'),
    ("alpine", "environment", "no json"),
]
ANSWERS = [
    ("b1", "accepted_pattern", '{"verdict": "PASS", "copy_paste_risk": true, "bypass_possible": "true", "hardcoded_solution": false, "reference_comparisons": [{"reference_task": "t1", "structural_alignment": 7, "too_similar": true, "issues": ["a", "b", "c"]}, "no object", {"reference_task": "t2"}]}'),
    ("b2", "accepted_pattern", '{"verdict": "PASS", "too_similar_to_existing": true, "instruction_leaks_rules": true}'),
]
TABLES["rubric_of"] = ("bundle_id string, text string", RUBRIC_OF)
TABLES["judged"] = ("bundle_id string, check_key string, raw string", JUDGED)
TABLES["corpora"] = ("id int, value string", [(1, '{"a": {"instruction": "do a", "spec": "sa"}, "b": {"instruction": "", "spec": "sb"}, "c": "text", "d": {"instruction": "do d"}, "e": {"other": 1}}'), (2, "{}")])
TABLES["noted"] = ("id int, notes array<string>", [(1, ["Loaded 3", "The sheet returned nothing", "fetch FAILED"]), (2, ["Loaded 3"]), (3, [])])
TABLES["answers"] = ("bundle_id string, check_key string, raw string", ANSWERS)
ACCEPTED_NAMES = ["t1", "t2", "t3", "t4"]


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, list):
        return "[" + ", ".join(_literal(v, "VARCHAR") for v in value) + "]::VARCHAR[]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({str(value).lower()} AS {kind})"


#: Key and text of the tables that rows are made from.
SOURCES = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text")}
_OWN = "{0} || '-' || CAST(_key AS STRING)"
_NUMBER = "_key * 100 + {0}"
#: Columns that tell a group's rows (a row alone where none are named), and what becomes of columns.
_BUNDLE = (["bundle_id"], {"bundle_id": _OWN})
MADE = {
    "files": (["bundle_id"], {"bundle_id": _OWN, "content": "CASE WHEN path = 'instruction.md' THEN content || coalesce(_text, '') ELSE content END"}),
    "rubrics": _BUNDLE, "verdicts": _BUNDLE, "archives": _BUNDLE, "answers": _BUNDLE, "rubric_of": _BUNDLE, "judged": _BUNDLE,
    "scores": ([], {"id": _NUMBER}), "names": ([], {"id": _NUMBER}), "noted": ([], {"id": _NUMBER}), "models": ([], {}),
    "corpora": ([], {"id": _NUMBER, "value": "replace(value, 'do ', 'do ' || CAST(_key AS STRING) || ' ')"}),
    "hits": (["q_key"], {"q_key": _NUMBER}),
    "sheet": ([], {"_ord": _NUMBER}),
    "matches": ([], {"key": _OWN}), "tracker": ([], {"key": _OWN}), "corpus": ([], {"key": _OWN}),
}
#: Tables whose groups are told apart alike, so that their rows meet.
ALIKE = {"judged": list(BUNDLES), "rubric_of": list(BUNDLES), "files": list(BUNDLES)}


def _numbered(name: str) -> tuple[list[str], list[str], list[tuple], int]:
    """Columns, kinds, the model rows with their group's number first, and how many groups there are."""
    schema, rows = TABLES[name]
    columns = [c.split() for c in schema.split(", ")]
    names, by = [c for c, _ in columns], MADE[name][0]
    if name in ("matches", "tracker", "corpus"):  # what is about one key meets
        group = lambda i, row: "abcde".index(row[0])
        many = 5
    elif by:
        keys = ALIKE.get(name) or list(dict.fromkeys(row[names.index(by[0])] for row in rows))
        group, many = (lambda i, row: keys.index(row[names.index(by[0])])), len(keys)
    else:
        group, many = (lambda i, row: i), len(rows)
    return names, [k for _, k in columns], [(group(i, row), *row) for i, row in enumerate(rows)], many


def _expressions(name: str, names: list[str]) -> list[tuple[str, str]]:
    return [(MADE[name][1].get(c, "{0}").format(c), c) for c in names]


def over(spark: SparkSession, d: str, name: str, source: str = "documents") -> DataFrame:
    """The rows of a kind that all rows of a source make."""
    key, text = SOURCES[source]
    rows = spark.read.parquet(f"{d}/{source}.parquet").select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if name == "accepted":
        return rows.select(F.expr("'t' || CAST(_key AS STRING)").alias("name"), F.col("_text").alias("instruction"), F.expr("'category = \"c' || CAST(_key % 3 AS STRING) || '\"'").alias("toml")).where(F.col("name").isin(ACCEPTED))
    names, _, models, many = _numbered(name)
    model = spark.createDataFrame(models, "_group int, " + TABLES[name][0])
    met = rows.join(F.broadcast(model), F.expr(f"_key % {many} = _group"))  # the models are a fixed number
    return met.select(*(F.expr(e).alias(c) for e, c in _expressions(name, names)))


#: References are accepted by name.
ACCEPTED = [*ACCEPTED_NAMES, "t9"]


def sql(name: str, source: str = "documents") -> str:
    """What :func:`over` gives as SQL, to stand in a FROM clause."""
    key, text = SOURCES[source]
    rows = f"(SELECT {key} AS _key, {text} AS _text FROM {source}) AS s"
    if name == "accepted":
        told = ", ".join(f"'{n}'" for n in ACCEPTED)
        return f"(SELECT * FROM (SELECT 't' || CAST(_key AS STRING) AS name, _text AS instruction, 'category = \"c' || CAST(_key % 3 AS STRING) || '\"' AS toml FROM {rows}) WHERE name IN ({told})) AS accepted"
    names, kinds, models, many = _numbered(name)
    types = [{"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}[k] for k in kinds]
    values = ", ".join("(" + ", ".join([str(r[0]), *(_literal(v, k) for v, k in zip(r[1:], types, strict=True))]) + ")" for r in models)
    made = ", ".join(f"{e} AS {c}" for e, c in _expressions(name, names))
    return f"(SELECT {made} FROM {rows} JOIN (VALUES {values}) AS m(_group, {', '.join(names)}) ON _key % {many} = _group) AS {name}"
