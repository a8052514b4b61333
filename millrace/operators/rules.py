"""Structure, static and rubric rules over the files of submitted bundles.

One aggregation lays a bundle's files side by side; every rule is then one
expression that yields an array of issues, and the arrays are concatenated in
rule order.  No rule needs a scan or a join of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import text as T

#: The files that a bundle must hold, and what they are.
REQUIRED = [
    ("task.toml", "Task metadata file"),
    ("instruction.md", "Agent instructions"),
    ("environment/Dockerfile", "Docker build file"),
    ("solution/solve.sh", "Oracle solution"),
    ("tests/test.sh", "Test runner"),
    ("tests/test_outputs.py", "Test assertions"),
]
#: Subcategories, fields and patterns that rules look for.
SUBCATEGORIES = ["api_integration", "db_interaction", "long_context", "tool_specific", "ui_building"]
EXTRA_FIELDS = ["docker_flags", "gpus", "gpu_types"]
LEAKAGE = r"(?iu)solve\.sh|solution/|/solution|/sol\b|oracle"
IMPORTS_SOLUTION = r"""(?iu)\b(?:from|import)\s+solution\b|importlib\.import_module\s*\(\s*['"]solution"""
PLACEHOLDER = r"(?iu)SET_AFTER|PLACEHOLDER|TODO_HASH|FIXME"
LARGE_IMAGE = r"(?diumU)^FROM\s+(gcc|golang|node|ruby|python(?!.*slim)):\S*-bookworm"
GO_BOOKWORM = r"(?diumU)^FROM\s+golang:\S*-bookworm"
GO_BASE = r"(?diumU)^FROM\s+golang:\S+"
GO_ALPINE = r"(?diumU)^FROM\s+golang:\S*-alpine"
NOT_COUNTED = ["Dockerfile", "docker-compose.yaml", "docker-compose.yml"]
TIMEOUT = 1800
SMALL_FILES = 20

#: What to do about an issue, by its rule; rules that aren't listed say nothing.
HINTS = {
    "ST1": "Fix zip layout — files must be at archive root (not nested in a folder).",
    "ST2": "Add environment/.../SPEC.md — required behavioral reference.",
    "S01": "Remove all comments — task.toml must have ZERO comments",
    "S02": "Remove the name = line — it causes AutoEval BUILD FAILURE",
    "S03": "Add allow_internet = false under [environment]",
    "S05": "Use 'small' (>=20 files) or 'large'",
    "S06": f"Valid: {sorted(SUBCATEGORIES)}. Use subcategories = [] if none fit.",
    "S12": "Add [agent] with timeout_sec = 1800.0",
    "S13": "Remove it",
    "S15": "Add @sha256:<digest> to pin the image",
    "S18": "Use debian:bookworm-slim@sha256:… and install compilers/Go tarball explicitly",
    "S19": "Install Go from official tarball on debian:bookworm-slim (~80MB base)",
    "S20": "Bake pytest into the Dockerfile",
    "S21": "Bake pytest-json-ctrf into the Dockerfile (test.sh needs ctrf.json)",
    "S22": "Remove references to solve.sh, solution/, oracle",
    "S23": "Re-derive expected values from the spec — never import solution/",
    "S24": "Run the oracle and fill in actual hash values",
    "S27": "Move all test deps to Dockerfile",
    "S28": "Add more fixture files or split large JSONs",
    "R0": "Paste or upload rubrics.txt.",
}

ISSUE = "array<struct<rule_id:string,severity:string,message:string>>"


def _none() -> Column:
    return F.array().cast(ISSUE)


def _one(rule: str, severity: str, message: Column | str) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _if(found: Column, rule: str, severity: str, message: Column | str) -> Column:
    return F.when(F.coalesce(found, F.lit(False)), F.array(_one(rule, severity, message)).cast(ISSUE)).otherwise(_none())


def _each(values: Column, rule: str, severity: str, message) -> Column:
    return F.coalesce(F.transform(values, lambda v: _one(rule, severity, message(v))).cast(ISSUE), _none())


def _listed(values: Column) -> Column:
    """An array of strings as Python shows a list."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def _decimal(value: Column) -> Column:
    """A double as Python shows it, up to 16 digits before the point."""
    return F.when(F.abs(value) >= 1e7, F.format_string("%.1f", value)).otherwise(value.cast("string"))


def hinted(issues: DataFrame) -> DataFrame:
    """Add ``fix_hint``, empty where a rule has none."""
    hints = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    return issues.withColumn("fix_hint", F.coalesce(F.element_at(hints, F.col("rule_id")), F.lit("")))


def side_by_side(files: DataFrame) -> DataFrame:
    """One row per bundle: the six files' texts, whether there is a SPEC.md, and the environment's file count.

    Only texts that rules read are carried; paths and texts may be null, a path that repeats counts once.
    """
    name = F.regexp_replace("path", "^.*/", "")
    of = lambda path: F.max(F.when(F.col("path") == path, T.unix_lines(F.coalesce("content", F.lit("")))))
    counted = F.col("path").startswith("environment/") & ~name.isin(NOT_COUNTED)
    return files.groupBy("bundle_id").agg(
        of("task.toml").alias("toml"),
        of("instruction.md").alias("instruction"),
        of("environment/Dockerfile").alias("docker"),
        of("solution/solve.sh").alias("solve"),
        of("tests/test.sh").alias("test_sh"),
        of("tests/test_outputs.py").alias("test_py"),
        F.coalesce(F.bool_or(name == "SPEC.md"), F.lit(False)).alias("has_spec"),
        F.count_if(counted).alias("env_files"),
    )


_COLUMNS = ["toml", "instruction", "docker", "solve", "test_sh", "test_py"]


def structure(_: None = None) -> Column:
    """Missing files; a missing SPEC.md only where no file is missing."""
    missing = F.concat(*(_if(F.col(c).isNull(), "ST1", "CRITICAL", f"Missing {path} ({what})") for c, (path, what) in zip(_COLUMNS, REQUIRED, strict=True)))
    return F.when(F.size(missing) > 0, missing).otherwise(_if(~F.col("has_spec"), "ST2", "HIGH", "Missing SPEC.md under environment/"))


def toml_rules() -> Column:
    toml, has = F.col("toml"), lambda x: F.contains(F.col("toml"), F.lit(x))
    comment = F.array_position(F.transform(T.lines(toml), lambda x: x.rlike(r"(?U)^\s*#")), True)
    listed = F.regexp_extract(toml, r"(?sU)subcategories\s*=\s*\[(.*?)\]", 1)
    wrong = F.filter(F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1)), lambda v: ~v.isin(SUBCATEGORIES))
    told = F.regexp_extract(T.after_last(toml, "[agent]"), r"(?U)timeout_sec\s*=\s*([\d.]+)", 1)
    # a number such as 1.2.3 gives no issue
    value = F.when(told != "", told).try_cast("double")
    number = F.concat(F.lit("agent.timeout_sec = "), _decimal(value))
    rules = [
        _if(comment > 0, "S01", "HIGH", F.concat(F.lit("task.toml has comment on line "), comment.cast("string"))),
        _if(toml.rlike(r"(?dmU)^name\s*="), "S02", "HIGH", "task.toml has non-standard 'name' field"),
        _if(~has("allow_internet"), "S03", "CRITICAL", "task.toml missing allow_internet"),
        _if(has("allow_internet = true"), "S04", "CRITICAL", "allow_internet = true is blocked"),
        _if(has('codebase_size = "minimal"'), "S05", "CRITICAL", "codebase_size = 'minimal' is blocked"),
        _each(wrong, "S06", "HIGH", lambda v: F.concat(F.lit("Invalid subcategory: '"), v, F.lit("'"))),
        _if(has('"python"') & ~has('difficulty = "hard"'), "S07", "HIGH", "Python task must have difficulty = 'hard'"),
        _if(has('difficulty = "easy"'), "S08", "HIGH", "difficulty = 'easy' is not accepted on the platform"),
        _if(value > TIMEOUT, "S09", "CRITICAL", F.concat(number, F.lit(f" exceeds maximum ({TIMEOUT})"))),
        _if(value < 1, "S10", "CRITICAL", F.concat(number, F.lit(" below minimum (1)"))),
        _if((value >= 1) & (value < TIMEOUT), "S11", "MEDIUM", F.concat(number, F.lit(f" (recommended: {TIMEOUT})"))),
        _if((told == "") & ~has("[agent]"), "S12", "HIGH", "task.toml missing [agent] section with timeout_sec"),
        _if(toml.rlike(r"(?dmU)^workdir\s*="), "S13", "MEDIUM", "task.toml has non-standard workdir field"),
        *(_if(toml.rlike(rf"(?dmU)^{f}\s*="), "S14", "MEDIUM", f"task.toml has non-standard {f} field") for f in EXTRA_FIELDS),
    ]
    return F.when(toml != "", F.concat(*rules)).otherwise(_none())


def docker_rules() -> Column:
    docker = F.col("docker")
    offline = F.contains(F.col("toml"), F.lit("allow_internet = false"))
    has = lambda x: F.contains(docker, F.lit(x))
    bases = F.filter(F.transform(T.lines(docker), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x.startswith("FROM") & ~F.contains(x, F.lit("@sha256:")))
    large = docker.rlike(LARGE_IMAGE) | docker.rlike(GO_BOOKWORM)
    return F.concat(
        _each(bases, "S15", "CRITICAL", lambda x: F.concat(F.lit("Unpinned base image: "), x)),
        _if(docker.rlike(r"(?U)COPY\s+tests/"), "S16", "CRITICAL", "Dockerfile has COPY tests/ (tests are mounted at runtime)"),
        _if(docker.rlike(r"(?U)COPY\s+solution/"), "S17", "CRITICAL", "Dockerfile has COPY solution/ (solution must never be in image)"),
        _if(large, "S18", "CRITICAL", "Dockerfile uses a large bookworm base image (gcc/golang/ruby/node/python — risk of 7200s build timeout)"),
        _if(~large & docker.rlike(GO_BASE) & ~docker.rlike(GO_ALPINE), "S19", "MEDIUM", "Dockerfile uses golang base image (prefer debian:bookworm-slim + Go tarball)"),
        _if(offline & ~has("pytest"), "S20", "HIGH", "allow_internet=false but pytest not installed in Dockerfile"),
        _if(offline & ~has("pytest-json-ctrf") & ~has("json-ctrf"), "S21", "MEDIUM", "allow_internet=false but pytest-json-ctrf not in Dockerfile"),
    )


def test_rules() -> Column:
    sh, py, toml = F.col("test_sh"), F.col("test_py"), F.col("toml")
    leaks = lambda c: T.unique_matches(F.col(c), LEAKAGE, 5)
    left = T.unique_matches(py, PLACEHOLDER, 3)
    has = lambda x: F.contains(sh, F.lit(x))
    commands = [
        (sh.rlike(r"(?U)\bcurl\b"), "curl"),
        (sh.rlike(r"(?U)\bwget\b"), "wget"),
        (has("pip install"), "pip install"),
        (has("apt-get install") | has("apt install"), "apt install"),
        (has("install.sh") & (has("uv") | has("astral")), "uv download"),
    ]
    used = F.concat_ws(", ", *(F.when(found, F.lit(name)) for found, name in commands))
    leak = lambda name, c: _if(F.size(leaks(c)) > 0, "S22", "CRITICAL", F.concat(F.lit(f"{name} has solution leakage: "), _listed(leaks(c))))
    return F.concat(
        leak("instruction.md", "instruction"),
        leak("tests/test_outputs.py", "test_py"),
        _if(py.rlike(IMPORTS_SOLUTION), "S23", "CRITICAL", "test_outputs.py imports or loads the solution package"),
        _if(F.size(left) > 0, "S24", "CRITICAL", F.concat(F.lit("test_outputs.py has placeholder values: "), _listed(left))),
        _if(~has("reward.txt"), "S25", "CRITICAL", "test.sh doesn't write reward.txt"),
        _if(~has("ctrf"), "S26", "HIGH", "test.sh doesn't produce ctrf.json"),
        _if(F.contains(toml, F.lit("allow_internet = false")) & (used != ""), "S27", "CRITICAL", F.concat(F.lit("test.sh downloads packages ("), used, F.lit(") but allow_internet=false"))),
    )


def count_rules() -> Column:
    few = F.contains(F.col("toml"), F.lit('codebase_size = "small"')) & (F.col("env_files") < SMALL_FILES)
    message = F.concat(F.lit("codebase_size='small' but only "), F.col("env_files").cast("string"), F.lit(f" files in environment/ (need >={SMALL_FILES})"))
    return _if(few, "S28", "HIGH", message)


def static_issues(files: DataFrame) -> DataFrame:
    """``bundle_id, seq, rule_id, severity, message, fix_hint``; content rules run only where no file is missing."""
    found = side_by_side(files).withColumn("structure", structure())
    whole = F.forall("structure", lambda i: i["rule_id"] != "ST1")
    issues = F.concat(F.col("structure"), F.when(whole, F.concat(toml_rules(), docker_rules(), test_rules(), count_rules())).otherwise(_none()))
    return hinted(found.select("bundle_id", F.posexplode(issues).alias("seq", "issue")).select("bundle_id", "seq", "issue.*"))


def rubric_issues(rubrics: DataFrame) -> DataFrame:
    """``bundle_id, seq, rule_id, severity, message, fix_hint`` of rubric texts (columns ``bundle_id, text``)."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.transform(T.lines(F.coalesce("text", F.lit(""))), strip), lambda x: x != "")

    def scored(line: Column) -> Column:
        told = F.when(F.contains(line, F.lit(",")), strip(F.substring_index(line, ",", -1)))
        return F.struct(line.alias("line"), told.alias("told"), F.when(told.rlike(r"(?U)^[+-]\d+$"), told.cast("decimal(38,0)")).alias("score"))

    def of_line(s: Column, i: Column) -> Column:
        here = F.concat(F.lit("rubrics.txt line "), (i + 1).cast("string"), F.lit(": "))
        return F.concat(
            _if(~s["line"].startswith("Agent"), "R1", "HIGH", F.concat(here, F.lit("must start with 'Agent'"))),
            _if(s["told"].isNull(), "R2", "HIGH", F.concat(here, F.lit("missing ',+/-N' at end"))),
            _if(s["told"].isNotNull() & s["score"].isNull(), "R3", "HIGH", F.concat(here, F.lit("invalid score '"), s["told"], F.lit("'"))),
            _if(F.abs(s["score"]) == 4, "R4", "HIGH", F.concat(here, F.lit("±4 is forbidden"))),
        )

    total, bad = rubric_totals_of(F.col("scored"))
    sums = F.concat(
        _if((total < 10) | (total > 40), "R5", "HIGH", F.concat(F.lit("Rubric positive sum = "), total.cast("string"), F.lit(" (must be 10-40)"))),
        _if(bad < 3, "R6", "HIGH", F.concat(F.lit("Rubric has only "), bad.cast("string"), F.lit(" negatives (need >=3)"))),
    )
    blank = F.array(_one("R0", "MEDIUM", "No rubrics uploaded")).cast(ISSUE)
    rows = rubrics.withColumn("scored", F.transform(kept, scored))
    issues = F.when(F.size("scored") == 0, blank).otherwise(F.concat(F.flatten(F.transform("scored", of_line)), sums))
    return hinted(rows.select("bundle_id", F.posexplode(issues).alias("seq", "issue")).select("bundle_id", "seq", "issue.*"))


def all_issues(static: DataFrame, rubric: DataFrame) -> DataFrame:
    """Static issues, then rubric issues, numbered through per bundle."""
    both = static.withColumn("_part", F.lit(0)).unionByName(rubric.withColumn("_part", F.lit(1)))
    order = Window.partitionBy("bundle_id").orderBy("_part", "seq")
    return both.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).drop("_part")


def rubric_totals_of(scored: Column) -> tuple[Column, Column]:
    """Sum of the positive scores, and how many are not positive (+0 and -0 among them)."""
    scores = F.filter(F.transform(scored, lambda s: s["score"]), lambda x: x.isNotNull())
    positive = F.aggregate(scores, F.lit(0).cast("decimal(38,0)"), lambda t, x: (t + F.when(x > 0, x).otherwise(F.lit(0))).cast("decimal(38,0)"))
    return positive, F.size(F.filter(scores, lambda x: x <= 0))
