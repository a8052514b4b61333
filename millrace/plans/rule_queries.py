"""Rules, verdicts, gates, corpora and reports; inline tables where the driver's tables hold nothing of the kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as T
from millrace.operators import gates, rules, verdicts
from millrace.plans import fixtures
from millrace.sources import bundles, sheets

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.over(spark, d, "files")


def _list(expression: str) -> str:
    return f"'[' || array_to_string(list_transform({expression}, lambda x: '''' || x || ''''), ', ') || ']'"


def _unique(column: str, pattern: str, most: int) -> str:
    found = f"regexp_extract_all({column}, '{pattern}', 0, 'i')"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)[1:{most}]"


_SIDE = f"""f AS (SELECT * FROM {fixtures.sql('files')}), side AS (SELECT bundle_id, max(content) FILTER (path = 'task.toml') AS toml, max(content) FILTER (path = 'instruction.md') AS ins,
    max(content) FILTER (path = 'environment/Dockerfile') AS dock, max(content) FILTER (path = 'solution/solve.sh') AS solve, max(content) FILTER (path = 'tests/test.sh') AS sh, max(content) FILTER (path = 'tests/test_outputs.py') AS py,
    bool_or(path = 'SPEC.md' OR path LIKE '%/SPEC.md') AS spec, count(*) FILTER (path LIKE 'environment/%' AND NOT regexp_matches(path, '(^|/)(Dockerfile|docker-compose\\.yaml|docker-compose\\.yml)$')) AS envs FROM f GROUP BY bundle_id),
    whole AS (SELECT * FROM side WHERE toml IS NOT NULL AND ins IS NOT NULL AND dock IS NOT NULL AND solve IS NOT NULL AND sh IS NOT NULL AND py IS NOT NULL),
    agent AS (SELECT bundle_id, regexp_extract(CASE WHEN contains(toml, '[agent]') THEN string_split(toml, '[agent]')[-1] ELSE '' END, 'timeout_sec\\s*=\\s*([\\d.]+)', 1) AS told FROM whole),
    timed AS (SELECT bundle_id, told, TRY_CAST(nullif(told, '') AS DOUBLE) AS v FROM agent)"""
_MISSING = " UNION ALL ".join(f"SELECT bundle_id, {i} AS o, 0 AS p, 'ST1' AS rule_id, 'CRITICAL' AS severity, 'Missing {path} ({what})' AS message FROM side WHERE {c} IS NULL" for i, (c, (path, what)) in enumerate(zip(["toml", "ins", "dock", "solve", "sh", "py"], rules.REQUIRED, strict=True)))
_MISSING += " UNION ALL SELECT bundle_id, 6, 0, 'ST2', 'HIGH', 'Missing SPEC.md under environment/' FROM whole WHERE NOT spec"


def _rule(order: int, rule: str, severity: str, message: str, where: str, source: str = "whole", toml: bool = True) -> str:
    return f"SELECT bundle_id, {order}, 0, '{rule}', '{severity}', {message} FROM {source} WHERE {where}" + " AND toml <> ''" * (toml and source == "whole")


_TOML = [
    "SELECT bundle_id, 11, 0, 'S01', 'HIGH', 'task.toml has comment on line ' || min(i) FROM (SELECT bundle_id, generate_subscripts(string_split(toml, chr(10)), 1) AS i, unnest(string_split(toml, chr(10))) AS line FROM whole) WHERE regexp_matches(line, '^\\s*#') GROUP BY bundle_id",
    _rule(12, "S02", "HIGH", "'task.toml has non-standard ''name'' field'", "regexp_matches(toml, '(?m)^name\\s*=')"),
    _rule(13, "S03", "CRITICAL", "'task.toml missing allow_internet'", "NOT contains(toml, 'allow_internet')"),
    _rule(14, "S04", "CRITICAL", "'allow_internet = true is blocked'", "contains(toml, 'allow_internet = true')"),
    _rule(15, "S05", "CRITICAL", "'codebase_size = ''minimal'' is blocked'", "contains(toml, 'codebase_size = \"minimal\"')"),
    "SELECT bundle_id, 16, i, 'S06', 'HIGH', 'Invalid subcategory: ''' || v || '''' FROM (SELECT bundle_id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM (SELECT bundle_id, regexp_extract_all(regexp_extract(toml, '(?s)subcategories\\s*=\\s*\\[(.*?)\\]', 1), '\"([^\"]+)\"', 1) AS x FROM whole)) WHERE v NOT IN (" + ", ".join(f"'{v}'" for v in rules.SUBCATEGORIES) + ")",
    _rule(17, "S07", "HIGH", "'Python task must have difficulty = ''hard'''", "contains(toml, '\"python\"') AND NOT contains(toml, 'difficulty = \"hard\"')"),
    _rule(18, "S08", "HIGH", "'difficulty = ''easy'' is not accepted on the platform'", "contains(toml, 'difficulty = \"easy\"')"),
    _rule(19, "S09", "CRITICAL", "'agent.timeout_sec = ' || v || ' exceeds maximum (1800)'", "v > 1800", "timed"),
    _rule(20, "S10", "CRITICAL", "'agent.timeout_sec = ' || v || ' below minimum (1)'", "v < 1", "timed"),
    _rule(21, "S11", "MEDIUM", "'agent.timeout_sec = ' || v || ' (recommended: 1800)'", "v >= 1 AND v < 1800", "timed"),
    _rule(22, "S12", "HIGH", "'task.toml missing [agent] section with timeout_sec'", "NOT contains(toml, '[agent]')"),
    _rule(23, "S13", "MEDIUM", "'task.toml has non-standard workdir field'", "regexp_matches(toml, '(?m)^workdir\\s*=')"),
    *(_rule(24 + i, "S14", "MEDIUM", f"'task.toml has non-standard {f} field'", f"regexp_matches(toml, '(?m)^{f}\\s*=')") for i, f in enumerate(rules.EXTRA_FIELDS)),
]
_LARGE = "(regexp_matches(dock, '(?im)^FROM\\s+(gcc|golang|node|ruby):\\S*-bookworm') OR len(list_filter(string_split(dock, chr(10)), lambda x: regexp_matches(x, '(?i)^FROM\\s+python:\\S*-bookworm') AND NOT regexp_matches(x, '(?i)^FROM\\s+python.*slim'))) > 0)"
_DOCKER = [
    "SELECT bundle_id, 31, i, 'S15', 'CRITICAL', 'Unpinned base image: ' || trim(line) FROM (SELECT bundle_id, generate_subscripts(string_split(dock, chr(10)), 1) AS i, unnest(string_split(dock, chr(10))) AS line FROM whole) WHERE starts_with(trim(line), 'FROM') AND NOT contains(line, '@sha256:')",
    _rule(32, "S16", "CRITICAL", "'Dockerfile has COPY tests/ (tests are mounted at runtime)'", "regexp_matches(dock, 'COPY\\s+tests/')", toml=False),
    _rule(33, "S17", "CRITICAL", "'Dockerfile has COPY solution/ (solution must never be in image)'", "regexp_matches(dock, 'COPY\\s+solution/')", toml=False),
    _rule(34, "S18", "CRITICAL", "'Dockerfile uses a large bookworm base image (gcc/golang/ruby/node/python — risk of 7200s build timeout)'", _LARGE, toml=False),
    _rule(35, "S19", "MEDIUM", "'Dockerfile uses golang base image (prefer debian:bookworm-slim + Go tarball)'", f"NOT {_LARGE} AND regexp_matches(dock, '(?im)^FROM\\s+golang:\\S+') AND NOT regexp_matches(dock, '(?im)^FROM\\s+golang:\\S*-alpine')", toml=False),
    _rule(36, "S20", "HIGH", "'allow_internet=false but pytest not installed in Dockerfile'", "contains(toml, 'allow_internet = false') AND NOT contains(dock, 'pytest')"),
    _rule(37, "S21", "MEDIUM", "'allow_internet=false but pytest-json-ctrf not in Dockerfile'", "contains(toml, 'allow_internet = false') AND NOT contains(dock, 'json-ctrf')"),
]
_LEAK = "solve\\.sh|solution/|/solution|/sol\\b|oracle"
_USED = "array_to_string(list_filter([CASE WHEN regexp_matches(sh, '\\bcurl\\b') THEN 'curl' END, CASE WHEN regexp_matches(sh, '\\bwget\\b') THEN 'wget' END, CASE WHEN contains(sh, 'pip install') THEN 'pip install' END, CASE WHEN contains(sh, 'apt-get install') OR contains(sh, 'apt install') THEN 'apt install' END, CASE WHEN contains(sh, 'install.sh') AND (contains(sh, 'uv') OR contains(sh, 'astral')) THEN 'uv download' END], lambda x: x IS NOT NULL), ', ')"
_PLACE = _unique("py", "SET_AFTER|PLACEHOLDER|TODO_HASH|FIXME", 3)
_TESTS = [
    *(_rule(41 + i, "S22", "CRITICAL", f"'{n} has solution leakage: ' || {_list(_unique(c, _LEAK, 5))}", f"len({_unique(c, _LEAK, 5)}) > 0", toml=False) for i, (n, c) in enumerate([("instruction.md", "ins"), ("tests/test_outputs.py", "py")])),
    _rule(43, "S23", "CRITICAL", "'test_outputs.py imports or loads the solution package'", "regexp_matches(py, '(?i)\\b(?:from|import)\\s+solution\\b|importlib\\.import_module\\s*\\(\\s*[''\"]solution')", toml=False),
    _rule(44, "S24", "CRITICAL", f"'test_outputs.py has placeholder values: ' || {_list(_PLACE)}", f"len({_PLACE}) > 0", toml=False),
    _rule(45, "S25", "CRITICAL", "'test.sh doesn''t write reward.txt'", "NOT contains(sh, 'reward.txt')", toml=False),
    _rule(46, "S26", "HIGH", "'test.sh doesn''t produce ctrf.json'", "NOT contains(sh, 'ctrf')", toml=False),
    _rule(47, "S27", "CRITICAL", f"'test.sh downloads packages (' || {_USED} || ') but allow_internet=false'", f"contains(toml, 'allow_internet = false') AND {_USED} <> ''"),
    _rule(48, "S28", "HIGH", "'codebase_size=''small'' but only ' || envs || ' files in environment/ (need >=20)'", "contains(toml, 'codebase_size = \"small\"') AND envs < 20"),
]
_HINT = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{h.replace(chr(39), chr(39) * 2)}'" for r, h in rules.HINTS.items()) + " ELSE '' END"
_ISSUES = f"WITH {_SIDE}, issues AS ({' UNION ALL '.join([_MISSING, *_TOML, *_DOCKER, *_TESTS])}), numbered AS (SELECT bundle_id, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY o, p) - 1 AS INTEGER) AS seq, rule_id, severity, message, {_HINT} AS fix_hint FROM issues)"


def _of(*prefixes: str) -> str:
    return f"{_ISSUES} SELECT * FROM numbered WHERE " + " OR ".join(f"rule_id BETWEEN '{a}' AND '{b}'" for a, b in (p.split("-") for p in prefixes))


@query(_of("ST1-ST2"))
def structure_missing(spark, d):
    return rules.static_issues(_files(spark, d)).where("rule_id IN ('ST1', 'ST2')")


@query(_of("S01-S14"))
def rule_toml(spark, d):
    return rules.static_issues(_files(spark, d)).where("rule_id BETWEEN 'S01' AND 'S14'")


@query(_of("S15-S21"))
def rule_dockerfile(spark, d):
    return rules.static_issues(_files(spark, d)).where("rule_id BETWEEN 'S15' AND 'S21'")


@query(_of("S22-S27"))
def rule_tests(spark, d):
    return rules.static_issues(_files(spark, d)).where("rule_id BETWEEN 'S22' AND 'S27'")


@query(_of("S28-S28"))
def rule_file_count(spark, d):
    return rules.static_issues(_files(spark, d)).where("rule_id = 'S28'")


@query(f"""{_ISSUES} SELECT b.bundle_id, NOT coalesce(bool_or(severity = 'CRITICAL' AND starts_with(message, 'Missing ')), false) AS structure_pass,
    NOT coalesce(bool_or(severity IN ('CRITICAL', 'HIGH')), false) AS static_pass, count(seq) AS n_issues FROM side b LEFT JOIN numbered n ON n.bundle_id = b.bundle_id GROUP BY b.bundle_id""")
def severity_gates(spark, d):
    return gates.structure_ok(rules.static_issues(_files(spark, d)), _files(spark, d))


_LINE = """lines AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l FROM src)),
    told AS (SELECT *, CASE WHEN contains(line, ',') THEN trim(string_split(line, ',')[-1]) END AS told FROM lines), scored AS (SELECT *, CASE WHEN regexp_full_match(told, '[+-]\\d+') THEN CAST(told AS HUGEINT) END AS score FROM told),
    sums AS (SELECT src.id, count(i) AS n, coalesce(sum(score) FILTER (score > 0), 0) AS total, count(*) FILTER (score <= 0) AS bad FROM src LEFT JOIN scored USING (id) GROUP BY src.id)"""
_RUBRIC = f"""{_LINE}, found AS (SELECT id, 0 AS i, 0 AS o, 'R0' AS rule_id, 'MEDIUM' AS severity, 'No rubrics uploaded' AS message FROM sums WHERE n = 0
    UNION ALL SELECT id, i, 1, 'R1', 'HIGH', 'rubrics.txt line ' || i || ': must start with ''Agent''' FROM scored WHERE NOT starts_with(line, 'Agent')
    UNION ALL SELECT id, i, 2, 'R2', 'HIGH', 'rubrics.txt line ' || i || ': missing '',+/-N'' at end' FROM scored WHERE told IS NULL
    UNION ALL SELECT id, i, 3, 'R3', 'HIGH', 'rubrics.txt line ' || i || ': invalid score ''' || told || '''' FROM scored WHERE told IS NOT NULL AND score IS NULL
    UNION ALL SELECT id, i, 4, 'R4', 'HIGH', 'rubrics.txt line ' || i || ': ±4 is forbidden' FROM scored WHERE abs(score) = 4
    UNION ALL SELECT id, 2000000000, 5, 'R5', 'HIGH', 'Rubric positive sum = ' || total || ' (must be 10-40)' FROM sums WHERE n > 0 AND (total < 10 OR total > 40)
    UNION ALL SELECT id, 2000000000, 6, 'R6', 'HIGH', 'Rubric has only ' || bad || ' negatives (need >=3)' FROM sums WHERE n > 0 AND bad < 3)"""


@query(f"WITH src AS (SELECT bundle_id AS id, text FROM {fixtures.sql('rubrics')}), {_RUBRIC} SELECT id AS bundle_id, CAST(row_number() OVER (PARTITION BY id ORDER BY i, o) - 1 AS INTEGER) AS seq, rule_id, severity, message, {_HINT} AS fix_hint FROM found")
def rubric_lint(spark, d):
    return rules.rubric_issues(fixtures.over(spark, d, "rubrics"))


@query(f"WITH src AS (SELECT conv_id || ':' || turn AS id, text FROM conversations), {_RUBRIC} SELECT rule_id, count(*) AS n, count(DISTINCT id) AS texts FROM found GROUP BY rule_id")
def rubric_totals(spark, d):
    """The rubric's line rules over every turn of the conversations table."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("bundle_id"), "text")
    return rules.rubric_issues(rows.repartition("bundle_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bundle_id").alias("texts"))


_LEAK_SQL = f"SELECT bundle_id, path, {_list(_unique('content', _LEAK, 5))} AS found FROM {fixtures.sql('files')} WHERE len({_unique('content', _LEAK, 5)}) > 0"


@query(_LEAK_SQL)
def regex_leakage_unique(spark, d):
    found = T.unique_matches(F.col("content"), rules.LEAKAGE, 5)
    return _files(spark, d).where(F.size(found) > 0).select("bundle_id", "path", rules._listed(found).alias("found"))


_WORDS = _unique("text", "idiot|clown|worthless|license", 3)


@query(f"SELECT doc_id, {_list(_WORDS)} AS found FROM documents WHERE len({_WORDS}) > 0")
def regex_terms_unique(spark, d):
    """The distinct-matches rule over the documents table, with terms that it holds."""
    found = T.unique_matches(F.col("text"), "(?iu)idiot|clown|worthless|license", 3)
    return spark.read.parquet(f"{d}/documents.parquet").where(F.size(found) > 0).select("doc_id", rules._listed(found).alias("found"))


_UNFENCED = "trim(CASE WHEN contains(raw, '```json') THEN string_split(substr(raw, instr(raw, '```json') + 7), '```')[1] WHEN contains(raw, '```') THEN string_split(substr(raw, instr(raw, '```') + 3), '```')[1] ELSE raw END, ' ' || chr(10))"
def _parsed(table: str) -> str:
    return f"p AS (SELECT bundle_id, check_key, TRY_CAST({_UNFENCED} AS JSON) AS j FROM {table}), parsed AS (SELECT bundle_id, check_key, j, CASE WHEN j IS NULL THEN 'ERROR' ELSE coalesce(j->>'$.verdict', 'UNKNOWN') END AS verdict, CASE WHEN j IS NULL THEN 0 ELSE CAST(j->>'$.alignment_score' AS DOUBLE) END AS alignment_score, j->>'$.reasoning' AS reasoning FROM p)"


_PARSED = _parsed(fixtures.sql("verdicts"))


@query(f"WITH {_PARSED} SELECT bundle_id, check_key, verdict, coalesce(alignment_score, -1) AS alignment_score, reasoning FROM parsed")
def llm_json_parse(spark, d):
    return verdicts.parsed(fixtures.over(spark, d, "verdicts")).select("bundle_id", "check_key", "verdict", F.coalesce("alignment_score", F.lit(-1.0)).alias("alignment_score"), "reasoning")


@query(f"""WITH {_PARSED}, g AS (SELECT bundle_id, check_key, pos, json_extract(j, '$.gaps[' || pos || ']') AS gap FROM (SELECT *, unnest(range(CAST(json_array_length(j, '$.gaps') AS BIGINT))) AS pos FROM parsed WHERE j IS NOT NULL))
    SELECT bundle_id, check_key, CAST(pos AS INTEGER) AS pos, CASE json_type(gap) WHEN 'OBJECT' THEN coalesce(gap->>'$.file', '—') ELSE '—' END AS file, CASE json_type(gap) WHEN 'OBJECT' THEN coalesce(gap->>'$.issue', '') ELSE gap->>'$' END AS issue,
    CASE json_type(gap) WHEN 'OBJECT' THEN coalesce(gap->>'$.fix', '') ELSE '' END AS fix FROM g WHERE json_type(gap) = 'OBJECT' OR json_type(gap) = 'VARCHAR' AND gap->>'$' <> ''""")
def llm_gap_normalise(spark, d):
    return verdicts.gaps(verdicts.parsed(fixtures.over(spark, d, "verdicts")).select("bundle_id", "check_key", "answer"))


@query(f"WITH {_PARSED} SELECT bundle_id, count(*) FILTER (verdict = 'REJECT') AS rejects, count(*) FILTER (verdict = 'NEEDS_WORK') AS needs_work, count(*) FILTER (verdict = 'ERROR') AS errors, count(*) AS ran, count(*) FILTER (verdict IN ('REJECT', 'NEEDS_WORK')) = 0 AS llm_pass FROM parsed GROUP BY bundle_id")
def llm_verdict_fold(spark, d):
    return gates.llm_pass(verdicts.parsed(fixtures.over(spark, d, "verdicts")))


# judge answers over a whole table: every label is one answer, bare, fenced or not JSON at all
_ANSWERS = """answers AS (SELECT doc_id // 9 AS bundle_id, CAST(doc_id % 9 AS VARCHAR) AS check_key, CASE WHEN toxic = 1 AND quality = 0 THEN 'I can not say' WHEN doc_id % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw
    FROM (SELECT *, '{"verdict": "' || CASE WHEN quality = 1 THEN 'ALIGNED' WHEN doc_id % 3 = 0 THEN 'REJECT' ELSE 'NEEDS_WORK' END || '", "alignment_score": ' || doc_id % 11 || ', "reasoning": "label ' || doc_id || '"}' AS body FROM labels))"""


def _answers(spark, d):
    key = F.col("doc_id")
    verdict = F.when(F.col("quality") == 1, "ALIGNED").when(key % 3 == 0, "REJECT").otherwise("NEEDS_WORK")
    body = F.concat(F.lit('{"verdict": "'), verdict, F.lit('", "alignment_score": '), (key % 11).cast("string"), F.lit(', "reasoning": "label '), key.cast("string"), F.lit('"}'))
    raw = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "I can not say").when(key % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = spark.read.parquet(f"{d}/labels.parquet")
    return rows.select(F.floor(key / 9).alias("bundle_id"), (key % 9).cast("string").alias("check_key"), raw.alias("raw"))


@query(f"WITH {_ANSWERS}, {_parsed('answers')} SELECT bundle_id, check_key, verdict, coalesce(alignment_score, -1) AS alignment_score, reasoning FROM parsed")
def judge_answers(spark, d):
    return verdicts.parsed(_answers(spark, d)).select("bundle_id", "check_key", "verdict", F.coalesce("alignment_score", F.lit(-1.0)).alias("alignment_score"), "reasoning")


@query(f"WITH {_ANSWERS}, {_parsed('answers')} SELECT bundle_id, count(*) FILTER (verdict = 'REJECT') AS rejects, count(*) FILTER (verdict = 'NEEDS_WORK') AS needs_work, count(*) FILTER (verdict = 'ERROR') AS errors, count(*) AS ran, count(*) FILTER (verdict IN ('REJECT', 'NEEDS_WORK')) = 0 AS llm_pass FROM parsed GROUP BY bundle_id")
def judge_gates(spark, d):
    return gates.llm_pass(verdicts.parsed(_answers(spark, d)))


_CHECKS = ", ".join(f"({i}, '{k}', [{', '.join(repr(r) for r in req)}], {str(spec).lower()})" for i, (k, _, req, spec) in enumerate(verdicts.CHECKS))


@query(f"""WITH {_SIDE}, present AS (SELECT bundle_id, list(path) AS paths FROM f GROUP BY bundle_id)
    SELECT p.bundle_id, check_key, CAST(ord AS INTEGER) AS ord, len(list_filter(required, lambda r: NOT list_contains(paths, r))) = 0 AND (NOT need_spec OR spec) AS applies
    FROM present p JOIN side USING (bundle_id) CROSS JOIN (VALUES {_CHECKS}) AS c(ord, check_key, required, need_spec)""")
def check_applicability(spark, d):
    return verdicts.applicable(_files(spark, d)).select("bundle_id", "check_key", "ord", "applies")


@query(f"""SELECT coalesce(string_agg('== accepted task ' || name || ', of category ' || regexp_extract(coalesce(toml, ''), 'category\\s*=\\s*"([^"]+)"', 1) || ' ==' || chr(10) || left(trim(coalesce(instruction, '')), 1200) || chr(10), chr(10) ORDER BY name), '(no accepted tasks are known)') AS digest
    FROM {fixtures.sql('accepted', 'benchmark')} WHERE name IN ('t1', 't2', 't3', 't4')""")
def accepted_digest(spark, d):
    return fixtures.over(spark, d, "accepted", "benchmark").agg(verdicts.accepted_digest(fixtures.over(spark, d, "accepted", "benchmark"), fixtures.ACCEPTED_NAMES).alias("digest"))


@query(f"""SELECT string_agg('== reference' || CASE WHEN name = 't9' THEN ': ' || name ELSE ' ' || o || '/4: ' || name || ', of category ' || regexp_extract(coalesce(toml, ''), 'category\\s*=\\s*"([^"]+)"', 1) END || ' ==' || chr(10) || instruction || chr(10), chr(10) ORDER BY o, name) AS listed
    FROM (SELECT *, CASE name WHEN 't1' THEN 1 WHEN 't2' THEN 2 WHEN 't3' THEN 3 WHEN 't4' THEN 4 ELSE 9 END AS o FROM {fixtures.sql('accepted', 'benchmark')} WHERE coalesce(instruction, '') <> '')""")
def accepted_list(spark, d):
    rows = fixtures.over(spark, d, "accepted", "benchmark")
    return rows.agg(verdicts.reference_list(rows, fixtures.ACCEPTED_NAMES).alias("listed"))


_FLAGGED = ", ".join(f"CASE WHEN json_type(raw, '$.{n}') = 'BOOLEAN' AND raw->>'$.{n}' = 'true' THEN '{n}' END" for n in verdicts.FLAGS)


@query(f"SELECT bundle_id, array_to_string(list_filter([{_FLAGGED}], lambda x: x IS NOT NULL), ',') AS flags FROM {fixtures.sql('answers')}")
def llm_flags(spark, d):
    return verdicts.flags(verdicts.parsed(fixtures.over(spark, d, "answers"))).select("bundle_id", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH r AS (SELECT bundle_id, CAST(pos AS INTEGER) AS pos, json_extract(raw, '$.reference_comparisons[' || pos || ']') AS j FROM (SELECT *, unnest(range(CAST(json_array_length(raw, '$.reference_comparisons') AS BIGINT))) AS pos FROM {fixtures.sql('answers')}))
    SELECT bundle_id, pos, coalesce(j->>'$.reference_task', '') AS reference, coalesce(j->>'$.structural_alignment', '—') AS structure, coalesce(j->>'$.differentiation_score', '—') AS differentiation, coalesce(j->>'$.too_similar', 'false') AS too_similar,
    coalesce(array_to_string(CAST(json_extract(j, '$.issues') AS VARCHAR[])[1:2], '; '), '') AS issues FROM r WHERE json_type(j) = 'OBJECT'""")
def llm_comparisons(spark, d):
    return verdicts.comparisons(verdicts.parsed(fixtures.over(spark, d, "answers")).select("bundle_id", "answer"))


_BITS = ["blocked", "structure_ok", "rubric_ok", "similarity_ok", "static_ok"]


@query(f"""SELECT doc_id, blocked, structure_ok, rubric_ok, coalesce(CAST(llm AS VARCHAR), 'none') AS llm, similarity_ok, static_ok, NOT blocked AND structure_ok AND rubric_ok AND coalesce(llm, true) AND similarity_ok AND static_ok AS overall
    FROM (SELECT doc_id, {", ".join(f"(doc_id // {2**i}) % 2 = 0 AS {n}" for i, n in enumerate(["blocked", "structure_ok", "rubric_ok", "similarity_ok", "static_ok"]))}, CASE (doc_id // 32) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS llm FROM documents)""")
def overall_gate_truth_table(spark, d):
    """Every document with the gates that the digits of its number tell, all 96 cases among them."""
    bit = lambda i: F.floor(F.col("doc_id") / 2**i) % 2 == 0
    third = F.floor(F.col("doc_id") / 32) % 3
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *(bit(i).alias(n) for i, n in enumerate(_BITS)), F.when(third == 0, True).when(third == 1, False).alias("llm"))
    out = rows.withColumn("overall", gates.overall(*(F.col(c) for c in ("blocked", "structure_ok", "rubric_ok", "llm", "similarity_ok", "static_ok"))))
    return out.withColumn("llm", F.coalesce(F.col("llm").cast("string"), F.lit("none"))).select("doc_id", "blocked", "structure_ok", "rubric_ok", "llm", "similarity_ok", "static_ok", "overall")


_NAN = "CASE WHEN {0} IN ('', 'nan', 'NaN') THEN 'nan' ELSE trim({0}) END"


@query("""WITH r AS (SELECT 'task ' || (doc_id % 40) || ' · ' || source AS key, 'task ' || (doc_id % 40) AS task_name, doc_id, source, text FROM documents WHERE trim(text) <> '')
    SELECT key, min(doc_id) AS ord, any_value(task_name) AS task_name, any_value(source) AS trainer, arg_max(trim(text), doc_id) AS instruction FROM r GROUP BY key""")
def corpus_key_last_wins(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").withColumn("name", F.concat(F.lit("task "), (F.col("doc_id") % 40).cast("string")))
    return sheets.keyed(rows, "name", "source", "text", order="doc_id").select("key", "ord", "task_name", "trainer", "instruction")


@query(f"""WITH r AS (SELECT _ord, {_NAN.format('name')} AS n, {_NAN.format('trainer')} AS t, {_NAN.format('instruction')} AS i FROM {fixtures.sql('sheet')}),
    k AS (SELECT _ord, CASE WHEN n = 'nan' THEN 'row-' || (_ord + 2) ELSE n END || ' · ' || t AS key, i FROM r WHERE i <> 'nan' AND i <> '') SELECT key, min(_ord) AS ord, arg_max(i, _ord) AS instruction FROM k GROUP BY key""")
def corpus_nan_guard(spark, d):
    return sheets.keyed(fixtures.over(spark, d, "sheet"), "name", "trainer", "instruction").select("key", "ord", "instruction")


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages")
def html_escape(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query(f"""WITH a AS (SELECT *, string_split(path, '/')[1] AS top FROM {fixtures.sql('archives')}), r AS (SELECT bundle_id, count(DISTINCT top) FILTER (top NOT IN ('.DS_Store', '__MACOSX')) AS tops, bool_and(contains(path, '/')) FILTER (top NOT IN ('.DS_Store', '__MACOSX')) AS folders FROM a GROUP BY bundle_id)
    SELECT bundle_id, CASE WHEN tops = 1 AND folders AND top NOT IN ('.DS_Store', '__MACOSX') THEN regexp_replace(path, '^[^/]*/', '') ELSE path END AS path, content FROM a JOIN r USING (bundle_id)""")
def bundle_flatten(spark, d):
    return bundles.flattened(fixtures.over(spark, d, "archives"))


@query(f"SELECT id, CASE id % 100 WHEN 1 THEN 'my task' WHEN 2 THEN 'd' WHEN 3 THEN 'b.tar' WHEN 4 THEN 'folder' WHEN 5 THEN 'task' ELSE '.zip' END AS name FROM {fixtures.sql('names')}")
def task_name(spark, d):
    return fixtures.over(spark, d, "names").select("id", T.stem_or(F.coalesce("zip_name", F.lit("")), F.col("folder")).alias("name"))


@query(f"SELECT model, lower(string_split(model, '/')[-1]) AS slug, regexp_matches(lower(string_split(model, '/')[-1]), '^(gpt-5|o1|o3|o4)') AS other_limit FROM {fixtures.sql('models')}")
def model_family(spark, d):
    return fixtures.over(spark, d, "models").select("model", T.model_slug(F.col("model")).alias("slug"), T.takes_other_limit(F.col("model")).alias("other_limit"))


@query("SELECT doc_id, left(text, 15000) AS content, octet_length(encode(text)) AS octets, length(text) AS chars, replace(source || ' ' || lang, ' ', '-') AS file_name FROM documents")
def truncated_read(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", T.truncated(F.col("text"), verdicts.FILE_CHARS).alias("content"), F.octet_length("text").cast("long").alias("octets"), F.length("text").cast("long").alias("chars"), T.safe_file_name(F.concat_ws(" ", "source", "lang")).alias("file_name"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_payloads(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
