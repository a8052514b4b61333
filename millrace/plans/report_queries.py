"""The search as it is run, with its messages, and the reports on submissions and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import similarity as S, text as T
from millrace.operators import gates, report, rules, search, tfidf, verdicts
from millrace.plans import fixtures
from millrace.plans.rule_queries import _HINT, _ISSUES as _DOCUMENT_ISSUES, _RUBRIC
from millrace.plans.search_queries import _METHOD, _REASON, _SET, _tfidf
from millrace.sources import sheets, vectors as V
from millrace.tables import written

QUERIES, SQL = {}, {}
#: The issues of the benchmark's bundles.
_ISSUES = _DOCUMENT_ISSUES.replace(fixtures.sql("files"), fixtures.sql("files", "benchmark"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- the search ------------------------------------------------------------------------
def _corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), "text", F.col("source").alias("trainer"))
    cached = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return V.known(docs, cached).withColumn("label", _task())


def _task():
    return F.concat(F.lit("Task "), F.col("key").cast("string"), F.lit(" · "), F.coalesce("trainer", F.lit("")))


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text, half of them with a vector, and the documents whose id is divisible by 100, half of them under their own name."""
    corpus = _corpus(spark, d)
    vectors = corpus.select(F.col("key").alias("item_id"), "v")
    items = spark.read.parquet(f"{d}/benchmark.parquet").join(vectors, "item_id", "left")
    items = items.select(F.format_string("b%d", "item_id").alias("key"), "text", F.lit("").alias("name"), F.when(F.col("item_id") % 2 == 0, F.col("v")).alias("v"))
    own = F.when(F.col("key") % 200 == 0, F.format_string(" task %d ·", "key")).otherwise(" ")
    return items.unionByName(corpus.where("key % 100 = 0").select(F.format_string("d%d", "key").alias("key"), "text", own.alias("name"), "v"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    # written, a few rows a submission have a known size: the corpus is joined without a shuffle, and the search is made once
    found = written(search.precheck(_submissions(spark, d), corpus), "found")
    named = corpus.select(F.col("key").alias("c_key"), F.col("label").alias("task"), F.coalesce("trainer", F.lit("")).alias("trainer"), F.coalesce("text", F.lit("")).alias("matched_instruction"))
    return written(found.join(named, "c_key"), "hits")


_LOADED = "Loaded from the table of documents"


def _summary(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    many = _corpus(spark, d).where(F.trim("text") != "").count()
    return search.messages(_submissions(spark, d), hits, F.lit(many).cast("long"), F.array(F.lit(_LOADED)))


def _prechecks(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return report.prechecks(_submissions(spark, d), hits, _summary(spark, d, hits))


_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_LABEL = "CASE WHEN sem IS NULL THEN 'No' WHEN {0} = 'meaning' THEN 'YES (meaning ≥70%)' WHEN {0} = 'dual' THEN 'YES (both ≥60%)' ELSE 'No' END".format(f"({_REASON})")


def _search(submissions: str, corpus: str) -> str:
    """CTEs up to ``hits`` for submissions (q_key, text, name, e) and a corpus (c_key, task, trainer, text, e)."""
    return f"""submissions AS ({submissions}), corpus AS ({corpus}),
    c AS (SELECT *, {_SET} AS t FROM corpus WHERE trim(text) <> ''), q AS (SELECT *, {_SET} AS t FROM submissions WHERE trim(text) <> ''),
    ce AS (SELECT c_key, len(t) AS n, unnest(t) AS w FROM c), qe AS (SELECT q_key, len(t) AS n, unnest(t) AS w FROM q),
    pairs AS (SELECT q_key, c_key, CAST(2 AS DOUBLE) * count(*) / (any_value(ce.n) + any_value(qe.n)) AS lex FROM ce JOIN qe USING (w) GROUP BY q_key, c_key),
    both_scores AS (SELECT q.q_key, c.c_key, c.task, c.trainer, c.text AS matched_instruction, round(coalesce(p.lex, 0), 12) AS lex, round(list_cosine_similarity(q.e, c.e), 12) AS sem
        FROM q JOIN c ON NOT (trim(q.name) <> '' AND contains(lower(c.task), lower(trim(q.name)))) LEFT JOIN pairs p ON p.q_key = q.q_key AND p.c_key = c.c_key),
    decided AS (SELECT *, {_REASON} AS block_reason, {_REASON} <> '' AS flagged, {_METHOD} AS method, greatest(lex, coalesce(sem, 0)) AS score, {_LABEL} AS flag_label FROM both_scores),
    hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_key ORDER BY flagged DESC, coalesce(sem, -1) DESC, lex DESC, c_key) AS INTEGER) AS rank FROM decided) WHERE rank <= 10)"""


_WHOLE = "printf('%.0f', {0} * 100) || '%'"
_SHARES = "'words ' || " + _WHOLE.format("{0}.lex") + " || ', meaning ' || " + _WHOLE.format("coalesce({0}.sem, 0)")


def _messages(loaded: str) -> str:
    """CTE ``summary`` over the CTEs of :func:`_search`."""
    return f"""firsts AS (SELECT q_key, bool_or(flagged) AS blocked, arg_min(score, rank) AS max_similarity, bool_or(sem IS NOT NULL) AS meaning_ran,
        arg_min({{'task': task, 'trainer': trainer, 'lex': lex, 'sem': sem, 'reason': block_reason}}, rank) AS top, arg_min({{'task': task, 'trainer': trainer, 'lex': lex, 'sem': sem, 'reason': block_reason}}, rank) FILTER (flagged) AS hit FROM hits GROUP BY q_key),
    worded AS (SELECT s.q_key, trim(coalesce(s.text, '')) AS body, coalesce(blocked, false) AS blocked, coalesce(max_similarity, 0) AS max_similarity, coalesce(meaning_ran, false) AS meaning_ran, (SELECT count(*) FROM c) AS corpus_count,
        CASE WHEN trim(coalesce(s.text, '')) = '' THEN 'There is no text to check.'
        WHEN blocked THEN 'Choose another task: the nearest existing text is ' || hit.task || ' (by ' || coalesce(nullif(hit.trainer, ''), 'unknown') || '): ' || {_SHARES.format("hit")} || ' (' || CASE WHEN hit.reason = 'meaning' THEN 'meaning 70% or more' ELSE 'words and meaning 60% or more' END || ').'
        WHEN top IS NOT NULL AND meaning_ran THEN 'Nothing too near: the nearest text has ' || {_SHARES.format("top")} || ' (both 60% or more, or meaning 70% or more is flagged).'
        WHEN top IS NOT NULL THEN 'Compared by words alone, as meaning was not compared: the nearest text has words ' || {_WHOLE.format("top.lex")} || '.'
        ELSE 'Nothing was found.' END AS message FROM submissions s LEFT JOIN firsts USING (q_key)),
    summary AS (SELECT q_key, blocked, max_similarity, meaning_ran, corpus_count, message, CASE WHEN body = '' THEN {loaded}
        ELSE list_concat({loaded}, [CASE WHEN meaning_ran THEN 'Meaning was compared with ' || corpus_count || ' texts.' ELSE 'Meaning was not compared.' END, message]) END AS notes FROM worded)"""


_V = f"v AS (SELECT vec_id, {_DOUBLES} AS e FROM embeddings)"
_CORPUS = "SELECT doc_id AS c_key, 'Task ' || doc_id || ' · ' || coalesce(source, '') AS task, coalesce(source, '') AS trainer, text, e FROM documents LEFT JOIN v ON vec_id = doc_id"
_SUBMITTED = """SELECT 'b' || item_id AS q_key, text, '' AS name, CASE WHEN item_id % 2 = 0 THEN e END AS e FROM benchmark LEFT JOIN v ON vec_id = item_id
    UNION ALL SELECT 'd' || doc_id, text, CASE WHEN doc_id % 200 = 0 THEN ' task ' || doc_id || ' ·' ELSE ' ' END, e FROM documents LEFT JOIN v ON vec_id = doc_id WHERE doc_id % 100 = 0"""
_FOUND = f"{_V}, {_search(_SUBMITTED, _CORPUS)}"
_PRECHECK = f"{_FOUND}, {_messages(f'''['{_LOADED}']''')}"


@query(f"WITH {_FOUND} SELECT q_key, rank, c_key, round(lex, 9) AS lex, coalesce(round(sem, 9), -1) AS sem, method, flagged, block_reason, flag_label FROM hits")
def precheck_ranked(spark, d):
    """Words and meaning of every submission against the whole corpus, merged, decided and ranked."""
    found = search.precheck(_submissions(spark, d), _corpus(spark, d))
    return found.select("q_key", "rank", "c_key", F.round("lex", 9).alias("lex"), F.coalesce(F.round("sem", 9), F.lit(-1.0)).alias("sem"), "method", "flagged", "block_reason", "flag_label")


@query(f"WITH {_PRECHECK} SELECT q_key, blocked, round(max_similarity, 9) AS max_similarity, meaning_ran, corpus_count, message, array_to_string(notes, '|') AS notes FROM summary")
def precheck_summary(spark, d):
    return _summary(spark, d, _hits(spark, d)).withColumn("max_similarity", F.round("max_similarity", 9)).withColumn("notes", F.array_join("notes", "|"))


# -- reports on submissions ------------------------------------------------------------
_P = "CAST(printf('%.1f', {0} * 100) AS DOUBLE)"
_MATCHES = f"""list({{'rank': rank, 'task': task, 'trainer': trainer, 'score_percent': {_P.format('score')}, 'lexical': {_P.format('lex')}, 'semantic': {_P.format('sem')}, 'lex': lex, 'sem': sem,
    'flagged': flagged, 'block_reason': block_reason, 'flag_label': flag_label, 'method': method, 'text': matched_instruction}} ORDER BY rank)"""
_ROWS = f"listed AS (SELECT q_key, {_MATCHES} AS matches FROM hits GROUP BY q_key), prechecks AS (SELECT m.*, coalesce(s.text, '') AS body, coalesce(matches, []) AS matches FROM summary m JOIN submissions s USING (q_key) LEFT JOIN listed USING (q_key))"


def _escaped(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _cells(*cells: str) -> str:
    return "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"


def _joined(values: str, x: str, row: str) -> str:
    return f"array_to_string(list_transform({values}, lambda {x}: {row}), '')"


def _table(values: str, x: str, row: str, columns: int, none: str) -> str:
    return f"CASE WHEN len({values}) > 0 THEN {_joined(values, x, row)} ELSE '<tr><td colspan=''{columns}''>{none}</td></tr>' END"


def _dash(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN {_escaped(x)} ELSE '—' END"


def _share(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR) || '%', '—')"


def _notes(x: str) -> str:
    return f"'<ul>' || {_joined(x, 'n', _escaped('n').join((chr(39) + '<li>' + chr(39) + ' || ', ' || ' + chr(39) + '</li>' + chr(39))))} || '</ul>'"


def _card(own: str) -> str:
    pane = lambda title, c, none: f"'<div><h4>{title} (' || format('{{:,}}', length({c})) || ' characters)</h4><pre>' || CASE WHEN {c} <> '' THEN {_escaped(c)} ELSE '{none}' END || '</pre></div>'"
    head = f"'<p><b>' || {_escaped('m.task')} || '</b>, ' || {_dash('m.trainer')} || ': words ' || {_share('m.lexical')} || ', meaning ' || {_share('m.semantic')} || ', flagged: ' || {_escaped('m.flag_label')} || '</p>'"
    return f"""'<section class="' || CASE WHEN m.flagged THEN 'card flagged' ELSE 'card' END || '">' || {head} || {pane('Submitted', own, '')} || {pane('Existing', 'm.text', 'no text')} || '</section>'"""


_MATCH_ROW = _cells(_escaped("m.task"), _dash("m.trainer"), _share("m.lexical"), _share("m.semantic"), _escaped("m.flag_label"))


@query(f"""WITH {_PRECHECK}, {_ROWS} SELECT q_key, CAST(to_json({{'type': 'instruction_precheck', 'report_format': 'full_comparison_v2', 'trainer_name': 'Ann', 'timestamp': '2026-01-01T00:00:00Z', 'instruction_preview': left(body, 500), 'instruction_full': body,
    'instruction_length': length(body), 'blocked': blocked, 'change_task': blocked, 'message': message, 'corpus_count': corpus_count, 'embedding_ran': meaning_ran, 'embed_model': 'table', 'embedding_error': CAST(NULL AS VARCHAR), 'api_key_present': true, 'api_provider': 'table', 'dual_threshold_percent': 60, 'semantic_block_threshold_percent': 70,
    'tracker_instructions': map_from_entries(list_transform(matches, lambda m: {{'k': m.task, 'v': coalesce(m.text, '')}})),
    'matches': list_transform(matches, lambda m: {{'task': m.task, 'trainer': m.trainer, 'lexical_percent': m.lexical, 'embedding_percent': m.semantic, 'dual_block': m.flagged, 'block_reason': m.block_reason, 'flag_label': m.flag_label, 'method': m.method, 'matched_instruction': m.text}}),
    'notes': notes}}) AS VARCHAR) AS report FROM prechecks""")
def precheck_json(spark, d):
    return report.precheck_json(_prechecks(spark, d), "Ann", "2026-01-01T00:00:00Z", "table", provider="table")


@query(f"""WITH {_PRECHECK}, {_ROWS} SELECT q_key, '<!DOCTYPE html><html><body>' || CASE WHEN blocked THEN '<h1 style="color:#a4133c">CHANGE TASK</h1>' ELSE '<h1 style="color:#1b7f4b">OK TO PROCEED</h1>' END
    || '<p>Trainer: Ann</p><p>' || {_escaped('message')} || '</p><p>Texts: ' || corpus_count || '; meaning: ' || CASE WHEN meaning_ran THEN 'compared' ELSE 'not compared' END || '</p><table><tr><th>Task</th><th>Trainer</th><th>Word overlap</th><th>Meaning</th><th>Flagged?</th></tr>'
    || {_table('matches', 'm', _MATCH_ROW, 5, 'No matches returned.')} || '</table>' || {_joined('matches', 'm', _card('body'))} || {_notes('notes')} || '</body></html>' AS html FROM prechecks""")
def precheck_html(spark, d):
    return report.precheck_html(_prechecks(spark, d), "Ann")


@query(f"WITH {_PRECHECK}, {_ROWS} SELECT q_key, m.rank AS rank, {_card('body')} AS card FROM (SELECT q_key, body, unnest(matches) AS m FROM prechecks)")
def comparison_cards(spark, d):
    return report.comparison_cards(_prechecks(spark, d))


# -- reports on bundles ----------------------------------------------------------------
def _files(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.over(spark, d, "files", "benchmark")


def _of_file(spark: SparkSession, d: str, name: str) -> DataFrame:
    """``key, text`` of one file of every bundle."""
    here = F.regexp_replace("path", "^.*/", "") == name
    return _files(spark, d).where(here).groupBy(F.col("bundle_id").alias("key")).agg(F.min_by(F.trim(F.coalesce("content", F.lit("")), F.lit(" \n\t\r")), "path").alias("text"))


def _assessments(spark: SparkSession, d: str) -> DataFrame:
    corpus = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), "text", F.col("source").alias("trainer")).withColumn("label", _task()).withColumn("v", F.lit(None).cast("array<double>"))
    submitted = _of_file(spark, d, "instruction.md").withColumn("name", F.col("key")).withColumn("v", F.lit(None).cast("array<double>"))
    named = corpus.select(F.col("key").alias("c_key"), F.col("label").alias("task"), F.coalesce("trainer", F.lit("")).alias("trainer"), F.col("text").alias("matched_instruction"))
    # three parts of a report read these few rows, so the search is made once
    hits = written(written(search.precheck(submitted, corpus), "found").join(named, "c_key"), "hits")
    many = corpus.where(F.trim("text") != "").count()
    prechecked = report.prechecks(submitted, hits, search.messages(submitted, hits, F.lit(many).cast("long")))
    spec = written(tfidf.topk(_of_file(spark, d, "SPEC.md"), corpus.select("key", "text")), "found").join(named.select("c_key", "task"), "c_key")
    static, rubric = rules.static_issues(_files(spark, d)), rules.rubric_issues(fixtures.over(spark, d, "rubric_of", "benchmark"))
    answers = verdicts.parsed(fixtures.over(spark, d, "judged", "benchmark"))
    results = verdicts.explained(verdicts.applicable(_files(spark, d)), answers)
    return report.assessments(gates.gated(_files(spark, d), static, rubric, hits, answers), rules.all_issues(static, rubric), prechecked, spec, results)


_JUDGED = f"""aj AS (SELECT bundle_id, check_key, TRY_CAST(raw AS JSON) AS j FROM {fixtures.sql('judged', 'benchmark')}), answered AS (SELECT bundle_id, check_key, CASE WHEN j IS NULL THEN 'ERROR' ELSE coalesce(j->>'$.verdict', 'UNKNOWN') END AS verdict,
        CASE WHEN j IS NULL THEN 0 ELSE CAST(j->>'$.alignment_score' AS DOUBLE) END AS alignment_score, j->>'$.reasoning' AS reasoning, j FROM aj),
    gap AS (SELECT bundle_id, check_key, pos, json_extract(j, '$.gaps[' || pos || ']') AS g FROM (SELECT *, unnest(range(CAST(json_array_length(j, '$.gaps') AS BIGINT))) AS pos FROM answered WHERE j IS NOT NULL)),
    gaps AS (SELECT bundle_id, check_key, list(CASE json_type(g) WHEN 'OBJECT' THEN {{'file': coalesce(g->>'$.file', '—'), 'issue': coalesce(g->>'$.issue', ''), 'fix': coalesce(g->>'$.fix', '')}} ELSE {{'file': '—', 'issue': g->>'$', 'fix': ''}} END ORDER BY pos) AS gaps FROM gap GROUP BY 1, 2),
    results AS (SELECT bundle_id, list({{'check_key': check_key, 'label': label, 'verdict': verdict, 'alignment_score': alignment_score, 'reasoning': reasoning, 'gaps': coalesce(gaps, [])}} ORDER BY ord) AS results
        FROM answered LEFT JOIN gaps USING (bundle_id, check_key) JOIN (VALUES {", ".join(f"({i}, '{k}', '{label}')" for i, (k, label, _, _) in enumerate(verdicts.CHECKS))}) AS k(ord, check_key, label) USING (check_key) GROUP BY bundle_id),
    judge AS (SELECT bundle_id, count(*) FILTER (verdict IN ('REJECT', 'NEEDS_WORK')) = 0 AS llm_pass FROM answered GROUP BY bundle_id)"""
_RUBRICS = f"src AS (SELECT bundle_id AS id, text FROM {fixtures.sql('rubric_of', 'benchmark')}), {_RUBRIC}"
_BUNDLE_TEXT = lambda name: f"SELECT bundle_id, arg_min(trim(coalesce(content, ''), ' ' || chr(10) || chr(9) || chr(13)), path) AS text FROM f WHERE regexp_replace(path, '^.*/', '') = '{name}' GROUP BY bundle_id"
_ASSESSED = f"""{_ISSUES}, {_RUBRICS},
    every AS (SELECT bundle_id, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY part, a, b) - 1 AS INTEGER) AS seq, rule_id, severity, message, {_HINT} AS fix_hint FROM (
        SELECT bundle_id, 0 AS part, seq AS a, 0 AS b, rule_id, severity, message FROM numbered UNION ALL SELECT id, 1, i, o, rule_id, severity, message FROM found)),
    issues_of AS (SELECT bundle_id, list({{'severity': severity, 'message': message, 'fix_hint': fix_hint}} ORDER BY seq) AS issues, bool_or(severity IN ('CRITICAL', 'HIGH')) AS severe, bool_or(severity = 'CRITICAL' AND starts_with(message, 'Missing ')) AS broken FROM every GROUP BY bundle_id),
    rubric_gate AS (SELECT id AS bundle_id, bool_or(severity IN ('CRITICAL', 'HIGH')) AS bad_rubric FROM found GROUP BY id),
    {_search(f"SELECT bundle_id AS q_key, text, bundle_id AS name, CAST(NULL AS DOUBLE[]) AS e FROM ({_BUNDLE_TEXT('instruction.md')})", "SELECT doc_id AS c_key, 'Task ' || doc_id || ' · ' || coalesce(source, '') AS task, coalesce(source, '') AS trainer, text, CAST(NULL AS DOUBLE[]) AS e FROM documents")},
    {_messages("CAST([] AS VARCHAR[])")}, {_ROWS},
    specs AS ({_BUNDLE_TEXT('SPEC.md')}), {_tfidf('bundle_id', 'specs')},
    spec_of AS (SELECT q_key AS bundle_id, list({{'task': task, 'score_percent': {_P.format('score')}, 'source': 'spec'}} ORDER BY rank) AS spec_matches, arg_min(score, rank) AS spec_max FROM tfidf_ranked JOIN corpus USING (c_key) GROUP BY q_key),
    {_JUDGED},
    assessed AS (SELECT b.bundle_id, NOT coalesce(broken, false) AS structure_pass, NOT coalesce(severe, false) AS static_pass, NOT coalesce(bad_rubric, false) AS rubric_pass, NOT coalesce(blocked, false) AS similarity_pass, llm_pass, coalesce(i.issues, []) AS issues,
        p.blocked, p.message, greatest(coalesce(p.max_similarity, 0), coalesce(spec_max, 0)) AS max_similarity, coalesce(p.matches, []) AS matches, coalesce(p.notes, []) AS notes, coalesce(p.body, '') AS body, coalesce(spec_matches, []) AS spec_matches, coalesce(r.results, []) AS results
        FROM side b LEFT JOIN issues_of i USING (bundle_id) LEFT JOIN rubric_gate USING (bundle_id) LEFT JOIN prechecks p ON p.q_key = b.bundle_id LEFT JOIN spec_of USING (bundle_id) LEFT JOIN results r USING (bundle_id) LEFT JOIN judge USING (bundle_id)),
    reported AS (SELECT *, similarity_pass AND structure_pass AND rubric_pass AND coalesce(llm_pass, true) AND static_pass AS overall_pass FROM assessed)"""


@query(f"""{_ASSESSED} SELECT bundle_id, CAST(to_json({{'task_name': bundle_id, 'trainer_name': 'Ann', 'timestamp': '2026-01-01T00:00:00Z', 'overall_pass': overall_pass, 'structure_pass': structure_pass, 'rubric_pass': rubric_pass, 'static_checks': {{'pass': static_pass, 'issues': issues}},
    'similarity': {{'pass': similarity_pass, 'instruction_blocked': blocked, 'instruction_block_message': CASE WHEN blocked THEN message ELSE '' END, 'dual_threshold_percent': 60, 'semantic_block_threshold_percent': 70, 'submitted_instruction': body, 'max_score_percent': {_P.format('max_similarity')}, 'threshold_warn_percent': 60, 'threshold_block_percent': 60,
        'instruction_top_matches': list_transform(matches, lambda m: {{'task': m.task, 'trainer': m.trainer, 'score_percent': m.score_percent, 'lexical_percent': CASE WHEN m.lex <> 0 THEN m.lexical END, 'semantic_percent': CASE WHEN m.sem <> 0 THEN m.semantic END, 'dual_block': m.flagged, 'block_reason': m.block_reason, 'flag_label': m.flag_label, 'method': m.method, 'source': 'instruction', 'matched_instruction': m.text}}),
        'spec_top_matches': spec_matches}}, 'llm_judge': {{'pass': llm_pass, 'results': CASE WHEN len(results) > 0 THEN map_from_entries(list_transform(results, lambda r: {{'k': r.check_key, 'v': {{'label': r.label, 'verdict': r.verdict, 'alignment_score': r.alignment_score, 'reasoning': r.reasoning, 'gaps': r.gaps}}}})) END}}, 'notes': notes}}) AS VARCHAR) AS report FROM reported""")
def report_json(spark, d):
    return report.report_json(_assessments(spark, d), "Ann", "2026-01-01T00:00:00Z")


_COLOUR = "CASE i.severity WHEN 'CRITICAL' THEN '#a4133c' WHEN 'HIGH' THEN '#c2571a' WHEN 'MEDIUM' THEN '#8a7a12' WHEN 'INFO' THEN '#2a5d84' ELSE '#555555' END"
_ISSUE_ROW = f"'<tr><td style=''color:' || {_COLOUR} || '''>' || {_escaped('i.severity')} || '</td><td>' || {_escaped('i.message')} || '</td><td>' || {_escaped('i.fix_hint')} || '</td></tr>'"


@query(f"{_ISSUES} SELECT bundle_id, string_agg({_ISSUE_ROW}, '' ORDER BY seq) AS html FROM numbered i GROUP BY bundle_id")
def issues_html(spark, d):
    return report.issues_html(rules.static_issues(_files(spark, d)))


_BADGE = """CASE WHEN {0} IS NULL THEN '<span class="badge skip">SKIPPED</span>' WHEN {0} THEN '<span class="badge pass">PASS</span>' ELSE '<span class="badge fail">FAIL</span>' END"""
_GAP = _cells(_escaped("g.file"), _escaped("g.issue"), _escaped("g.fix"))
_VERDICT = f"""'<section><b style="color:' || CASE r.verdict WHEN 'PASS' THEN '#1b7f4b' WHEN 'NEEDS_WORK' THEN '#c2571a' ELSE '#a4133c' END || '">' || {_escaped('r.label')} || ': ' || {_escaped('r.verdict')} || '</b> ' || coalesce(CAST(r.alignment_score AS VARCHAR), '—')
    || '<p>' || {_escaped("coalesce(r.reasoning, '')")} || '</p>' || CASE WHEN len(r.gaps) > 0 THEN '<table>' || {_joined('r.gaps', 'g', _GAP)} || '</table>' ELSE '' END || '</section>'"""


@query(f"""{_ASSESSED} SELECT bundle_id, '<!DOCTYPE html><html><body>' || CASE WHEN overall_pass THEN '<h1 style="color:#1b7f4b">READY TO SUBMIT</h1>' ELSE '<h1 style="color:#a4133c">NEEDS FIXES</h1>' END || '<p>' || {_escaped('bundle_id')} || ', Ann</p><table><tr><th>Layer</th><th>Result</th><th>Detail</th></tr>'
    || {_cells("'Static checks'", _BADGE.format('static_pass'), "len(issues) || ' issues'")} || {_cells("'Similarity'", _BADGE.format('similarity_pass'), f"'at most ' || {_P.format('max_similarity')} || '%'")} || {_cells("'Judge'", _BADGE.format('llm_pass'), "CASE WHEN len(results) > 0 THEN 'done' ELSE 'skipped' END")} || '</table><table>'
    || {_table('issues', 'i', _ISSUE_ROW, 3, 'No issues.')} || '</table>' || CASE WHEN blocked THEN '<p><b>' || {_escaped('message')} || '</b></p>' ELSE '' END || '<table>' || {_table('matches', 'm', _MATCH_ROW, 5, 'No matches returned.')} || '</table>' || {_joined('matches', 'm', _card('body'))}
    || '<table>' || {_table('spec_matches', 'm', _cells(_escaped('m.task'), _share('m.score_percent')), 2, 'No matches returned.')} || '</table>' || CASE WHEN len(results) > 0 THEN {_joined('results', 'r', _VERDICT)} ELSE '<p>The judge did not run.</p>' END || {_notes('notes')} || '</body></html>' AS html FROM reported""")
def report_html(spark, d):
    return report.report_html(_assessments(spark, d), "Ann")


# -- prompts, corpora and texts --------------------------------------------------------
_ASKED = "CASE check_key " + " ".join(f"WHEN '{k}' THEN '{q.replace(chr(39), chr(39) * 2)}'" for k, q in verdicts.QUESTIONS.items()) + " END"
_SHOWN = [n for n in verdicts.PROMPT_FILES]


@query(f"""WITH f AS (SELECT * FROM {fixtures.sql('files', 'benchmark')}), side AS (SELECT bundle_id, {", ".join(f"arg_min(content, path) FILTER ({'path LIKE ' + repr('%' + n) if n == 'SPEC.md' else 'path = ' + repr(n)}) AS f{i}" for i, n in enumerate(_SHOWN))}, list(path) AS paths, bool_or(regexp_replace(path, '^.*/', '') = 'SPEC.md') AS spec FROM f GROUP BY bundle_id),
    k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', [{', '.join(repr(r) for r in req)}], {str(spec).lower()})" for i, (k, _, req, spec) in enumerate(verdicts.CHECKS))}) AS c(ord, check_key, required, need_spec)),
    accepted AS (SELECT * FROM {fixtures.sql('accepted', 'benchmark')}),
    told AS (SELECT (SELECT string_agg('== accepted task ' || name || ', of category ' || regexp_extract(coalesce(toml, ''), 'category\\s*=\\s*"([^"]+)"', 1) || ' ==' || chr(10) || left(trim(coalesce(instruction, '')), 1200) || chr(10), chr(10) ORDER BY name) FROM accepted WHERE name IN ('t1', 't2', 't3', 't4')) AS digest,
        (SELECT string_agg('== reference' || CASE WHEN name = 't9' THEN ': ' || name ELSE ' ' || o || '/4: ' || name || ', of category ' || regexp_extract(coalesce(toml, ''), 'category\\s*=\\s*"([^"]+)"', 1) END || ' ==' || chr(10) || instruction || chr(10), chr(10) ORDER BY o, name) FROM (SELECT *, CASE name WHEN 't1' THEN 1 WHEN 't2' THEN 2 WHEN 't3' THEN 3 WHEN 't4' THEN 4 ELSE 9 END AS o FROM accepted WHERE coalesce(instruction, '') <> '')) AS listed)
    SELECT bundle_id, check_key, concat_ws(chr(10) || chr(10), '{verdicts.GUARD}', '{verdicts.PERSONA}', {_ASKED}, CASE check_key WHEN '{verdicts.WITH_LIST}' THEN listed WHEN '{verdicts.WITH_DIGEST}' THEN digest END,
        trim({" || chr(10) || chr(10) || ".join(f"'<<< {n} >>>' || chr(10) || coalesce(left(f{i}, {verdicts.TOML_CHARS if n == 'task.toml' else verdicts.FILE_CHARS}), '[FILE NOT FOUND]')" for i, n in enumerate(_SHOWN))}, chr(10)), '{verdicts.ANSWER}') AS prompt
    FROM side CROSS JOIN k CROSS JOIN told WHERE len(list_filter(required, lambda r: NOT list_contains(paths, r))) = 0 AND (NOT need_spec OR spec)""")
def judge_prompts(spark, d):
    return verdicts.prompts(_files(spark, d), fixtures.over(spark, d, "accepted", "benchmark"), fixtures.ACCEPTED_NAMES)


@query(f"SELECT id, (list_filter(notes, lambda n: regexp_matches(lower(n), 'failed|returned')))[1] AS error FROM {fixtures.sql('noted')}")
def first_error_note(spark, d):
    return fixtures.over(spark, d, "noted").select("id", T.first_error(F.col("notes")).alias("error"))


@query(f"""WITH k AS (SELECT id, unnest(json_keys(value)) AS key, value FROM {fixtures.sql('corpora')}), e AS (SELECT id, key, json_extract(value, '$.' || key) AS entry FROM k)
    SELECT key, nullif(entry->>'$.instruction', '') AS instruction, nullif(entry->>'$.spec', '') AS spec FROM e WHERE json_type(entry) = 'OBJECT'""")
def json_corpus(spark, d):
    return sheets.json_corpus(fixtures.over(spark, d, "corpora"))


_SHORT = "CASE {0} WHEN '' THEN 'No' WHEN 'meaning' THEN 'YES · meaning ≥70%' ELSE 'YES · both ≥60%' END".format(_REASON)


@query(f"SELECT id, {_SHORT} AS label FROM {fixtures.sql('scores')}")
def flag_label_short(spark, d):
    rows = search.decided(fixtures.over(spark, d, "scores"))
    return rows.select("id", S.flag_label(F.col("flagged"), F.col("block_reason"), short=True).alias("label"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) / 1024.0 < 1024 THEN printf('%.1f KB', greatest(octet_length(encode(text)) / 1024.0, 0.1)) ELSE printf('%.1f MB', octet_length(encode(text)) / 1048576.0) END AS size FROM documents")
def size_labels(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.size_label(F.octet_length("text")).alias("size"))


@query("SELECT doc_id AS key, e.embedding IS NOT NULL AS known FROM documents LEFT JOIN embeddings e ON vec_id = doc_id")
def cached_vectors(spark, d):
    return _corpus(spark, d).select("key", F.col("v").isNotNull().alias("known"))


@query(f"""WITH {_JUDGED}, f AS (SELECT * FROM {fixtures.sql('files', 'benchmark')}), side AS (SELECT bundle_id, list(path) AS paths, bool_or(regexp_replace(path, '^.*/', '') = 'SPEC.md') AS spec FROM f GROUP BY bundle_id),
    k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', [{', '.join(repr(r) for r in req)}], {str(spec).lower()})" for i, (k, _, req, spec) in enumerate(verdicts.CHECKS))}) AS c(ord, check_key, required, need_spec)),
    a AS (SELECT bundle_id, CAST(ord AS INTEGER) AS ord, check_key, len(list_filter(required, lambda r: NOT list_contains(paths, r))) = 0 AND (NOT need_spec OR spec) AS applies FROM side CROSS JOIN k)
    SELECT bundle_id, ord, check_key, CASE WHEN applies AND verdict IS NOT NULL THEN verdict ELSE 'SKIPPED' END AS verdict, coalesce(CASE WHEN applies THEN alignment_score END, -1) AS alignment_score FROM a LEFT JOIN answered USING (bundle_id, check_key)""")
def judge_results(spark, d):
    rows = verdicts.results(verdicts.applicable(_files(spark, d)), verdicts.parsed(fixtures.over(spark, d, "judged", "benchmark")))
    return rows.select("bundle_id", "ord", "check_key", "verdict", F.coalesce("alignment_score", F.lit(-1.0)).alias("alignment_score"))


@query("""SELECT name, count(*) FILTER (NOT (trim(name) <> '' AND (lower(key) = lower(trim(name)) OR contains(lower(key), lower(trim(name))) OR trim(text) = trim(own)))) AS kept
    FROM (SELECT 'Task ' || doc_id || ' · ' || source AS key, text FROM documents) CROSS JOIN (SELECT n AS name, (SELECT text FROM documents WHERE doc_id = 100) AS own FROM (VALUES (''), ('task 1'), ('nobody')) AS t(n)) GROUP BY name""")
def exclude_identical(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.where("doc_id = 100").select(F.col("text").alias("own")).crossJoin(spark.createDataFrame([("",), ("task 1",), ("nobody",)], "name string"))
    key = F.concat(F.lit("Task "), F.col("doc_id").cast("string"), F.lit(" · "), F.col("source"))
    rows = docs.select(key.alias("key"), "text").crossJoin(F.broadcast(names))  # three names
    return rows.groupBy("name").agg(F.count_if(~S.excludes_identical(F.col("key"), F.col("name"), F.col("text"), F.col("own"))).alias("kept"))


_SUMMARISED = """(SELECT 't' || item_id AS name, CASE item_id % 3 WHEN 0 THEN [text, 'b'] WHEN 1 THEN CAST([] AS VARCHAR[]) END AS expected_field_hash_keys, CASE item_id % 3 WHEN 0 THEN ['X'] WHEN 2 THEN ['Y', 'Z'] END AS test_classes,
    CASE item_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS hashes_asserted FROM benchmark) AS r"""


@query(f"SELECT name, '  ' || name || ': ' || coalesce(len(expected_field_hash_keys), 0) || ' fields fixed by a hash, ' || coalesce(len(test_classes), 0) || ' test classes; hashes are asserted: ' || CASE WHEN hashes_asserted THEN 'True' ELSE 'False' END AS line FROM {_SUMMARISED}")
def reference_patterns(spark, d):
    third = F.col("item_id") % 3
    none = F.array().cast("array<string>")
    rows = spark.read.parquet(f"{d}/benchmark.parquet").select(
        F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("name"),
        F.when(third == 0, F.array(F.col("text"), F.lit("b"))).when(third == 1, none).alias("expected_field_hash_keys"),
        F.when(third == 0, F.array(F.lit("X"))).when(third == 2, F.array(F.lit("Y"), F.lit("Z"))).alias("test_classes"),
        F.when(third == 0, True).when(third == 1, False).alias("hashes_asserted"),
    )
    return verdicts.reference_patterns(rows)
