"""Judge checks: which apply, their prompts, and what their raw answers say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import text as T

#: Checks by order: key, label, files that must be there, whether a SPEC.md must be.
CHECKS = [
    ("instruction_vs_all_refs", "Instruction vs All 8 References", ["instruction.md"], False),
    ("accepted_pattern", "Accepted Task Pattern", ["instruction.md"], False),
    ("instruction_spec", "Instruction ↔ SPEC", ["instruction.md"], True),
    ("instruction_test", "Instruction ↔ Tests", ["instruction.md", "tests/test_outputs.py"], False),
    ("spec_test", "SPEC ↔ Tests", ["tests/test_outputs.py"], True),
    ("solution_instruction", "Solution ↔ Instruction", ["solution/solve.sh", "instruction.md"], False),
    ("solution_spec", "Solution ↔ SPEC", ["solution/solve.sh"], False),
    ("solution_test", "Solution ↔ Tests", ["solution/solve.sh", "tests/test_outputs.py"], False),
    ("environment", "Environment ↔ Task", ["environment/Dockerfile", "task.toml"], False),
]
#: Characters read of a file, of task.toml, and the files of a prompt by name.
FILE_CHARS, TOML_CHARS = 15_000, 5_000
PROMPT_FILES = ["task.toml", "instruction.md", "SPEC.md", "tests/test_outputs.py", "solution/solve.sh", "environment/Dockerfile"]


def checks(spark: SparkSession) -> DataFrame:
    rows = [(key, label, i, required, spec) for i, (key, label, required, spec) in enumerate(CHECKS)]
    return spark.createDataFrame(rows, "check_key string, label string, ord int, required array<string>, need_spec boolean")


def applicable(files: DataFrame) -> DataFrame:
    """``bundle_id, check_key, label, ord, applies`` of every bundle and check."""
    name = F.regexp_replace("path", "^.*/", "")
    held = [p for _, _, required, _ in CHECKS for p in required]
    present = files.groupBy("bundle_id").agg(F.collect_set(F.when(F.col("path").isin(held), F.col("path"))).alias("present"), F.coalesce(F.bool_or(name == "SPEC.md"), F.lit(False)).alias("has_spec"))
    both = present.crossJoin(F.broadcast(checks(files.sparkSession)))  # nine rows
    return both.select("bundle_id", "check_key", "label", "ord", ((F.size(F.array_except("required", "present")) == 0) & (~F.col("need_spec") | F.col("has_spec"))).alias("applies"))


def files_block(files: DataFrame) -> DataFrame:
    """``bundle_id, block``: the files of a prompt, each under its name, cut to what a judge reads."""
    name = F.when(F.col("path").endswith("SPEC.md"), "SPEC.md").otherwise(F.col("path"))
    # of several SPEC.md the first by path
    of = lambda n: F.min_by(F.when(name == n, F.col("content")), F.when(name == n, F.col("path")))
    side = files.groupBy("bundle_id").agg(*(of(n).alias(f"f{i}") for i, n in enumerate(PROMPT_FILES)))
    parts = [F.concat(F.lit(f"<<< {n} >>>\n"), T.truncated(F.col(f"f{i}"), TOML_CHARS if n == "task.toml" else FILE_CHARS)) for i, n in enumerate(PROMPT_FILES)]
    return side.select("bundle_id", F.concat(F.lit("\n"), F.concat_ws("\n\n", *parts), F.lit("\n")).alias("block"))


#: What every prompt begins with: who judges, what may not be objected to, and the form of the answer.
PERSONA = "You review tasks that are submitted for a benchmark. Judge only what the files below say; quote them where you object."
GUARD = "Folder layout and required files were checked before and are in order; do not report them."
ANSWER = 'Answer with one JSON object: {"verdict": "PASS", "NEEDS_WORK" or "REJECT", "alignment_score": 0 to 100, "reasoning": text, "gaps": [{"file": name, "issue": text, "fix": text}]}.'
#: What each check asks.
QUESTIONS = {
    "instruction_vs_all_refs": "Compare the instruction with every accepted instruction below. Is it of their kind and depth, and is it a task of its own? For each add to reference_comparisons an object with reference_task, structural_alignment, differentiation_score, too_similar and issues.",
    "accepted_pattern": "Does the task follow the pattern of the accepted tasks below without copying one? Set copy_paste_risk and too_similar_to_existing.",
    "instruction_spec": "Do the instruction and SPEC.md ask for the same behaviour, and does neither leave out or contradict what the other fixes?",
    "instruction_test": "Does every assertion of the tests follow from the instruction, and is every demand of the instruction tested? Set instruction_leaks_rules if it gives the checks away.",
    "spec_test": "Do the tests check what SPEC.md fixes, no more and no less? Set unused_hash_checks if expected hashes are never compared.",
    "solution_instruction": "Does the solution do what the instruction asks by working it out? Set hardcoded_solution if it writes down results.",
    "solution_spec": "Does the solution keep to SPEC.md, edge cases included?",
    "solution_test": "Would the solution pass the tests, and could something that doesn't solve the task pass them too? Set bypass_possible if so.",
    "environment": "Do the Dockerfile and task.toml give the task what it needs, and nothing that gives the solution away?",
}
#: The checks that are shown the accepted references, as whole texts or as a digest.
WITH_LIST, WITH_DIGEST = "instruction_vs_all_refs", "accepted_pattern"


def closest(instruction_hits: DataFrame, spec_hits: DataFrame, most: int = 1500) -> DataFrame:
    """``bundle_id, closest``: the first match of the instruction and of the SPEC, each with the beginning of its text (``q_key, rank, task, score, text``)."""
    one = lambda hits, what: hits.where("rank = 1").select(F.col("q_key").alias("bundle_id"), F.concat(F.lit(f"Nearest {what}: "), F.col("task"), F.lit(" ("), T.percent(F.col("score")), F.lit(")\n"), F.left(F.coalesce("text", F.lit("")), F.lit(most))).alias(what))
    both = one(instruction_hits, "instruction").join(one(spec_hits, "SPEC"), "bundle_id", "full")
    return both.select("bundle_id", F.concat_ws("\n\n", "instruction", "SPEC").alias("closest"))


def prompts(files: DataFrame, references: DataFrame | None = None, names: list[str] | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """``bundle_id, check_key, prompt`` of the checks that apply: guard, persona, question, references, files and answer's form.

    ``references (name, instruction, toml)`` are the accepted tasks, a set of bounded size, those of ``names`` first;
    ``nearest`` is what :func:`closest` gives.
    """
    asked = F.create_map(*(F.lit(x) for pair in QUESTIONS.items() for x in pair))
    rows = applicable(files).where("applies").join(files_block(files), "bundle_id")
    if references is not None:
        told = references.agg(reference_list(references, names or []).alias("listed"), accepted_digest(references, names or []).alias("digest"))
        rows = rows.crossJoin(F.broadcast(told))  # one row
    else:
        rows = rows.withColumn("listed", F.lit(None).cast("string")).withColumn("digest", F.lit(None).cast("string"))
    rows = rows.join(nearest, "bundle_id", "left") if nearest is not None else rows.withColumn("closest", F.lit(None).cast("string"))
    shown = F.when(F.col("check_key") == WITH_LIST, F.col("listed")).when(F.col("check_key") == WITH_DIGEST, F.concat_ws("\n\n", "digest", "closest"))
    return rows.select("bundle_id", "check_key", F.concat_ws("\n\n", F.lit(GUARD), F.lit(PERSONA), F.element_at(asked, F.col("check_key")), F.nullif(shown, F.lit("")), F.trim(F.col("block"), F.lit("\n")), F.lit(ANSWER)).alias("prompt"))


def judged(prompted: DataFrame, provider: Callable[[list[str]], list[str]]) -> DataFrame:
    """``bundle_id, check_key, raw``: a provider's answers, batch by batch; an error becomes an ERROR verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            try:
                raw = provider(rows["prompt"].tolist())
            except Exception as e:  # the provider is foreign code, and one failure must not end the job
                raw = ['{"verdict": "ERROR", "alignment_score": 0, "reasoning": "%s", "gaps": []}' % type(e).__name__] * len(rows)
            yield pd.DataFrame({"bundle_id": rows["bundle_id"], "check_key": rows["check_key"], "raw": raw})

    return prompted.select("bundle_id", "check_key", "prompt").mapInPandas(run, "bundle_id string, check_key string, raw string")


def unfenced(raw: Column) -> Column:
    """The JSON of an answer: inside its first json fence, else its first fence, else all of it."""
    inside = lambda mark: F.substring_index(F.substring(raw, F.instr(raw, mark) + len(mark), F.length(raw)), "```", 1)
    found = F.when(F.contains(raw, F.lit("```json")), inside("```json")).when(F.contains(raw, F.lit("```")), inside("```")).otherwise(raw)
    return F.regexp_replace(found, r"(?U)^\s+|\s+$", "")


def parsed(verdicts: DataFrame) -> DataFrame:
    """Add ``answer`` (variant), ``verdict, alignment_score, reasoning`` to rows with ``raw``; unreadable answers are ERROR."""
    out = verdicts.withColumn("answer", F.try_parse_json(unfenced(F.col("raw"))))
    get = lambda path, kind: F.try_variant_get("answer", path, kind)
    return out.select("*", F.when(F.col("answer").isNull(), "ERROR").otherwise(F.coalesce(get("$.verdict", "string"), F.lit("UNKNOWN"))).alias("verdict"), F.when(F.col("answer").isNull(), 0.0).otherwise(get("$.alignment_score", "double")).alias("alignment_score"), get("$.reasoning", "string").alias("reasoning"))


def gaps(answers: DataFrame) -> DataFrame:
    """Unnest ``answer.gaps``: objects give (file or a dash, issue, fix), texts that aren't empty an issue, others nothing."""
    each = answers.select("*", F.posexplode(F.expr("try_variant_get(answer, '$.gaps', 'array<variant>')")).alias("pos", "gap"))
    kind = F.schema_of_variant("gap")
    get = lambda path: F.try_variant_get("gap", path, "string")
    text, whole = kind == "STRING", kind.startswith("OBJECT")
    out = each.where(whole | text & (get("$") != ""))
    return out.select(
        *(c for c in answers.columns if c != "answer"), "pos",
        F.when(whole, F.coalesce(get("$.file"), F.lit("—"))).otherwise(F.lit("—")).alias("file"),
        F.when(whole, F.coalesce(get("$.issue"), F.lit(""))).otherwise(get("$")).alias("issue"),
        F.when(whole, F.coalesce(get("$.fix"), F.lit(""))).otherwise(F.lit("")).alias("fix"),
    )


def results(applied: DataFrame, answers: DataFrame) -> DataFrame:
    """Every check of every bundle by order; those that don't apply or have no answer are SKIPPED without a score."""
    out = applied.join(answers.select("bundle_id", "check_key", "verdict", "alignment_score"), ["bundle_id", "check_key"], "left")
    told = F.col("applies") & F.col("verdict").isNotNull()
    return out.select("bundle_id", "ord", "check_key", "label", F.when(told, F.col("verdict")).otherwise("SKIPPED").alias("verdict"), F.when(told, F.col("alignment_score")).alias("alignment_score"))


def explained(applied: DataFrame, answers: DataFrame) -> DataFrame:
    """The checks that ran, by bundle: ``ord, check_key, label, verdict, alignment_score, reasoning`` and their ``gaps`` in order."""
    each = gaps(answers.select("bundle_id", "check_key", "answer")).groupBy("bundle_id", "check_key").agg(F.array_sort(F.collect_list(F.struct("pos", "file", "issue", "fix"))).alias("gaps"))
    own = F.transform("gaps", lambda g: F.struct(g["file"].alias("file"), g["issue"].alias("issue"), g["fix"].alias("fix")))
    out = applied.join(answers.select("bundle_id", "check_key", "verdict", "alignment_score", "reasoning"), ["bundle_id", "check_key"]).join(each, ["bundle_id", "check_key"], "left")
    return out.select("bundle_id", "ord", "check_key", "label", "verdict", "alignment_score", "reasoning", F.coalesce(own, F.array().cast("array<struct<file:string,issue:string,fix:string>>")).alias("gaps"))


def accepted_digest(references: DataFrame, names: list[str], limit: int = 1200) -> Column:
    """One line block per accepted reference in the order of ``names`` (an aggregate over ``name, instruction, toml``)."""
    order = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("name"))
    block = F.concat(F.lit("== accepted task "), F.col("name"), F.lit(", of category "), T.toml_category(F.coalesce("toml", F.lit(""))), F.lit(" ==\n"), F.left(F.trim(F.coalesce("instruction", F.lit(""))), F.lit(limit)), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.when(order > 0, F.struct(order.alias("o"), block.alias("b")))))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda x: x["b"]), "\n")).otherwise("(no accepted tasks are known)")


#: The yes-or-no findings that an answer may carry.
FLAGS = ["hardcoded_solution", "instruction_leaks_rules", "unused_hash_checks", "bypass_possible", "copy_paste_risk", "too_similar_to_existing"]


def flags(answers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add ``flags``: the names whose value in ``answer`` is exactly true, in the order given."""
    value = lambda n: F.try_variant_get("answer", f"$.{n}", "variant")
    found = [F.when((F.schema_of_variant(value(n)) == "BOOLEAN") & F.try_variant_get("answer", f"$.{n}", "boolean"), F.lit(n)) for n in names or FLAGS]
    return answers.withColumn("flags", F.filter(F.array(*found), lambda x: x.isNotNull()))


def comparisons(answers: DataFrame) -> DataFrame:
    """Unnest ``answer.reference_comparisons``: per object its reference, the three scores or their defaults, and the first two issues joined."""
    each = answers.select("*", F.posexplode(F.expr("try_variant_get(answer, '$.reference_comparisons', 'array<variant>')")).alias("pos", "one")).where(F.schema_of_variant("one").startswith("OBJECT"))
    get = lambda path, default: F.coalesce(F.try_variant_get("one", path, "string"), F.lit(default))
    issues = F.array_join(F.slice(F.try_variant_get("one", "$.issues", "array<string>"), 1, 2), "; ")
    return each.select(
        *(c for c in answers.columns if c != "answer"), "pos",
        get("$.reference_task", "").alias("reference"), get("$.structural_alignment", "—").alias("structure"), get("$.differentiation_score", "—").alias("differentiation"), get("$.too_similar", "false").alias("too_similar"),
        F.coalesce(issues, F.lit("")).alias("issues"),
    )


def reference_patterns(references: DataFrame) -> DataFrame:
    """``name, line``: how many hash-locked fields and test classes an accepted reference has, and whether hashes are asserted."""
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    asserted = F.when(F.coalesce("hashes_asserted", F.lit(False)), "True").otherwise("False")
    line = F.concat(F.lit("  "), F.col("name"), F.lit(": "), count("expected_field_hash_keys"), F.lit(" fields fixed by a hash, "), count("test_classes"), F.lit(" test classes; hashes are asserted: "), asserted)
    return references.select("name", line.alias("line"))


def reference_list(references: DataFrame, names: list[str]) -> Column:
    """All accepted instructions (an aggregate over ``name, instruction, toml``): the named ones numbered in order, then the others by name."""
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("name"))
    known = F.coalesce("instruction", F.lit("")) != ""
    rows = F.array_sort(F.collect_list(F.when(known, F.struct(F.when(place > 0, place).otherwise(1 << 30).alias("o"), F.col("name").alias("n"), F.col("instruction").alias("i"), T.toml_category(F.coalesce("toml", F.lit(""))).alias("c")))))

    def block(r: Column, at: Column) -> Column:
        named = F.concat(F.lit(" "), (at + 1).cast("string"), F.lit(f"/{len(names)}: "), r["n"], F.lit(", of category "), r["c"])
        return F.concat(F.lit("== reference"), F.when(r["o"] < 1 << 30, named).otherwise(F.concat(F.lit(": "), r["n"])), F.lit(" ==\n"), r["i"], F.lit("\n"))

    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, block), "\n")).otherwise("(no references are known)")
