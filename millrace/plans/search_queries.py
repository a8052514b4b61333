"""Similarity search over the tables: benchmark texts against documents, and vectors against vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import similarity as S, text as T
from millrace import tables
from millrace.operators import gramindex, nearest, search, setjoin, tfidf
from millrace.plans import fixtures
from millrace.sources import vectors as V, versions

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("key"), "text")


_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_SET = f"list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: x <> ''))"
_PAIRS = f"""
    c AS (SELECT doc_id AS c_key, {_SET} AS t FROM documents), q AS (SELECT item_id AS q_key, {_SET} AS t FROM benchmark),
    ce AS (SELECT c_key, len(t) AS n, unnest(t) AS w FROM c), qe AS (SELECT q_key, len(t) AS n, unnest(t) AS w FROM q),
    pairs AS (SELECT q_key, c_key, CAST(2 AS DOUBLE) * count(*) / (any_value(ce.n) + any_value(qe.n)) AS lex FROM ce JOIN qe USING (w) GROUP BY q_key, c_key)"""
_TOP = f"""{_PAIRS}, every AS (SELECT q.q_key, c.c_key, coalesce(p.lex, 0) AS lex FROM q CROSS JOIN c LEFT JOIN pairs p ON p.q_key = q.q_key AND p.c_key = c.c_key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY lex DESC, c_key) AS r FROM every)"""


@query(f"SELECT doc_id AS key, {_NORM} AS norm FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("key", T.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id AS key, CAST(len({_SET}) AS INTEGER) AS n_words FROM documents")
def token_sets(spark, d):
    return _docs(spark, d).select("key", F.size(T.token_set(F.col("text"))).alias("n_words"))


@query(f"WITH {_TOP} SELECT q_key, CAST(r AS INTEGER) AS rank, c_key, lex FROM ranked WHERE r <= 10")
def dice_topk(spark, d):
    return search.dice_topk(_items(spark, d), _docs(spark, d))


@query(f"WITH {_PAIRS} SELECT q_key, c_key, lex FROM pairs WHERE lex >= 0.6")
def dice_pairs_threshold(spark, d):
    return search.dice_threshold(_items(spark, d), _docs(spark, d))


_CLASSES = f"""sets AS (SELECT doc_id, list_sort({_SET}) AS t FROM documents), classes AS (SELECT min(doc_id) AS set_key, count(*) AS copies, t FROM sets WHERE len(t) > 0 GROUP BY t)"""


@query(f"""WITH {_CLASSES}, e AS (SELECT set_key, copies, len(t) AS n, unnest(t) AS w FROM classes)
    SELECT a.set_key AS a_key, b.set_key AS b_key, any_value(a.copies) AS a_copies, any_value(b.copies) AS b_copies, CAST(2 AS DOUBLE) * count(*) / (any_value(a.n) + any_value(b.n)) AS lex
    FROM e a JOIN e b ON a.w = b.w AND a.set_key < b.set_key GROUP BY a.set_key, b.set_key HAVING CAST(2 AS DOUBLE) * count(*) / (any_value(a.n) + any_value(b.n)) >= 0.6""")
def dice_self_pairs(spark, d):
    """All documents against all: pairs of different word sets at 0.6."""
    return setjoin.self_pairs(_docs(spark, d))


@query(f"WITH {_CLASSES} SELECT doc_id AS key, set_key FROM sets JOIN classes USING (t)")
def dice_self_classes(spark, d):
    """The class of every document that has words."""
    return setjoin.classes(_docs(spark, d))


@query(f"WITH {_PAIRS} SELECT q_key, c_key, lex FROM pairs WHERE lex >= 0.6")
def dice_pairs_distributed(spark, d):
    """The pairs of ``dice_pairs_threshold`` by the join that holds no side anywhere whole."""
    return setjoin.search(_items(spark, d), _docs(spark, d))


@query(f"SELECT min(doc_id) AS first_key, count(*) AS copies, norm FROM (SELECT doc_id, {_NORM} AS norm FROM documents) GROUP BY norm HAVING count(*) > 1")
def exact_normalized_dups(spark, d):
    rows = _docs(spark, d).select("key", T.normalize(F.col("text")).alias("norm"))
    return rows.groupBy("norm").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


_COSINE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    scored AS (SELECT q.vec_id AS q_key, c.vec_id AS c_key, list_cosine_similarity(q.e, c.e) AS sem FROM v q CROSS JOIN v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)"""


@query(f"WITH {_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(sem, 9) DESC, c_key) AS r FROM scored) SELECT q_key, CAST(r AS INTEGER) AS rank, c_key, round(sem, 6) AS sem FROM r WHERE r <= 10")
def cosine_topk(spark, d):
    """Every vector whose id is divisible by 100 is a query, against all vectors but itself."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return search.cosine_topk(rows.where("key % 100 = 0"), rows).withColumn("sem", F.round("sem", 6))


@query(f"WITH {_COSINE.replace('q.vec_id % 100 = 0 AND ', '')}, r AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(sem, 9) DESC, c_key) AS r FROM scored) SELECT q_key, CAST(r AS INTEGER) AS rank, c_key, round(sem, 6) AS sem FROM r WHERE r <= 10")
def cosine_all_topk(spark, d):
    """Every vector against all others, exactly, by pivots."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return nearest.all_topk(rows).withColumn("sem", F.round("sem", 6))


_REASON = "CASE WHEN sem IS NULL THEN '' WHEN lex >= 0.6 AND sem >= 0.6 THEN 'dual' WHEN sem >= 0.7 THEN 'meaning' ELSE '' END"
_METHOD = "CASE WHEN sem >= 0.6 AND lex >= 0.6 THEN 'dual-60' WHEN sem >= 0.7 THEN 'meaning-70' WHEN sem >= 0.6 THEN 'semantic-high' WHEN lex >= 0.6 THEN 'lexical-only' ELSE 'below-threshold' END"


@query(f"SELECT id, {_REASON} AS block_reason, {_REASON} <> '' AS flagged FROM {fixtures.sql('scores')}")
def decide_branches(spark, d):
    return search.decided(fixtures.over(spark, d, "scores")).select("id", "block_reason", "flagged")


@query(f"SELECT id, {_METHOD} AS method FROM {fixtures.sql('scores')}")
def method_label(spark, d):
    return search.decided(fixtures.over(spark, d, "scores")).select("id", "method")


@query(f"SELECT id, greatest(lex, coalesce(sem, 0)) AS score FROM {fixtures.sql('scores')}")
def combined_score(spark, d):
    return search.decided(fixtures.over(spark, d, "scores")).select("id", "score")


@query(f"SELECT id, CASE {_REASON} WHEN '' THEN 'No' WHEN 'meaning' THEN 'YES (meaning ≥70%)' ELSE 'YES (both ≥60%)' END AS flag_label FROM {fixtures.sql('scores')}")
def flag_label(spark, d):
    return search.decided(fixtures.over(spark, d, "scores")).select("id", "flag_label")


_RANK = "row_number() OVER (PARTITION BY q_key ORDER BY flagged DESC, coalesce(sem, -1) DESC, lex DESC, ord)"


@query(f"SELECT q_key, ord, CAST({_RANK} AS INTEGER) AS rank FROM {fixtures.sql('hits')}")
def rank_with_ties(spark, d):
    return search.ranked(fixtures.over(spark, d, "hits"), "q_key", "ord").select("q_key", "ord", "rank")


@query(f"WITH r AS (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM {fixtures.sql('hits')}) SELECT q_key, bool_or(flagged) AS blocked, arg_min(score, rank) AS max_similarity, coalesce(min(rank) FILTER (flagged), 0) AS first_flagged FROM r GROUP BY q_key")
def block_any(spark, d):
    return search.blocked(search.ranked(fixtures.over(spark, d, "hits"), "q_key", "ord"), "q_key").withColumn("first_flagged", F.coalesce("first_flagged", F.lit(0)))


# the same decisions over a whole table: every line item is a match of its part, with scores from its numbers
_PAIRS = """scores AS (SELECT l_partkey AS q_key, l_orderkey * 100 + l_linenumber AS ord,
    CASE WHEN l_suppkey % 11 <> 0 THEN (l_orderkey * 37 + l_linenumber * 11) % 101 / 100.0 END AS lex,
    CASE WHEN l_orderkey % 7 <> 0 THEN (l_orderkey * 13 + l_linenumber * 29) % 101 / 100.0 END AS sem FROM lineitem)"""
_LABEL = f"CASE {_REASON} WHEN '' THEN 'No' WHEN 'meaning' THEN 'YES (meaning ≥70%)' ELSE 'YES (both ≥60%)' END"
_DECIDED = f"{_PAIRS}, hits AS (SELECT *, {_REASON} AS block_reason, {_REASON} <> '' AS flagged, {_METHOD} AS method, greatest(coalesce(lex, 0), coalesce(sem, 0)) AS score, {_LABEL} AS flag_label FROM scores)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matches with both scores; a score may be missing."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    lex = F.when(F.col("l_suppkey") % 11 != 0, (order * 37 + line * 11) % 101 / F.lit(100.0))
    sem = F.when(order % 7 != 0, (order * 13 + line * 29) % 101 / F.lit(100.0))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("q_key"), (order * 100 + line).alias("ord"), lex.alias("lex"), sem.alias("sem"))


@query(f"WITH {_DECIDED} SELECT q_key, ord, block_reason, flagged, method, score, flag_label FROM hits")
def decided_rows(spark, d):
    return search.decided(_pairs(spark, d)).select("q_key", "ord", "block_reason", "flagged", "method", "score", "flag_label")


@query(f"WITH {_DECIDED}, r AS (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM hits) SELECT q_key, ord, rank FROM r WHERE rank <= 10")
def ranked_rows(spark, d):
    """The ten best matches of each part, as reports list them."""
    return search.ranked(search.decided(_pairs(spark, d)), "q_key", "ord").select("q_key", "ord", "rank")


@query(f"WITH {_DECIDED}, r AS (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM hits) SELECT q_key, bool_or(flagged) AS blocked, arg_min(score, rank) AS max_similarity, coalesce(min(rank) FILTER (flagged), 0) AS first_flagged FROM r WHERE rank <= 10 GROUP BY q_key")
def blocked_rows(spark, d):
    hits = search.ranked(search.decided(_pairs(spark, d)), "q_key", "ord")
    return search.blocked(hits, "q_key").withColumn("first_flagged", F.coalesce("first_flagged", F.lit(0)))


@query(f"""WITH {_TOP}, best AS (SELECT q_key, c_key, lex FROM ranked WHERE r <= 10)
    SELECT q_key, bool_or(lex >= 0.6) AS lexical_hit, max(lex) AS best_lex FROM best GROUP BY q_key""")
def search_summary(spark, d):
    best = search.dice_topk(_items(spark, d), _docs(spark, d))
    return best.groupBy("q_key").agg(F.bool_or(F.col("lex") >= S.DUAL).alias("lexical_hit"), F.max("lex").alias("best_lex"))


_FROM, _TO = tfidf.accents()
_STOP = "[" + ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS) + "]"


def _grams(key: str, table: str) -> str:
    return f"""SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM (
        SELECT {key} AS key, list_filter(regexp_extract_all(translate(lower(text), '{_FROM}', '{_TO}'), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM {table})"""


_VOCABULARY = f"""dc AS (SELECT key, gram, count(*) AS tf FROM ({_grams('doc_id', 'documents')}) GROUP BY key, gram),
    vocabulary AS (SELECT gram, sum(tf) AS cf, count(*) AS df FROM dc GROUP BY gram ORDER BY cf DESC, gram LIMIT 5000)"""


@query(f"WITH {_VOCABULARY} SELECT gram, CAST(cf AS BIGINT) AS cf, df FROM vocabulary")
def tfidf_vocab(spark, d):
    return tfidf.vocabulary(_docs(spark, d))


def _tfidf(key: str, table: str) -> str:
    """CTEs up to ``tfidf_ranked`` (q_key, c_key, score, rank) for the texts of a table against the documents."""
    return f"""{_VOCABULARY}, qc AS (SELECT key, gram, count(*) AS tf FROM ({_grams(key, table)}) GROUP BY key, gram),
    n AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> ''), idf AS (SELECT gram, ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1 AS idf FROM vocabulary, n),
    dw AS (SELECT key, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY key)) AS w FROM dc JOIN idf USING (gram)),
    qw AS (SELECT key, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY key)) AS w FROM qc JOIN idf USING (gram)),
    weighed AS (SELECT qw.key AS q_key, dw.key AS c_key, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (gram) GROUP BY 1, 2),
    tfidf_every AS (SELECT b.{key} AS q_key, t.doc_id AS c_key, coalesce(score, 0) AS score FROM {table} b CROSS JOIN (SELECT doc_id FROM documents WHERE trim(text) <> '') t LEFT JOIN weighed p ON p.q_key = b.{key} AND p.c_key = t.doc_id),
    tfidf_ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, c_key) AS INTEGER) AS rank FROM tfidf_every) WHERE rank <= 5)"""


@query(f"WITH {_tfidf('item_id', 'benchmark')} SELECT q_key, rank, c_key, round(score, 6) AS score FROM tfidf_ranked")
def tfidf_topk(spark, d):
    return tfidf.topk(_items(spark, d), _docs(spark, d)).withColumn("score", F.round("score", 6))


def _gram_index(spark: SparkSession, d: str) -> gramindex.Index:
    folder = f"{tables.scratch(spark)}/millrace/gram-index-{uuid.uuid4().hex}"
    tables.until_exit(spark, folder)
    return gramindex.build(_docs(spark, d), folder)


@query(f"WITH {_tfidf('item_id', 'benchmark')} SELECT q_key, rank, c_key, round(score, 6) AS score FROM tfidf_ranked")
def tfidf_indexed_topk(spark, d):
    """The rows of ``tfidf_topk`` from a written index."""
    return gramindex.topk(_items(spark, d), _gram_index(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_tfidf('doc_id', '(SELECT * FROM documents WHERE doc_id % 100 = 0)')} SELECT q_key, rank, c_key, round(score, 6) AS score FROM tfidf_ranked")
def tfidf_indexed_documents(spark, d):
    """The documents whose id is divisible by 100 against all documents."""
    return gramindex.topk(_docs(spark, d).where("key % 100 = 0"), _gram_index(spark, d)).withColumn("score", F.round("score", 6))


_NAMED = "(VALUES (''), ('task 1'), ('SRC3'), ('nobody')) AS n(name)"


@query(f"""SELECT name, count(*) FILTER (NOT (trim(name) <> '' AND contains(lower(key), lower(trim(name))))) AS kept, count(*) FILTER (NOT contains(lower(key), lower(name))) AS kept_tfidf
    FROM (SELECT 'Task ' || doc_id || ' · ' || source AS key FROM documents) CROSS JOIN {_NAMED} GROUP BY name""")
def exclude_self(spark, d):
    key = F.concat(F.lit("Task "), F.col("doc_id").cast("string"), F.lit(" · "), F.col("source"))
    names = spark.createDataFrame([("",), ("task 1",), ("SRC3",), ("nobody",)], "name string")
    rows = spark.read.parquet(f"{d}/documents.parquet").select(key.alias("key")).crossJoin(F.broadcast(names))  # four names
    kept = ~S.excludes(F.col("key"), F.col("name"))
    return rows.groupBy("name").agg(F.count_if(kept).alias("kept"), F.count_if(~S.excludes_tfidf(F.col("key"), F.col("name"))).alias("kept_tfidf"))


@query("SELECT CAST(NULL AS BIGINT) AS q_key, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS BIGINT) AS c_key, CAST(NULL AS DOUBLE) AS score WHERE false")
def tfidf_exclude_blank(spark, d):
    """A blank name leaves out the whole corpus, so nothing is found."""
    corpus = _docs(spark, d).where(~S.excludes_tfidf(F.col("key").cast("string"), F.lit("")))
    return tfidf.topk(_items(spark, d), corpus)


@query(f"""WITH {_TOP} SELECT q_key, c_key, lex, left(text, 1500) AS excerpt FROM ranked JOIN documents ON doc_id = c_key WHERE r = 1""")
def closest_match_excerpt(spark, d):
    best = search.dice_topk(_items(spark, d), _docs(spark, d), 1)
    return best.join(_docs(spark, d).withColumnRenamed("key", "c_key"), "c_key", "left").select("q_key", "c_key", "lex", F.left(F.coalesce("text", F.lit("")), F.lit(1500)).alias("excerpt"))


@query(f"""SELECT key, coalesce(CASE WHEN trim(matched_instruction) <> '' THEN matched_instruction END, CASE WHEN trim(t.text) <> '' THEN t.text END, CASE WHEN trim(c.text) <> '' THEN c.text END, '') AS matched_instruction
    FROM {fixtures.sql('matches')} LEFT JOIN (SELECT * FROM {fixtures.sql('tracker')}) t USING (key) LEFT JOIN (SELECT * FROM {fixtures.sql('corpus')}) c USING (key)""")
def text_fallback(spark, d):
    return search.enriched(*(fixtures.over(spark, d, n) for n in ("matches", "tracker", "corpus")))


@query("SELECT sha256(string_agg(key || chr(0) || text || chr(0), '' ORDER BY key)) AS signature FROM (SELECT CAST(item_id AS VARCHAR) AS key, text FROM benchmark)")
def corpus_signature(spark, d):
    """Over the benchmark texts, a corpus of bounded size."""
    return V.signature(_items(spark, d).withColumn("key", F.col("key").cast("string")))


def _next_version(docs: DataFrame) -> DataFrame:
    """Documents some of which are gone, changed or new."""
    text = F.when(F.col("key") % 97 == 3, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("key % 83 = 7").select((-F.col("key") - 1).alias("key"), "text")
    return docs.where("key % 89 <> 5").select("key", text.alias("text")).unionByName(new)


@query("""WITH old AS (SELECT doc_id AS key, text FROM documents), new AS (SELECT key, CASE WHEN key % 97 = 3 THEN text || '!' ELSE text END AS text FROM old WHERE key % 89 <> 5 UNION ALL SELECT -key - 1, text FROM old WHERE key % 83 = 7)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old a FULL JOIN new b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR coalesce(a.text, '') <> coalesce(b.text, '')""")
def corpus_changes(spark, d):
    """What differs between the documents and a next version of them, from two written trees of digests."""
    folder = f"{tables.scratch(spark)}/millrace/versions-{uuid.uuid4().hex}"
    tables.until_exit(spark, folder)
    old, new = versions.keep(_docs(spark, d), f"{folder}/old"), versions.keep(_next_version(_docs(spark, d)), f"{folder}/new")
    return versions.changes(old, new)


@query("""WITH r AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS bucket, sha256(CAST(doc_id AS VARCHAR) || chr(0) || text || chr(0)) AS digest FROM documents),
    a AS (SELECT left(bucket, 8) AS own, sha256(string_agg(digest, '' ORDER BY bucket, digest)) AS digest FROM r GROUP BY own),
    b AS (SELECT left(own, 4) AS top, sha256(string_agg(digest, '' ORDER BY own)) AS digest FROM a GROUP BY top) SELECT sha256(string_agg(digest, '' ORDER BY top)) AS signature FROM b""")
def corpus_tree_signature(spark, d):
    return V.tree_signature(_docs(spark, d).withColumn("key", F.col("key").cast("string")))
