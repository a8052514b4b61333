"""The contract queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversation_repair, embedding_dedup, exact_dedup, html_text, langid, ngram_join, packing, pii, quality_rules, secrets, spelling_variants, substring_dedup
from ._shared import documents

#: The vocabulary file of the token contracts.
VOCABULARY = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 1024
END_TOKEN = 2


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(), SEQUENCE_TOKENS, END_TOKEN)


def trained(docs: DataFrame) -> langid.Model:
    """The language model of the rows that are not held out."""
    return langid.fit(docs, ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, trained(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html": op5_html,
    "op6_ngram_join": op6_ngram_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
    "op11_quality_rules": op11_quality_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

#: CRC-32 of a string's UTF-8 bytes, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({s})) + 1),
        lambda k: 16 * (instr('0123456789ABCDEF', substr(hex(encode({s})), 2 * k - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode({s})), 2 * k, 1)) - 1)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE_SQL = {
    "op8_exact_dedup": """
        WITH groups AS (
            SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size
            FROM documents GROUP BY coalesce(text, '')
        )
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.body) AS text_sha256
        FROM documents d JOIN groups g ON coalesce(d.text, '') = g.body
    """,
    "op12_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
        ), lowered AS (
            SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS many
            FROM runs WHERE length(run) >= 7 GROUP BY ALL
        ), hashed AS (
            SELECT run, many, {_CRC32.format(s="(id || ':' || run)")} AS h FROM lowered
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(many)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(many) >= 2
        ), shorter AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ), pairs AS (
            SELECT a.word AS word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
            UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
        ), near AS (
            SELECT p.word, count(*) AS n_near, min({{'minus': -o.n, 'word': o.word}}) AS best FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
        ), told AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 10 * w.n THEN best.word END AS form, CASE WHEN -best.minus >= 10 * w.n THEN -best.minus END AS form_n
            FROM words w LEFT JOIN near USING (word)
        ), chain(word, stands, step) AS (
            SELECT word, word, 0 FROM told
            UNION ALL SELECT c.word, t.form, c.step + 1 FROM chain c JOIN told t ON t.word = c.stands WHERE t.form IS NOT NULL
        )
        SELECT t.word, t.n, t.n_near, t.form, t.form_n, r.root FROM told t JOIN (SELECT word, arg_max(stands, step) AS root FROM chain GROUP BY word) r USING (word)
    """,
    "op13_conversation_repair": f"""
        WITH RECURSIVE known AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_CRC32.format(s="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
            FROM conversations
        ), harmed AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM known WHERE h <> 0
        ), placed AS (
            SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM harmed
        ), rows AS (
            SELECT *,
                   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault
            FROM placed
        ), pairs AS (
            SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM rows
        ), faults AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, max(place) AS n
            FROM rows GROUP BY conv_id
        ), illegal AS (
            SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id
        ), inserts(state, cost, letters, mid) AS (
            VALUES (0, 0, '', 0), (1, 0, '', 1), (2, 0, '', 2), (3, 0, '', 3), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 2, 'I', 3), (3, 2, 'I', 2),
                   (0, 4, 'II', 3), (1, 4, 'II', 3), (2, 4, 'II', 2), (3, 4, 'II', 3)
        ), edits(mid, initial, letter, cost, state) AS (
            VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (3, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3),
                   (0, NULL, 'R', 2, 2), (1, NULL, 'R', 2, 2), (2, NULL, 'R', 2, 3), (3, NULL, 'R', 2, 2),
                   (0, NULL, 'D', 3, 0), (1, NULL, 'D', 3, 1), (2, NULL, 'D', 3, 2), (3, NULL, 'D', 3, 3)
        ), best(conv_id, place, state, told) AS (
            SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} FROM faults
            UNION ALL
            SELECT b.conv_id, r.place, e.state, min({{
                'cost': b.told.cost + i.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END,
                'audit': b.told.audit || i.letters || e.letter,
                'out': b.told.out
                    || CASE WHEN i.letters = '' THEN '' WHEN i.mid = 2 AND i.letters = 'I' THEN 'user:' || chr(10) WHEN i.letters = 'I' THEN 'assistant:' || chr(10)
                            WHEN i.mid = 3 THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE 'assistant:' || chr(10) || 'user:' || chr(10) END
                    || CASE e.letter WHEN 'K' THEN r.role || ':' || r.text || chr(10) WHEN 'R' THEN CASE e.state WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text || chr(10) ELSE '' END}})
            FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.place = b.place + 1
            JOIN inserts i ON i.state = b.state
            JOIN edits e ON e.mid = i.mid AND (e.letter = 'D' OR coalesce(r.fault, '') NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR e.initial = r.initial))
            GROUP BY b.conv_id, r.place, e.state
        ), ends AS (
            SELECT b.conv_id, min(CASE b.state WHEN 1 THEN {{'cost': b.told.cost + 4, 'audit': b.told.audit || 'II', 'out': b.told.out || 'user:' || chr(10) || 'assistant:' || chr(10)}}
                WHEN 2 THEN {{'cost': b.told.cost + 2, 'audit': b.told.audit || 'I', 'out': b.told.out || 'assistant:' || chr(10)}} ELSE b.told END) AS told
            FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND b.place = f.n GROUP BY b.conv_id
        )
        SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
               coalesce(i.illegal, 0) AS illegal, coalesce(e.told.cost, 0) AS cost, coalesce(e.told.audit, '') AS audit,
               sha256(coalesce(CASE WHEN e.told.out <> '' THEN left(e.told.out, length(e.told.out) - 1) END, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN illegal i ON i.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
}
