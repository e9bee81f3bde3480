"""Registered queries of the corpus operators: each over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, langid, licenses, lines, mixing, neardup, negatives, personal, quality, simhash, spelling, tokens, urls,
)
from .tables import read

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return add


#: Words of lower-cased text, in DuckDB.
ALNUM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANK_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {ALNUM_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.s, bw.item FROM dw JOIN bw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                        decontamination.contaminated().alias("contaminated"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


@query("op9_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op3_url_filters")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


@query("op4_license_scans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(read(spark, sf_dir, "documents"))


WORD_LETTERS = "".join(map(chr, range(0xC0, 0x100)))
#: The 64 letters beyond ASCII as the 64 characters before "a", so that edits count code points.
ONE_BYTE = "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

OP11_SQL = f"""
WITH RECURSIVE table_step AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM table_step),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]{{7,}}')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM found GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(
           range(1, octet_length(encode(id || ':' || run)) + 1), lambda p: CAST(('0x' || substr(hex(encode(id || ':' || run)), 2 * p - 1, 2)) AS BIGINT))),
           lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h
  FROM counted, crc),
named AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM named WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
plain AS (SELECT word, n, length(word) AS len, translate(word, '{WORD_LETTERS}', '{ONE_BYTE}') AS p FROM words),
cuts AS (SELECT word, n, p, len, len AS size, p AS piece FROM plain
         UNION SELECT word, n, p, len, len - 1, substr(p, 1, i - 1) || substr(p, i + 1) FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM plain)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM cuts a JOIN cuts b USING (size, piece)
          WHERE a.word <> b.word AND levenshtein(a.p, b.p) = 1),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, near := near)) AS top FROM pairs GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                  CASE WHEN -top.m >= 10 * w.n THEN top.near END AS form, CASE WHEN -top.m >= 10 * w.n THEN -top.m END AS form_n
           FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM judged
          UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON c.at = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN judged j ON c.at = j.word WHERE j.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM judged JOIN ends USING (word)"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(read(spark, sf_dir, "documents"))


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score,
                            row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label, largest=None, copies=True)
