"""The query suite of the corpus operators: one thin query an operator, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, fingerprint, hmm_lm, lang_id, line_dedup, mixing, near_dup, packing, url_filter
from .common import table

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Tools that conversations may call, by name, with the JSON schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "top_k": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "read": {"type": "object", "properties": {"path": {"type": "string", "minLength": 1}}, "required": ["path"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "removed_lines")


def op2_ann_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.train_and_predict(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.train_and_score(table(spark, sf_dir, "documents"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.link_tool_calls(table(spark, sf_dir, "conversations"), TOOLS)
    return found.withColumn("errors", F.array_join("errors", "; "))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ann_one_bit": op2_ann_one_bit,
        "op3_mix_sources": op3_mix_sources,
        "op4_minhash_near_dup": op4_minhash_near_dup,
        "op5_language_mixture": op5_language_mixture,
        "op6_pack_windows": op6_pack_windows,
        "op7_url_rules": op7_url_rules,
        "op8_fingerprints": op8_fingerprints,
        "op9_hidden_markov_lm": op9_hidden_markov_lm,
        "op10_tool_calls": op10_tool_calls,
    }


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT host, path, max(struct_pack(n := length(rh || rp), h := length(rh), b := (verdict = 'block'), rule := rh || rp, verdict := verdict)) AS best
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""


OP2_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS norm FROM v WHERE len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(c.x, q.x), lambda p: p[1] * p[2])) / (c.norm * q.norm) AS score FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: No conversation of the test tables holds calls; messages are what SQL can say of this operator.
OP10_SQL = """
SELECT conv_id, turn, 0::INT AS part, role, 'message' AS kind, NULL::VARCHAR AS call_id, true AS linked, 0::INT AS level, true AS valid, '' AS errors,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ann_one_bit": OP2_SQL, "op4_minhash_near_dup": OP4_SQL, "op7_url_rules": OP7_SQL, "op10_tool_calls": OP10_SQL}
