"""Queries of the reference's operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detectors, scores, text, vectors
from ..operators import agents, diff, graph, memory, rack, sessions, similarity, skills, units, vault
from ..operators.common import at_rest
from ..sources import exports
from . import sql as S
from .registry import query

ASKED = ["red wigdet", "small ring", "Blue  Gadget!", "large bolt economy", "shiny gizmo", "zzzz qqqq"]
VALUES = ", ".join(f"({i}, {S.quote(q)})" for i, q in enumerate(ASKED, 1))


def asked(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASKED, 1)), "query_id bigint, query string")


def part_rows(read) -> DataFrame:
    """Parts as entries to be: the name is the key, name, type and brand the content, the size decides the kind."""
    return read("part").select(
        F.col("p_partkey").alias("entry_id"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content"),
        F.col("p_name").alias("key"),
        F.when(F.col("p_size") > 40, 2).when(F.col("p_size") > 20, 1).otherwise(3).alias("kind"),
        F.create_map(F.lit("skill"), F.col("p_brand")).alias("meta"),
    )


def part_entries(read) -> DataFrame:
    return at_rest(memory.build_entries(part_rows(read), score_trust=False), "parts")


PART = "p AS (SELECT p_partkey AS entry_id, p_name || ' ' || p_type || ' ' || p_brand AS content, p_name AS key, CASE WHEN p_size > 40 THEN 2 WHEN p_size > 20 THEN 1 ELSE 3 END AS kind, p_brand FROM part)"
ENCODED = f"""q(query_id, query) AS (VALUES {VALUES}), {PART},
texts AS (SELECT key AS t FROM p UNION SELECT content FROM p UNION SELECT query FROM q), {S.encode('texts')},
uq AS (SELECT query_id, query, {S.normalize('query')} AS qn, bits FROM q JOIN enc ON query = t),
names AS (SELECT DISTINCT key, content FROM p),
sims AS (SELECT query_id, key, content, greatest({S.sim('uq.bits', 'ek.bits')}, {S.sim('uq.bits', 'ec.bits')}) AS confidence
  FROM uq, names JOIN enc ek ON names.key = ek.t JOIN enc ec ON names.content = ec.t)"""


def _search_sql(top_k: int, where: str = "true") -> str:
    return f"""WITH {ENCODED},
alive AS (SELECT * FROM p WHERE {where}),
exact AS (SELECT query_id, max(entry_id) AS entry_id FROM uq JOIN alive ON {S.normalize('key')} = qn AND qn <> '' GROUP BY query_id),
fuzzy AS (SELECT s.query_id, a.entry_id, s.confidence FROM sims s JOIN alive a USING (key, content) LEFT JOIN exact e ON e.query_id = s.query_id
  WHERE s.confidence >= 0.6 AND a.entry_id IS DISTINCT FROM e.entry_id),
hits AS (SELECT query_id, entry_id, 1.0::DOUBLE AS confidence, 'exact' AS mode FROM exact UNION ALL SELECT query_id, entry_id, confidence, 'fuzzy' FROM fuzzy),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mode <> 'exact', confidence DESC, entry_id DESC, mode DESC) AS rank FROM hits)
SELECT query_id, rank::INT AS rank, entry_id, confidence, mode, content FROM ranked JOIN p USING (entry_id) WHERE rank <= {top_k}"""


@query(_search_sql(3))
def search_exact_then_fuzzy(spark, read):
    """Three hits a query over parts, exact first."""
    return memory.search(asked(spark), part_entries(read)).select("query_id", "rank", "entry_id", "confidence", "mode", "content")


@query(_search_sql(3, "kind = 2"))
def search_kind_filter(spark, read):
    """the same among skills only."""
    return memory.search(asked(spark), part_entries(read), kind="skill").select("query_id", "rank", "entry_id", "confidence", "mode", "content")


@query(f"SELECT q.query_id, b.entry_id, b.confidence, b.mode FROM (VALUES {VALUES}) q(query_id, query) LEFT JOIN (SELECT * FROM ({_search_sql(1)}) WHERE confidence >= 0.75) b ON q.query_id = b.query_id")
def search_or_none(spark, read):
    """the best hit above the confidence, or nulls."""
    return memory.search_or_none(asked(spark), part_entries(read)).select("query_id", "entry_id", "confidence", "mode")


@query(
    f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, rank)::INT AS rank, "group", entry_id, confidence FROM (
SELECT h.query_id, h.rank, p_brand AS "group", h.entry_id, h.confidence, row_number() OVER (PARTITION BY h.query_id, CASE WHEN p_size > 40 THEN 2 WHEN p_size > 20 THEN 1 ELSE 3 END, p_brand ORDER BY rank) AS n
FROM ({_search_sql(40)}) h JOIN part ON p_partkey = entry_id) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, rank) <= 3"""
)
def search_grouped(spark, read):
    """The best hit of each brand."""
    return memory.search_grouped(asked(spark), part_entries(read)).select("query_id", "rank", "group", "entry_id", "confidence")


@query(
    f"""WITH src AS (SELECT DISTINCT p_name AS t FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region), {S.encode('src')} SELECT t AS name, hex FROM enc"""
)
def encode_names(spark, read):
    """Hypervectors of all names."""
    names = read("part").select(F.col("p_name").alias("name")).union(read("nation").select("n_name")).union(read("region").select("r_name")).distinct()
    vec = vectors.encoder()(F.col("name"))
    return names.withColumn("v", vec).select("name", F.array_join(F.transform("v", lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "").alias("hex"))


@query(
    f"""WITH src AS (SELECT n_name AS t FROM nation), {S.encode('src')},
x AS (SELECT t, bits::VARCHAR AS b FROM enc)
SELECT t AS name, (length(replace(substr(b, 1, 24), '0', '')) / 24.0 * 2 - 1) * 15 AS x, (length(replace(substr(b, 25, 24), '0', '')) / 24.0 * 2 - 1) * 15 AS y, (length(replace(substr(b, 49, 24), '0', '')) / 24.0 * 2 - 1) * 15 AS z, bit_count(b::BIT)::BIGINT AS ones FROM x"""
)
def vector_layout(spark, read):
    """Coordinates from vector bits, and their count."""
    v = read("nation").select(F.col("n_name").alias("name"), vectors.encoder()(F.col("n_name")).alias("v"))
    x, y, z = vectors.layout3d(F.col("v"))
    return v.select("name", x.alias("x"), y.alias("y"), z.alias("z"), vectors.popcount(F.col("v")).cast("bigint").alias("ones"))


def nation_entries(read) -> DataFrame:
    rows = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return memory.build_entries(rows.select(F.col("n_nationkey").alias("entry_id"), F.concat_ws(" ", "n_name", "r_name").alias("content"), F.col("n_name").alias("key")), score_trust=False)


@query(
    f"""WITH e AS (SELECT n_nationkey AS id, n_name AS key, n_name || ' ' || r_name AS content FROM nation JOIN region ON n_regionkey = r_regionkey),
src AS (SELECT key AS t FROM e UNION SELECT content FROM e), {S.encode('src')},
v AS (SELECT id, k.bits AS k, c.bits AS c FROM e JOIN enc k ON e.key = k.t JOIN enc c ON e.content = c.t)
SELECT a.id::BIGINT AS a, b.id::BIGINT AS b, greatest({S.sim('a.k', 'b.k')}, {S.sim('a.c', 'b.c')}) AS similarity FROM v a JOIN v b ON a.id < b.id
WHERE greatest({S.sim('a.k', 'b.k')}, {S.sim('a.c', 'b.c')}) >= 0.55 ORDER BY similarity DESC, a, b LIMIT 200"""
)
def similarity_graph(spark, read):
    """The strongest edges between nations."""
    return similarity.similarity_edges(nation_entries(read))


def name_entries(read) -> DataFrame:
    """Distinct part names, numbered in order."""
    names = read("part").groupBy(F.col("p_name").alias("content")).agg(F.min("p_partkey").alias("entry_id"))
    return memory.build_entries(names, score_trust=False)


@query(
    f"""WITH e AS (SELECT min(p_partkey) AS id, p_name AS t FROM part GROUP BY p_name), src AS (SELECT t FROM e), {S.encode('src')}, v AS (SELECT id, bits FROM e JOIN enc USING (t))
SELECT a.id AS a, b.id AS b, {S.sim('a.bits', 'b.bits')} AS similarity FROM v a JOIN v b ON a.id < b.id WHERE {S.sim('a.bits', 'b.bits')} >= 0.7"""
)
def near_dup_pairs(spark, read):
    """Pairs of similar names."""
    return similarity.similar_pairs(name_entries(read), 0.7)


@query(
    f"""WITH RECURSIVE e AS (SELECT min(p_partkey) AS id, p_name AS t FROM part GROUP BY p_name), src AS (SELECT t FROM e), {S.encode('src')},
v AS (SELECT id, bits, row_number() OVER (ORDER BY id) AS n FROM e JOIN enc USING (t)),
near AS (SELECT b.n, list(a.id) AS ids FROM v b JOIN v a ON a.id < b.id AND {S.sim('a.bits', 'b.bits')} >= 0.7 GROUP BY b.n),
o AS (SELECT v.id, v.n, coalesce(near.ids, []) AS ids FROM v LEFT JOIN near USING (n)),
g(n, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.n, CASE WHEN list_has_any(taken[-5:], o.ids) THEN taken ELSE list_append(taken, o.id) END FROM g JOIN o ON o.n = g.n + 1),
last AS (SELECT taken FROM g ORDER BY n DESC LIMIT 1) SELECT id AS entry_id, list_contains(taken, id) AS accepted FROM o, last"""
)
def greedy_dedup(spark, read):
    """Names that are like none of the last five accepted ones."""
    return similarity.greedy_dedup(name_entries(read), 0.7, window=5)


RACK_ENTRIES = """e AS (SELECT 'region' AS cartridge, r_regionkey::BIGINT AS entry_id, r_name AS key FROM region
 UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'part', p_partkey, p_name FROM part)"""
RACK_ASKED = "q(query_id, query) AS (VALUES (1, 'nation 7'), (2, 'europa'), (3, 'red widgets'), (4, 'NATION_7'))"


@query(
    f"""WITH {RACK_ASKED}, {RACK_ENTRIES}, texts AS (SELECT key AS t FROM e UNION SELECT query FROM q), {S.encode('texts')},
uq AS (SELECT query_id, {S.normalize('query')} AS qn, bits FROM q JOIN enc ON query = t),
sims AS (SELECT query_id, t AS key, {S.sim('uq.bits', 'enc.bits')} AS confidence FROM uq, enc),
exact AS (SELECT query_id, cartridge, max(entry_id) AS entry_id FROM uq JOIN e ON {S.normalize('key')} = qn GROUP BY ALL),
hits AS (SELECT query_id, cartridge, entry_id, 1.0::DOUBLE AS confidence, 'exact' AS mode FROM exact UNION ALL
 SELECT s.query_id, e.cartridge, e.entry_id, confidence, 'fuzzy' FROM sims s JOIN e USING (key) LEFT JOIN exact x ON x.query_id = s.query_id AND x.cartridge = e.cartridge WHERE confidence >= 0.6 AND e.entry_id IS DISTINCT FROM x.entry_id),
own AS (SELECT *, row_number() OVER (PARTITION BY query_id, cartridge ORDER BY mode <> 'exact', confidence DESC, entry_id DESC) AS place FROM hits QUALIFY place <= 3),
once AS (SELECT own.*, key FROM own JOIN e USING (cartridge, entry_id) QUALIFY row_number() OVER (PARTITION BY query_id, cartridge, key ORDER BY confidence DESC, place) = 1)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, cartridge, place))::INT AS rank, cartridge, entry_id, confidence, mode FROM once
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, cartridge, place) <= 3"""
)
def rack_search(spark, read):
    """Three cartridges searched as one."""
    rows = [read("region").select(F.lit("region").alias("cartridge"), F.col("r_regionkey").cast("bigint").alias("entry_id"), F.col("r_name").alias("content"))]
    rows.append(read("nation").select(F.lit("nation"), F.col("n_nationkey").cast("bigint"), "n_name"))
    rows.append(read("part").select(F.lit("part"), "p_partkey", "p_name"))
    entries = at_rest(memory.build_entries(rows[0].union(rows[1]).union(rows[2]), score_trust=False), "rack")
    q = spark.createDataFrame([(1, "nation 7"), (2, "europa"), (3, "red widgets"), (4, "NATION_7")], "query_id bigint, query string")
    return rack.search(q, entries).select("query_id", "rank", "cartridge", "entry_id", "confidence", "mode")


SEMANTIC_BITS = 1024


@query(
    f"""WITH sgn AS (SELECT j, d, CASE WHEN (strpos('0123456789abcdef', substr(md5('semantic:' || j || ':' || d), 8, 1)) - 1) % 2 = 1 THEN 1 ELSE -1 END AS s FROM range(0, 64) a(j), range(0, {SEMANTIC_BITS}) b(d)),
comp AS (SELECT vec_id, label, unnest(range(0, 64)) AS j, unnest(embedding) AS x FROM embeddings),
bits AS (SELECT vec_id, label, d, sum(round(x::DOUBLE * 1000000)::BIGINT * s) > 0 AS b FROM comp JOIN sgn USING (j) GROUP BY ALL),
v AS (SELECT vec_id, label, string_agg(b::INT::VARCHAR, '' ORDER BY d)::BIT AS bits FROM bits GROUP BY ALL),
q AS (SELECT label AS query_id, min(vec_id) AS qid FROM embeddings GROUP BY label),
s AS (SELECT q.query_id, v.vec_id AS entry_id, {S.sim('v.bits', 'w.bits')} AS confidence FROM q JOIN v w ON w.vec_id = q.qid, v WHERE v.vec_id <> q.qid)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, entry_id DESC))::INT AS rank, entry_id, confidence FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, entry_id DESC) <= 5"""
)
def semantic_topk(spark, read):
    """Nearest sign vectors of each label's first vector."""
    signed = read("embeddings").select("vec_id", "label", vectors.simhash(64, SEMANTIC_BITS)("embedding").alias("s"))
    q = signed.groupBy(F.col("label").alias("query_id")).agg(F.min(F.struct("vec_id", "s")).alias("q"))  # a row a label
    sim = vectors.similarity(F.col("s"), F.col("q.s"))
    pairs = signed.crossJoin(F.broadcast(q)).filter(F.col("vec_id") != F.col("q.vec_id")).select("query_id", F.col("vec_id").alias("entry_id"), sim.alias("confidence"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), F.col("entry_id").desc())
    return pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("query_id", "rank", "entry_id", "confidence")


@query(f"SELECT doc_id, md5({S.normalize('text')}) AS digest FROM documents")
def normalize_documents(spark, read):
    """X1."""
    return read("documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


_CLEAN = S.strip(r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')")


@query(f"SELECT doc_id, length(c)::BIGINT AS n, md5(CASE WHEN length(c) > 50000 THEN left(c, 50000) || '... [truncated]' ELSE c END) AS digest, left(c, 1024) AS key FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)")
def sanitize_documents(spark, read):
    """X2, X3."""
    c = text.sanitize_content(F.col("text"))
    clean = text.strip(F.regexp_replace("text", text.CONTROL, ""))
    return read("documents").select("doc_id", F.length(clean).cast("bigint").alias("n"), F.md5(c).alias("digest"), text.sanitize_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter({S.tokens('text')}, lambda w: NOT list_contains({S.strings(text.STOP_EN)}, lower(w))), ' ')) AS digest FROM documents")
def stopword_strip(spark, read):
    """X5."""
    return read("documents").select("doc_id", F.md5(text.drop_words(F.col("text"), text.STOP_EN)).alias("digest"))


_AFFIX = "CASE " + " ".join(f"WHEN ends_with(lower(w), '{a}') AND length(w) - {len(a)} >= 3 THEN left(lower(w), length(w) - {len(a)})" for a in ["ing", "ed", "es", "ly", "s"]) + " ELSE lower(w) END"


@query(f"SELECT doc_id, md5(array_to_string(list_transform({S.tokens('text')}, lambda w: {_AFFIX}), ' ')) AS digest FROM documents")
def affix_strip(spark, read):
    """X6."""
    return read("documents").select("doc_id", F.md5(text.strip_affixes(F.col("text"), text.AFFIX_EN)).alias("digest"))


@query()
def normalizer_pipeline(spark, read):
    """Folding, stop words and affixes in one chain (NFKD is beyond SQL, so tested against Python)."""
    chain = text.normalizer("unicode_fold,stopwords:en,affix:en")
    return read("documents").select("doc_id", F.md5(chain(F.col("text"))).alias("digest"))


def _salience(c: str) -> str:
    return f"""round(least(1.0, 0.3 * len(regexp_extract_all({c}, {S.quote(text.SALIENT)})) + 0.2 * (length({c}) - length(replace({c}, '?', ''))) + least(0.4, 0.01 * len({S.tokens(c)}))), 3)::DOUBLE"""


@query(f"SELECT doc_id, {_salience('text')} AS salience FROM documents")
def salience_documents(spark, read):
    """X12."""
    return read("documents").select("doc_id", text.salience(F.col("text")).alias("salience"))


@query(r"SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug, substr(sha256(url || '|' || coalesce(html, '')), 1, 16) AS digest FROM (SELECT page_id, url, html, left(regexp_replace(regexp_replace(lower(url), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 42) AS s FROM pages)")
def slugs_and_digests(spark, read):
    """X16, V17."""
    return read("pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.digest16(F.col("url"), F.coalesce("html", F.lit(""))).alias("digest"))


EX = rf"""said AS (SELECT conv_id::VARCHAR AS session, turn, role, text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
runs AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS pos, coalesce(sum((role <> 'user')::INT) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM said),
parts AS (SELECT *, (row_number() OVER (PARTITION BY session, run ORDER BY turn) - 1) // 8 AS part FROM runs),
ex0 AS (SELECT session, min(pos) AS turn_lo, max(pos) AS turn_hi, {S.strip("coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE role = 'user'), '')")} AS q0,
 {S.strip("coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE role <> 'user'), '')")} AS a, string_agg(text, ' ' ORDER BY pos) AS body FROM parts GROUP BY session, run, part),
ex AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn_lo) AS xid, turn_lo, turn_hi, CASE WHEN q0 = '' THEN 'context' ELSE q0 END AS q, a, body FROM ex0)"""


def turns_of(read) -> DataFrame:
    return read("conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", "role", "text")


@query(f"WITH {EX} SELECT session, xid, turn_lo::INT AS turn_lo, turn_hi::INT AS turn_hi, md5(q) AS q, md5(a) AS a, {_salience('body')} AS salience FROM ex")
def exchanges(spark, read):
    """Turns to exchanges with their salience."""
    found = sessions.exchanges(turns_of(read))
    return found.select("session", "xid", F.col("turn_lo").cast("int").alias("turn_lo"), F.col("turn_hi").cast("int").alias("turn_hi"), F.md5("q").alias("q"), F.md5("a").alias("a"), text.salience(F.col("body")).alias("salience"))


WORDS = f"w0 AS (SELECT *, {S.content_words('q')} AS q1, {S.content_words('a')} AS a1, {S.bare('q')} AS qb FROM ex), w1 AS (SELECT *, {S.distinct('q1')} AS qw, {S.distinct('a1')} AS aw FROM w0), w2 AS (SELECT *, list_concat(qw[1:4], aw[1:10]) AS e0 FROM w1), w3 AS (SELECT *, {S.distinct('e0')} AS every, list_filter(qb, lambda w: NOT list_contains({S.strings(text.DEIXIS)}, w)) AS kept FROM w2)"
DENY = rf"""w4 AS (SELECT *, every[1:12] AS anchors, trim(regexp_replace(array_to_string(kept, ' '), '\s+', ' ', 'g')) AS clean, len(list_filter(kept, lambda w: NOT list_contains({S.strings(text.STOP_SESSION)}, w))) >= 2 AS thick FROM w3),
w5 AS (SELECT *, CASE WHEN thick THEN clean ELSE trim(clean || ' ' || array_to_string(anchors[1:3], ' ')) END AS denied FROM w4),
w6 AS (SELECT *, list_filter([denied, array_to_string(anchors[1:8], ' '), CASE WHEN len(aw) >= 3 THEN array_to_string(aw[1:6], ' ') ELSE '' END], lambda k: trim(k) <> '' AND NOT list_contains(every, k)) AS k0 FROM w5),
keyed AS (SELECT *, {S.distinct('k0')} AS keys, '[turns ' || turn_lo || '-' || turn_hi || '] Q: ' || denied || ' A: ' || a AS content FROM w6)"""


@query(f"WITH {EX}, {WORDS}, {DENY} SELECT session, xid, unnest(range(0, len(keys)))::INT AS place, unnest(keys) AS key, md5(content) AS content FROM keyed")
def exchange_keys(spark, read):
    """Distilled keys, one row each."""
    d = sessions.distil(sessions.exchanges(turns_of(read)))
    return d.select("session", "xid", F.posexplode("keys").alias("place", "key"), F.md5("content").alias("content"))


FACT = rf"regexp_replace(content, '^\[turns[^\]]*\]\s*', '')"
SALIENT_EX = f"sal AS (SELECT *, {_salience('body')} AS salience FROM keyed)"


@query(
    f"""WITH {EX}, {WORDS}, {DENY}, {SALIENT_EX}, f AS (SELECT session, xid, {FACT} AS body, salience FROM sal WHERE salience >= 0.4),
k AS (SELECT *, lower(array_to_string(list_filter({S.tokens('body')}, lambda w: NOT list_contains({S.strings(text.STOP_FACT)}, lower(w)))[1:5], ' ')) AS first FROM f)
SELECT session, xid, 'fact:' || CASE WHEN first = '' THEN 'exchange-' || xid ELSE first END || ' ' || xid AS key, md5(body) AS content, salience FROM k"""
)
def graduate(spark, read):
    """Salient exchanges become facts."""
    found = sessions.distil(sessions.exchanges(turns_of(read))).select("session", "xid", "content", "salience")
    none = spark.createDataFrame([], "session string, xid bigint")
    return rack.graduate(found, none).select("session", "xid", "key", F.md5("content").alias("content"), "salience")


@query(f"WITH {EX}, {WORDS}, {DENY}, {SALIENT_EX} SELECT count(*) FILTER (WHERE salience < 0.4) AS reviewed, 0::BIGINT AS promoted, count(*) FILTER (WHERE salience < 0.4) AS skipped FROM sal")
def graduate_rerun(spark, read):
    """After a run, only what was skipped is reviewed, and nothing more promoted."""
    found = sessions.distil(sessions.exchanges(turns_of(read))).select("session", "xid", "content", "salience")
    done = rack.graduate(found, spark.createDataFrame([], "session string, xid bigint")).select("session", "xid")
    return rack.graduation_report(found, done)


@query(f"WITH {EX}, {WORDS}, {DENY}, {SALIENT_EX} SELECT session, xid, md5(content) AS content, salience FROM sal WHERE len(keys) > 0")
def gather_exchanges(spark, read):
    """Entries of all keys back to one row an exchange."""
    entries = sessions.turn_entries(sessions.distil(sessions.exchanges(turns_of(read))))
    return sessions.gather(entries).select("session", "xid", F.md5("content").alias("content"), "salience")


@query()
def recall(spark, read):
    """The best exchanges for questions (tested against a loop)."""
    distilled = at_rest(sessions.distil(sessions.exchanges(turns_of(read))), "distilled")
    entries = at_rest(memory.build_entries(sessions.turn_entries(distilled), reject_credentials=False, score_trust=False), "turns")
    q = spark.createDataFrame([(1, "the error of the last thing"), (2, "ouble edoution"), (3, "of the and")], "query_id bigint, query string")
    return sessions.recall(q, entries)


DMS = "r AS (SELECT user_id AS xid, least(1.0, avg(value::DECIMAL(18, 4))::DOUBLE / 100) AS salience, min(ts) AS created_at, count(*) AS access_count FROM events GROUP BY user_id)"


def decay_records(read) -> DataFrame:
    """Users as records: what they spent is the salience, their events the accesses, half of the kinds durable."""
    g = read("events").groupBy(F.col("user_id").alias("xid")).agg(F.avg(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"), F.min("ts").alias("created_at"), F.count("*").alias("access_count"))
    return g.select("xid", F.least(F.lit(1.0), F.col("v") / 100).alias("salience"), "created_at", "access_count", F.when(F.col("access_count") > 60, "durable").otherwise("session").alias("tier"))


@query(
    f"""WITH {DMS}, s AS (SELECT *, CASE WHEN access_count > 60 THEN 'durable' ELSE 'session' END AS tier, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 60000000.0 AS age_minutes FROM r)
SELECT xid, tier, round(age_minutes, 4) AS age_minutes, round(salience * exp(-0.1 * greatest(age_minutes / 60, 0)) + 0.15 * access_count, 6) AS score FROM s"""
)
def decay_scores(spark, read):
    """Utility of every record."""
    s = sessions.scored(decay_records(read), F.lit("2024-02-01").cast("timestamp"))
    return s.select("xid", "tier", F.round("age_minutes", 4).alias("age_minutes"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {DMS}, s AS (SELECT xid, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 60000000.0 / 60 AS h, salience, access_count FROM r WHERE access_count <= 60)
SELECT xid, access_count FROM s ORDER BY salience * exp(-0.1 * greatest(h, 0)) + 0.15 * access_count, xid LIMIT 20"""
)
def eviction_list(spark, read):
    """T4: the twenty least useful records that aren't durable."""
    return sessions.eviction_list(decay_records(read), F.lit("2024-02-01").cast("timestamp"), 20).select("xid", "access_count")


@query(f"WITH {DMS} SELECT CASE WHEN access_count > 60 THEN 'durable' ELSE 'session' END AS tier, count(*) AS records, sum(access_count)::BIGINT AS accesses, (SELECT count(*) > 100 FROM r) AS over_budget FROM r GROUP BY 1")
def decay_tiers(spark, read):
    """A8."""
    return sessions.tier_stats(decay_records(read), 100)


_LANG_KIND = "CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 0 END"


def doc_kinds(read) -> DataFrame:
    kind = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(0)
    return read("documents").select(F.col("doc_id").alias("entry_id"), F.coalesce("source", F.lit("none")).alias("cartridge"), kind.alias("kind"), F.lit(False).alias("deleted"), F.col("text").alias("content"), F.col("lang").alias("key_norm"))


@query(f"SELECT CASE k WHEN 1 THEN 'fact' WHEN 2 THEN 'skill' WHEN 3 THEN 'doc' ELSE 'generic' END AS kind, count(*) AS entries FROM (SELECT {_LANG_KIND} AS k FROM documents) GROUP BY 1")
def kind_stats(spark, read):
    """A2."""
    return memory.stats(doc_kinds(read))


@query("SELECT coalesce(source, 'none') AS cartridge, count(*) AS entries, round(100.0 * count(*) / 500, 1)::DOUBLE AS percent_full FROM documents GROUP BY 1")
def rack_percent_full(spark, read):
    """A3."""
    return rack.rack_stats(doc_kinds(read), 500)


@query(
    """WITH n AS (SELECT coalesce(source, 'none') AS cartridge, doc_id, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY coalesce(source, 'none')) AS total FROM documents)
SELECT cartridge, doc_id AS entry_id, (i // 40)::INT AS block, CASE WHEN i // 40 < total // 40 THEN cartridge || '__' || (i // 40 + 2) ELSE cartridge END AS shard FROM n"""
)
def shard_assign(spark, read):
    """Documents of a source in shards of 40."""
    return rack.assign_shards(doc_kinds(read), 40)


@query("SELECT doc_id AS entry_id, CASE lang WHEN 'en' THEN 'facts' WHEN 'fr' THEN 'tools' ELSE 'main' END AS cartridge FROM documents")
def route_kinds(spark, read):
    """Kinds to cartridges by name, by number, by default."""
    return rack.route(doc_kinds(read).drop("cartridge"), {"fact": "facts", "2": "tools"}, "main").select("entry_id", "cartridge")


@query(
    """WITH d AS (SELECT doc_id, source, text, lang FROM documents)
SELECT regexp_replace(source, '\\d+$', '') AS cartridge, count(*) AS entries FROM (SELECT DISTINCT regexp_replace(source, '\\d+$', '') || '' AS source, text, lang FROM d) GROUP BY 1"""
)
def compact_shards(spark, read):
    """All numbered sources as shards of one, without repeated contents."""
    rows = doc_kinds(read).withColumn("cartridge", F.regexp_replace("cartridge", r"(\d+)$", "__$1"))
    return rack.compact_shards(rows).groupBy("cartridge").agg(F.count("*").alias("entries"))


_PII = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, {S.quote(p)})) AS value FROM documents" for k, p in detectors.PII.items())


@query(f"WITH f AS ({_PII} UNION ALL SELECT doc_id, 'credit_card', value FROM (SELECT doc_id, unnest(regexp_extract_all(text, {S.quote(detectors.CARD)})) AS value FROM documents) WHERE {S.luhn('value')}) SELECT doc_id, type, value, count(*) AS n FROM f GROUP BY ALL")
def pii_findings(spark, read):
    """Personal data in documents."""
    found = read("documents").select("doc_id", F.explode(detectors.pii_findings(F.col("text"))).alias("f"))
    return found.groupBy("doc_id", "f.type", "f.value").agg(F.count("*").alias("n"))


def _risks(read) -> DataFrame:
    rows = read("documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), "text")
    rows = rows.union(read("conversations").select(F.lit("conversations"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"))
    return rows.union(read("pages").select(F.lit("pages"), F.col("page_id").cast("string"), "html"))


@query(
    f"""WITH t AS (SELECT 'documents' AS origin, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'pages', page_id::VARCHAR, html FROM pages),
r AS (SELECT origin, id, {S.injection('text')} AS found FROM t)
SELECT origin, id, (['SAFE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[coalesce(list_max(list_transform(found, lambda x: x.l)), 0) + 1] AS risk, coalesce(list_max(list_transform(found, lambda x: x.w)), 0.0)::DOUBLE AS score, len(found)::INT AS n FROM r"""
)
def injection_risk(spark, read):
    """Risk of documents, turns and pages."""
    return _risks(read).withColumn("r", detectors.injection_risk(F.col("text"))).select("origin", "id", "r.risk", "r.score", F.size("r.patterns").alias("n"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS family FROM documents WHERE regexp_matches(text, {S.quote(p)})" for k, p in detectors.CREDENTIALS.items()))
def credential_scan(spark, read):
    """Families of secrets in documents; the rules are this engine's own."""
    return read("documents").select("doc_id", F.explode(detectors.credentials(F.col("text"))).alias("family"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS content, o_orderstatus AS kind FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'urgent' ELSE o_orderpriority END AS content, CASE WHEN o_totalprice < 50000 THEN 'X' ELSE o_orderstatus END AS kind FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS k, o.content AS oc, n.content AS nc, o.kind AS ok, n.kind AS nk FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey),
s AS (SELECT k, unnest(list_filter([CASE WHEN oc IS NULL THEN 'added' END, CASE WHEN nc IS NULL THEN 'removed' END, CASE WHEN oc <> nc THEN 'updated' END, CASE WHEN ok <> nk THEN 'reclassified' END], lambda x: x IS NOT NULL)) AS status FROM j)
SELECT k::VARCHAR AS key, status FROM s"""
)
def diff_snapshots(spark, read):
    """Two snapshots of orders compared as entries."""
    o = read("orders")
    as_entries = lambda df, content, kind: df.select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderkey").cast("string").alias("key_norm"), content.alias("content"), kind.alias("kind"))
    old = as_entries(o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")), F.col("o_orderpriority"), F.col("o_orderstatus"))
    price = F.col("o_totalprice")
    new = as_entries(o.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")), F.when(price > 300000, "urgent").otherwise(F.col("o_orderpriority")), F.when(price < 50000, "X").otherwise(F.col("o_orderstatus")))
    return diff.diff_entries(old, new)


@query(
    """WITH a AS (SELECT s_name AS source, md5(s_nationkey::VARCHAR) AS d FROM supplier WHERE s_acctbal < 8000), b AS (SELECT s_name AS source, md5(CASE WHEN s_acctbal > 5000 THEN 'x' ELSE s_nationkey::VARCHAR END) AS d FROM supplier WHERE s_acctbal > 1000)
SELECT source, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (source) WHERE a.d IS DISTINCT FROM b.d"""
)
def unit_diff(spark, read):
    """Tables of digests compared."""
    s = read("supplier")
    key = F.col("s_nationkey").cast("string")
    old = s.filter("s_acctbal < 8000").select(F.col("s_name").alias("source"), F.md5(key).alias("digest"))
    new = s.filter("s_acctbal > 1000").select(F.col("s_name").alias("source"), F.md5(F.when(F.col("s_acctbal") > 5000, "x").otherwise(key)).alias("digest"))
    return diff.diff_digests(old, new)


@query(
    """WITH l AS (SELECT c_name AS k, sha256(c_mktsegment) AS sha FROM customer), s AS (SELECT c_name AS k, sha256(CASE WHEN c_acctbal > 5000 THEN 'old' ELSE c_mktsegment END) AS sha, 'e' || c_nationkey AS etag FROM customer WHERE c_acctbal > 0),
r AS (SELECT c_name AS k, 'e' || CASE WHEN c_acctbal > 7500 OR c_acctbal < 2000 THEN 99 ELSE c_nationkey END AS etag FROM customer WHERE c_acctbal > 500)
SELECT k AS remote_key, CASE WHEN s.sha IS NULL OR r.etag IS NULL THEN 'local_ahead' WHEN l.sha = s.sha AND r.etag = s.etag THEN 'in_sync' WHEN l.sha = s.sha THEN 'remote_ahead' WHEN r.etag = s.etag THEN 'local_ahead' ELSE 'conflict' END AS status
FROM l LEFT JOIN s USING (k) LEFT JOIN r USING (k)"""
)
def sync_status(spark, read):
    """Local, synced and remote state."""
    c = read("customer")
    local = c.select(F.col("c_name").alias("remote_key"), F.sha2("c_mktsegment", 256).alias("sha256"))
    etag = lambda n: F.concat(F.lit("e"), n.cast("string"))
    synced = c.filter("c_acctbal > 0").select(F.col("c_name").alias("remote_key"), F.sha2(F.when(F.col("c_acctbal") > 5000, "old").otherwise(F.col("c_mktsegment")), 256).alias("sha256"), etag(F.col("c_nationkey")).alias("etag"))
    remote = c.filter("c_acctbal > 500").select(F.col("c_name").alias("remote_key"), etag(F.when((F.col("c_acctbal") > 7500) | (F.col("c_acctbal") < 2000), 99).otherwise(F.col("c_nationkey"))).alias("etag"))
    return diff.sync_status(local, synced, remote)


@query(
    """SELECT page_id, top IN ('facts', 'skills', 'docs', 'agents', 'vaults') AND NOT (ends_with(path, '.tmp') OR ends_with(path, '.lock')) AS syncable, CASE WHEN kind IS NULL THEN 'never' WHEN policy = 'local_only' THEN 'never' WHEN policy IN ('write_through', 'never') THEN policy WHEN kind IN ('agent', 'secret', 'vault') THEN 'never' ELSE 'write_through' END AS policy
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'facts' WHEN 1 THEN 'secrets' WHEN 2 THEN 'agents' ELSE 'other' END AS top, CASE WHEN page_id % 3 = 0 THEN 'x.tmp' ELSE 'x.json' END AS path,
 CASE page_id % 5 WHEN 0 THEN 'agent' WHEN 1 THEN 'vault' WHEN 2 THEN NULL ELSE 'memory' END AS kind, CASE page_id % 7 WHEN 0 THEN 'local_only' WHEN 1 THEN 'write_through' WHEN 2 THEN 'never' END AS policy FROM pages)"""
)
def sync_rules(spark, read):
    """allowlist and policy of made-up paths and headers for every page."""
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (F.col("page_id") % n + 1).cast("int"))
    rows = read("pages").select("page_id", F.concat_ws("/", pick(4, "facts", "secrets", "agents", "other"), F.when(F.col("page_id") % 3 == 0, "x.tmp").otherwise("x.json")).alias("path"), pick(5, "agent", "vault", None, "memory", "memory").alias("kind"), pick(7, "local_only", "write_through", "never", None, None, None, None).alias("policy"))
    return rows.select("page_id", diff.syncable(F.col("path")).alias("syncable"), diff.sync_policy(F.col("kind"), F.col("policy"), F.col("kind").isNotNull()).alias("policy"))


_RECORD = """'{"event_id": "' || event_id || '", "event_type": "' || event_type || '"}'"""


@query(
    f"""WITH c AS (SELECT user_id AS log, event_id AS seq, event_type, value, coalesce(lag(sha256({_RECORD})) OVER (PARTITION BY user_id ORDER BY event_id), '') AS prev FROM events),
t AS (SELECT log, seq, seq AS event_id, prev, CASE WHEN value > 90 THEN 'forged' ELSE event_type END AS event_type FROM c)
SELECT log, seq, prev = coalesce(lag(sha256({_RECORD})) OVER (PARTITION BY log ORDER BY seq), '') AS ok FROM t"""
)
def audit_chain_verify(spark, read):
    """Hash chains of each user's events, some of them forged afterwards."""
    rows = read("events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"), "event_type", "value")
    chained = diff.chain(rows, ["event_id", "event_type"])
    forged = chained.withColumn("event_type", F.when(F.col("value") > 90, "forged").otherwise(F.col("event_type")))
    return diff.verify_chain(forged, ["event_id", "event_type"])


@query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def event_backlog(spark, read):
    """The last fifty events of the ring."""
    return diff.backlog(read("events").select(F.col("event_id").alias("seq"), "event_type"), 50)


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(value) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(value) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM r GROUP BY event_type"""
)
def latency_quantiles(spark, read):
    """Values at ranks, a kind of event."""
    return diff.quantiles(read("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("total")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def checkpoint_trail(spark, read):
    """The last ten orders of each customer."""
    return agents.trail(read("orders"), "o_custkey", "o_orderdate", tie="o_orderkey").select("o_custkey", "o_orderkey")


CALLS = """s AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region)"""


def call_graph(read) -> tuple[DataFrame, DataFrame]:
    """Customers call nations, nations regions, and each region one nation, so there are cycles."""
    c, n, r = read("customer"), read("nation"), read("region")
    tag = lambda t, x: F.concat(F.lit(t), F.col(x).cast("string"))
    node = lambda df, t, k, name, kind: df.select(tag(t, k).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), F.concat(F.lit(kind + "/"), tag(t, k)).alias("file_path"), F.lit("table").alias("language"), F.lit("").alias("docstring"))
    symbols = node(c, "c", "c_custkey", "c_name", "customer").union(node(n, "n", "n_nationkey", "n_name", "nation")).union(node(r, "r", "r_regionkey", "r_name", "region"))
    edge = lambda df, a, x, b, y: df.select(tag(a, x).alias("source"), tag(b, y).alias("target"), F.lit("calls").alias("kind"))
    edges = edge(c, "c", "c_custkey", "n", "c_nationkey").union(edge(n, "n", "n_nationkey", "r", "n_regionkey")).union(edge(r, "r", "r_regionkey", "n", "r_regionkey"))
    return symbols, edges


@query(
    f"""WITH RECURSIVE {CALLS}, w(start, id, depth) AS (SELECT id, id, 0 FROM s WHERE id LIKE 'r%' UNION SELECT w.start, e.source, w.depth + 1 FROM w JOIN e ON e.target = w.id WHERE w.depth < 3),
m AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY ALL)
SELECT start, id, depth::INT AS depth FROM m WHERE depth > 0 UNION ALL SELECT DISTINCT e.source, e.target, -1 FROM e WHERE e.source LIKE 'r%' AND NOT EXISTS (FROM m WHERE m.start = e.source AND m.id = e.target)"""
)
def blast_radius(spark, read):
    """What reaches each region within three calls."""
    symbols, edges = call_graph(read)
    return graph.blast_radius(edges, symbols.filter("kind = 'region'").select("id"))


@query(f"WITH {CALLS} SELECT t.name, e.source AS caller FROM s t JOIN e ON e.target = t.id WHERE t.id LIKE 'n%'")
def callers(spark, read):
    """J11."""
    symbols, edges = call_graph(read)
    return graph.callers(symbols, edges, read("nation").select(F.col("n_name").alias("name")))


@query(f"WITH {CALLS} SELECT t.name, e.target AS callee FROM s t JOIN e ON e.source = t.id WHERE t.id LIKE 'n%' OR t.id LIKE 'r%'")
def callees(spark, read):
    """J11."""
    symbols, edges = call_graph(read)
    return graph.callees(symbols, edges, read("nation").select(F.col("n_name").alias("name")).union(read("region").select("r_name")))


@query(f"WITH {CALLS}, c AS (SELECT id, name, CASE WHEN lower(name) = 'nation_1' THEN 1.0 WHEN contains(lower(name), 'nation_1') THEN 0.8 WHEN contains(CASE left(id, 1) WHEN 'c' THEN 'customer/' WHEN 'n' THEN 'nation/' ELSE 'region/' END || id, 'nation_1') THEN 0.3 END AS score FROM s) SELECT id, name, score::DOUBLE AS score FROM c WHERE score IS NOT NULL ORDER BY score DESC, name, id LIMIT 20")
def symbol_search(spark, read):
    """T7."""
    symbols, _ = call_graph(read)
    return graph.search_symbols(symbols, "NATION_1").select("id", "name", "score")


@query(f"WITH {CALLS} SELECT 'symbol_kind' AS facet, CASE left(id, 1) WHEN 'c' THEN 'customer' WHEN 'n' THEN 'nation' ELSE 'region' END AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'language', 'table', count(*) FROM s UNION ALL SELECT 'edge_kind', 'calls', count(*) FROM e")
def graph_stats(spark, read):
    """A7."""
    return graph.graph_stats(*call_graph(read))


_MODELS = ", ".join(f"('{m}', {a}, {b}, {c})" for m, a, b, c in scores.MODELS)


@query(
    f"""WITH m(model, layers, kv_heads, head_dim) AS (VALUES {_MODELS}), x AS (SELECT model, k::INT AS k, layers::BIGINT * kv_heads * 2 * head_dim * 2 AS per, k::BIGINT * 45 AS sparse FROM m, (VALUES (1), (3), (10)) b(k))
SELECT model, k, per AS kv_bytes_per_token, per * 1000000 AS stuffing_kv_bytes, sparse AS sparse_tokens, per * sparse AS sparse_kv_bytes, (per * 1000000)::DOUBLE / (per * sparse) AS reduction_x, (1.0::DOUBLE - (per * sparse)::DOUBLE / (per * 1000000)) * 100 AS savings_pct FROM x"""
)
def kv_estimate(spark, read):
    """V13."""
    return scores.kv_estimates(spark)


@query(
    r"""WITH r AS (SELECT page_id, 'vault:' || regexp_extract(url, '://([^/]+)', 1) || '/' || page_id AS ref FROM pages UNION ALL SELECT page_id, '${vault:' || page_id || '}' FROM pages UNION ALL SELECT page_id, url FROM pages)
SELECT page_id, ref, CASE WHEN ref LIKE 'vault:%' THEN regexp_extract(ref, '^vault:([^/]+)/', 1) WHEN ref LIKE '${vault:%' THEN 'default' END AS vault, CASE WHEN ref LIKE 'vault:%' OR ref LIKE '${vault:%' THEN page_id::VARCHAR END AS name FROM r"""
)
def vault_ref_parse(spark, read):
    """X20, J14."""
    p = read("pages")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    refs = p.select("page_id", F.concat(F.lit("vault:"), host, F.lit("/"), F.col("page_id").cast("string")).alias("ref"))
    refs = refs.union(p.select("page_id", F.concat(F.lit("${vault:"), F.col("page_id").cast("string"), F.lit("}")))).union(p.select("page_id", "url"))
    v, n = text.vault_ref(F.col("ref"))
    return refs.select("page_id", "ref", v.alias("vault"), n.alias("name"))


@query("SELECT s_suppkey, s_name AS value FROM supplier")
def vault_round_trip(spark, read):
    """Values sealed, keys rotated, and opened again."""
    rows = read("supplier").select("s_suppkey", F.lit("main").alias("vault"), F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("value"))
    one, two = vault.derive_key("first", b"0" * 16), vault.derive_key("second", b"1" * 16)
    return vault.unseal(vault.rotate(vault.seal(rows, one), one, two), two).select("s_suppkey", "value")


@query(
    """WITH b AS (SELECT event_type AS metric, median(value) AS base FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), c AS (SELECT event_type AS metric, median(value) AS median FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT metric, round(median, 6) AS median, round(base, 6) AS base, round((median - base) / base, 6) AS change, (median - base) / base <= 0.2 AS ok FROM b JOIN c USING (metric)"""
)
def perf_gate(spark, read):
    """Medians of later events against earlier ones."""
    e = read("events").select(F.col("event_type").alias("metric"), "value", "ts")
    cut = F.lit("2024-01-10").cast("timestamp")
    base = e.filter(F.col("ts") < cut).groupBy("metric").agg(F.median("value").alias("value"))
    g = diff.median_gate(e.filter(F.col("ts") >= cut), base)
    return g.select("metric", F.round("median", 6).alias("median"), F.round("base", 6).alias("base"), F.round("change", 6).alias("change"), "ok")


def part_cards(read) -> DataFrame:
    """Parts as skill cards: faulty in ways that validation finds."""
    p = read("part")
    keys = F.filter(F.array(F.when(F.col("p_size") > 5, F.concat(F.lit("when the problem involves "), "p_name")), F.when(F.col("p_size") > 30, F.col("p_name")), F.when(F.col("p_size") > 45, F.concat(F.lit("choose a fitting "), "p_name"))), lambda k: k.isNotNull())
    content = F.when(F.col("p_size") == 50, " ").when(F.col("p_size") > 25, F.concat("p_type", F.lit(" compute 3 + 4 first"))).otherwise(F.concat(F.lit("one two three four five six seven eight nine ten "), "p_type"))
    return p.select(F.col("p_partkey").alias("card_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), content.alias("content"), keys.alias("keys"), F.lit("coding").alias("domain"), F.lit("easy").alias("difficulty"), F.lit("").alias("pattern"), F.lit("").alias("source"))


@query(
    """WITH c AS (SELECT p_partkey AS card_id, p_name || ' ' || p_brand AS name, p_size AS z, p_type, row_number() OVER (PARTITION BY p_name || ' ' || p_brand ORDER BY p_partkey) > 1 AS copy FROM part),
f AS (SELECT card_id, name, unnest(list_filter([CASE WHEN copy THEN {'s': 'error', 'i': 'duplicate name'} END, CASE WHEN z = 50 THEN {'s': 'error', 'i': 'empty content'} END, CASE WHEN z <> 50 AND z <= 5 THEN {'s': 'error', 'i': 'no trigger keys'} END,
 CASE WHEN z > 5 AND z <= 30 THEN {'s': 'warning', 'i': 'too few trigger keys'} END, CASE WHEN z > 5 AND z <= 30 THEN {'s': 'warning', 'i': 'all triggers abstract'} END, CASE WHEN z > 25 AND z <> 50 THEN {'s': 'warning', 'i': 'numeric answers'} END,
 CASE WHEN z > 25 AND z <> 50 THEN {'s': 'warning', 'i': 'short content'} END, CASE WHEN z > 30 AND z <> 50 THEN {'s': 'info', 'i': 'short triggers'} END], lambda x: x IS NOT NULL)) AS x FROM c)
SELECT card_id, name, x.s AS severity, x.i AS issue FROM f"""
)
def skill_validation(spark, read):
    """X19."""
    return skills.validate(part_cards(read))


@query(
    """WITH c AS (SELECT p_partkey, p_name, p_brand, p_size AS z, p_type FROM part),
k AS (SELECT p_name || ' ' || p_brand AS name, unnest(list_filter([CASE WHEN z > 5 THEN 'when the problem involves ' || p_name END, CASE WHEN z > 30 THEN p_name END, CASE WHEN z > 45 THEN 'choose a fitting ' || p_name END], lambda x: x IS NOT NULL)) AS key,
 CASE WHEN z = 50 THEN ' ' WHEN z > 25 THEN p_type || ' compute 3 + 4 first' ELSE 'one two three four five six seven eight nine ten ' || p_type END AS content FROM c)
SELECT 'skill:' || name AS source, key, 'SKILL ' || name || ': ' || content AS content, count(*) AS n FROM k GROUP BY ALL"""
)
def skill_entries(spark, read):
    """One entry a trigger."""
    return skills.entries(part_cards(read)).groupBy("source", "key", "content").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey::VARCHAR AS agent, (o_orderkey % 6)::INT AS s, (['identity', 'instruction', 'preference', 'goal', 'decision', 'note'])[o_orderkey % 6 + 1] AS section, o_orderpriority || ' ' || o_totalprice::VARCHAR AS content,
 left(o_orderpriority, 1)::INT AS priority, o_orderstatus = 'F' AS done, o_orderdate AS updated, o_orderkey AS seq FROM orders),
p AS (SELECT * FROM o QUALIFY s > 2 OR row_number() OVER (PARTITION BY agent, s ORDER BY seq DESC) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY agent, s ORDER BY updated DESC, seq) AS r FROM p WHERE s <> 3 OR NOT done QUALIFY s <> 4 OR r <= 5),
l AS (SELECT agent, s, '[' || section || '] ' || content AS line, row_number() OVER (PARTITION BY agent ORDER BY s, CASE WHEN s = 3 THEN -priority ELSE 0 END, CASE WHEN s IN (3, 4) THEN r ELSE seq END, '[' || section || '] ' || content) AS n FROM r),
g(agent, n, used, shut, packet) AS (SELECT DISTINCT agent, 0::BIGINT, 0::BIGINT, -1, '## Agent: ' || agent FROM l
 UNION ALL SELECT g.agent, l.n, CASE WHEN shut <> s AND used + length(line) + 2 <= 400 THEN used + length(line) + 2 ELSE used END, CASE WHEN shut <> s AND used + length(line) + 2 > 400 THEN s ELSE shut END,
 CASE WHEN shut <> s AND used + length(line) + 2 <= 400 THEN packet || chr(10) || line ELSE packet END FROM g JOIN l ON l.agent = g.agent AND l.n = g.n + 1)
SELECT agent, packet FROM g QUALIFY row_number() OVER (PARTITION BY agent ORDER BY n DESC) = 1"""
)
def agent_bootstrap(spark, read):
    """Packets with a budget."""
    o = read("orders")
    section = F.element_at(F.array(*[F.lit(s) for s in ["identity", "instruction", "preference", "goal", "decision", "note"]]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = o.select(F.col("o_custkey").cast("string").alias("agent"), section.alias("section"), F.lit(None).cast("string").alias("key"), F.concat_ws(" ", "o_orderpriority", F.col("o_totalprice").cast("string")).alias("content"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.array().cast("array<string>").alias("tags"), F.col("o_orderdate").alias("updated"), F.col("o_orderkey").alias("seq"))
    return agents.bootstrap(agents.put(spark.createDataFrame([], agents.STATE), rows), 400)


@query("SELECT doc_id AS entry_id, md5('{\"content\":' || to_json(text) || ',\"kind\":\"' || CASE lang WHEN 'en' THEN 'fact' WHEN 'fr' THEN 'skill' WHEN 'de' THEN 'doc' ELSE 'generic' END || '\"' || CASE WHEN source IS NULL THEN '' ELSE ',\"source\":\"' || source || '\"' END || CASE WHEN lang IS NULL THEN '' ELSE ',\"key_norm\":\"' || lang || '\"' END || '}') AS digest FROM documents")
def export_json(spark, read):
    """Live entries as JSON lines."""
    rows = doc_kinds(read).join(read("documents").select(F.col("doc_id").alias("entry_id"), "source"), "entry_id")
    return exports.json_lines(rows).select("entry_id", F.md5("value").alias("digest"))


@query("SELECT event_id, props AS line, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def parse_payloads(spark, read):
    """JSON payloads as variants."""
    v = F.try_parse_json(F.col("props"))
    return read("events").select("event_id", F.col("props").alias("line"), F.try_variant_get(v, "$.k", "string").alias("k"))


@query("SELECT min(doc_id) AS entry_id, count(*) AS n FROM documents WHERE lang IS DISTINCT FROM 'de' GROUP BY text, lang")
def delete_and_compact(spark, read):
    """German documents deleted, the first of each content and key kept, with how many there were."""
    rows = doc_kinds(read)
    left = memory.delete(rows, rows.filter("key_norm = 'de'").select("entry_id"))
    counts = memory.live(left).groupBy("content", "key_norm").agg(F.count("*").alias("n"))
    kept = memory.compact(left, dedupe=True)
    same = (kept["content"] == counts["content"]) & kept["key_norm"].eqNullSafe(counts["key_norm"])
    return kept.join(counts, same).select("entry_id", "n")


@query("SELECT entry_id FROM (SELECT conv_id * 1000 + turn AS entry_id, role FROM conversations) QUALIFY role <> 'user' OR row_number() OVER (PARTITION BY role = 'user' ORDER BY entry_id) > 40")
def session_forget(spark, read):
    """The forty oldest turn entries forgotten; what is left."""
    rows = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.when(F.col("role") == "user", 4).otherwise(1).alias("kind"), F.lit(False).alias("deleted"))
    return memory.live(sessions.forget(rows, 40)).select("entry_id")


@query(f"WITH {EX} SELECT xid, session FROM ex QUALIFY row_number() OVER (PARTITION BY xid ORDER BY turn_lo, session) = 1 ORDER BY xid DESC LIMIT 10")
def recent_exchanges(spark, read):
    """The last exchanges by number, each number once."""
    found = sessions.exchanges(turns_of(read))
    first = found.groupBy("xid").agg(F.min_by(F.struct("session", "turn_lo"), F.struct("turn_lo", "session")).alias("f")).select("xid", "f.session", "f.turn_lo")
    return sessions.recent(first).select("xid", "session")


_EXT = "CASE WHEN p_size < 20 THEN '.py' WHEN p_size < 30 THEN '.ts' WHEN p_size < 38 THEN '.tsx' WHEN p_size < 44 THEN '.rs' ELSE '.txt' END"


@query(f"WITH f AS (SELECT 'src/' || p_partkey || {_EXT} AS path, {_EXT} AS e FROM part), l AS (SELECT path, CASE e WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.rs' THEN 'rust' END AS language FROM f) SELECT language, count(*) AS files FROM l WHERE language IS NOT NULL GROUP BY 1 ORDER BY files DESC, min(path) LIMIT 3")
def language_census(spark, read):
    """The three most frequent languages of made-up paths for every part."""
    z = F.col("p_size")
    ext = F.when(z < 20, ".py").when(z < 30, ".ts").when(z < 38, ".tsx").when(z < 44, ".rs").otherwise(".txt")
    return units.census(read("part").select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), ext).alias("path")))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size > 10) AS correct, count(*) AS total FROM part GROUP BY 1")
def routing_accuracy(spark, read):
    """How many problems of each brand were routed as expected."""
    rows = read("part").select("p_brand", F.col("p_type").alias("expected"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("none").alias("routed"))
    return skills.accuracy(rows, "p_brand")


@query("SELECT o_custkey AS project, max(o_orderdate) AS last_activity, max(o_orderdate) < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY AS stale FROM orders GROUP BY 1")
def stale_projects(spark, read):
    """Customers by their last order."""
    rows = read("orders").groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderdate").alias("last_activity"))
    return agents.stale(rows, F.lit("2001-01-01").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber * (l_quantity::INT + 1))::DOUBLE AS value FROM lineitem")
def evaluate_answers(spark, read):
    """Arithmetic on the last line of made-up answers for every line item."""
    said = F.concat(F.lit("so it is\nANSWER="), F.col("l_linenumber").cast("string"), F.lit(" x ("), F.col("l_quantity").cast("int").cast("string"), F.lit(" + 1)"))
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scores.evaluated(said).alias("value"))


@query("SELECT u.user_id AS xid, count(*) + coalesce(max(m.n), 0) AS access_count FROM events u LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) m ON m.user_id = u.user_id GROUP BY 1")
def recall_feedback(spark, read):
    """ST5, W10: recalls (here errors) counted into the accesses of records."""
    return sessions.touch(decay_records(read), read("events").filter("event_type = 'error'").select(F.col("user_id").alias("xid"))).select("xid", "access_count")


@query("SELECT page_id, page_id * 1000 <= 65536 AND url LIKE 'https://%' AND regexp_extract(url, '^https://([^/?#:]+)', 1) <> '' AS ok FROM pages")
def secret_policies(spark, read):
    """Policies of made-up secrets that may go to each page's host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    return read("pages").select("page_id", detectors.valid_policy(F.col("page_id") * 1000, F.lit("bearer"), host, F.col("url")).alias("ok"))


@query("SELECT c_custkey, contains(n, '@') OR regexp_matches(n, '\\+?\\d[\\d\\s\\-]{8,}\\d') AS sensitive FROM (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_name || '@x' WHEN c_acctbal > 0 THEN 'c' || c_custkey ELSE '+49 170 1234567' END AS n FROM customer)")
def sensitive_names(spark, read):
    """F9."""
    name = F.when(F.col("c_acctbal") > 5000, F.concat("c_name", F.lit("@x"))).when(F.col("c_acctbal") > 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).otherwise("+49 170 1234567")
    return read("customer").select("c_custkey", detectors.sensitive_name(name).alias("sensitive"))


@query("SELECT o_custkey::VARCHAR AS agent, CASE o_orderkey % 3 WHEN 0 THEN 'identity' WHEN 1 THEN 'goal' ELSE 'note' END AS section, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE count(*) END AS entries FROM orders GROUP BY 1, 2, o_orderkey % 3")
def agent_sections(spark, read):
    """Entries of each agent's sections; singletons are replaced."""
    section = F.element_at(F.array(F.lit("identity"), F.lit("goal"), F.lit("note")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = read("orders").select(F.col("o_custkey").cast("string").alias("agent"), section.alias("section"), F.lit(None).cast("string").alias("key"), F.col("o_orderstatus").alias("content"), F.lit(1).alias("priority"), F.lit("open").alias("status"), F.array().cast("array<string>").alias("tags"), F.col("o_orderdate").cast("timestamp").alias("updated"), F.col("o_orderkey").alias("seq"))
    return agents.section_stats(agents.put(spark.createDataFrame([], agents.STATE), rows))
