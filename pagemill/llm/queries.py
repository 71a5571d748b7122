"""The opN_<name> queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_wrappers, mixing, quality, suffix_dedup, superminhash, token_counts, topk_search, warc
from .common import stored, table

QUERY_EVERY = 50
TOP = 5
TRICKY = "\\### Assistant: </turn> ok"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(stored(token_counts.encoded_lengths(table(spark, sf_dir, "documents")), "lengths"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk_search.quantized(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(v.where(F.col("vec_id") % QUERY_EVERY == 0), v, TOP)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remaining_texts(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_wrappers.main_text(pages, stored(html_wrappers.infer(pages), "wrappers"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row is a message of its own, whatever rows share its turn: it is opened and its text arrives as a delta
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().cast("string").alias("msg_id"))
    none, turn = F.lit(None).cast("string"), F.col("turn").cast("long") * 2
    event = lambda seq, kind, role, text: F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), F.col("msg_id"), role.alias("role"), text.alias("text"))
    log = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.inline(F.array(event(turn, "start", F.col("role"), none), event(turn + 1, "delta", none, F.col("text")))))
    # the added conversation arrives as a streamed log, with an edit and a regeneration
    extra = [
        (-7, 0, "start", "u", "user", "draft"), (-7, 1, "edit", "u", None, TRICKY),
        (-7, 2, "start", "a", "assistant", "wrong"), (-7, 3, "regenerate", "a", None, None), (-7, 4, "delta", "a", None, TRICKY[:9]), (-7, 5, "delta", "a", None, TRICKY[9:]),
    ]
    log = log.union(spark.createDataFrame(extra, chat.EVENTS))
    return chat.digests(stored(chat.formatted(chat.messages(log)), "formatted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_topk_search, op3_warc, op4_suffix_dedup, op5_mixing, op6_html_wrappers, op7_quality, op8_chat_formatting, op9_decontamination, op10_near_dedup, pipeline)
}

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS "rank", vec_id, score FROM r WHERE n <= 5
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d
"""

_ESCAPED = r"regexp_replace({}, '([\\<>#])', '\\\1', 'g')"
_OP8 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + 2 * length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS9 = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS9} AS w FROM documents),
i AS (SELECT item_id, {_WORDS9} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS lo FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.lo, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.lo, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

ORACLE_SQL = {"op2_topk_search": _OP2, "op3_warc": _OP3, "op8_chat_formatting": _OP8, "op9_decontamination": _OP9, "op10_near_dedup": _OP10}
