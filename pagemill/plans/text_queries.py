"""Queries on pages, chunks, translation, refinement and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text as X
from ..operators import chunking as C
from ..operators import refine as R
from .registry import PARAGRAPHS, ROT13, SENTENCES, WS, chunk_paragraph, chunk_table, escape, fold, hard_split, query, strip, table, values

LATIN = (0x00C0, 0x024F)
_LINES = "SELECT doc_id, (k - 1)::BIGINT AS page_num, l[k] AS text, doc_id % 2 = 0 AS has_image FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_CHUNKS = chunk_table()


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents as pages."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_num", "text"))
    return t.select("doc_id", F.col("page_num").cast("long").alias("page_num"), "text", (F.col("doc_id") % 2 == 0).alias("has_image"))


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.chunked(table(spark, d, "documents")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query(f"SELECT doc_id, page_num, text FROM ({_LINES})")
def page_scan(spark, d):
    return pages(spark, d).select("doc_id", "page_num", "text")


@query(f"SELECT doc_id, page_num, text FROM ({_LINES}) WHERE page_num >= 3")
def page_scan_resume(spark, d):
    return pages(spark, d).where("page_num >= 3").select("doc_id", "page_num", "text")


@query(f"SELECT doc_id, page_num, length({strip('text')}) < 25 AND (has_image OR length({strip('text')}) = 0) AS needs_ocr FROM ({_LINES})")
def needs_ocr_flag(spark, d):
    return pages(spark, d).select("doc_id", "page_num", X.needs_ocr(F.col("text"), F.col("has_image")).alias("needs_ocr"))


@query(f"SELECT doc_id, page_num, text FROM ({_LINES}) WHERE {strip('text')} <> ''")
def blank_filter(spark, d):
    return pages(spark, d).where(~X.is_blank(F.col("text"))).select("doc_id", "page_num", "text")


_CONV = "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, (k - 1)::BIGINT AS idx, p[k] AS paragraph FROM (SELECT conv_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT conv_id, {PARAGRAPHS.format('text')} AS p FROM ({_CONV})))")
def split_paragraphs(spark, d):
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(C.in_order("text", "turn"), "\n\n").alias("text"))
    return whole.select("conv_id", F.posexplode(C.paragraphs(F.col("text"))).alias("idx", "paragraph")).withColumn("idx", F.col("idx").cast("long"))


_BLOCK = fold(f"list_filter(list(text ORDER BY turn), lambda c: {strip('c')} <> '')", "CASE WHEN a.c = '' THEN x.c ELSE a.c || chr(10) || x.c END", 1200)


@query(f"SELECT conv_id, (k - 1)::BIGINT AS block_idx, b[k] AS block FROM (SELECT conv_id, b, unnest(range(1, len(b) + 1)) AS k FROM (SELECT conv_id, {_BLOCK} AS b FROM conversations GROUP BY conv_id))")
def group_blocks(spark, d):
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(C.in_order("text", "turn").alias("parts"))
    return parts.select("conv_id", F.posexplode(C.blocks(F.col("parts"), 1200)).alias("block_idx", "block")).withColumn("block_idx", F.col("block_idx").cast("long"))


def _listed(expression: str, name: str, source: str = "documents", where: str = "TRUE") -> str:
    return f"SELECT doc_id, (k - 1)::BIGINT AS idx, p[k] AS {name} FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT doc_id, {expression} AS p FROM {source} WHERE {where}))"


def _exploded(df, column, name):
    return df.select("doc_id", F.posexplode(column).alias("idx", name)).withColumn("idx", F.col("idx").cast("long"))


@query(_listed(SENTENCES.format("text"), "sentence"))
def split_sentences(spark, d):
    return _exploded(table(spark, d, "documents"), C.sentences(F.col("text")), "sentence")


@query(_listed(chunk_paragraph("text", 400), "piece"))
def chunk_pack(spark, d):
    return _exploded(table(spark, d, "documents"), C.chunk_paragraph(F.col("text")), "piece")


@query(_listed(hard_split("text", 120), "piece"))
def chunk_hard_split(spark, d):
    return _exploded(table(spark, d, "documents"), C.hard_split(F.col("text"), 120), "piece")


@query(f"SELECT doc_id, chunk_idx, chunk, length(chunk)::BIGINT AS n_chars FROM ({_CHUNKS})")
def chunk_documents(spark, d):
    return chunk_rows(spark, d).withColumn("n_chars", F.length("chunk").cast("long"))


_PAGE = f"list_transform([list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {strip('x')} <> '')], lambda l: CASE WHEN len(l) > 0 THEN l ELSE ['[No extractable text on this page]'] END)[1]"


@query(_listed(_PAGE, "paragraph"))
def doc_paragraphs(spark, d):
    return _exploded(table(spark, d, "documents"), C.page_paragraphs(F.col("text")), "paragraph")


@query(f"SELECT doc_id, idx, {escape('paragraph')} AS paragraph FROM ({_listed(_PAGE, 'paragraph')})")
def pdf_paragraphs(spark, d):
    return doc_paragraphs(spark, d).withColumn("paragraph", X.xml_escape(F.col("paragraph")))


_CONV_LINES = f"SELECT conv_id, turn, (k - 1)::BIGINT AS line, l[k] AS text FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT conv_id, turn, {_PAGE} AS l FROM conversations))"
_BUILT = f"""
SELECT conv_id, -1::BIGINT AS page_num, 0::BIGINT AS seq, 'title' AS kind, 'conversation ' || conv_id AS text FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, turn, 0, 'break', '' FROM conversations c WHERE turn > (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id)
UNION ALL SELECT conv_id, turn, 1, 'label', 'Page ' || (turn + 1) FROM conversations
UNION ALL SELECT conv_id, turn, line + 2, 'paragraph', text FROM ({_CONV_LINES})"""


def _built(spark, d):
    p = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page_num"), "text")
    return C.document_rows(p, "conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))


@query(_BUILT)
def docx_rows(spark, d):
    """All that a document holds: title, page breaks between pages, page labels, paragraphs or a placeholder."""
    return _built(spark, d)


@query(f"SELECT conv_id, page_num, seq, kind, {escape('text')} AS text FROM ({_BUILT})")
def pdf_rows(spark, d):
    return _built(spark, d).withColumn("text", X.xml_escape(F.col("text")))


@query(f"SELECT doc_id, {escape('text')} AS escaped FROM documents")
def xml_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.xml_escape(F.col("text")).alias("escaped"))


_REQUESTS = rf"""
WITH RECURSIVE p AS (
  SELECT doc_id, 0 AS idx, ''::VARCHAR AS piece, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, idx + 1, CASE WHEN length(rest) <= 4800 THEN rest ELSE rest[1:cut] END,
    CASE WHEN length(rest) <= 4800 THEN '' ELSE regexp_replace(rest[cut + 1:], '^{WS}+', '') END
  FROM (SELECT *, CASE WHEN sp <= 0 THEN 4800 ELSE sp END AS cut FROM (
    SELECT *, CASE WHEN strpos(reverse(rest[1:4800]), ' ') = 0 THEN 0 ELSE length(rest[1:4800]) - strpos(reverse(rest[1:4800]), ' ') END AS sp FROM p))
  WHERE rest <> '')
SELECT doc_id, (idx - 1)::BIGINT AS idx, piece FROM p WHERE idx > 0
"""


@query(_REQUESTS)
def request_split(spark, d):
    return _exploded(table(spark, d, "documents").where("text <> ''"), C.request_parts(F.col("text")), "piece")


@query(f"SELECT doc_id, string_agg({ROT13.format('piece')}, ' ' ORDER BY idx) AS translation FROM ({_REQUESTS}) GROUP BY doc_id")
def request_translate(spark, d):
    """An oversize request goes out in pieces, whose answers are joined with a space."""
    t = table(spark, d, "documents").where("text <> ''")
    return t.select("doc_id", C.requested(F.col("text"), X.rot13).alias("translation"))


@query(f"SELECT doc_id, string_agg(chunk, chr(10) ORDER BY chunk_idx) AS page FROM ({_CHUNKS}) GROUP BY doc_id")
def reassemble_pages(spark, d):
    """A page's chunks are joined where they were made; pages that are stored in parts go through C.reassembled."""
    t = table(spark, d, "documents").where(~X.is_blank(F.col("text")))
    return t.select("doc_id", F.array_join(C.chunks(F.col("text")), "\n").alias("page"))


@query(f"SELECT doc_id, string_agg('--- Page ' || (page_num + 1) || ' ---' || chr(10) || text, chr(10) || chr(12) || chr(10) ORDER BY page_num) AS txt FROM ({_LINES}) GROUP BY doc_id")
def assemble_txt(spark, d):
    part = lambda line, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), line)
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), part), "\n\f\n").alias("txt"))


@query(f"SELECT doc_id, page_num, CASE WHEN {strip('text')} = '' OR doc_id % 3 = 0 THEN text ELSE {ROT13.format('text')} END AS translation FROM ({_LINES})")
def translate_passthrough(spark, d):
    p = pages(spark, d).withColumn("src", F.when(F.col("doc_id") % 3 == 0, "bn").otherwise("en")).withColumn("dst", F.lit("bn"))
    return R.translated(p, "text", "src", "dst").select("doc_id", "page_num", "translation")


@query(f"SELECT doc_id, chunk_idx, CASE WHEN doc_id % 7 = 0 THEN chunk ELSE {ROT13.format('chunk')} END AS translation, doc_id % 7 <> 0 AS ok FROM ({_CHUNKS})")
def translate_fallback(spark, d):
    failed = F.col("doc_id") % 7 == 0
    return chunk_rows(spark, d).select("doc_id", "chunk_idx", R.fallback(F.col("chunk"), X.rot13(F.col("chunk")), failed).alias("translation"), (~failed).alias("ok"))


@query(f"SELECT doc_id, page_num, CASE WHEN length({strip('text')}) < 25 AND (has_image OR length({strip('text')}) = 0) AND doc_id % 3 <> 0 AND page_num % 2 = 0 THEN 'ocr ' || page_num ELSE text END AS text FROM ({_LINES})")
def ocr_coalesce(spark, d):
    found = F.when(F.col("page_num") % 2 == 0, F.concat(F.lit("ocr "), F.col("page_num").cast("string"))).otherwise("")
    needed = X.needs_ocr(F.col("text"), F.col("has_image"))
    return pages(spark, d).select("doc_id", "page_num", X.ocr_coalesce(F.col("text"), found, needed, F.col("doc_id") % 3 != 0).alias("text"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def ocr_line_join(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.join_lines(F.split("text", "\n")).alias("text"))


def _density(x: str, a: str, b: str) -> str:
    solid = f"length(regexp_replace({x}, '{WS}', '', 'g'))"
    return rf"CASE WHEN {solid} = 0 THEN 0.0 ELSE length(regexp_replace({x}, '[^\x{{{a}}}-\x{{{b}}}]', '', 'g')) / {solid}::DOUBLE END"


@query(f"SELECT doc_id, round({_density('text', '00C0', '024F')}, 6) AS density FROM documents")
def script_density(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.script_density(F.col("text"), *LATIN), 6).alias("density"))


_VARIANT = r"CASE chunk_idx % 5 WHEN 0 THEN chunk WHEN 1 THEN '' WHEN 2 THEN chunk[1 : length(chunk) // 3] WHEN 3 THEN regexp_replace(chunk, '[^\x00-\x7F]', 'x', 'g') ELSE chunk || chunk || chunk END"
_REASON = f"""CASE WHEN {strip('cand')} = '' THEN 'empty' WHEN length(cand) / greatest(1, length(chunk))::DOUBLE < 0.45 THEN 'too_short'
  WHEN length(cand) / greatest(1, length(chunk))::DOUBLE > 2.5 THEN 'too_long'
  WHEN {_density('chunk', '00C0', '024F')} > 0.3 AND {_density('cand', '00C0', '024F')} < 0.5 * {_density('chunk', '00C0', '024F')} THEN 'wrong_script' END"""
_REFINED = f"SELECT doc_id, chunk_idx, chunk, cand, {_REASON} AS reason FROM (SELECT *, {_VARIANT} AS cand FROM ({_CHUNKS}))"


def _refined(spark, d):
    c = chunk_rows(spark, d).withColumn("cand", R.variants(F.col("chunk"), F.col("chunk_idx")))
    return c.withColumn("reason", R.refusal(F.col("chunk"), F.col("cand"), LATIN))


@query(f"SELECT doc_id, chunk_idx, reason IS NULL AS ok, reason FROM ({_REFINED})")
def refine_validate(spark, d):
    return _refined(spark, d).select("doc_id", "chunk_idx", F.col("reason").isNull().alias("ok"), "reason")


@query(f"SELECT doc_id, chunk_idx, CASE WHEN reason IS NULL THEN cand ELSE chunk END AS refined FROM ({_REFINED})")
def refine_blocks(spark, d):
    c = chunk_rows(spark, d)
    tries = F.array(F.lit(""), R.variants(F.col("chunk"), F.col("chunk_idx")))
    return c.select("doc_id", "chunk_idx", R.first_plausible(F.col("chunk"), tries, LATIN).alias("refined"))


@query(f"SELECT doc_id, count(*) FILTER (reason IS NULL)::BIGINT AS refined, count(*) FILTER (reason IS NOT NULL)::BIGINT AS fallback, count(*)::BIGINT AS total FROM ({_REFINED}) GROUP BY doc_id")
def refine_summary(spark, d):
    """Counted within each page's array of chunks: nothing is shuffled."""
    t = table(spark, d, "documents").where(~X.is_blank(F.col("text"))).select("doc_id", C.chunks(F.col("text")).alias("c"))
    good = F.filter(F.transform("c", lambda c, i: R.refusal(c, R.variants(c, i), LATIN)), lambda r: r.isNull())
    t = t.select("doc_id", F.size(good).cast("long").alias("refined"), F.size("c").cast("long").alias("total"))
    return t.select("doc_id", "refined", (F.col("total") - F.col("refined")).alias("fallback"), "total")


_ANSWERS = [
    ("<think>hm|no</think> plain text", "plain text"), ("```text|fenced answer|```", "fenced answer"), ("Sure, here you go:||Here is the text:|body line|more", "body line|more"),
    ("Output:", "Output:"), ('"quoted whole"', "quoted whole"), ('""', '""'), ("“curly”", "curly"), ("  spaced  ", "spaced"), ("Revised version:|  |a: b:|c", "a: b:|c"), ("not a preamble|Final:|x", "not a preamble|Final:|x"),
]


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query(f"SELECT id::BIGINT AS id, replace(answer, '|', chr(10)) AS answer FROM (VALUES {_rows((i, a) for i, (_, a) in enumerate(_ANSWERS))}) AS t(id, answer)")
def llm_sanitize(spark, d):
    raw = values(spark, _rows((i, a) for i, (a, _) in enumerate(_ANSWERS)) + " AS t(id, raw)")
    return raw.select(F.col("id").cast("long").alias("id"), R.sanitize(F.replace(F.col("raw"), F.lit("|"), F.lit("\n"))).alias("answer"))


@query("SELECT page_id, list_last(string_split(replace(url, chr(92), '/'), '/')) AS name FROM pages")
def basename(spark, d):
    return table(spark, d, "pages").select("page_id", X.basename(F.col("url")).alias("name"))


def _megabytes(c):
    return F.octet_length(c) / 1048576.0


@query("""
SELECT page_id, CASE WHEN NOT (page_id % 11 <> 0) THEN 'not found' WHEN NOT lower(split_part(split_part(url, '?', 1), '#', 1)) LIKE '%.html' THEN 'not a pdf'
  WHEN strlen(html) / 1048576.0 > 0.005 THEN 'too large' WHEN strlen(html) <= 0 THEN 'empty' WHEN page_id % 5 = 1 THEN 'no pages' END AS reject_reason FROM pages
""")
def validate_inputs(spark, d):
    name = F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), r"(?i)\.html$", ".pdf")
    reason = formats.reject_reason(F.col("page_id") % 11 != 0, name, _megabytes(F.col("html")), F.when(F.col("page_id") % 5 == 1, 0).otherwise(1), most=0.005)
    return table(spark, d, "pages").select("page_id", reason.alias("reject_reason"))


_SIZES = "(0), (1023), (1024), (1048576), (1099511627776), (1536) AS t(n)"


@query("""
WITH s AS (SELECT n::BIGINT AS n FROM (VALUES (0), (1023), (1024), (1048576), (1099511627776), (1536)) AS t(n) UNION ALL SELECT strlen(html) FROM pages)
SELECT n, CASE WHEN n < 1024 THEN format('{:.1f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:.1f} MB', n / 1048576.0::DOUBLE)
  WHEN n < 1099511627776 THEN format('{:.1f} GB', n / 1073741824.0::DOUBLE) ELSE format('{:.1f} TB', n / 1099511627776.0::DOUBLE) END AS size FROM s
""")
def human_size(spark, d):
    n = values(spark, _SIZES).select(F.col("n").cast("long").alias("n")).union(table(spark, d, "pages").select(F.octet_length("html").cast("long")))
    return n.select("n", formats.human_size(F.col("n").cast("double")).alias("size"))


_NAMES = "('লেখা.pdf'), ('a/b.pdf'), ('v1.2.pdf'), ('a b-c.pdf'), ('noext'), ('.hidden'), ('x?*.PDF') AS t(name)"
_SANE = strip(r"regexp_replace(substr(name, 1, length(name) - length(suffix)), '[^\p{L}\p{N}_\-. ]', '_', 'g')") + " || suffix"
_SUFFIX = "regexp_extract(name, '[^/]([.][^./]+)$', 1)"
_NAMED = f"SELECT name, {_SUFFIX} AS suffix FROM (SELECT * FROM (VALUES {_NAMES.replace(' AS t(name)', '')}) AS t(name) UNION ALL SELECT DISTINCT list_last(string_split(url, '/')) FROM pages)"


def _names(spark, d):
    return values(spark, _NAMES).union(basename(spark, d).select("name").distinct())


@query(f"SELECT name, {_SANE} AS clean FROM ({_NAMED})")
def sanitize_filename(spark, d):
    return _names(spark, d).select("name", X.sanitize_filename(F.col("name")).alias("clean"))


@query(f"SELECT name, {strip(chr(40) + 'regexp_replace(substr(name, 1, length(name) - length(suffix)) || ' + chr(39) + '_translated' + chr(39) + ', ' + chr(39) + r'[^\p{L}\p{N}_\-. ]' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')' + chr(41))} || '.docx' AS output FROM ({_NAMED})")
def output_names(spark, d):
    suffix = F.regexp_extract("name", r"[^/]([.][^./]+)$", 1)
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(suffix))
    return _names(spark, d).select("name", X.sanitize_filename(F.concat(stem, F.lit("_translated.docx"))).alias("output"))
