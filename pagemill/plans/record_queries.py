"""Queries on jobs, history, checkpoints, settings, progress and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.text import py_strip
from ..operators import jobs as J
from ..operators.chunking import in_order
from ..sources import records
from .registry import query, table, values

_HISTORY = """
SELECT o_orderkey AS job_id, 'order-' || o_custkey || '.pdf' AS filename, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'CANCELLED' END AS status,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') ELSE '' END AS completed_at,
  o_custkey % 50 AS total_pages, o_totalprice AS duration_seconds FROM orders
"""
_ORDER = "coalesce(nullif(completed_at, ''), created_at) DESC, job_id"


def history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("CANCELLED")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("order-"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("filename"), status.alias("status"), stamp("o_orderdate").alias("created_at"),
        F.when(status == "COMPLETED", stamp(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))).otherwise("").alias("completed_at"), (F.col("o_custkey") % 50).alias("total_pages"), F.col("o_totalprice").alias("duration_seconds"),
    )


@query(_HISTORY)
def history_all(spark, d):
    h = history(spark, d)
    return h.orderBy(*J.history_order(h))


@query(f"SELECT job_id, filename, status FROM ({_HISTORY}) ORDER BY {_ORDER} LIMIT 5")
def history_recent(spark, d):
    h = history(spark, d)
    return h.orderBy(*J.history_order(h)).limit(5).select("job_id", "filename", "status")


@query(f"""SELECT count(*)::BIGINT AS total_jobs, count(*) FILTER (status = 'COMPLETED')::BIGINT AS completed, count(*) FILTER (status = 'FAILED')::BIGINT AS failed,
  coalesce(sum(total_pages) FILTER (status = 'COMPLETED'), 0)::BIGINT AS pages, round(coalesce(sum(duration_seconds) FILTER (status = 'COMPLETED'), 0), 2) AS seconds FROM ({_HISTORY})""")
def history_stats(spark, d):
    return J.stats(history(spark, d))


@query(f"SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'CANCELLED' ELSE status END AS status, filename FROM ({_HISTORY}) UNION ALL SELECT -1, 'FAILED', 'new.pdf'")
def history_upsert(spark, d):
    h = history(spark, d).select("job_id", "status", "filename")
    new = h.where("job_id % 10 = 0").withColumn("status", F.lit("CANCELLED")).union(values(spark, "(-1, 'FAILED', 'new.pdf') AS t(job_id, status, filename)"))
    return J.upsert(h, new)


@query(f"SELECT job_id, CASE job_id % 10 WHEN 0 THEN 'CANCELLED' WHEN 5 THEN 'COMPLETED' ELSE status END AS status, filename FROM ({_HISTORY})")
def history_rewrite(spark, d):
    """Jobs that are recorded again, some of them twice: the last record wins."""
    h = history(spark, d).select("job_id", "status", "filename")
    first = h.where("job_id % 5 = 0").withColumns({"status": F.lit("CANCELLED"), "seq": F.lit(0)})
    second = h.where("job_id % 10 = 5").withColumns({"status": F.lit("COMPLETED"), "seq": F.lit(1)})
    return J.upsert(h, second.union(first), "job_id", "seq")


@query(f"SELECT job_id, status FROM ({_HISTORY}) WHERE FALSE")
def history_clear(spark, d):
    return J.cleared(history(spark, d).select("job_id", "status"))


@query("SELECT o_custkey AS owner, o_orderkey AS job_id, 'order-' || o_custkey || '.pdf' AS filename FROM orders WHERE o_custkey % 7 <> 3")
def history_json(spark, d):
    """Each owner's history as one JSON array, read back; a torn file is an empty history."""
    schema = "job_id bigint, filename string"
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("order-"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("filename"))).alias("entries")
    )
    whole = F.to_json("entries")
    files = h.select("owner", F.when(F.col("owner") % 7 == 3, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole).alias("file"))
    return files.select("owner", F.explode(records.parse_array("file", schema)).alias("r")).select("owner", "r.*")


@query(f"SELECT job_id, filename FROM ({_HISTORY}) WHERE job_id NOT IN (1, 2, 3)")
def history_delete(spark, d):
    return history(spark, d).where(~F.col("job_id").isin(1, 2, 3)).select("job_id", "filename")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001')")
def history_search(spark, d):
    return J.search(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "  00001 ")


@query("SELECT conv_id AS job_id, turn AS page FROM conversations WHERE conv_id % 4 <> 0")
def checkpoint_delete(spark, d):
    """The page logs that are left once finished jobs' checkpoints are deleted."""
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("page"))
    return J.forget(log, checkpoints(spark, d).where("status = 'COMPLETED'"))


@query("SELECT * FROM (VALUES ('a1'), ('b-2')) AS t(job_id)")
def resumable_jobs(spark, d):
    """Folders that hold a checkpoint."""
    files = values(spark, "('/ck/a1/checkpoint.json'), ('/ck/a1/pages.jsonl'), ('/ck/b-2/checkpoint.json'), ('/ck/c/pages.jsonl'), ('/ck/d/old-checkpoint.json') AS t(path)")
    return files.select(records.checkpoint_job(F.col("path")).alias("job_id")).where("job_id is not null").distinct()


_PAGES = "SELECT conv_id AS job_id, turn AS page, text, 0::BIGINT AS seq FROM conversations UNION ALL SELECT conv_id, turn, 'again ' || text, 1 FROM conversations WHERE turn % 3 = 0"


def page_log(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("page"), "text", F.lit(0).cast("long").alias("seq"))
    return c.union(c.where("page % 3 = 0").select("job_id", "page", F.concat(F.lit("again "), F.col("text")), F.lit(1).cast("long")))


@query(f"SELECT job_id, page, text FROM ({_PAGES}) QUALIFY row_number() OVER (PARTITION BY job_id, page ORDER BY seq DESC) = 1")
def checkpoint_dedup(spark, d):
    return J.latest(page_log(spark, d), ["job_id", "page"], "seq").select("job_id", "page", "text")


@query("SELECT conv_id AS job_id, turn AS page, text FROM conversations")
def checkpoint_jsonl(spark, d):
    """Page records as JSON lines, and back."""
    lines = page_log(spark, d).where("seq = 0").select("job_id", records.page_line("page", "text").alias("line"))
    return records.page_records(lines, "line", "job_id").select("job_id", "page", "text")


@query("SELECT conv_id AS job_id, turn AS page, CASE WHEN turn % 4 = 2 THEN '' ELSE text END AS text FROM conversations WHERE turn % 4 NOT IN (1, 3)")
def jsonl_tolerant_read(spark, d):
    """Torn lines, lines without a page, other JSON values and blank lines are skipped; a missing text is empty."""
    line = records.page_line("page", "text")
    odd = F.when(F.col("page") % 8 == 1, F.substring(line, F.lit(1), F.length(line) - 3)).when(F.col("page") % 8 == 5, F.lit("[1, 2]")).when(F.col("page") % 8 == 3, F.lit('{"text": "x"}'))
    odd = odd.when(F.col("page") % 8 == 7, F.lit("  ")).when(F.col("page") % 4 == 2, F.to_json(F.struct("page"))).otherwise(line)
    return records.page_records(page_log(spark, d).where("seq = 0").select("job_id", odd.alias("line")), "line", "job_id").select("job_id", "page", "text")


_CHECK = """SELECT conv_id AS job_id, CASE conv_id % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'RUNNING' END AS status, CASE WHEN conv_id % 5 > 0 THEN '/in/' || conv_id || '.pdf' END AS input_path,
  max(turn) AS last_completed_page, CASE WHEN conv_id % 3 > 0 THEN 'google' END AS translation_backend, count(*)::BIGINT AS total_pages FROM conversations GROUP BY conv_id"""


def checkpoints(spark, d) -> DataFrame:
    k = F.col("conv_id")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_completed_page"), F.count("*").alias("total_pages"))
    return c.select(
        k.alias("job_id"), F.when(k % 4 == 0, "COMPLETED").when(k % 4 == 1, "FAILED").when(k % 4 == 2, "RUNNING").alias("status"), F.when(k % 5 > 0, F.concat(F.lit("/in/"), k.cast("string"), F.lit(".pdf"))).alias("input_path"),
        "last_completed_page", F.when(k % 3 > 0, "google").alias("translation_backend"), "total_pages", F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("boolean").alias("refine_enabled"),
    )


@query(f"SELECT job_id, status, input_path, last_completed_page FROM ({_CHECK}) WHERE job_id % 6 <> 5")
def checkpoint_load(spark, d):
    """Checkpoints as JSON objects, read back; corrupt ones are no checkpoint."""
    text = F.to_json(F.struct("job_id", "status", "input_path", "last_completed_page"))
    torn = F.when(F.col("job_id") % 6 == 5, F.substring(text, F.lit(1), F.length(text) - 4)).otherwise(text)
    return records.checkpoints(checkpoints(spark, d).select(torn.alias("line")), "line")


@query(f"SELECT job_id, last_completed_page FROM ({_CHECK}) UNION ALL SELECT -5, -1")
def checkpoint_init(spark, d):
    """Create-if-absent: an existing checkpoint wins."""
    old = checkpoints(spark, d).select("job_id", "last_completed_page")
    new = old.where("job_id % 2 = 0").select("job_id").union(spark.range(-5, -4).toDF("job_id")).withColumn("last_completed_page", F.lit(-1).cast("long"))
    return old.union(new.join(old, "job_id", "left_anti"))


@query(f"SELECT job_id, max(page) AS last_page, greatest(0, max(page) + 1) AS resume_page, max(page) >= 0 AS resumable FROM ({_PAGES}) GROUP BY job_id")
def resume_point(spark, d):
    return J.resume_points(page_log(spark, d))


@query(f"SELECT job_id, status FROM ({_CHECK}) WHERE coalesce(status, '') <> 'COMPLETED'")
def incomplete_jobs(spark, d):
    return J.incomplete(checkpoints(spark, d)).select("job_id", "status")


@query(f"SELECT job_id, input_path, job_id || '.pdf' AS original_filename, 'QUEUED' AS status, last_completed_page + 1 AS current_page, total_pages, coalesce(translation_backend, 'argos') AS translation_backend, FALSE AS refine_enabled FROM ({_CHECK}) WHERE input_path IS NOT NULL")
def reconstruct_jobs(spark, d):
    return J.reconstructed(checkpoints(spark, d))


@query(f"SELECT job_id FROM ({_CHECK}) WHERE coalesce(status, '') <> 'COMPLETED' AND job_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 10 = 1)")
def recovery_candidates(spark, d):
    active = table(spark, d, "conversations").where("conv_id % 10 = 1").select(F.col("conv_id").alias("job_id"))
    return J.incomplete(checkpoints(spark, d)).join(active, "job_id", "left_anti").select("job_id")


_EVENTS = "SELECT user_id AS job_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::BIGINT AS page, value AS seconds, event_type = 'error' AS failed, ts, event_type FROM events"


def progress(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), (F.row_number().over(w) - 1).cast("long").alias("page"), F.col("value").alias("seconds"), (F.col("event_type") == "error").alias("failed"), "ts", "event_type"
    )


_MEAN = "(sum(round(seconds * 1000000)::BIGINT) OVER w)::DOUBLE / count(seconds) OVER w / 1000000.0::DOUBLE"
_PERCENT = "least(100.0::DOUBLE, format('{:.1f}', page / 60::DOUBLE * 100)::DOUBLE)"


@query(f"""SELECT job_id, page, CASE WHEN page >= 60 THEN 0.0::DOUBLE ELSE format('{{:.1f}}', {_MEAN} * (60 - page))::DOUBLE END AS eta_seconds, {_PERCENT} AS percent
FROM ({_EVENTS}) WINDOW w AS (PARTITION BY job_id ORDER BY page ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def progress_eta(spark, d):
    e = J.eta(progress(spark, d), ["job_id"], "page", "seconds", F.lit(60))
    return e.select("job_id", "page", "eta_seconds", formats.percent(F.col("page"), F.lit(60)).alias("percent"))


@query(f"""SELECT job_id, page // 25 AS run, page, CASE WHEN page >= 60 THEN 0.0::DOUBLE ELSE format('{{:.1f}}', {_MEAN} * (60 - page))::DOUBLE END AS eta_seconds
FROM ({_EVENTS}) WINDOW w AS (PARTITION BY job_id, page // 25 ORDER BY page ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def progress_eta_resumed(spark, d):
    """Jobs that were resumed after every 25 pages: each run has a window of its own."""
    runs = progress(spark, d).withColumn("run", F.floor(F.col("page") / 25))
    return J.eta(runs, ["job_id", "run"], "page", "seconds", F.lit(60)).select("job_id", "run", "page", "eta_seconds")


@query(f"""WITH e AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY page) AS island FROM ({_EVENTS}))
SELECT job_id, page, sum(failed::INT) OVER (PARTITION BY job_id, island ORDER BY page)::BIGINT AS streak, sum(failed::INT) OVER (PARTITION BY job_id, island ORDER BY page) >= 3 AS abort FROM e""")
def failure_streaks(spark, d):
    return J.failure_streaks(progress(spark, d), "job_id", "page", F.col("failed"), 3).select("job_id", "page", "streak", "abort")


_LINE = "'[' || strftime(ts, '%H:%M:%S') || '] ' || event_type"


def _log_line():
    return F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), F.col("event_type"))


@query(f"SELECT job_id, page AS seq, {_LINE} AS line FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY page DESC) <= 20")
def recent_logs(spark, d):
    return J.last_rows(progress(spark, d), "job_id", "page", 20).select("job_id", F.col("page").alias("seq"), _log_line().alias("line"))


@query(f"SELECT job_id, string_agg({_LINE}, chr(10) ORDER BY page) AS log FROM ({_EVENTS}) GROUP BY job_id")
def log_export(spark, d):
    return progress(spark, d).withColumn("line", _log_line()).groupBy("job_id").agg(F.array_join(in_order("line", "page"), "\n").alias("log"))


@query(f"SELECT job_id, page FROM ({_EVENTS}) WHERE (page + 1) % 25 = 0 OR page = 59")
def milestone_pages(spark, d):
    return progress(spark, d).where("(page + 1) % 25 = 0 or page = 59").select("job_id", "page")


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN value * 50 END AS x FROM events)
SELECT event_id, CASE WHEN x IS NULL THEN 'calculating...' WHEN floor(x) < 60 THEN floor(x)::BIGINT || 's' WHEN floor(x) < 3600 THEN (floor(x)::BIGINT // 60) || 'm ' || (floor(x)::BIGINT % 60) || 's'
  ELSE (floor(x)::BIGINT // 3600) || 'h ' || (floor(x)::BIGINT // 60 % 60) || 'm' END AS duration FROM s""")
def format_duration(spark, d):
    return table(spark, d, "events").select("event_id", formats.duration(F.when(F.col("event_id") % 9 > 0, F.col("value") * 50)).alias("duration"))


_JOBS = "SELECT o_orderkey AS job_id, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'RUNNING' WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'CANCELLED' END AS status FROM orders"


def jobs(spark, d) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(F.col("o_orderkey") % 97 == 0, "RUNNING").when(s == "F", "COMPLETED").when(s == "O", "QUEUED").otherwise("CANCELLED")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey", status.alias("status"))


@query(f"SELECT job_id, status, c_name AS owner, coalesce(n.n, 0)::BIGINT AS queued_of_owner FROM ({_JOBS}) j JOIN customer ON c_custkey = j.o_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM ({_JOBS}) WHERE status = 'QUEUED' GROUP BY 1) n ON n.o_custkey = j.o_custkey")
def job_dashboard(spark, d):
    j = jobs(spark, d)
    queued = j.where("status = 'QUEUED'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    owner = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
    return j.join(owner, "o_custkey").join(queued, "o_custkey", "left").select("job_id", "status", "owner", F.coalesce("n", F.lit(0)).cast("long").alias("queued_of_owner"))


@query(f"SELECT count(*) FILTER (status = 'QUEUED')::BIGINT AS queued, bool_or(status = 'RUNNING') AS active, max(job_id) FILTER (status = 'RUNNING') AS shown FROM ({_JOBS})")
def queue_summary(spark, d):
    s = F.col("status")
    return jobs(spark, d).agg(F.count_if(s == "QUEUED").alias("queued"), F.bool_or(s == "RUNNING").alias("active"), F.max(F.when(s == "RUNNING", F.col("job_id"))).alias("shown"))


@query(f"SELECT job_id, row_number() OVER (ORDER BY job_id)::BIGINT AS place FROM ({_JOBS}) WHERE status = 'QUEUED'")
def queue_order(spark, d):
    """The place of every queued job; no window holds more than a range of them."""
    return J.places(jobs(spark, d).where("status = 'QUEUED'").select("job_id"), "job_id")


@query(f"SELECT job_id, row_number() OVER (ORDER BY job_id)::BIGINT AS place FROM ({_JOBS}) WHERE status = 'QUEUED'")
def queue_order_all(spark, d):
    """queue_order under its former name, from when that ordered a part only."""
    return queue_order(spark, d)


_VIEWED = "SELECT c_custkey AS owner, c_custkey * 7 AS job_id FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1"


@query(f"""WITH j AS (SELECT o_custkey AS owner, job_id, status FROM ({_JOBS})), v AS ({_VIEWED}),
p AS (SELECT owner, (SELECT max(job_id) FROM j x WHERE x.owner = o.owner AND status = 'RUNNING') AS a,
  (SELECT max(x.job_id) FROM j x JOIN v ON v.owner = x.owner AND v.job_id = x.job_id WHERE x.owner = o.owner) AS w,
  (SELECT max(job_id) FROM j x WHERE x.owner = o.owner) AS l FROM (SELECT DISTINCT owner FROM j) o)
SELECT owner, coalesce(a, w, l) AS job_id, CASE WHEN a IS NOT NULL THEN 'active' WHEN w IS NOT NULL THEN 'viewed' ELSE 'latest' END AS why FROM p""")
def display_job(spark, d):
    j = jobs(spark, d).select(F.col("o_custkey").alias("owner"), "job_id", "status", F.col("job_id").alias("added"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") * 7).alias("job_id"))
    first = table(spark, d, "orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("owner")).agg(F.min("o_orderkey").alias("job_id"))
    return J.shown_jobs(j, c.union(first), "owner")


_BOARD = "SELECT c_custkey AS job_id, c_name AS filename, CASE c_custkey % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM customer"


@query(f"""SELECT j.job_id, filename, CASE status WHEN 'RUNNING' THEN 'Translating' WHEN 'COMPLETED' THEN 'Completed' ELSE 'Failed' END AS label, coalesce(n, 0)::BIGINT AS pages_done,
  least(100.0::DOUBLE, format('{{:.1f}}', coalesce(n, 0) / 70::DOUBLE * 100)::DOUBLE) AS percent, last_log
FROM ({_BOARD}) j LEFT JOIN (SELECT job_id, max(page) + 1 AS n, max_by({"'[' || strftime(ts, '%H:%M:%S') || '] ' || event_type"}, page) AS last_log FROM ({_EVENTS}) GROUP BY job_id) e ON e.job_id = j.job_id""")
def job_board(spark, d):
    """Jobs with their progress and their newest log line."""
    k, e = F.col("c_custkey"), progress(spark, d)
    j = table(spark, d, "customer").select(k.alias("job_id"), F.col("c_name").alias("filename"), F.when(k % 3 == 0, "RUNNING").when(k % 3 == 1, "COMPLETED").otherwise("FAILED").alias("status"))
    return J.board(j, e.select("job_id", "page"), e.select("job_id", F.col("page").alias("seq"), _log_line().alias("line")), F.lit(70))


@query(f"SELECT job_id, status IN ('COMPLETED', 'FAILED', 'CANCELLED') AS is_terminal, status IN ('QUEUED', 'RUNNING', 'PAUSED') AS is_active FROM ({_JOBS})")
def job_status_flags(spark, d):
    return jobs(spark, d).select("job_id", F.col("status").isin(*formats.TERMINAL).alias("is_terminal"), F.col("status").isin(*formats.ACTIVE).alias("is_active"))


@query("SELECT * FROM (VALUES ('QUEUED', 'Queued'), ('RUNNING', 'Translating'), ('PAUSED', 'Paused'), ('COMPLETED', 'Completed'), ('FAILED', 'Failed'), ('CANCELLED', 'Cancelled'), ('odd state', 'Odd State')) AS t(status, label)")
def status_labels(spark, d):
    s = values(spark, "('QUEUED'), ('RUNNING'), ('PAUSED'), ('COMPLETED'), ('FAILED'), ('CANCELLED'), ('odd state') AS t(status)")
    return s.select("status", formats.status_label(F.col("status")).alias("label"))


@query("SELECT job_id, fmt, '/out/' || job_id || '.' || fmt AS path FROM (SELECT c_custkey AS job_id, unnest(['docx', 'odt', 'txt']) AS fmt FROM customer) WHERE fmt <> 'odt'")
def format_fanout(spark, d):
    """Formats that can be written, one row each; the map of paths is built and taken apart again."""
    j = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.explode(F.array(F.lit("docx"), F.lit("odt"), F.lit("txt"))).alias("fmt"))
    j = j.where(F.col("fmt").isin("docx", "pdf", "txt")).withColumn("path", F.concat(F.lit("/out/"), F.col("job_id").cast("string"), F.lit("."), F.col("fmt")))
    paths = j.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("fmt", "path"))).alias("paths"))
    return paths.select("job_id", F.explode("paths").alias("fmt", "path"))


_HAS = "('b', '20'), ('c', '3'), ('a', NULL), ('z', 'new') AS t(key, value)"


@query("SELECT * FROM (VALUES ('a', NULL), ('b', '20'), ('c', '3'), ('z', 'new'), ('q', 'kept')) AS t(key, value)")
def settings_overlay(spark, d):
    return J.overlay(values(spark, "('a', '1'), ('b', '2'), ('c', NULL), ('q', 'kept') AS t(key, value)"), values(spark, _HAS))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'bn' THEN 'Bengali' ELSE upper(lang) END AS label, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def lang_labels(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", formats.language_label(F.col("lang")).alias("label"), "n")


def _installed(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("src"), F.lit("en").alias("dst")).distinct()


_WANTED = "('en', 'bn'), ('de', 'en'), ('fr', 'en'), ('fr', 'fr'), ('it', 'en'), ('en', 'en') AS t(src, dst)"
_WANTED_SQL = f"(SELECT * FROM (VALUES {_WANTED.replace(' AS t(src, dst)', '')}) AS t(src, dst))"


@query("SELECT DISTINCT lang AS src, 'en' AS dst FROM documents")
def installed_pairs(spark, d):
    return _installed(spark, d)


@query(f"SELECT w.src, w.dst, w.src = w.dst OR EXISTS (SELECT 1 FROM documents WHERE lang = w.src AND w.dst = 'en') AS available FROM {_WANTED_SQL} w")
def pair_availability(spark, d):
    there = _installed(spark, d).withColumn("there", F.lit(True))
    w = values(spark, _WANTED).join(there, ["src", "dst"], "left")
    return w.select("src", "dst", ((F.col("src") == F.col("dst")) | F.col("there").isNotNull()).alias("available"))


@query(f"SELECT w.src, w.dst, 'pkg_' || w.src || '_' || w.dst AS package FROM {_WANTED_SQL} w WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = w.src AND w.dst = 'en') AND w.src <> 'it' AND w.src <> w.dst")
def pairs_to_install(spark, d):
    """Requested pairs that aren't installed, with the first package that offers them; pairs without one are skipped."""
    offers = values(spark, "('en', 'bn', 1, 'pkg_en_bn'), ('en', 'bn', 2, 'other'), ('de', 'en', 1, 'pkg_de_en'), ('es', 'en', 1, 'pkg_es_en') AS t(src, dst, n, package)")
    missing = values(spark, _WANTED).join(_installed(spark, d), ["src", "dst"], "left_anti")
    return missing.join(offers.groupBy("src", "dst").agg(F.min_by("package", "n").alias("package")), ["src", "dst"])


@query("SELECT * FROM (VALUES (1::BIGINT, TRUE, 2::BIGINT), (2, FALSE, 3), (3, TRUE, 1)) AS t(id, usable, options)")
def model_available(spark, d):
    """Usable if listed, or if the list is empty; the current model is put first into the options if it is missing."""
    m = values(spark, "(1, 'm:3b', array('m:3b', 'x')), (2, 'm:3b', array('y', 'x')), (3, 'm:3b', cast(array() as array<string>)) AS t(id, model, models)")
    listed = F.array_contains("models", F.col("model"))
    options = F.when(listed, F.col("models")).otherwise(F.array_prepend("models", F.col("model")))
    return m.select(F.col("id").cast("long").alias("id"), (listed | (F.size("models") == 0)).alias("usable"), F.size(options).cast("long").alias("options"))


@query("SELECT replace(replace(pair, 'T', chr(9)), 'N', chr(160)) AS pair, src, dst FROM (VALUES ('en-bn', 'en', 'bn'), ('a-b-c', 'a', 'b-c'), (' x - y ', 'x', 'y'), ('Tde -Nfr', 'de', 'fr'), ('-', '', '')) AS t(pair, src, dst)")
def parse_pairs(spark, d):
    """T and N stand for a tab and a no-break space."""
    p = values(spark, "('en-bn'), ('en'), ('a-b-c'), (' x - y '), ('Tde -Nfr'), ('-') AS t(pair)").select(F.translate("pair", "TN", "\t\u00a0").alias("pair"))
    p = p.withColumn("s", F.split("pair", "-", 2)).where(F.size("s") == 2)
    return p.select("pair", py_strip(F.col("s")[0]).alias("src"), py_strip(F.col("s")[1]).alias("dst"))


@query(f"SELECT count(*)::BIGINT AS pairs, count(*) FILTER (NOT ok)::BIGINT AS missing, bool_or(NOT ok) AS any_missing FROM (SELECT w.src = w.dst OR EXISTS (SELECT 1 FROM documents WHERE lang = w.src AND w.dst = 'en') AS ok FROM {_WANTED_SQL} w)")
def engine_status(spark, d):
    """Whether any supported pair has no model."""
    ok = F.col("available")
    return pair_availability(spark, d).agg(F.count("*").alias("pairs"), F.count_if(~ok).alias("missing"), F.bool_or(~ok).alias("any_missing"))


@query("SELECT lang, CASE lang WHEN 'bn' THEN 'bn' ELSE 'en' END AS engine, count(*)::BIGINT AS n FROM (SELECT lang FROM documents UNION ALL SELECT 'bn') GROUP BY 1, 2")
def ocr_languages(spark, d):
    langs = table(spark, d, "documents").select("lang").union(values(spark, "('bn') AS t(lang)"))
    return langs.select("lang", formats.ocr_language(F.col("lang")).alias("engine")).groupBy("lang", "engine").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('chunk_max_chars', 400, TRUE), ('chunk_max_chars', 410, FALSE), ('chunk_max_chars', 850, FALSE), ('translation_workers', 6, TRUE), ('online_translation_workers', 5, FALSE), ('refine_timeout', 17, TRUE), ('ocr_dpi', 125, TRUE), ('theme', 1, NULL)) AS t(name, value, ok)")
def tuning_ranges(spark, d):
    v = values(spark, "('chunk_max_chars', 400), ('chunk_max_chars', 410), ('chunk_max_chars', 850), ('translation_workers', 6), ('online_translation_workers', 5), ('refine_timeout', 17), ('ocr_dpi', 125), ('theme', 1) AS t(name, value)")
    return v.select("name", "value", formats.in_range(F.col("name"), F.col("value")).alias("ok"))


@query("SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, FALSE), (4, FALSE), (5, FALSE)) AS t(id, ok)")
def start_guard(spark, d):
    v = values(spark, "(1, array('f'), array('docx'), 'en', 'bn'), (2, cast(array() as array<string>), array('docx'), 'en', 'bn'), (3, array('f'), cast(null as array<string>), 'en', 'bn'), (4, array('f'), array('txt'), 'en', 'en'), (5, array('f'), array('txt'), null, null) AS t(id, files, formats, src, dst)")
    return v.select("id", formats.may_start(F.col("files"), F.col("formats"), F.col("src"), F.col("dst")).alias("ok"))


@query("SELECT * FROM (VALUES (1, 'm:3b,x'), (2, ''), (3, ''), (4, '')) AS t(id, models)")
def list_models(spark, d):
    """The names in a model server's reply; none for an error."""
    r = spark.createDataFrame([(1, '{"models": [{"name": "m:3b"}, {"name": ""}, {"size": 1}, {"name": "x"}]}'), (2, "502 bad gateway"), (3, None), (4, '{"models": []}')], "id int, reply string")
    return r.select("id", F.array_join(records.model_names(F.col("reply")), ",").alias("models"))


@query("SELECT * FROM (VALUES ('ann', 'a', '1'), ('ann', 'b', '20'), ('ann', 'z', 'new'), ('bob', 'a', '1'), ('bob', 'b', '2'), ('cy', 'a', '1'), ('cy', 'b', '2')) AS t(who, key, value)")
def settings_files(spark, d):
    """Settings files over the defaults; a torn file (bob) or a reset one (cy) leaves the defaults."""
    files = spark.createDataFrame([("ann", '{"b": 20, "z": "new"}'), ("bob", '{"b": 20,'), ("cy", "{}")], "who string, file string")
    stored = files.select("who", F.explode(records.parse_settings("file")).alias("key", "value"))
    defaults = values(spark, "('a', '1'), ('b', '2') AS t(key, value)").crossJoin(F.broadcast(files.select("who")))
    return J.overlay(defaults, stored, "who", "key")

_BACKENDS = "('argos'), ('google'), ('deepl'), (NULL) AS t(name)"


@query("SELECT * FROM (VALUES ('argos', 'argos'), ('google', 'google'), ('deepl', 'argos'), (NULL, 'argos')) AS t(name, backend)")
def backend_resolve(spark, d):
    return values(spark, _BACKENDS).select("name", formats.backend(F.col("name")).alias("backend"))


@query("SELECT * FROM (VALUES ('argos', 400::BIGINT, 1::BIGINT), ('google', 3000, 2), ('deepl', 400, 3), (NULL, 400, 1)) AS t(name, chunk_chars, workers)")
def backend_tuning(spark, d):
    b = values(spark, "('argos', 0), ('google', 2), ('deepl', 3), (NULL, -1) AS t(name, n)")
    return b.select("name", formats.backend_chunk(F.col("name")).cast("long").alias("chunk_chars"), formats.backend_workers(F.col("n")).cast("long").alias("workers"))


@query("SELECT msg, (k - 1)::BIGINT AS attempt, seconds[k] AS seconds FROM (SELECT msg, seconds, unnest([1, 2, 3]) AS k FROM (VALUES ('HTTP 429', [4.0::DOUBLE, 8.0, 16.0]), ('Quota exceeded', [4.0, 8.0, 16.0]), ('timeout', [2.0, 4.0, 8.0])) AS t(msg, seconds))")
def backoff_schedule(spark, d):
    m = values(spark, "('HTTP 429'), ('Quota exceeded'), ('timeout') AS t(msg)")
    out = m.select("msg", F.posexplode(formats.backoff(4, formats.rate_limited(F.col("msg")))).alias("attempt", "seconds"))
    return out.select("msg", F.col("attempt").cast("long").alias("attempt"), F.col("seconds").cast("double").alias("seconds"))
