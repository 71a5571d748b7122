"""Record stores: jobs, history, checkpoints, settings, logs, progress."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import percent, round_one, status_label
from ..functions.text import py_strip


def latest(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of each key in the order of ``order``."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def history_order(df: DataFrame) -> list[Column]:
    """Newest first by completed_at, or created_at if that is empty; then job_id."""
    return [F.coalesce(F.nullif(F.col("completed_at"), F.lit("")), F.col("created_at")).desc(), F.col("job_id").asc()]


def upsert(history: DataFrame, new: DataFrame, key: str = "job_id", *order: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key; of several new rows of a key the last in ``order`` does.

    Without an order the new rows must be one a key. Columns of ``new`` that the
    history doesn't have only order.
    """
    if order:
        new = latest(new, key, *order).select(*history.columns)
    return history.join(new.select(key), key, "left_anti").unionByName(new)


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    needle = F.lower(py_strip(F.lit(query)))
    return df.where(F.lower(F.col(column)).contains(needle))


def stats(history: DataFrame) -> DataFrame:
    """One row; durations are added as whole cents, so that the order of rows doesn't show."""
    done = F.col("status") == "COMPLETED"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return history.agg(
        F.count("*").alias("total_jobs"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        zero(F.sum(F.when(done, F.col("total_pages")))).cast("long").alias("pages"), (zero(F.sum(F.when(done, F.round(F.col("duration_seconds") * 100).cast("decimal(20,0)")))).cast("double") / 100).alias("seconds"),
    )


def resume_points(pages: DataFrame) -> DataFrame:
    """(job_id, last_page, resume_page, resumable) from an append-only page log; nothing is ever updated in place."""
    last = F.coalesce(F.max("page"), F.lit(-1))
    return pages.groupBy("job_id").agg(last.alias("last_page")).select("job_id", "last_page", F.greatest(F.lit(0), F.col("last_page") + 1).alias("resume_page"), (F.col("last_page") >= 0).alias("resumable"))


def incomplete(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(F.coalesce("status", F.lit("")) != "COMPLETED")


def reconstructed(checkpoints: DataFrame) -> DataFrame:
    """Jobs as they can be queued again; without an input path there is none. Backend and refinement are restored too."""
    c = checkpoints.where("input_path is not null")
    or_ = lambda name, value: F.coalesce(F.col(name), F.lit(value)).alias(name)
    return c.select(
        "job_id", "input_path", F.coalesce("original_filename", F.element_at(F.split("input_path", "/"), -1)).alias("original_filename"), F.lit("QUEUED").alias("status"),
        (F.coalesce("last_completed_page", F.lit(-1)) + 1).alias("current_page"), or_("total_pages", 0), or_("translation_backend", "argos"), or_("refine_enabled", False),
    )


def overlay(defaults: DataFrame, data: DataFrame, *keys: str) -> DataFrame:
    """(keys, value): stored settings over defaults, by ``key`` unless more is named; a stored null stays null."""
    keys = keys or ("key",)
    d, x = defaults.alias("d"), data.withColumn("_there", F.lit(True)).alias("x")
    return d.join(x, list(keys), "full_outer").select(*keys, F.when(F.col("x._there"), F.col("x.value")).otherwise(F.col("d.value")).alias("value"))


def last_rows(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def eta(df: DataFrame, key: list[str], page: str, seconds: str, total: Column, window: int = 12) -> DataFrame:
    """Adds ``eta_seconds``: mean of the last pages' durations times the pages that remain, 0 at the end.

    ``key`` names the job and its run: a resumed job starts a window of its own.
    """
    w = Window.partitionBy(*key).orderBy(page).rowsBetween(1 - window, 0)
    left = total - F.col(page)
    # summed as whole microseconds, so that the frame's order of addition doesn't show
    mean = F.sum(F.round(F.col(seconds) * 1000000).cast("long")).over(w) / F.count(seconds).over(w) / 1000000.0
    return df.withColumn("eta_seconds", F.when(left <= 0, F.lit(0.0)).otherwise(round_one(mean * left)))


def failure_streaks(df: DataFrame, key: str, order: str, failed: Column, most: int = 12) -> DataFrame:
    """Adds ``streak`` (failures on end so far) and ``abort`` (the streak has reached ``most``), in a fixed order."""
    w = Window.partitionBy(key).orderBy(order)
    df = df.withColumn("_failed", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_failed")).over(w))
    streak = F.sum("_failed").over(Window.partitionBy(key, "_island").orderBy(order))
    return df.withColumn("streak", streak).withColumn("abort", F.col("streak") >= most).drop("_failed", "_island")


def places(df: DataFrame, order: str, ranges: int = 512) -> DataFrame:
    """Adds ``place``: 1 for the smallest of the numeric column ``order`` and on, nulls last, over all rows.

    Ranges of about equal size are numbered each and moved by the exact counts of those
    before, so no window holds more than a range; equal values of ``order`` are in any order.
    """
    edges = df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    cut = Bucketizer(splits=[-float("inf"), *(sorted(set(edges)) or [0.0]), float("inf")], inputCol="_value", outputCol="_range", handleInvalid="keep")
    dealt = cut.transform(df.withColumn("_value", F.coalesce(F.col(order).cast("double"), F.lit(float("nan"))))).drop("_value")
    # at most one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    row = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_last()))
    return dealt.withColumn("_row", row).join(F.broadcast(counts), "_range").withColumn("place", (F.col("_row") + F.col("_before")).cast("long")).drop("_range", "_row", "_before")


def shown_jobs(jobs: DataFrame, viewed: DataFrame, owner: str) -> DataFrame:
    """(owner, job_id, why): the job that each owner is shown, in one aggregation.

    The running job, else the one that the owner viewed last if it is known, else
    the one that was added last. ``jobs``: owner, job_id, status, added;
    ``viewed``: owner, job_id. Owners without jobs have no row.
    """
    last = viewed.select(owner, "job_id").distinct().withColumn("_viewed", F.lit(True))
    j = jobs.join(last, [owner, "job_id"], "left")
    newest = lambda condition: F.max(F.when(condition, F.struct("added", "job_id")))["job_id"]
    picks = j.groupBy(owner).agg(newest(F.col("status") == "RUNNING").alias("a"), newest(F.col("_viewed")).alias("v"), newest(F.lit(True)).alias("l"))
    why = F.when(F.col("a").isNotNull(), "active").when(F.col("v").isNotNull(), "viewed").otherwise("latest")
    return picks.select(owner, F.coalesce("a", "v", "l").alias("job_id"), why.alias("why"))


def board(jobs: DataFrame, pages: DataFrame, logs: DataFrame, total: Column) -> DataFrame:
    """Each job with its progress and its newest log line: job_id, filename, label, pages_done, percent, last_log.

    ``jobs``: job_id, filename, status; ``pages``: job_id, page; ``logs``: job_id,
    seq, line. Jobs without pages or logs stay, at 0 and without a line.
    """
    done = pages.groupBy("job_id").agg((F.max("page") + 1).alias("pages_done"))
    line = logs.groupBy("job_id").agg(F.max_by("line", "seq").alias("last_log"))
    j = jobs.join(done, "job_id", "left").join(line, "job_id", "left").withColumn("pages_done", F.coalesce("pages_done", F.lit(0)).cast("long"))
    return j.select("job_id", "filename", status_label(F.col("status")).alias("label"), "pages_done", percent(F.col("pages_done"), total).alias("percent"), "last_log")


def forget(rows: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """A store without the keys of ``gone``: checkpoints, page logs or history entries that are deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def cleared(rows: DataFrame) -> DataFrame:
    """An empty store of the same columns; written over the old one, it clears it."""
    return rows.limit(0)
