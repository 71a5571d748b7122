"""Page logs, checkpoints and histories as JSON, read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "page LONG, text STRING"
CHECKPOINT = "job_id LONG, status STRING, input_path STRING, last_completed_page LONG"


def page_line(page: str, text: str) -> Column:
    return F.to_json(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))


def _objects(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Adds ``_r``, the parsed object; null for lines that aren't whole JSON objects."""
    parsed = F.from_json(line, f"{schema}, _torn STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    whole = F.col(line).rlike(r"(?s)^\s*\{.*\}\s*$")
    return df.withColumn("_r", F.when(whole, parsed)).where("_r is not null and _r._torn is null")


def page_records(df: DataFrame, line: str, *keys: str) -> DataFrame:
    """(keys, page, text) of the lines that hold a page; a missing text is empty, anything else is skipped."""
    return _objects(df, line, PAGE).where("_r.page is not null").select(*keys, F.col("_r.page").alias("page"), F.coalesce("_r.text", F.lit("")).alias("text"))


def checkpoints(df: DataFrame, line: str) -> DataFrame:
    return _objects(df, line, CHECKPOINT).select("_r.job_id", "_r.status", "_r.input_path", "_r.last_completed_page")


def read_page_log(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, page, text) of ``path/<job_id>/pages*.jsonl``, the directory naming the job."""
    lines = spark.read.text(f"{path}/*/pages*.jsonl").withColumn("job_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return page_records(lines, "value", "job_id")


def append_page_log(pages: DataFrame, path: str) -> None:
    """Append (job_id, page, text) rows as files of JSON lines, a directory for each job; files are complete or absent."""
    pages.select("job_id", "page", "text").write.mode("append").partitionBy("job_id").json(path)


def read_documents(spark: SparkSession, path: str, parse) -> DataFrame:
    """(path, page_num, text, had_error, error_message) of binary files; ``parse(bytes)`` yields a text for each page.

    A page that raises is an empty one with its error; a file that can't be
    opened is one row of page -1.
    """
    schema = "path string, page_num int, text string, had_error boolean, error_message string"

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                n = -1
                try:
                    for n, page in enumerate(parse(bytes(content))):  # noqa: B007
                        rows.append((name, n, page() if callable(page) else page, False, None) if not isinstance(page, Exception) else (name, n, "", True, str(page)))
                except Exception as e:  # noqa: BLE001 - the file is reported, the others go on
                    rows.append((name, n + 1 if n >= 0 else -1, "", True, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "had_error", "error_message"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def parse_array(text: str, schema: str) -> Column:
    """The objects of a whole JSON array; an empty array if it is torn or isn't one."""
    whole = F.col(text).rlike(r"(?s)^\s*\[.*\]\s*$")
    return F.coalesce(F.when(whole, F.from_json(text, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})), F.array().cast(f"array<struct<{schema}>>"))


def parse_settings(text: str) -> Column:
    """The settings of a whole JSON object as a map of texts; none if it is torn or isn't one."""
    whole = F.col(text).rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.coalesce(F.when(whole, F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})), F.create_map().cast("map<string,string>"))


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of JSON array files; a file that can't be parsed counts as empty."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(parse_array("value", schema)).alias("r")).select("r.*")


def write_history(entries: DataFrame, path: str) -> None:
    """Overwrite a history with one JSON array; meant for a person's history, which one file holds."""
    one = entries.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*entries.columns)))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object file; a file that can't be parsed has none, so defaults hold (see jobs.overlay)."""
    return spark.read.text(path, wholetext=True).select(F.explode(parse_settings("value")).alias("key", "value"))


def checkpoint_job(path: Column) -> Column:
    """The job whose folder holds this checkpoint file; null for other files."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/checkpoint\.json$", 1), F.lit(""))


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(job_id) of the folders of ``root`` that hold a checkpoint; file contents aren't read."""
    files = spark.read.format("binaryFile").load(f"{root}/*/checkpoint.json").select(checkpoint_job(F.col("path")).alias("job_id"))
    return files.distinct()


def model_names(reply: Column) -> Column:
    """The non-empty names of a model server's JSON reply; none if it can't be parsed."""
    models = F.from_json(reply, "models array<struct<name:string>>", {"mode": "PERMISSIVE"})["models"]
    return F.coalesce(F.filter(F.transform(models, lambda m: m["name"]), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))
