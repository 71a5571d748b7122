"""Page-at-a-time translation as a resumable stream."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, rot13
from ..operators.chunking import chunked
from ..plans.registry import ROT13, chunk_table

NAME = "documents.parquet"
#: The SQL of stream_translate's rows.
ORACLE_SQL = f"SELECT doc_id, chunk_idx::INTEGER AS chunk_idx, {ROT13.format('chunk')} AS translation FROM ({chunk_table()})"
OUT = "doc_id long, chunk_idx int, translation string"


def run(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files: int = 1000, pattern: str | None = None, cancelled=None) -> bool:
    """Translate what has arrived in the folder ``source`` since the last run; whether it came to the end.

    ``pattern`` keeps to files of such a name. Killed runs continue, each file's rows are written once. ``cancelled`` is
    asked now and then; once it says true the stream stops, to be resumed later.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(source)
    c = F.col("chunk")
    done = chunked(rows).select("doc_id", "chunk_idx", F.when(is_blank(c), c).otherwise(rot13(c)).alias("translation"))
    stream = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not stream.awaitTermination(1 if cancelled else None):
        if not stream.isActive:
            break
        if cancelled and cancelled():
            stream.stop()
            return False
    return True


def stream_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as an available-now stream, written to the shared folder and read back."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagemill-stream-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf_dir}/{NAME}")
    # a stream reads folders: a table that is one file is the one of its name in its folder
    one = not any(f"/{NAME}/" in f for f in table.inputFiles()[:1])
    run(spark, sf_dir if one else f"{sf_dir}/{NAME}", table.schema, f"{root}/out", f"{root}/state", pattern=NAME if one else None)
    return spark.read.schema(OUT).parquet(f"{root}/out")
