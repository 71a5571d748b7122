"""Literal-row parity, properties and streaming of the translation operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagemill.functions import formats, text as X
from pagemill.operators import chunking as C
from pagemill.operators import jobs as J
from pagemill.operators import refine as R
from pagemill.plans.registry import ORACLE_SQL, QUERIES
from pagemill.sources import records
from pagemill.streaming import translate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_strip_and_blank(spark):
    values = [None, "", "   ", " ", "\u001c", "\t a\n", "a "]
    assert column(spark, values, X.is_blank) == [True, True, True, True, True, False, False]
    assert column(spark, values[5:], X.py_strip) == ["a", "a"]


def test_paragraphs_and_sentences(spark):
    assert column(spark, ["a\n\nb\n \nc\n\n\n\nd\n"], C.paragraphs) == [["a", "b", "c", "d"]]
    assert column(spark, ["A. B!C? D\nE। F॥ G"], C.sentences) == [["A.", "B!C?", "D\nE।", "F॥", "G"]]


def test_chunks(spark):
    ten = lambda c: C.chunks(c, 10)
    assert column(spark, [None, " ", "exactly 10", "a.\nb", "Aa. Bb. Cc. Dd.", "x" * 25, "Ab. " + "word " * 4, "one  two three"], ten) == [
        [], [], ["exactly 10"], ["a.\nb"], ["Aa. Bb.", "Cc. Dd."], ["x" * 10], ["Ab.", "word word", "word word"], ["one two", "three"],
    ]
    assert column(spark, ["x" * 25 + " y"], lambda c: C.hard_split(c, 10, lossless=True)) == [["x" * 10, "x" * 10, "x" * 5 + " y"]]


def test_chunks_keep_length_and_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = C.chunked(docs, most=200).groupBy("doc_id").agg(F.max(F.length("chunk")).alias("n"), F.array_join(C.in_order("chunk", "chunk_idx"), "").alias("t"))
    joined = rows.join(docs, "doc_id").select("n", F.regexp_replace("t", X.WS, "").alias("a"), F.regexp_replace("text", X.WS, "").alias("b")).collect()
    assert joined and all(r.n <= 200 and r.a == r.b for r in joined)


def test_blocks(spark):
    parts = [["aaaa", " ", "bbbbb", "c"], ["x" * 12, "y"], []]
    assert column(spark, parts, lambda c: C.blocks(c, 10), "array<string>") == [["aaaa\nbbbbb", "c"], ["x" * 12, "y"], []]


def test_request_parts(spark):
    assert column(spark, ["abc", "aaa bbb ccc", "abcdefghij"], lambda c: C.request_parts(c, 5)) == [["abc"], ["aaa", "bbb", "ccc"], ["abcde", "fghij"]]


def test_refusal(spark):
    rows = [("a" * 20, ""), ("a" * 20, "b" * 9), ("a" * 20, "b" * 8), ("a" * 20, "b" * 50), ("a" * 20, "b" * 51), ("বাংলা", "abcde"), ("abcde", "vwxyz")]
    df = spark.createDataFrame(rows, "o string, c string")
    bn = X.SCRIPT_RANGES["bn"]
    got = [r[0] for r in df.select(R.refusal(F.col("o"), F.col("c"), bn)).collect()]
    assert got == ["empty", None, "too_short", None, "too_long", "wrong_script", None]


def test_python_backend_falls_back_by_row(spark):
    def shout(t):
        if "b" in t:
            raise ValueError("no b")
        return t.upper()

    df = spark.createDataFrame([("a",), ("b",), (None,), (" ",)], "t string")
    assert [tuple(r) for r in R.with_python_backend(df, "t", shout).collect()] == [("a", "A", True, None), ("b", "b", False, "ValueError: no b"), (None, None, True, None), (" ", " ", True, None)]


def test_formats(spark):
    assert column(spark, [None, 5.9, 61.0, 3725.0], formats.duration, "double") == ["calculating...", "5s", "1m 1s", "1h 2m"]
    assert column(spark, [0, 1023, 1024, 3328], lambda c: formats.human_size(c.cast("double")), "long") == ["0.0 B", "1023.0 B", "1.0 KB", "3.2 KB"]
    assert column(spark, ["লেখা.pdf", "a/b.pdf", ".hidden"], X.sanitize_filename) == ["ল_খ_.pdf", "a_b.pdf", ".hidden"]
    assert column(spark, ["RUNNING", "odd"], formats.status_label) == ["Translating", "Odd"]


def test_needs_ocr(spark):
    df = spark.createDataFrame([("x" * 24, False), ("x" * 24, True), ("x" * 25, True), ("  ", False), (None, None)], "t string, i boolean")
    assert [r[0] for r in df.select(X.needs_ocr(F.col("t"), F.col("i"))).collect()] == [False, True, False, True, True]


def test_streaks_restart(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True, True, True])], "j int, p int, f boolean")
    rows = J.failure_streaks(df, "j", "p", F.col("f"), 3).orderBy("p").collect()
    assert [r.streak for r in rows] == [1, 2, 0, 1, 2, 3] and [r.abort for r in rows] == [False] * 5 + [True]


def test_places(spark):
    rows = [7, None, 3, 3, -1, *range(100, 3100)]
    got = {}
    for r in J.places(spark.createDataFrame([(x,) for x in rows], "id long").repartition(3), "id", ranges=16).collect():
        got.setdefault(r.id, set()).add(r.place)
    assert got == {-1: {1}, 3: {2, 3}, 7: {4}, None: {len(rows)}} | {x: {x - 95} for x in range(100, 3100)}
    assert J.places(spark.createDataFrame([], "id long"), "id").count() == 0


def test_the_whole_queue_is_in_order(spark):
    queued = QUERIES["queue_summary"](spark, SF).first().queued
    places = [r.place for r in QUERIES["queue_order_all"](spark, SF).orderBy("job_id").collect()]
    assert places == list(range(1, queued + 1))


def test_page_log_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("j1", 0, 'a "quoted"\nline'), ("j2", 3, "")], "job_id string, page long, text string")
    records.append_page_log(pages.withColumn("job_id", F.col("job_id")), str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log")).select("value")
    got = {tuple(r) for r in records.page_records(lines, "value").collect()}
    assert got == {(0, 'a "quoted"\nline'), (3, "")}


def test_documents_with_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"p0|p1")
    (tmp_path / "b.bin").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("|")

    rows = records.read_documents(spark, str(tmp_path), parse).orderBy("path", "page_num").collect()
    assert [(r.page_num, r.text, r.had_error) for r in rows] == [(0, "p0", False), (1, "p1", False), (-1, "", True)]


def test_stream_resumes(spark, tmp_path):
    schema = "doc_id long, text string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    go = lambda: translate.run(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "state"))
    put("one", [(1, "Hello there.")])
    go()
    put("two", [(2, "More.")])
    go()
    go()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0, "Uryyb gurer."), (2, 0, "Zber.")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    columns, rows = want.columns, want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(rows, key=str)


def test_entry(spark):
    assert set(entry.queries()) >= set(QUERIES) and entry.entry(spark).count() == 4
