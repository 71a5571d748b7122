"""Stores, checks, backends and exact rounding of the translation operators, on literal rows."""

import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import formats
from pagemill.operators import backends, chunking as C, jobs as J, refine as R
from pagemill.sources import records
from pagemill.streaming import translate

SF = "/root/testdata/sf0.001"


def test_round_one_is_exact(spark):
    values = [0.0, 0.25, 0.35, 0.45, 0.75, 0.05, 0.15, 2.675, 33.333333, 99.95, 1234.5, 0.25000000000000006, 0.24999999999999997, 0.1, 12.5 / 7] + [k / 40 for k in range(200)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(formats.round_one(F.col("v"))).collect()]
    assert got == [round(v, 1) for v in values]


def test_percent(spark):
    rows = [(c, t) for t in (0, 1, 3, 7, 60, 400, 2000) for c in range(0, 2100, 7)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", formats.percent(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r.p == (0.0 if r.t <= 0 else min(100.0, round(r.c / r.t * 100, 1))) for r in got)


def test_eta_windows_restart(spark):
    rows = [(1, 0, i, float(i)) for i in range(20)] + [(1, 1, i, 5.0) for i in range(20, 30)]
    got = {r.page: r.eta_seconds for r in J.eta(spark.createDataFrame(rows, "job long, run int, page long, s double"), ["job", "run"], "page", "s", F.lit(29)).collect()}
    assert got[20] == 45.0 and got[19] == round(sum(range(8, 20)) / 12 * 10, 1) and got[29] == 0.0


def test_upsert_keeps_the_last_new_row(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, status string")
    new = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (3, "z", 0)], "job_id long, status string, seq int")
    assert sorted(map(tuple, J.upsert(old, new, "job_id", "seq").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert J.cleared(old).count() == 0 and [r.job_id for r in J.forget(old, new).collect()] == [1]


def test_search_for_nothing_finds_all(spark):
    names = spark.createDataFrame([("a",), ("B",), (None,)], "n string")
    assert J.search(names, "n", "  ").count() == 2 and J.search(names, "n", "b").count() == 1


def test_shown_jobs(spark):
    jobs = spark.createDataFrame([(1, 10, "QUEUED", 1), (1, 11, "RUNNING", 2), (1, 12, "QUEUED", 3), (2, 20, "FAILED", 1), (2, 21, "QUEUED", 2), (3, 30, "FAILED", 1), (3, 31, "QUEUED", 2)], "owner long, job_id long, status string, added int")
    viewed = spark.createDataFrame([(1, 10), (2, 20), (3, 99), (4, 1)], "owner long, job_id long")
    assert sorted(map(tuple, J.shown_jobs(jobs, viewed, "owner").collect())) == [(1, 11, "active"), (2, 20, "viewed"), (3, 31, "latest")]


def test_json_stores(spark, tmp_path):
    entries = spark.createDataFrame([(1, "a.pdf"), (2, "b\"c.pdf")], "job_id long, filename string")
    records.write_history(entries, f"{tmp_path}/h")
    records.write_history(entries, f"{tmp_path}/h")
    assert sorted(map(tuple, records.read_history(spark, f"{tmp_path}/h", "job_id bigint, filename string").collect())) == [(1, "a.pdf"), (2, 'b"c.pdf')]
    for name, text in (("torn", '[{"job_id": 1,'), ("object", '{"job_id": 1}'), ("empty", "")):
        (tmp_path / name).write_text(text)
        assert records.read_history(spark, f"{tmp_path}/{name}", "job_id bigint, filename string").count() == 0
    (tmp_path / "s").write_text('{"a": 1, "b": null, "c": "x"}')
    defaults = spark.createDataFrame([("a", "0"), ("b", "2"), ("d", "4")], "key string, value string")
    assert dict(J.overlay(defaults, records.read_settings(spark, f"{tmp_path}/s")).collect()) == {"a": "1", "b": None, "c": "x", "d": "4"}
    assert dict(J.overlay(defaults, records.read_settings(spark, f"{tmp_path}/torn")).collect()) == {"a": "0", "b": "2", "d": "4"}


def test_checkpoint_folders(spark, tmp_path):
    pages = spark.createDataFrame([(7, 0, "a"), (7, 1, "b"), (8, 0, "c")], "job_id long, page long, text string")
    records.append_page_log(pages, f"{tmp_path}/log")
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["job_id=7", "job_id=8"]
    for job, name in (("a", "checkpoint.json"), ("b", "pages.jsonl")):
        (tmp_path / "c" / job).mkdir(parents=True)
        (tmp_path / "c" / job / name).write_text('{"page": 0, "text": "x"}\n')
    assert [r.job_id for r in records.list_checkpoints(spark, f"{tmp_path}/c").collect()] == ["a"]
    assert [tuple(r) for r in records.read_page_log(spark, f"{tmp_path}/c").collect()] == [("b", 0, "x")]


def test_reassembled_orders_by_page_then_time(spark):
    rows = [(1, 1, 0, "b"), (1, 0, 1, "a2"), (1, 0, 0, "a"), (2, 0, 0, "z")]
    got = C.reassembled(spark.createDataFrame(rows, "k long, page long, seq long, t string"), "k", "page", "seq", "t", "|")
    assert dict(got.collect()) == {1: "a|a2|b", 2: "z"}


def test_document_rows(spark):
    pages = spark.createDataFrame([(1, 0, "a\n \nb"), (1, 1, " "), (2, 3, None)], "k long, page_num long, text string")
    rows = [tuple(r) for r in C.document_rows(pages, "k", F.lit("t")).orderBy("k", "page_num", "seq").collect()]
    empty = "[No extractable text on this page]"
    assert rows == [
        (1, -1, 0, "title", "t"), (1, 0, 1, "label", "Page 1"), (1, 0, 2, "paragraph", "a"), (1, 0, 3, "paragraph", "b"), (1, 1, 0, "break", ""), (1, 1, 1, "label", "Page 2"),
        (1, 1, 2, "paragraph", empty), (2, -1, 0, "title", "t"), (2, 3, 1, "label", "Page 4"), (2, 3, 2, "paragraph", empty),
    ]


def test_requests_are_joined_with_spaces(spark):
    t = spark.createDataFrame([("aaa bbb  ccc",), ("abc",), (None,)], "t string")
    assert [r[0] for r in t.select(C.requested(F.col("t"), F.upper, 5)).collect()] == ["AAA BBB  CCC", "ABC", None]  # a piece keeps the first of two spaces


def test_chunks_of_a_very_long_text(spark):
    text = "word and another. " * 1_100_000  # 20 MB
    start = time.time()
    n, longest = spark.createDataFrame([(1, text)], "doc_id long, text string").select(C.chunks(F.col("text")).alias("c")).select(F.size("c"), F.array_max(F.transform("c", F.length))).first()
    assert longest <= 400 and n > 40_000 and time.time() - start < 60
    parts = spark.createDataFrame([("a " * 5_000_000,)], "t string").select(F.size(C.request_parts(F.col("t")))).first()[0]
    assert parts > 2000


class Upper:
    made = 0

    def translate(self, text, source, target):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    def is_pair_available(self, source, target):
        return True

    def health(self):
        return backends.probe(self)


def test_python_backends(spark):
    def make():  # made in each worker
        class Local:
            def translate(self, text, source, target):
                if text == "bad":
                    raise ValueError("no")
                return text.upper()

        return Local()

    df = spark.createDataFrame([("a",), ("bad",), (" ",), (None,)], "t string")
    got = sorted((tuple(r) for r in backends.translated(df, "t", "en", "bn", "upper", make).collect()), key=str)
    assert got == sorted([("a", "A", True, None), ("bad", "bad", False, "ValueError: no"), (" ", " ", True, None), (None, None, True, None)], key=str)
    assert [r.translation for r in backends.translated(df, "t", "bn", "bn", "upper", make).collect()] == ["a", "bad", " ", None]
    assert Upper().health() == (True, "HELLO") and backends.probe(Upper(), "bad") == (False, "ValueError: no") and backends.probe(Upper(), " ") == (False, "empty answer")
    assert backends.per_worker("k", list) is backends.per_worker("k", list)


def test_throttle():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    t = backends.Throttle(0.15, clock=lambda: now[0], sleep=sleep)
    t.wait()
    now[0] += 0.05
    t.wait()
    now[0] += 1
    t.wait()
    assert slept == [0.1]


def test_translated_reads_once(spark):
    df = spark.createDataFrame([("ab", "en", "bn"), (" ", "en", "bn"), ("ab", "bn", "bn"), (None, "en", "bn")], "t string, s string, d string")
    out = R.translated(df, "t", "s", "d")
    assert [r.translation for r in out.collect()] == ["no", " ", "ab", None]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_stream_stops_and_goes_on(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(6).write.parquet(f"{tmp_path}/in")
    run = lambda **k: translate.run(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/state", files=1, **k)
    run(cancelled=lambda: True)
    assert run() is True
    want = translate.stream_translate(spark, SF)
    assert sorted(map(tuple, spark.read.schema(translate.OUT).parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["queue_order", "refine_summary", "reassemble_pages", "assemble_txt"])
def test_whole_tables_without_a_gathering_task(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    if name == "queue_order":
        assert "job_id <= 2000" not in entry.oracle_sql()[name]
    else:
        assert "Exchange" not in plan
