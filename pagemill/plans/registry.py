"""The query registry and the fragments that the queries' SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import WS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str) -> DataFrame:
    """Literal rows, written as ``(..), (..) AS t(a, b)`` for both engines."""
    return spark.sql(f"SELECT * FROM VALUES {rows}")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


ROT13 = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"
class _Template(str):
    """A fragment with ``@`` for its argument (braces belong to the patterns)."""

    def format(self, x: str) -> str:
        return self.replace("@", x)


PARAGRAPHS = _Template(rf"list_filter(list_transform(string_split_regex(@, '\n{WS}*\n'), lambda p: {strip('p')}), lambda p: p <> '')")
SENTENCES = _Template(rf"string_split(regexp_replace(@, '([.!?।॥]){WS}+', '\1' || chr(1), 'g'), chr(1))")


def fold(items: str, joined: str, most: int) -> str:
    """Greedy packing of a list: a.d holds the closed pieces, a.c the open one; ``joined`` is the text of a.c and x.c."""
    shaped = f"list_transform({items}, lambda w: {{'d': []::VARCHAR[], 'c': w}})"
    step = f"CASE WHEN length({joined}) > {most} AND a.c <> '' THEN {{'d': list_append(a.d, a.c), 'c': x.c}} ELSE {{'d': a.d, 'c': {joined}}} END"
    out = f"list_reduce({shaped}, lambda a, x: {step}, {{'d': []::VARCHAR[], 'c': ''}})"
    return f"list_transform([{out}], lambda s: CASE WHEN s.c <> '' THEN list_append(s.d, s.c) ELSE s.d END)[1]"


def _joined(a: str, x: str) -> str:
    return f"CASE WHEN {a}.c = '' THEN {x}.c ELSE " + strip(f"({a}.c || ' ' || {x}.c)") + " END"


def hard_split(text: str, most: int) -> str:
    shaped = f"list_transform(string_split({text}, ' '), lambda w: {{'d': []::VARCHAR[], 'c': w}})"
    joined = _joined("b", "y")
    step = f"CASE WHEN length({joined}) > {most} AND b.c <> '' THEN {{'d': list_append(b.d, b.c), 'c': y.c}} ELSE {{'d': b.d, 'c': {joined}}} END"
    out = f"list_reduce({shaped}, lambda b, y: {step}, {{'d': []::VARCHAR[], 'c': ''}})"
    done = f"list_transform([{out}], lambda s: CASE WHEN s.c <> '' THEN list_append(s.d, s.c) ELSE s.d END)[1]"
    return f"list_transform({done}, lambda c: c[1:{most}])"


def chunk_paragraph(text: str, most: int) -> str:
    joined = _joined("a", "x")
    shaped = f"list_transform(list_filter(list_transform({SENTENCES.format(text)}, lambda s: {strip('s')}), lambda s: s <> ''), lambda w: {{'d': []::VARCHAR[], 'c': w}})"
    close = "CASE WHEN a.c <> '' THEN list_append(a.d, a.c) ELSE a.d END"
    step = (
        f"CASE WHEN length(x.c) > {most} THEN {{'d': list_concat({close}, {hard_split('x.c', most)}), 'c': ''}} "
        f"WHEN length({joined}) > {most} THEN {{'d': {close}, 'c': x.c}} ELSE {{'d': a.d, 'c': {joined}}} END"
    )
    out = f"list_reduce({shaped}, lambda a, x: {step}, {{'d': []::VARCHAR[], 'c': ''}})"
    done = f"list_transform([{out}], lambda s: CASE WHEN s.c <> '' THEN list_append(s.d, s.c) ELSE s.d END)[1]"
    return f"CASE WHEN length({text}) <= {most} THEN [{text}] ELSE {done} END"


def chunk_table(most: int = 400) -> str:
    """SQL of (doc_id, chunk_idx, chunk) of all documents."""
    return f"""
    SELECT doc_id, (k - 1)::BIGINT AS chunk_idx, c[k] AS chunk FROM (
      SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS k FROM (
        SELECT doc_id, flatten(list_transform({PARAGRAPHS.format("coalesce(text, '')")}, lambda p: {chunk_paragraph("p", most)})) AS c FROM documents))"""
