"""Translation with fallback and validated refinement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, is_blank, py_strip, rot13, script_density

# An answer's length over its source's, at least and at most; the part of the source's script
# density that it must keep; the density from which on a text counts as written in the script.
LEAST_RATIO, MOST_RATIO, KEPT_DENSITY, SURE_DENSITY = 0.45, 2.50, 0.50, 0.30
# Fixed pattern: lines that small models put before an answer.
PREAMBLE = rf"(?i)^{WS}*(sure|okay|ok|certainly|here('s| is)|below is|corrected|revised|output|result|polished|edited|final)\b[^\n]{{0,120}}:{WS}*$"

#: A backend is a column expression or a Python function of a text; the registry is open.
BACKENDS: dict[str, Callable[[Column], Column]] = {"rot13": rot13}


def translated(df: DataFrame, text: str, source: str, target: str, backend: str = "rot13") -> DataFrame:
    """Adds ``translation``; blank texts and equal languages pass unchanged and never reach the backend.

    Backends here are column expressions, so one pass over the rows does; see
    backends.translated for Python ones.
    """
    skip = is_blank(F.col(text)) | F.col(source).eqNullSafe(F.col(target))
    return df.withColumn("translation", F.when(skip, F.col(text)).otherwise(BACKENDS[backend](F.col(text))))


def with_python_backend(df: DataFrame, text: str, translate: Callable[[str], str]) -> DataFrame:
    """Adds ``translation``, ``ok`` and ``error``: an exception of the backend leaves the source text of its row and is counted, not raised."""
    from pyspark.sql import types as T

    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("translation", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out, ok, error = [], [], []
            for value in b.column(at).to_pylist():
                try:
                    out.append(value if value is None or not value.strip() else translate(value))
                    ok.append(True)
                    error.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of a backend falls back to the source text
                    out.append(value)
                    ok.append(False)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(ok, pa.bool_()), pa.array(error, pa.string())], names=[*b.schema.names, "translation", "ok", "error"])

    return df.mapInArrow(run, schema)


def fallback(text: Column, answer: Column, failed: Column) -> Column:
    return F.when(failed | answer.isNull(), text).otherwise(answer)


def sanitize(raw: Column) -> Column:
    """A model's answer without scratchpad, code fence, leading preamble lines and outer quotes."""
    text = py_strip(F.regexp_replace(raw, "(?is)<think>.*?</think>", ""))
    fence = r"(?s)^```[a-zA-Z]*\n(.*?)\n?```$"
    text = F.when(text.rlike(fence), py_strip(F.regexp_extract(text, fence, 1))).otherwise(text)

    # leading preamble lines go while something stands behind them, with the blank lines after each
    def step(s, line):
        leading = ~s["body"] & (s["left"] > 1) & line.rlike(PREAMBLE)
        blank = ~s["body"] & s["after"] & is_blank(line)
        drop = leading | blank
        return F.struct(
            (~drop).alias("body"), drop.alias("after"), (s["left"] - 1).alias("left"), F.when(drop, s["kept"]).otherwise(F.array_append(s["kept"], line)).alias("kept")
        )

    lines = F.split(text, "\n")
    start = F.struct(F.lit(False).alias("body"), F.lit(False).alias("after"), F.size(lines).alias("left"), F.array().cast("array<string>").alias("kept"))
    text = py_strip(F.aggregate(lines, start, step, lambda s: F.array_join(s["kept"], "\n")))
    inner = py_strip(F.substring(text, F.lit(2), F.length(text) - 2))
    quoted = (F.length(text) >= 2) & F.substring(text, 1, 1).isin('"', "'", "“", "‘") & F.substring(text, -1, 1).isin('"', "'", "”", "’") & (inner != "")
    return F.when(quoted, inner).otherwise(text)


def refusal(original: Column, candidate: Column, script: tuple[int, int] | None = None) -> Column:
    """Why a candidate isn't plausible: empty, too_short, too_long or wrong_script; null if it is."""
    ratio = F.length(candidate) / F.greatest(F.lit(1), F.length(original))
    reason = F.when(F.coalesce(py_strip(candidate), F.lit("")) == "", "empty").when(ratio < LEAST_RATIO, "too_short").when(ratio > MOST_RATIO, "too_long")
    if script:
        before, after = script_density(original, *script), script_density(candidate, *script)
        reason = reason.when((before > SURE_DENSITY) & (after < before * KEPT_DENSITY), "wrong_script")
    return reason


def first_plausible(original: Column, candidates: Column, script: tuple[int, int] | None = None) -> Column:
    """The first candidate that isn't refused, else the original."""
    good = F.filter(candidates, lambda c: refusal(original, c, script).isNull())
    return F.coalesce(F.get(good, F.lit(0)), original)


def variants(text: Column, k: Column) -> Column:
    """The refiner's deterministic stand-in: by ``k`` mod 5 the text, nothing, a third of it, ASCII only, or three times it."""
    return (
        F.when(k % 5 == 0, text).when(k % 5 == 1, "").when(k % 5 == 2, F.substring(text, F.lit(1), F.floor(F.length(text) / 3).cast("int")))
        .when(k % 5 == 3, F.regexp_replace(text, r"[^\x00-\x7F]", "x")).otherwise(F.concat(text, text, text))
    )
