"""Translation backends that are Python objects: one per worker process, probed before use, held to a rate."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .refine import with_python_backend


class Backend(Protocol):
    """What a backend offers; ``health`` never raises."""

    def translate(self, text: str, source: str, target: str) -> str: ...

    def is_pair_available(self, source: str, target: str) -> bool: ...

    def health(self) -> tuple[bool, str]: ...


_MADE: dict = {}


def per_worker(key, make: Callable[[], object]):
    """The object that ``make`` gives, made once per worker process and key: models load once, not once a batch."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


class Throttle:
    """At least ``interval`` seconds between the starts of requests of this process."""

    def __init__(self, interval: float, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.interval - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()


def probe(backend: Backend, sample: str = "Hello", source: str = "en", target: str = "bn") -> tuple[bool, str]:
    """(usable, detail) of a translation of one sample; whatever goes wrong is told, not raised."""
    try:
        answer = backend.translate(sample, source, target)
        return (True, answer) if answer and answer.strip() else (False, "empty answer")
    except Exception as e:  # noqa: BLE001 - the probe reports any failure
        return False, f"{type(e).__name__}: {e}"


def translated(df: DataFrame, text: str, source: str, target: str, key: str, make: Callable[[], Backend]) -> DataFrame:
    """Adds ``translation``, ``ok`` and ``error`` by the backend that ``make`` gives in each worker.

    Blank texts and rows whose two languages are equal never reach it: the parts
    are filtered and united, since ``when`` doesn't keep rows from a Python
    function. ``source`` and ``target`` are language codes, the same for all rows.
    """
    if source == target:
        return df.withColumns({"translation": F.col(text), "ok": F.lit(True), "error": F.lit(None).cast("string")})
    skip = is_blank(F.col(text))
    same = df.where(skip).withColumns({"translation": F.col(text), "ok": F.lit(True), "error": F.lit(None).cast("string")})
    return same.unionByName(with_python_backend(df.where(~skip), text, lambda t: per_worker(key, make).translate(t, source, target)))
