"""Numbers, durations and labels as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of job states, language names, code of each language in the OCR engine, tuning by backend.
STATUS_LABELS = {"QUEUED": "Queued", "RUNNING": "Translating", "PAUSED": "Paused", "COMPLETED": "Completed", "FAILED": "Failed", "CANCELLED": "Cancelled"}
LANGUAGES = {"en": "English", "bn": "Bengali"}
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
ACTIVE = ("QUEUED", "RUNNING", "PAUSED")
BACKENDS = {"argos": (400, 2), "google": (3000, 2)}
OCR_LANGUAGES = {"en": "en", "bn": "bn"}
RATE_LIMITED = "429|too many requests|rate limit|quota"
# Least, most and step of each tunable; without a step any value between is good.
TUNING = {
    "chunk_max_chars": (100, 800, 50), "translation_workers": (1, 6, 1), "max_file_size_mb": (10, 5000, None), "refine_block_chars": (400, 3000, 100), "refine_timeout": (15, 600, None),
    "ocr_dpi": (100, 300, 25), "online_chunk_max_chars": (500, 4500, 250), "online_translation_workers": (1, 4, 1),
}


def lookup(values: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), default)


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB of 1024, one decimal, halves to even."""
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    part = lambda a, b: F.floor(a / b).cast("string")
    rest = lambda a, b: F.pmod(a, F.lit(b)).cast("string")
    minutes = F.floor(s / 60)
    return (
        F.when(seconds.isNull(), "calculating...").when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(part(s, 60), F.lit("m "), rest(s, 60), F.lit("s")))
        .otherwise(F.concat(part(minutes, 60), F.lit("h "), rest(minutes, 60), F.lit("m")))
    )


def round_one(x: Column) -> Column:
    """A number of zero or more to one decimal, by its exact binary value, ties to even.

    What is left of the midpoint is subtracted without an error: 16 and 4 times a
    double are exact, and so are differences of numbers that near to each other.
    """
    x = x.cast("double")
    n = F.floor(x * 10)
    middle = (n + 0.5) / 10.0
    # the sign of (middle as a double) - (middle), for values that equal the double
    rest = (middle * 16.0 - (2 * n + 1)) + middle * 4.0
    up = (x > middle) | ((x == middle) & ((rest > 0) | ((rest == 0) & (n % 2 == 1))))
    return F.when(up, n + 1).otherwise(n) / 10.0


def percent(current: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), round_one(current / total * 100)))


def status_label(status: Column) -> Column:
    return lookup(STATUS_LABELS, status, F.initcap(status))


def language_label(code: Column) -> Column:
    return lookup(LANGUAGES, code, F.upper(code))


def backend(name: Column) -> Column:
    return F.when(name.isin(*BACKENDS), name).otherwise("argos")


def backend_chunk(name: Column) -> Column:
    return F.when(backend(name) == "google", BACKENDS["google"][0]).otherwise(BACKENDS["argos"][0])


def backend_workers(workers: Column) -> Column:
    return F.greatest(F.lit(1), workers)


def reject_reason(exists: Column, name: Column, megabytes: Column, pages: Column, most: int = 1024) -> Column:
    """The first check an uploaded file fails, or null."""
    return (
        F.when(~F.coalesce(exists, F.lit(False)), "not found").when(~F.lower(name).endswith(".pdf"), "not a pdf")
        .when(megabytes > most, "too large").when(megabytes <= 0, "empty").when(pages.isNull(), "could not open").when(pages == 0, "no pages")
    )


def backoff(attempts: int, limited: Column, base: float = 2.0) -> Column:
    """Delay before each retry, doubled if the endpoint limits the rate."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 2)), lambda n: F.pow(F.lit(base), n + 1) * F.when(limited, 2).otherwise(1))


def rate_limited(message: Column) -> Column:
    return F.lower(message).rlike(RATE_LIMITED)


def ocr_language(code: Column) -> Column:
    """The OCR engine's name of a language; English for those that it doesn't know."""
    return lookup(OCR_LANGUAGES, code, F.lit("en"))


def in_range(name: Column, value: Column) -> Column:
    """Whether a tunable's value is one that can be set; null for a name that isn't tunable."""
    out = F.when(F.lit(False), F.lit(False))
    for key, (least, most, step) in TUNING.items():
        good = value.between(least, most)
        out = out.when(name == key, F.coalesce(good & ((value - least) % step == 0) if step else good, F.lit(False)))
    return out


def may_start(files: Column, formats: Column, source: Column, target: Column) -> Column:
    """A job can start with files, output formats and two different languages."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return some(files) & some(formats) & ~source.eqNullSafe(target)
