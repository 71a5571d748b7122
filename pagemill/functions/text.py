"""Text functions, all Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points of white space, as a character class that Java and RE2 read alike.
WS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SENTENCE_END = "[.!?।॥]"

#: Unicode range of the script of each target language that has one.
SCRIPT_RANGES = {"bn": (0x0980, 0x09FF)}


#: The same code points one by one: trimming by a set only looks at a text's ends.
WS_SET = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_SET))


def is_blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return c.isNull() | (py_strip(c) == "")


def needs_ocr(text: Column, has_image: Column, least: int = 25) -> Column:
    """A page whose text layer is short looks scanned if it has an image or no text at all."""
    n = F.length(py_strip(F.coalesce(text, F.lit(""))))
    return (n < least) & (F.coalesce(has_image, F.lit(False)) | (n == 0))


def ocr_coalesce(text: Column, ocr: Column, needed: Column, enabled: Column) -> Column:
    """The OCR text where it was asked for and found something, else the text layer."""
    return F.when(needed & enabled & (F.coalesce(ocr, F.lit("")) != ""), ocr).otherwise(text)


def join_lines(lines: Column) -> Column:
    """Recognised lines without blank ones, one under the other."""
    return F.array_join(F.filter(lines, lambda x: ~is_blank(x)), "\n")


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def script_density(c: Column, first: int | None, last: int | None) -> Column:
    """Share of the characters that aren't white space which lie in a script's range; null without a range, 0 without characters."""
    if first is None:
        return F.lit(None).cast("double")
    solid = F.length(F.regexp_replace(c, WS, ""))
    inside = F.length(F.regexp_replace(c, rf"[^\x{{{first:04X}}}-\x{{{last:04X}}}]", ""))
    return F.when(solid == 0, F.lit(0.0)).otherwise(inside / solid)


def sanitize_filename(name: Column) -> Column:
    """Odd characters of the stem become underscores; the suffix stays."""
    suffix = F.regexp_extract(name, r"(?s)[^/]([.][^./]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.concat(py_strip(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-. ]", "_")), suffix)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def rot13(c: Column) -> Column:
    """The deterministic stand-in for a translation backend; it keeps length and script."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, up + low, up[13:] + up[:13] + low[13:] + low[:13])
