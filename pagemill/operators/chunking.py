"""Splitting pages into chunks and joining chunks into blocks.

Greedy packing is one pass over a text that remembers only the open piece. As a
fold over an array in Catalyst it is interpreted and copies the closed pieces at
each step; here it is an Arrow function, linear in the text. The splits that need
no memory (paragraphs, sentences, lines) are Catalyst expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, WS, WS_SET, is_blank, py_strip

MAX_CHARS = 400
_SPACE = f"[{re.escape(WS_SET)}]"
_PARAGRAPH = re.compile(rf"\n{_SPACE}*\n")
_SENTENCE = re.compile(f"(?<={SENTENCE_END}){_SPACE}+")


def _lists(value: Column, split) -> Column:
    """The column of ``split``'s lists, batch by batch; null for null."""

    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else split(v) for v in values.to_pylist()], pa.list_(pa.string()))

    return run(value)


def pack(parts: list[str], most: int, joined) -> list[str]:
    """Parts joined greedily while they have at most ``most`` characters; a longer part is a piece of its own."""
    out, cur = [], ""
    for part in parts:
        both = joined(cur, part) if cur else part
        if cur and len(both) > most:
            out.append(cur)
            both = part
        cur = both
    return [*out, cur] if cur else out


def _spaced(a: str, b: str) -> str:
    return f"{a} {b}".strip()


def _words(text: str, most: int, lossless: bool) -> list[str]:
    words = text.split(" ")
    if lossless:
        words = [w[i : i + most] for w in words for i in range(0, max(1, len(w)), most)]
    return [piece[:most] for piece in pack(words, most, _spaced)] or [text[:most]]


def _packed(paragraph: str, most: int) -> list[str]:
    if len(paragraph) <= most:
        return [paragraph]
    out, short = [], []
    for sentence in filter(None, map(str.strip, _SENTENCE.split(paragraph))):
        if len(sentence) <= most:
            short.append(sentence)
            continue
        out += [*pack(short, most, _spaced), *_words(sentence, most, False)]
        short = []
    return out + pack(short, most, _spaced)


def _chunked(text: str, most: int) -> list[str]:
    return [piece for p in map(str.strip, _PARAGRAPH.split(text)) if p for piece in _packed(p, most)]


def _requests(text: str, most: int) -> list[str]:
    out, at = [], 0
    while at < len(text):
        stop = len(text)
        if stop - at > most:
            stop = text.rfind(" ", at, at + most)
            stop = stop if stop > at else at + most
        out.append(text[at:stop])
        at = stop
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty paragraphs; a blank line parts them."""
    return F.filter(F.transform(F.split(text, rf"\n{WS}*\n"), py_strip), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Parts after closing punctuation and white space; the punctuation stays."""
    return F.split(paragraph, f"(?<={SENTENCE_END}){WS}+")


def hard_split(text: Column, most: int = MAX_CHARS, lossless: bool = False) -> Column:
    """Greedy pieces of at most ``most`` characters, cut at spaces; null for null.

    A longer word is truncated, as in the behaviour matched here, or with
    ``lossless`` cut into several pieces.
    """
    return _lists(text, lambda t: _words(t, most, lossless))


def chunk_paragraph(paragraph: Column, most: int = MAX_CHARS) -> Column:
    """Sentences packed greedily; a short paragraph stays as it is, a long sentence is cut at spaces; null for null."""
    return _lists(paragraph, lambda t: _packed(t, most))


def chunks(text: Column, most: int = MAX_CHARS) -> Column:
    """A page's chunks, in order; null and blank pages have none."""
    return _lists(F.coalesce(text, F.lit("")), lambda t: _chunked(t, most))


def chunked(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """(key, chunk_idx, chunk): one row for each chunk, without a shuffle."""
    return df.select(key, F.posexplode(chunks(F.col(text), most)).alias("chunk_idx", "chunk"))


def blocks(parts: Column, most: int) -> Column:
    """Chunks joined by line breaks while they fit; blank and null chunks are left out, none is split."""
    return _lists(parts, lambda p: pack([c for c in p if c and c.strip()], most, lambda a, b: f"{a}\n{b}"))


def request_parts(text: Column, most: int = 4800) -> Column:
    """Pieces of an oversize request: cut at the last space within ``most`` characters, else there; the rest is stripped on the left."""
    return _lists(text, lambda t: _requests(t, most))


def requested(text: Column, translate, most: int = 4800) -> Column:
    """An oversize text translated piece by piece; the pieces' translations are joined with a space."""
    return F.array_join(F.transform(request_parts(text, most), translate), " ")


def page_paragraphs(text: Column, placeholder: str = "[No extractable text on this page]") -> Column:
    """Non-blank lines of a page, or a placeholder for a blank page."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~is_blank(x))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(placeholder)))


def in_order(value: str, *order: str) -> Column:
    """Aggregate: the values of a group as an array, in an explicit order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])


def reassembled(pages: DataFrame, key: str, page: str, seq: str, text: str, sep: str) -> DataFrame:
    """(key, text): stored pages of each key joined in the order of page, then of ``seq`` for pages that were written again."""
    return pages.groupBy(key).agg(F.array_join(in_order(text, page, seq), sep).alias(text))


def document_rows(pages: DataFrame, key: str, title: Column) -> DataFrame:
    """(key, page_num, seq, kind, text): what a built document holds, in the order of page_num and seq.

    ``pages``: key, page_num from 0, text; one row a page. A title (page_num -1),
    then of each page a break (but before the first), its label, its non-blank
    lines or a placeholder. Null texts are blank pages.
    """
    item = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    label = F.concat(F.lit("Page "), (F.col("page_num") + 1).cast("string"))
    lines = F.transform(page_paragraphs(F.col("text")), lambda x, i: F.struct((i + 2).cast("long").alias("seq"), F.lit("paragraph").alias("kind"), x.alias("text")))
    first = pages.groupBy(key).agg(F.min("page_num").alias("first"))
    heads = first.select(key, F.lit(-1).cast("long").alias("page_num"), item(0, "title", title).alias("r"))
    breaks = pages.select(key, "page_num").join(first, key).where("page_num > first").select(key, "page_num", item(0, "break", F.lit("")).alias("r"))
    own = pages.select(key, "page_num", F.explode(F.concat(F.array(item(1, "label", label)), lines)).alias("r"))
    return heads.unionByName(breaks).unionByName(own).select(key, "page_num", "r.seq", "r.kind", "r.text")
