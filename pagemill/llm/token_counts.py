"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import base64
import os
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch, slices

#: Folder of public vocabulary files; given as a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary's texts are split before they are encoded.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict = {}


def _encoder(path: str, pattern: str = PATTERN):
    """One encoder per worker process: a byte-level BPE, from its public file of ranks."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def encoded_lengths(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens), a row per row of ``docs``: the length of each whole text in tokens.

    Null and empty texts have 0; repeated rows and null ids are rows like others;
    an empty table gives an empty result; other columns are not looked at.
    """
    path = os.path.join(tokenizers, vocabulary)

    def run(batches):
        schema = arrow_schema("doc_id long, n_tokens long")
        encode = _encoder(path, pattern).encode_ordinary
        for texts, ids in slices(batches, "text", "doc_id"):
            yield batch(schema, ids, [len(encode(t.decode())) if t else 0 for t in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 4096) -> DataFrame:
    """A row for each length that occurs: n_tokens, n_docs, total_tokens, and suffix sums over longer documents too.

    ``docs_from`` and ``tokens_from`` count documents of n_tokens or more and
    their tokens; ``truncated_tokens`` is what a context limit of n_tokens keeps
    of all documents; ``docs_share_to`` is the part of documents of n_tokens or
    fewer, to nine decimals (``quantile`` ranks by the counts). The sums are made within blocks of ``block``
    lengths, then over the blocks, so no task gets all lengths. Null lengths
    are left out; an empty table gives an empty result.
    """
    h = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    h = h.withColumns({"total_tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / block)})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("total_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all")
    )
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(blocks, "block").withColumns({"docs_from": F.sum("n_docs").over(own) + F.col("d_later"), "tokens_from": F.sum("total_tokens").over(own) + F.col("t_later")})
    shorter = F.col("t_all") - F.col("tokens_from")
    return h.select(
        "n_tokens", "n_docs", "total_tokens", "docs_from", "tokens_from",
        (shorter + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        F.round((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all"), 9).alias("docs_share_to"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: limit, docs_over (documents longer than it) and kept_tokens of all documents under any context limit."""
    low = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    over = F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)
    return histogram.agg(F.lit(limit).cast("long").alias("limit"), F.coalesce(F.sum(over), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(low), F.lit(0)).alias("kept_tokens"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: q and the smallest length that at least this part of the documents doesn't exceed (null without documents).

    Ranks are compared as whole numbers; ``q`` counts as the simplest fraction
    near it, so that a third of three documents is one.
    """
    part = Fraction(q).limit_denominator(10**9)
    every = histogram.agg(F.max("docs_from")).first()[0] or 0
    least = -(-part.numerator * every // part.denominator)
    return histogram.where(F.lit(every) - F.col("docs_from") + F.col("n_docs") >= least).agg(F.lit(q).alias("q"), F.min("n_tokens").alias("n_tokens"))
