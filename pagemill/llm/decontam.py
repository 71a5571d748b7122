"""Benchmark decontamination: a distributed positional inverted index of the training tokens.

The index is dealt out by document: every shard (a slice of a partition's texts)
stores the positions of its tokens by term, for the terms that the test items
use. Phrases are answered in each shard by intersecting offset-adjusted lists
from the rarest term, so no token is shuffled and a hot term or source only makes
its own shards' lists longer. The test items go to the shards in blocks of a
checked size.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, slices, stored

WINDOW = 10
#: Bytes of test items that are sent to the shards at once; more items take more passes.
BLOCK_BYTES = 16 << 20
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).lower())
_FAR = 1 << 40


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return (text or b"").translate(_TABLE).split()


class ShardIndex:
    """Positional postings of a shard: the places of each term, sorted, as one array of ``term * _FAR + place``."""

    def __init__(self, documents: list[np.ndarray], terms: int, gap: int = 1):
        """``documents``: of each its words' numbers in a vocabulary of ``terms``, -1 for others."""
        sizes = np.array([len(d) for d in documents], np.int64)
        #: Where each document begins; ``gap`` free places between documents keep matches inside them.
        self.begins = np.r_[0, np.cumsum(sizes + gap)][:-1]
        ids = np.concatenate(documents).astype(np.int64) if documents else np.empty(0, np.int64)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(documents)) * gap, sizes)
        known = ids >= 0
        ids, place = ids[known], place[known]
        order = np.argsort(ids, kind="stable")
        self.postings = ids[order] * _FAR + place[order]
        edge = np.searchsorted(ids[order], np.arange(terms + 1))
        self.first, self.count = edge[:-1], np.diff(edge)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * _FAR + place
        at = np.searchsorted(self.postings, key)
        found = at < len(self.postings)
        found[found] = self.postings[at[found]] == key[found]
        return found & (place >= 0)

    def phrases(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each occurrence of the phrases in the rows of ``terms`` (padded with -1, ``size`` words each)."""
        none = np.iinfo(np.int64).max
        often = np.where(terms >= 0, self.count[np.maximum(terms, 0)], none)
        order = np.argsort(often, axis=1, kind="stable")  # rarest first
        live = np.flatnonzero(often.min(axis=1) > 0)
        rare = order[live, 0]
        t = terms[live, rare]
        n = self.count[t]
        phrase = np.repeat(live, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = self.postings[np.repeat(self.first[t], n) + inside] % _FAR - np.repeat(rare, n)
        for k in range(1, terms.shape[1]):
            j = order[phrase, k]
            ok = (k >= size[phrase]) | self.has(np.maximum(terms[phrase, j], 0), start + j)
            phrase, start = phrase[ok], start[ok]
        return phrase, start

    def near(self, terms: list[int], slop: int) -> list[int]:
        """Starts of the stretches of at most ``slop`` words that hold all terms: each begins at a place of one of them."""
        if any(t < 0 or not self.count[t] for t in terms):
            return []
        lists = [self.postings[self.first[t] : self.first[t] + self.count[t]] % _FAR for t in dict.fromkeys(terms)]
        begin = np.unique(np.concatenate(lists))
        for places in sorted(lists, key=len):
            at = np.searchsorted(places, begin)
            ok = at < len(places)
            ok[ok] = places[at[ok]] < begin[ok] + slop
            begin = begin[ok]
        return begin.tolist()


def _numbers(text: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    w = words(text)
    return np.fromiter((vocabulary.get(x, -1) for x in w), np.int32, len(w))


def _blocks(benchmark: DataFrame) -> list:
    """Of each block of about BLOCK_BYTES of test items: a function that reads its items that have words."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1

    def read(part: DataFrame):
        return lambda: [(r.item_id, w) for r in part.collect() if (w := words(r.text.encode()))]

    return [read(b if count == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)) for i in range(count)]


def _plan(items, window: int):
    """Vocabulary, distinct windows as rows of term ids, their sizes, and the items of each."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for item, w in items:
        ids = [vocabulary.setdefault(x, len(vocabulary)) for x in w]
        for i in range(max(1, len(ids) - window + 1)):
            owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
    terms = np.full((len(owners), window), -1, np.int64)
    for row, key in zip(terms, owners, strict=True):
        row[: len(key)] = key
    return vocabulary, terms, (terms >= 0).sum(axis=1), [sorted(o) for o in owners.values()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, then the flat columns of ``carry``) with n_words, hits (start and end word, flat) and item_ids.

    A window is ``window`` consecutive words of a test item, or all words of a
    shorter one; hits are the document's words inside any occurrence of a window.
    Null texts and texts without words have no hits; null item_ids and items
    without words take no part; repeated rows each get their own result.
    """
    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    out = docs.select(*keep, *carry, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<long>").alias("item_ids"))
    kinds = "".join(f"{c} {t.replace('bigint', 'long')}, " for c, t in docs.select(*carry).dtypes)
    ddl = f"doc_id long, text string, {kinds}n_words long, hits array<int>, item_ids array<long>"
    spark = docs.sparkSession
    blocks = _blocks(benchmark)
    for k, read in enumerate(blocks):
        plan = spark.sparkContext.broadcast(_plan(read(), window))

        def run(batches, plan=plan):
            vocabulary, terms, size, owners = plan.value
            schema = arrow_schema(ddl)
            for texts, ids, hits, found, *rest in slices(batches, "text", "doc_id", "hits", "item_ids", *carry):
                documents = [_numbers(t, vocabulary) for t in texts]
                index = ShardIndex(documents, len(vocabulary))
                phrase, start = index.phrases(terms, size) if len(terms) else (np.empty(0, np.int64),) * 2
                order = np.argsort(start, kind="stable")
                phrase, start = phrase[order], start[order]
                own = np.searchsorted(index.begins, start, "right") - 1
                for d in np.unique(own).tolist():
                    mine = slice(*np.searchsorted(own, [d, d + 1]))
                    at = start[mine] - index.begins[d]
                    hits[d] = _merge(hits[d], at, at + size[phrase[mine]])
                    found[d] = sorted({*found[d], *(i for p in phrase[mine].tolist() for i in owners[p])})
                yield batch(schema, ids, [None if t is None else t.decode() for t in texts], *rest, [len(d) for d in documents], hits, found)

        if k + 1 < len(blocks):  # a block's pass ends before the next block is sent
            out = stored(out.mapInArrow(run, ddl), "pass")
            plan.unpersist()
        else:
            out = out.mapInArrow(run, ddl)
    return out


def _merge(flat: list[int], start: np.ndarray, end: np.ndarray) -> list[int]:
    runs: list[list[int]] = []
    for a, b in sorted([*zip(flat[::2], flat[1::2], strict=True), *zip(start.tolist(), end.tolist(), strict=True)]):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [x for r in runs for x in r]


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, phrases: list[str], slop: int) -> DataFrame:
    """(doc_id, query, at): places in each text where a stretch of at most ``slop`` words holds all words of a query.

    ``at`` counts words from 0. Queries without words match nothing.
    """
    queries = [[w for w in words(p.encode())] for p in phrases]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for q in queries for w in q))}

    def run(batches):
        schema = arrow_schema("doc_id long, query int, at int")
        for texts, ids in slices(batches, "text", "doc_id"):
            index = ShardIndex([_numbers(t, vocabulary) for t in texts], len(vocabulary), gap=max(1, slop))
            for k, q in enumerate(queries):
                at = np.array(index.near([vocabulary[w] for w in q], slop) if q else [], np.int64)
                own = np.searchsorted(index.begins, at, "right") - 1
                yield batch(schema, [ids[d] for d in own.tolist()], [k] * len(at), (at - index.begins[own]).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, query int, at int")


def hit_hash(item_ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()
