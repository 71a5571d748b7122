"""Suffix dedup: whether the longest previous factor has a fixed length or more, over the repeated parts of a corpus.

A suffix whose longest previous factor has ``length`` bytes or more starts a
passage that was seen before. One suffix array of a whole corpus can't be dealt
over a cluster, so suffixes are first dealt out by content: every string of
``length`` bytes (a window) belongs to its *anchor*, the substring of half that
length with the smallest hash. Equal windows have equal anchors at equal
offsets, so all matches of a suffix lie in the group of its anchor, and anchors
that occur once need no further look. Neighbouring windows with one anchor
travel as one span; equal spans (by two 64-bit hashes, of the anchor and of the
whole span) are one class; the distinct spans of an anchor are sorted as suffixes,
with the common prefixes of neighbours, and the previous and next smaller
positions in suffix order give each suffix its longest previous factor, up to
``length``. A suffix whose factor reaches ``length`` has an earlier match there.

An anchor with very many distinct spans (a passage that a large part of the
documents quote) is dealt out over several tasks, which exchange their distinct
windows' hashes, counted before they are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, arrow_schema, as_bytes, batch, byte_runs, mix64, slices, stored

LENGTH = 400
#: Distinct spans of one anchor that are sorted by one task; more are dealt out.
GROUP = 1024
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_INVERSE = pow(_BASE, -1, 1 << 64)
_NULL = -(1 << 63)


def suffix_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks) by prefix doubling: of each position, the rank of its next 1, 2, 4, ... up to ``length`` values (0 to 256)."""
    n = len(data)
    rank, width = data.astype(np.int64), 1
    levels = [(1, data.astype(np.int16))]
    while 2 * width <= length:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        rank = (rank << 9) | after if width < 2 else rank * (1 << 18 if width < 4 else n) + after
        width *= 2
        if width >= 4:  # up to two values are their own key
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        levels.append((width, rank.astype(np.int32)))
    return levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Of pairs of positions: how many values they have in common from there on, ``length`` at most."""
    out, last = np.zeros(len(x), np.int64), len(levels[0][1]) - 1
    for width, rank in reversed(levels):
        same = rank[np.minimum(x + out, last)] == rank[np.minimum(y + out, last)]
        out += width * (same & (out + width <= length))
    return out


def _previous_smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Of each suffix, in suffix order: the common prefix with the last one before it that has a smaller place.

    ``lcp`` is that with the one just before. All suffixes look for theirs at
    once and jump to what those that they meet have found so far.
    """
    at, common = np.arange(len(place)) - 1, lcp.copy()
    common[:1] = 0
    going = np.flatnonzero(common > 0)
    going = going[place[at[going]] > place[going]]
    while len(going):
        met = at[going]
        nearest, shared = at[met], np.minimum(common[going], common[met])
        at[going], common[going] = nearest, np.where(nearest < 0, 0, shared)
        going = going[(common[going] > 0) & (place[nearest] > place[going])]
    return common


def previous_factors(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The LPF array in suffix order: the longer of the matches with the previous and the next suffix of smaller place."""
    before = _previous_smaller(place, lcp)
    behind = _previous_smaller(place[::-1], np.r_[0, lcp[:0:-1]])[::-1]
    return np.maximum(before, behind)


def longest_previous_factor(text: bytes) -> np.ndarray:
    """The LPF array of a text: of each position, the longest match that starts earlier."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    # behind the end stand zeros, which no byte equals
    levels = suffix_levels(np.r_[np.frombuffer(text, np.uint8).astype(np.int16) + 1, np.zeros(n, np.int16)], n)
    width, rank = levels[-1]
    order = np.lexsort((rank[np.arange(n) + n - width], rank[:n]))
    lcp = np.r_[0, common_prefixes(levels, order[:-1], order[1:], n)]
    out = np.empty(n, np.int64)
    out[order] = previous_factors(order, lcp)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def _min_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - w + span], x[w - span :]) if w > span else x


def anchors(texts: list[bytes], length: int):
    """(text index, anchor position, first window, last window) arrays of all windows of some texts, by anchor."""
    k = length // 2
    pieces = [(i, o) for i, t in enumerate(texts) if len(t) >= length for o in range(0, len(t) - length + 1, _PIECE - length)]
    while pieces:
        part, held = [], 0
        while pieces and (not part or held + len(texts[pieces[0][0]]) <= _PIECE):
            i, o = pieces.pop(0)
            piece = texts[i][o : o + _PIECE - 1] if len(texts[i]) >= _PIECE else texts[i]
            part.append((i, o, piece))
            held += len(piece)
        data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        ends = sizes.cumsum()
        power, inverse = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        total = np.r_[np.uint64(0), np.add.accumulate(_BYTES[data] * power)]
        n = len(data) - k + 1
        # rolling hash of each k bytes, brought to power 0 so that equal bytes have equal hashes everywhere
        h = mix64((total[k:] - total[:-k]) * inverse[:n])
        at = _min_in_windows((h & ~np.uint64(_PIECE - 1)) | np.arange(n, dtype=np.uint64), length - k + 1) & np.uint64(_PIECE - 1)
        at = at.astype(np.int64)
        start = np.arange(len(at))
        owner = np.searchsorted(ends, start, "right")
        good = start + length <= ends[owner]
        first = np.flatnonzero(good & np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~good[:-1]])
        last = np.flatnonzero(good & np.r_[(at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~good[1:], True])
        own = owner[first]
        shift = np.array([p[1] for p in part])[own] - (ends - sizes)[own]
        yield np.array([p[0] for p in part])[own], at[first] + shift, first + shift, last + shift


def _base(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, the text's key (k1, k2), n_bytes and the SHA-256 of the whole text."""
    ddl = "doc_id long, k1 long, k2 long, n_bytes long, sha string"

    def run(batches):
        schema = arrow_schema(ddl)
        for texts, ids in slices(batches, "text", "doc_id"):
            texts = [t or b"" for t in texts]
            keys = [_key(t) for t in texts]
            yield batch(schema, ids, [k[0] for k in keys], [k[1] for k in keys], [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts])

    return _rows(docs).mapInArrow(run, ddl)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _key(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """A row for each run of windows with one anchor: fp (the anchor's hash), sh (the span's), node (the text's k1), doc, p, a, b."""
    ddl = "fp long, sh long, node long, doc long, p int, a int, b int"

    def run(batches):
        schema = arrow_schema(ddl)
        digest, k = xxhash.xxh3_64_intdigest, length // 2
        for texts, ids in slices(batches, "text", "doc_id"):
            texts = [t or b"" for t in texts]
            nodes = np.array([_key(t)[0] for t in texts], np.int64)
            ids = np.array([_NULL if i is None else i for i in ids], np.int64)
            for own, p, a, b in anchors(texts, length):
                where = list(zip(own.tolist(), p.tolist(), a.tolist(), b.tolist(), strict=True))
                fp = np.array([digest(texts[i][q : q + k]) for i, q, _, _ in where], np.uint64).view(np.int64)
                sh = np.array([digest(texts[i][x : y + length]) for i, _, x, y in where], np.uint64).view(np.int64)
                yield batch(schema, fp, sh, nodes[own], ids[own], p.astype(np.int32), a.astype(np.int32), b.astype(np.int32))

    return _rows(docs).mapInArrow(run, ddl)


def _cut(batches, length: int):
    """Rows of a document with its wanted spans, to a row for each span with its bytes."""
    schema = arrow_schema(_CUT)
    for texts, ids, nodes, wanted in slices(batches, "text", "doc", "node", "wanted"):
        out = []
        for text, doc, node, spans in zip(texts, ids, nodes, wanted, strict=True):
            if text is None or _key(text)[0] != node:
                continue  # another text under the same doc_id
            out += [(s["fp"], s["lot"], s["n"], doc, node, s["p"], s["a"], s["b"], text[s["a"] : s["b"] + length]) for s in spans]
            if len(out) > 4096:
                yield batch(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield batch(schema, *zip(*out, strict=True))


_CUT = "fp long, lot int, n long, doc long, node long, p int, a int, b int, bytes binary"
_FOUND = "node long, s0 int, s1 int"
_OPEN = "fp long, wh long, cnt long, doc long, node long, s int"


def _sorted_groups(batches, length: int, keep: str, crowded: bool):
    """Suffix order and previous factors of each (anchor, lot), several groups at a time.

    Yields runs of window starts to remove (_FOUND), or for crowded anchors each
    distinct window of a lot with its count and first place (_OPEN).
    """

    def solve(rows):
        data = np.frombuffer(b"".join(r[8] for r in rows), np.uint8)
        count = np.array([r[7] - r[6] + 1 for r in rows])
        base = np.r_[0, np.cumsum([len(r[8]) for r in rows])[:-1]]
        span = np.repeat(np.arange(len(rows)), count)
        inside = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
        at = base[span] + inside
        group = np.unique(np.array([(r[0], r[1]) for r in rows], np.int64), axis=0, return_inverse=True)[1].reshape(-1)[span]
        doc = np.array([r[3] for r in rows], np.int64)[span]
        node = np.array([r[4] for r in rows], np.int64)[span]
        start = np.array([r[6] for r in rows], np.int64)[span] + inside
        many = np.array([r[2] for r in rows], np.int64)[span]
        place = np.empty(len(at), np.int64)
        place[np.lexsort((start, node, doc))] = np.arange(len(at))
        levels = suffix_levels(data, length)
        width, rank = levels[-1]
        order = np.lexsort((place, rank[at + length - width], rank[at], group))
        lcp = np.r_[0, common_prefixes(levels, at[order[:-1]], at[order[1:]], length) * (group[order[1:]] == group[order[:-1]])]
        if keep == "first":
            again = previous_factors(place[order], lcp) >= length
        else:  # another place, earlier or later; classes of several spans are settled as such
            again = (np.maximum(previous_factors(place[order], lcp), previous_factors(-place[order], lcp)) >= length) & (many[order] == 1)
        found = _runs(np.sort(order[again]), span, start, node)
        if not crowded:
            return None, found
        # what is repeated within the lot is settled here; of each distinct window the lots exchange the first place
        head = np.flatnonzero(lcp < length)
        lead, raw = order[head], data.tobytes()
        wh = np.array([xxhash.xxh3_64_intdigest(raw[x : x + length]) for x in at[lead].tolist()], np.uint64).view(np.int64)
        fp = np.array([r[0] for r in rows], np.int64)[span[lead]]
        return (fp, wh, np.add.reduceat(many[order], head), doc[lead], node[lead], start[lead].astype(np.int32)), found

    def emit(rows):
        opened, found = solve(rows)
        if crowded:
            nothing = [None] * len(found[0])
            yield batch(both, *opened, [None] * len(opened[0]), [None] * len(opened[0]))
            yield batch(both, nothing, nothing, nothing, nothing, found[0], nothing, found[1], found[2])
        else:
            yield batch(schema, *found)

    schema, both = arrow_schema(_FOUND), arrow_schema(f"{_OPEN}, s0 int, s1 int")
    rows, held, last = [], 0, ()
    for b in batches:
        columns = [c.to_pylist() for c in b.columns[:8]] + [as_bytes(b.column(8))]
        for r in zip(*columns, strict=True):
            if held > _PIECE and last[:2] != r[:2]:
                yield from emit(rows)
                rows, held = [], 0
            if last == (this := (r[0], r[1], r[4], r[6])):
                continue  # two rows of one document and text give each span twice
            rows.append(r)
            held += len(r[8])
            last = this
    if rows:
        yield from emit(rows)


def _runs(hit, span, start, node):
    """Sorted suffix numbers to (node, first start, last start) of runs within a span."""
    if not len(hit):
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    cut = np.r_[True, (np.diff(hit) != 1) | (span[hit][1:] != span[hit][:-1])]
    first, last = hit[cut], hit[np.r_[cut[1:], True]]
    return node[first], start[first].astype(np.int32), start[last].astype(np.int32)


def _removed_runs(docs: DataFrame, length: int, keep: str) -> DataFrame:
    """(node, s0, s1): runs of window starts to remove in the text of key ``node`` (that of its first document, in mode "first")."""
    spans = _spans(docs, length)
    place = F.struct("node", "a")
    # a table of its own: the join below can split a hot anchor only if neither side is aggregated in its stage
    twice = spans.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp")
    twice = stored(twice, "twice")
    # grouped by fp ^ sh, which tells fp as sh is a key too: grouping by fp itself would run in the join's task,
    # so that a passage of very many documents stayed whole there; so the join can be split and copies meet map-side
    mixed = F.col("fp").bitwiseXOR(F.col("sh")).alias("mix")
    spans = spans.join(twice, "fp").groupBy(mixed, "sh", "node", "p", "a", "b").agg(F.min("doc").alias("doc"))
    spans = spans.select(F.col("mix").bitwiseXOR(F.col("sh")).alias("fp"), "sh", "node", "p", "a", "b", "doc")
    spans = stored(spans, "spans")
    same = ["fp", "sh", "off", "len"]
    spans = spans.withColumns({"off": F.col("p") - F.col("a"), "len": F.col("b") - F.col("a")})
    classes = spans.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc", "node", "p", "a", "b")).alias("f"))
    classes = stored(classes, "classes")
    kinds = classes.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # all members of a class go but one, or none: those that stay are known from the classes and are taken away by place,
    # so no span is joined with its class and the copies of a passage don't come together
    stay = classes if keep == "first" else classes.where("n = 1")
    stay = stay.select("f.node", "f.a", "f.b", F.lit(True).alias("stays"))
    again = spans.select("node", "a", "b", F.lit(False).alias("stays")).union(stay)
    again = again.groupBy("node", F.col("a").alias("s0"), F.col("b").alias("s1")).agg(F.max("stays").alias("stays"))
    again = again.where("not stays").drop("stays")
    wanted = classes.join(kinds, "fp").withColumn("lots", F.ceil(F.col("kinds") / GROUP).cast("int"))
    lot = F.pmod(F.xxhash64("sh", "off", "len"), F.col("lots")).cast("int").alias("lot")
    wanted = wanted.select(F.col("f.doc").alias("doc"), F.col("f.node").alias("node"), F.struct("fp", lot, "n", "f.p", "f.a", "f.b", "lots").alias("s"))
    wanted = wanted.groupBy("doc", "node").agg(F.collect_list("s").alias("wanted"))
    texts = _rows(docs).select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), "text")
    crowded = stored(kinds.where(F.col("kinds") > GROUP).select("fp"), "crowded")

    def cut(batches):
        yield from _cut(batches, length)

    found = again
    # one plan from here on, so that the dealt-out texts are shuffled once for all that reads them
    pieces = texts.join(wanted, "doc").select("text", "doc", "node", "wanted").mapInArrow(cut, _CUT)
    groups = lambda df: df.repartition("fp", "lot").sortWithinPartitions("fp", "lot", "node", "a")
    if not crowded.take(1):
        return found.union(groups(pieces).mapInArrow(lambda it: _sorted_groups(it, length, keep, False), _FOUND))
    calm, busy = pieces.join(crowded, "fp", "left_anti"), pieces.join(crowded, "fp", "left_semi")
    found = found.union(groups(calm).mapInArrow(lambda it: _sorted_groups(it, length, keep, False), _FOUND))
    opened = groups(busy).mapInArrow(lambda it: _sorted_groups(it, length, keep, True), f"{_OPEN}, s0 int, s1 int")
    found = found.union(opened.where("s0 is not null").select("node", "s0", "s1"))
    opened = opened.where("fp is not null")
    first = F.min(F.struct("doc", "node", "s")).alias("f")
    every = opened.groupBy("fp", "wh").agg(F.sum("cnt").alias("total"), first).where("total > 1")
    back = opened.join(every, ["fp", "wh"])
    back = back.where("cnt = 1") if keep == "none" else back.where("not (doc = f.doc and node = f.node and s = f.s)")
    return found.union(back.select("node", F.col("s").alias("s0"), F.col("s").alias("s1")))


def _covered(runs, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows starting in the runs cover."""
    out: list[list[int]] = []
    for s0, s1 in sorted((r["s0"], r["s1"]) for r in runs):
        if out and s0 <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s1 + length)
        else:
            out.append([s0, s1 + length])
    return [(x, y) for x, y in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end byte, flat), kept, sha (of the whole text).

    Texts count as UTF-8 bytes, matches don't cross documents. ``keep="none"``
    removes each byte that is covered by a string of ``length`` bytes which also
    starts anywhere else; ``keep="first"`` leaves the first place of each string,
    in the order of doc_id and position. ``kept`` holds the bytes that are left,
    and is null where nothing is removed (the text stays as it is) or everything
    is. Null texts are empty, null doc_ids come first, rows that share doc_id and
    text are separate copies with "none" and one document with "first"; an empty
    table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    base = stored(_base(docs), "base")
    order = F.coalesce("doc_id", F.lit(_NULL))
    texts = base.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.first("n_bytes").alias("n"))
    # texts that occur again: with "none" they go whole, whatever else matches
    whole = texts.where(F.col("n") >= length)
    runs = _removed_runs(docs, length, keep)
    if keep == "none":
        runs = runs.join(whole.where("copies > 1").select(F.col("k1").alias("node")), "node", "left_anti")
    runs = runs.groupBy("node").agg(F.collect_list(F.struct("s0", "s1")).alias("runs"))
    runs = runs.join(whole.select(F.col("k1").alias("node"), F.col("first").alias("doc")), "node")
    ddl = "node long, n_removed long, n_spans long, kept_sha256 string, spans array<int>, kept binary"

    def settle(batches):
        schema = arrow_schema(ddl)
        for texts_, nodes, found in slices(batches, "text", "node", "runs"):
            out = []
            for text, node, r in zip(texts_, nodes, found, strict=True):
                if text is None or _key(text)[0] != node:
                    continue
                gone = _covered(r, length)
                edges = [0, *(e for s in gone for e in s), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((node, len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [e for s in gone for e in s], kept))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    plain = _rows(docs).select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), "text")
    done = plain.join(runs, "doc").select("text", "node", "runs").mapInArrow(settle, ddl).dropDuplicates(["node"]).withColumnRenamed("node", "k1")
    out = base.join(texts, ["k1", "k2"]).join(done, "k1", "left")
    copy = F.col("copies") > 1 if keep == "none" else F.coalesce("doc_id", F.lit(_NULL)) != F.col("first")
    all_gone = copy & (F.col("n_bytes") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    pick = lambda whole_, some, none: F.when(all_gone, whole_).when(F.col("n_removed").isNotNull(), some).otherwise(none)
    return out.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(empty, F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        pick(F.array(F.lit(0), F.col("n_bytes").cast("int")), F.col("spans"), F.array().cast("array<int>")).alias("spans"),
        F.when(~all_gone, F.col("kept")).alias("kept"), "sha",
    )


def remaining_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 as ``remove_repeats`` has them, and text.

    ``text`` is what is left when all copies of each repeated string are gone:
    the bytes of ``kept_sha256``, but for characters that a cut goes through,
    which stay whole. Null texts stay null, texts that go whole are empty.
    """
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    # equal texts of one doc_id have equal results
    result = remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "sha").dropDuplicates(["doc_id", "sha"])
    rows = _rows(docs).select(F.col("doc_id").alias("_doc"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))

    def cut(batches):
        import pyarrow as pa

        schema = arrow_schema(ddl)
        for texts, spans, *digests in slices(batches, "text", "spans", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"):
            left = [_whole_characters(t, flat) if flat else t for t, flat in zip(texts, spans, strict=True)]
            yield batch(schema, *digests, pa.array(left, pa.binary()).view(pa.string()))

    joined = rows.join(result, rows["_doc"].eqNullSafe(result["doc_id"]) & (rows["_sha"] == result["sha"]))
    return joined.select("text", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans").mapInArrow(cut, ddl)


def without_later_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, n_chars and others) without repeated passages but their first place.

    Only whole characters are cut. Rows of which everything is removed go; rows
    that had no text stay as they are. n_chars is that of the text that is left.
    """
    result = remove_repeats(docs, length, "first").where("n_removed > 0")
    cuts = stored(result.select(F.col("doc_id").alias("_doc"), F.col("sha").alias("_sha"), "spans").dropDuplicates(["_doc", "_sha"]), "cuts")
    columns = docs.columns
    at, size = columns.index("text"), columns.index("n_chars")

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for b in byte_runs(whole, at, SLICE_BYTES):
                spans = b.column(len(columns)).to_pylist()
                texts, sizes = as_bytes(b.column(at)), b.column(size).to_pylist()
                stays = []
                for i, flat in enumerate(spans):
                    if flat:
                        texts[i] = _whole_characters(texts[i] or b"", flat)
                        sizes[i] = len(texts[i].decode())
                    stays.append(not flat or bool(texts[i].strip()))
                out = list(b.columns[: len(columns)])
                out[at] = pa.array([t if t is None else t.decode() for t in texts], pa.string())
                out[size] = pa.array(sizes, out[size].type)
                yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(stays, pa.bool_()))

    own = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    rows = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["_doc"]) & (own == cuts["_sha"]), "left").select(*(docs[c] for c in columns), "spans")
    return rows.mapInArrow(cut, docs.schema)


def _whole_characters(text: bytes, flat: list[int]) -> bytes:
    edges = [0]
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        edges += [a, b]
    edges.append(len(text))
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
