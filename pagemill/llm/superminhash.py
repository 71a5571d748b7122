"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find grouping.

SuperMinHash (Ertl, 2017) gives each element a random permutation of the slots;
slot ``l`` keeps the smallest ``rank + r`` over all elements, where ``rank`` is
the slot's place in that element's permutation and ``r`` is uniform in [0, 1).
The ranks of an element are a permutation, so slots are correlated in the way
that lowers the variance, and elements need not be walked further once every
slot holds a value below the current rank: the early stop.

Plan: documents -> (set key, signature) -> one class per distinct set -> bands ->
each bucket's star around the member that shares the most -> pairs that look
alike -> clusters. Members of a bucket that are in different clusters are compared
by sketches in tiles, which joins clusters. Links are only within clusters: the
stars' pairs are checked on full sets, which gives components of links; then the
components of a cluster are checked against its largest one, in tiles. No step makes the pairs of a group as rows: a hot group is one cluster
from the star on, and a tile gives at most a spanning forest.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, arrow_schema, as_bytes, batch, byte_rows, byte_runs, column, key_groups, mix64, slices, stored
from .components import connected_components

#: 48 bands of 6 slots: a pair at similarity 0.8 shares no band with odds (1 - 0.8 ** 6) ** 48 = 5e-7.
BANDS, ROWS = 48, 6
#: Pairs whose signatures agree on a smaller part of the slots are not verified.
#: At a true similarity of 0.8 the estimate's deviation is below 0.024: more than 8 deviations.
LEAST_ESTIMATE = 0.6
#: Members of a bucket or cluster that one task holds; larger ones are tiled.
TILE = 512
#: Members that stream past those in one task.
STREAM = 4096

_GOLDEN = 0x9E3779B97F4A7C15
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (the whole sequence if it is shorter)."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    n = min(size, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(_GOLDEN) + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures (uint32: rank << 22 | 22 bits of r) of several sets, level by level over all elements."""
    assert slots <= 1024
    out = np.full((len(sets), slots), _EMPTY, np.uint32)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    steps: list[np.ndarray] = []  # the Fisher-Yates picks so far
    places = None  # from some level on, each element's permutation so far
    for level in range(slots):
        if not len(doc):
            break
        x = mix64(element + np.uint64((level + 1) * _GOLDEN & (1 << 64) - 1))
        pick = ((x >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64) + level
        if places is None and level >= 12:
            places = np.tile(np.arange(slots, dtype=np.uint16), (len(doc), 1))
            at = np.arange(len(doc))
            for k, p in enumerate(steps):
                places[at, k], places[at, p] = places[at, p], places[at, k]
            steps = []
        if places is None:
            slot = pick.copy()
            for k in range(level - 1, -1, -1):
                slot[slot == steps[k]] = -k - 1
                moved = slot < 0
                slot[moved] = -slot[moved] - 1
            steps.append(pick)
        else:
            at = np.arange(len(doc))
            slot = places[at, pick].astype(np.int64)
            places[at, pick] = places[at, level]
            places[at, level] = slot
        value = (np.uint32(level) << np.uint32(22)) | (x & np.uint64((1 << 22) - 1)).astype(np.uint32)
        np.minimum.at(flat, doc * slots + slot, value)
        # the early stop: a document whose slots are all filled can't be improved by later levels
        going = (out == _EMPTY).any(axis=1)
        keep = going[doc]
        if not keep.all():
            doc, element = doc[keep], element[keep]
            steps = [s[keep] for s in steps]
            places = None if places is None else places[keep]
    return out


def _grouped(sets: list[np.ndarray], most: int = 100_000):
    """Consecutive runs of sets with about ``most`` elements."""
    start = held = 0
    for i, s in enumerate(sets):
        held += len(s) + 16
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sets):
        yield start, len(sets)


def features(docs: DataFrame, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Of each row: doc_id, n_shingles, set key (k1, k2), band hashes and a one-byte-a-slot sketch.

    Rows without words have no key, bands or sketch.
    """
    ddl = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"

    def run(batches):
        schema = arrow_schema(ddl)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for texts, ids in slices(batches, "text", "doc_id"):
            sets = [shingle_set(t, shingle) for t in texts]
            for a, b in _grouped(sets):
                part = sets[a:b]
                sig = signatures(part, bands * rows)
                key = np.tile(salt, (len(part), 1))
                for i in range(rows):
                    key = mix64(key * np.uint64(_GOLDEN) + sig[:, i::rows])
                key = key.view(np.int64)
                sketch = (sig & np.uint32(255)).astype(np.uint8)
                full = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in part]
                yield batch(
                    schema, ids[a:b], [len(s) for s in part],
                    [f and int.from_bytes(f[:8], "little", signed=True) for f in full], [f and int.from_bytes(f[8:], "little", signed=True) for f in full],
                    [key[i] if f else None for i, f in enumerate(full)], [sketch[i].tobytes() if f else None for i, f in enumerate(full)],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def _dealt(texts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` (keys, side, doc and others) with their texts (doc, text), each group in one partition, side 0 first."""
    rows = texts.join(wanted.hint("merge"), "doc").select(*keys, "side", "doc", *(c for c in wanted.columns if c not in (*keys, "side", "doc")), "text")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "doc")


def _spread(of: int, count: str):
    """Numbers 0, 1, ... of the tiles of ``of`` members that hold ``count`` of them."""
    return F.explode(F.expr(f"sequence(0, cast(ceil({count} / {of}) as int) - 1)"))


def _tile(doc: str, of: int, count: str):
    return F.pmod(F.xxhash64(doc), F.ceil(F.col(count) / of)).cast("int")


def verified(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full shingle sets have ``100 * intersection >= percent * union``.

    A document's pairs stream past its set, in tiles of STREAM; of a doc_id with
    several texts any may do.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    centres = sizes.select("a", _spread(STREAM, "n").alias("t"), F.lit(0).alias("side"), F.col("a").alias("doc"))
    members = pairs.join(sizes, "a").select("a", _tile("b", STREAM, "n").alias("t"), F.lit(1).alias("side"), F.col("b").alias("doc"))

    def run(batches):
        schema = arrow_schema("a long, b long")
        key, own = None, []
        for a, t, side, doc, text in _rows(batches):
            good = []
            for i, words in enumerate(text):
                if (a[i], t[i]) != key:
                    key, own = (a[i], t[i]), []
                mine = shingle_set(words, shingle)
                if not side[i]:
                    own.append(mine)
                elif any(_linked(x, mine, percent) for x in own):
                    good.append(i)
            yield batch(schema, [a[i] for i in good], [doc[i] for i in good])

    return _dealt(texts, stored(centres.unionByName(members), "stars"), ["a", "t"]).mapInArrow(run, "a long, b long").distinct()


def _rows(batches):
    """Lists of the columns' values, the last one a text, cut after some bytes of text."""
    for whole in batches:
        for b in byte_runs(whole, whole.num_columns - 1, SLICE_BYTES):
            yield [*(c.to_pylist() for c in b.columns[:-1]), as_bytes(b.columns[-1])]


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose signatures agree on enough slots to be worth the exact check."""

    def run(batches):
        schema = arrow_schema("a long, b long")
        for b in batches:
            if b.num_rows:
                good = (byte_rows(b.column(2)) == byte_rows(b.column(3))).mean(axis=1) >= LEAST_ESTIMATE
                yield batch(schema, b.column(0).to_numpy()[good], b.column(1).to_numpy()[good])

    s = reps.select("doc_id", "sketch")
    full = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


class _Forest:
    """Union-find that tells which links join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        self.parent[max(p, q)] = min(p, q)
        return p != q


def _crossing(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of clusters that hold members which share a bucket and look alike.

    ``members``: bucket, doc, cluster. Members outside of a bucket's most
    frequent cluster are held in tiles, all its members stream past them; a tile
    gives a spanning forest of its clusters.
    """

    def run(batches):
        schema = arrow_schema("a long, b long")
        for _, parts in key_groups(batches, 3):
            side, cluster, sketch = column(parts, 3).to_numpy(), column(parts, 4).to_numpy(), byte_rows(column(parts, 5))
            held = side == 0
            ours, theirs, x, y = cluster[held], cluster[~held], sketch[held], sketch[~held]
            if not len(ours) or not len(theirs):
                continue
            need, forest, ties = LEAST_ESTIMATE * x.shape[1], _Forest(), []
            for i in range(len(theirs)):
                other = np.flatnonzero(ours != theirs[i])
                alike = other[(x[other] == y[i]).sum(axis=1) >= need]
                ties += [(int(theirs[i]), c) for c in np.unique(ours[alike]).tolist() if forest.join(int(theirs[i]), c)]
            if ties:
                yield batch(schema, *zip(*ties, strict=True))

    # counted by cluster first: the most frequent one of a bucket is then found without holding all its clusters
    parts = members.groupBy("bucket", "cluster").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "cluster")).alias("m")).where("parts > 1")
    sizes = sizes.select("bucket", "n", (F.col("n") - F.col("m.n")).alias("rest"), F.col("m.cluster").alias("most"))
    m = members.join(stored(sizes, "mixed"), "bucket").join(reps.select(F.col("doc_id").alias("doc"), "sketch"), "doc")
    m = stored(m, "crossing")
    held = m.where("cluster <> most").select("bucket", _spread(STREAM, "n").alias("t"), _tile("doc", TILE, "rest").alias("u"), F.lit(0).alias("side"), "cluster", "sketch")
    past = m.select("bucket", _tile("doc", STREAM, "n").alias("t"), _spread(TILE, "rest").alias("u"), F.lit(1).alias("side"), "cluster", "sketch")
    rows = held.unionByName(past).repartition("bucket", "t", "u").sortWithinPartitions("bucket", "t", "u")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _settled(texts: DataFrame, clusters: DataFrame, found: DataFrame, sizes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within a cluster, from the exact check on full sets.

    ``clusters`` and ``found``: (node, component). Members outside of a cluster's
    largest component are held in tiles, all its members stream past them; a
    tile gives a spanning forest of the links it finds.
    """
    members = clusters.withColumnsRenamed({"node": "doc", "component": "cluster"}).join(found.withColumnsRenamed({"node": "doc", "component": "comp"}), "doc", "left")
    members = members.withColumn("comp", F.coalesce("comp", "doc")).join(sizes.groupBy(F.col("doc_id").alias("doc")).agg(F.sum("n_shingles").alias("w")), "doc")
    members = stored(members, "clusters")
    # a member counts for as many as its set is larger than usual
    load = F.sum(F.ceil(F.col("w") / 600)).alias("n")
    parts = members.groupBy("cluster", "comp").agg(load)
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "comp")).alias("m")).where("parts > 1")
    totals = totals.select("cluster", "n", (F.col("n") - F.col("m.n")).alias("rest"), F.col("m.comp").alias("most"))
    m = stored(members.join(totals, "cluster"), "open")
    held = m.where("comp <> most").select("cluster", _spread(STREAM, "n").alias("t"), _tile("doc", TILE, "rest").alias("u"), F.lit(0).alias("side"), "doc", "comp")
    past = m.select("cluster", _tile("doc", STREAM, "n").alias("t"), _spread(TILE, "rest").alias("u"), F.lit(1).alias("side"), "doc", "comp")

    def run(batches):
        schema = arrow_schema("a long, b long")
        key, sets, forest, index = None, [], _Forest(), None
        for cluster, t, u, side, doc, comp, text in _rows(batches):
            links = []
            for i, words in enumerate(text):
                if (this := (cluster[i], t[i], u[i])) != key:
                    key, sets, forest, index = this, [], _Forest(), None
                mine = shingle_set(words, shingle)
                if not side[i]:
                    sets.append((doc[i], comp[i], mine))
                    continue
                index = index or _SetIndex(sets)
                for d, c in index.linked(mine, percent, comp[i]):
                    if forest.join(comp[i], c):
                        links.append((d, doc[i]))
            if links:
                yield batch(schema, *zip(*links, strict=True))

    return _dealt(texts, stored(held.unionByName(past), "tiles"), ["cluster", "t", "u"]).mapInArrow(run, "a long, b long")


class _SetIndex:
    """The elements of several documents' sets, to intersect another set with all at once."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray]]):
        self.doc, self.comp = (np.array([s[k] for s in sets], np.int64) for k in (0, 1))
        self.size = np.array([len(s[2]) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        flat = np.concatenate([s[2] for s in sets]) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.elements, self.owner = flat[order], owner[order]

    def linked(self, other: np.ndarray, percent: int, comp: int) -> list[tuple[int, int]]:
        """(doc, component) of the sets in other components that are linked with ``other``."""
        first, last = (np.searchsorted(self.elements, other, side) for side in ("left", "right"))
        n = last - first
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        both = np.bincount(self.owner[at], minlength=len(self.doc))
        good = np.flatnonzero((both > 0) & (100 * both >= percent * (self.size + len(other) - both)) & (self.comp != comp))
        return list(zip(self.doc[good].tolist(), self.comp[good].tolist(), strict=True))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of word shingles have
    ``100 * intersection >= percent * union``, checked on full sets; component_id
    is the smallest doc_id reachable. Documents of equal sets are one class, so
    groups of copies never make pairs of their own. Null or empty texts have no
    shingles and link with nothing; rows that share a doc_id are one document,
    linked with whatever any of their texts is linked with; a null doc_id takes
    no part (component_id null, kept false). An empty table gives an empty
    result; other columns of ``docs`` are not looked at.
    """
    f = stored(features(docs, shingle, bands, rows), "features")
    usable = f.where("k1 is not null and doc_id is not null")
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    rep_ids = classes.select(F.col("rep").alias("doc_id")).distinct()
    reps = usable.join(rep_ids, "doc_id", "left_semi").select("doc_id", "k1", "k2", "n_shingles", "bands", "sketch").dropDuplicates(["doc_id", "k1", "k2"])
    reps = stored(reps.drop("k1", "k2"), "reps")
    band = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("bucket"))
    members = stored(band.join(band.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "members")
    # a bucket's centre is the member with the largest buckets: in a group of near copies, that which most copies are near to
    rank = members.groupBy("doc").agg(F.struct(F.sum("n").alias("s"), F.xxhash64("doc").alias("o")).alias("rank"))
    centres = members.join(rank, "doc").groupBy("bucket").agg(F.max(F.struct("rank", "doc")).alias("m")).select("bucket", F.col("m.doc").alias("a"))
    star = members.join(centres, "bucket").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    tried = stored(_alike(star, reps), "pairs")
    near = connected_components(tried)
    cluster = F.coalesce("component", "doc").alias("cluster")
    placed = members.select("bucket", "doc").join(near.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", cluster)
    ties = stored(_crossing(placed, reps), "ties")
    if ties.take(1):
        near = connected_components(near.union(ties))
    # the documents are shuffled once, by the same plan at every size; both checks read the candidates' texts alone
    texts = stored(_texts(docs).join(near.select(F.col("node").alias("doc")).hint("merge"), "doc", "left_semi"), "texts")
    found = connected_components(stored(verified(texts, tried, shingle, percent), "links"))
    more = _settled(texts, near, found, reps.select("doc_id", "n_shingles"), shingle, percent)
    # an id with texts of several classes ties these
    own = usable.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    same = own.join(several, "doc_id").where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    found = connected_components(found.union(more).union(same))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    out = f.join(named, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
