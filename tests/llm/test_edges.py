"""Edge cases of the training-data operators: exactness, empty tables, very long texts, repeats, clashing columns."""

import base64
import gzip
import hashlib
import io
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import chat, decontam, html_wrappers, quality, suffix_dedup, superminhash, token_counts, topk_search, warc
from pagemill.llm.common import byte_runs, slices
from pagemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, node long, comp long, side int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3, 4) for i, t in rows], DOCS)


def test_token_counts_of_a_table(spark):
    encode = token_counts._encoder(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}").encode_ordinary
    lengths = [len(encode(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = {r.n_tokens: r for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert (r.docs_from, r.tokens_from) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.docs_share_to == round(sum(x <= n for x in lengths) / len(lengths), 9)


def test_quantiles_are_exact(spark):
    h = token_counts.length_histogram(spark.createDataFrame([(i, i + 1) for i in range(30)], "doc_id long, n_tokens long"))
    for q, want in ((0.0, 1), (1 / 30, 1), (0.1, 3), (0.7, 21), (2 / 3, 20), (5 / 6, 25), (1.0, 30)):
        assert token_counts.quantile(h, q).first().n_tokens == want
    assert token_counts.quantile(h.limit(0), 0.5).first().n_tokens is None


def test_topk_is_exact_and_defined_for_repeats(spark):
    rows = [(0, [1.0, 1.0]), (1, [float(1 << 50), 3.0]), (2, [float(1 << 50), 1.0]), (0, [2.0, 2.0]), (3, [1e300, 1.0])]
    v = topk_search.quantized(spark.createDataFrame([(i, e, 7) for i, e in rows], "vec_id long, embedding array<double>, part int"), scale=1)
    got = [tuple(r) for r in topk_search.top_k(v.where("vec_id = 0"), v.where("vec_id < 3"), 5).orderBy("rank").collect()]
    # of the rows of id 0 the smallest vector asks, and none is a candidate
    assert got == [(0, 1, 1, (1 << 50) + 3), (0, 2, 2, (1 << 50) + 1)]
    wide = v.where("vec_id in (1, 2)")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(wide, wide, 1).collect()
    big = spark.createDataFrame([(5, [float((1 << 30) + 1), float(1 << 29)]), (6, [float((1 << 30) + 1), 3.0])], "vec_id long, v array<double>")
    assert topk_search.top_k(big.where("vec_id = 5"), big, 1).first().score == ((1 << 30) + 1) ** 2 + 3 * (1 << 29)


def member(head: str, block: bytes) -> bytes:
    return gzip.compress(f"WARC/1.0\r\n{head}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_warc_records_of_other_writers(tmp_path):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload"
    digest = hashlib.sha256(b"payload").hexdigest()
    data = member("warc-type: warcinfo\r\nContent-Type: application/warc-fields\r\n", b"software: x\r\n") + member(
        f"WARC-TYPE: response\r\nContent-Type: application/http; msgtype=response\r\nwarc-payload-digest: sha256:{digest}\r\nX-Long: a\r\n b\r\n", body
    )
    data += member("WARC-Type: metadata\r\nWARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"m").digest()).decode() + "\r\n", b"m")
    got = list(warc.read_records(io.BytesIO(data), keep_payload=True))
    assert [(h["WARC-Type"], p) for h, _, _, p in got] == [("warcinfo", b"software: x\r\n"), ("response", b"payload"), ("metadata", b"m")]
    assert got[1][0]["x-long"] == "a b" and got[1][2] == hashlib.sha1(b"payload").hexdigest()
    for bad in (data.replace(b"x", b"y"), member("WARC-Type: response\r\nContent-Type: application/http\r\n", b"x" * (2 << 20)), gzip.compress(b"WARC/1.0\r\n\r\n"), member("WARC-Type: metadata\r\nWARC-Block-Digest: md5:00\r\n", b"m")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_rows_that_share_the_largest_id(spark):
    big = "x" * 1200
    pages = spark.createDataFrame([(2, "u", big, 1), (2, "u", big, 1), (1, "u", big, 1)], "page_id long, url string, html string, records int")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archived(pages).collect()) == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]


def whole_windows(rows, length, keep):
    """Removed bytes by a rolling hash over every window, checked against nothing else."""
    first, count, out = {}, Counter(), {}
    hashes = []
    for i, t in rows:
        h = [hash(t[k : k + length]) for k in range(len(t) - length + 1)]
        hashes.append(h)
        count.update(h)
        for k, x in enumerate(h):
            first.setdefault(x, (i, k))
    for (i, t), h in zip(rows, hashes, strict=True):
        mask = np.zeros(len(t) + 1, np.int64)
        for k, x in enumerate(h):
            if count[x] > 1 if keep == "none" else first[x] != (i, k):
                mask[k] += 1
                mask[min(len(t), k + length)] -= 1
        mask = np.cumsum(mask)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        out[i] = (len(t), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("keep", "length"), [("none", 400), ("first", 200)])
def test_repeats_of_a_table(spark, keep, length):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(500)
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d, length, keep).collect()}
    assert got == whole_windows(rows, length, keep)


def test_repeats_in_a_very_long_text(spark):
    rng = np.random.default_rng(7)
    noise = bytes(rng.integers(97, 123, 700_000).astype(np.uint8))
    text = noise + noise[1000:1500] + b"a" * 5000
    rows = [(1, text), (2, noise[262_000:263_000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, [(i, t.decode()) for i, t in rows])).collect()}
    assert got == whole_windows(rows, 400, "none")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_copies_of_a_passage_do_not_meet_in_a_join(spark, keep):
    rng = np.random.default_rng(11)
    shared = [bytes(rng.integers(97, 123, 150).astype(np.uint8)) for _ in range(6)]
    rows = [(i, b"%d " % i + b" %d " % (i % 5) + b"|%d|".join(shared[:5]).replace(b"%d", b"%d" % i)) for i in range(40)]  # near copies
    rows += [(50, shared[5]), (51, b"once " + shared[5]), (52, rows[3][1]), (53, b"x" * 90)]
    d = docs(spark, [(i, t.decode()) for i, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d, 40, keep).collect()}
    assert got == whole_windows(rows, 40, keep)
    plan = suffix_dedup._removed_runs(d, 40, keep)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"Join .*\bsh#", plan)


def test_previous_factors_of_runs():
    text = b"a" * 300 + b"b" + b"a" * 200
    lpf = suffix_dedup.longest_previous_factor(text)
    assert lpf[0] == 0 and lpf[1] == 299 and lpf[300] == 0 and lpf[301] == 200 and lpf[-1] == 1


def test_deep_pages():
    deep = "<div>" * 200 + "text" + "<nav>menu</nav>" + "<p>more</p>" + "</div>" * 200
    assert html_wrappers.extract(f"<body>{deep}<footer>f</footer></body>") == "text\nmore"
    assert html_wrappers.extract("<div>" * 20_000 + "x" + "<i>" * 20_000 + "y") == "xy"
    page = html_wrappers._page(f"<body>{deep}</body>")
    assert html_wrappers.extract(f"<body>{deep}</body>", html_wrappers._merged(page, page)) == "text\nmore"


def test_class_names_that_tell_of_something_else():
    assert html_wrappers.extract("<div class='content with-sidebar'><p>a</p></div>") == "a"


def plain_pooled(text, vectors):
    """Mean, deviation and neighbours' product, token by token."""
    doc, bucket, shape = quality.tokens([text])
    if not len(doc):
        return np.zeros(5 * quality.DIMS)
    out = []
    for ids in (bucket, shape):
        rows = [vectors[i].astype(float) for i in ids]
        mean = sum(rows) / len(rows)
        out += [mean, np.sqrt(np.maximum(0, sum(r * r for r in rows) / len(rows) - mean * mean))]
    rows = [vectors[i].astype(float) for i in bucket]
    return np.concatenate([*out, sum((a * b for a, b in zip(rows, rows[1:], strict=False)), np.zeros(quality.DIMS)) / len(rows)])


def test_pooled_token_by_token(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(quality.BUCKETS + quality._SHAPES, quality.DIMS)).astype(np.float32)
    words = ["the", "Of", "x1", "AB", "...", "!", "foo-bar", "é"]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (0, 1, 2, 7, 400)]
    want = [plain_pooled(t, vectors) for t in texts]
    for size in (64, 1 << 18):  # pieces change nothing
        monkeypatch.setattr(quality, "_SLICE", size)
        assert np.allclose(quality.pooled(texts, vectors), want, atol=1e-5)


def test_word_vectors_pair_by_pair(spark, monkeypatch):
    texts = ["a b c a", "b a", None, "", "c!", "d " * 300]
    dims, signs = quality.index_vectors()
    table = np.zeros((quality.BUCKETS + quality._SHAPES, quality.DIMS))
    for t in texts:
        _, bucket, shape = quality.tokens([(t or "").encode()])
        for own in (bucket, shape):
            for i in range(len(own)):
                for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                    if i != j:
                        np.add.at(table[own[i]], dims[own[j]], signs[own[j]])
    want = table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))
    assert np.allclose(quality.word_vectors(docs(spark, list(enumerate(texts)))), want, atol=1e-6)


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    d = docs(spark, [(i, f"text {i}") for i in range(50)] + [(None, "x")])
    got = {r.doc_id: r.held_out for r in d.select("doc_id", quality.held_out().alias("held_out")).collect()}
    assert got == {None: False} | {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    labels = spark.createDataFrame([(i, 1) for i in range(50) if got[i]], "doc_id long, quality int")
    assert quality.fitted(d, labels)[1] == 0.5


def test_slices_cut_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * 100, None, "", "b" * 1000, "c"]), pa.array(range(5))], names=["text", "id"])
    parts = list(byte_runs(b, 0, 300))
    assert len(parts) > 1 and [x for p in parts for x in p.column(1).to_pylist()] == [0, 1, 2, 3, 4]
    assert [x for _, ids in slices([b], "text", "id", size=200) for x in ids] == [0, 1, 2, 3, 4]


def test_chat_repeats_and_clashes(spark):
    log = spark.createDataFrame([(1, 0, "message", None, "user", "q", 5), (1, 0, "message", None, "user", "q", 6), (2, 3, "delta", "m", None, "x", 7)], chat.EVENTS + ", turn long")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.formatted(chat.messages(log))).collect()}
    assert got == {1: (2, 0), 2: (1, 0)}
    long = spark.createDataFrame([(1, i, "delta", "m", "assistant", "ab" * 5000) for i in range(100)], chat.EVENTS)
    assert chat.digests(chat.formatted(chat.messages(long))).first().loss_chars == 1_000_000


def test_near_duplicates_of_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, other), (3, other + " y"), (4, "alone at last"), (2, base + " x")]
    got = sorted((r.doc_id, r.component_id) for r in superminhash.near_duplicates(docs(spark, rows), shingle=2).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0 and suffix_dedup.without_later_copies(none).count() == 0
    assert superminhash.near_duplicates(none).count() == 0
    assert decontam.contamination(none, bench).count() == 0 and decontam.digest(decontam.contamination(docs(spark, [(1, "a b")]), bench.limit(0))).first().contaminated is False
    assert html_wrappers.main_text(pages, html_wrappers.infer(pages)).count() == 0
    assert chat.digests(chat.formatted(chat.messages(spark.createDataFrame([], chat.EVENTS)))).count() == 0


def test_very_long_texts(spark):
    text = "word and another " * 60_000
    d = docs(spark, [(1, text), (2, "short one")])
    bench = spark.createDataFrame([(1, "and another word and")], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.digest(decontam.contamination(d, bench)).collect()}
    assert found == {1: (180_000, 180_000 - 2), 2: (2, 0)}
    assert {r.doc_id: r.n_tokens for r in token_counts.encoded_lengths(d).collect()}[1] > 150_000
    scores = quality.scored(d, (np.zeros((quality.BUCKETS + quality._SHAPES, quality.DIMS), np.float32), 0.25)).collect()
    assert [r.score for r in scores] == [0.25, 0.25]


def test_stages_with_nulls_repeats_and_nothing(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, long), (3, None), (None, "no id"), (4, ""), (3, None), (5, "five words are too few")]
    d = docs(spark, rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    near = P.near_dedup(spark, d, str(tmp_path))
    assert near.columns == P.COLUMNS and key(near) == sorted([(1, long), (3, None), (None, "no id"), (4, ""), (5, "five words are too few")], key=str)
    assert len(key(P.suffix_array_dedup(spark, near, str(tmp_path)))) == 5
    assert len(key(P.decontamination(spark, near, str(tmp_path)))) == 5
    # without labels every score is 0.5, so that all go
    assert P.quality_classifier(spark, d, str(tmp_path)).count() == 0
    for _, stage in P.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_planted_passages_are_gone_from_the_text(spark, tmp_path):
    rng = np.random.default_rng(13)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, other = say(75), say(60)
    assert len(passage) >= 400
    texts = [(1, "<" + passage + ">" + say(40)), (2, say(20) + "[" + passage + "]"), (3, say(9) + "é" + passage + "1" + say(9)), (None, "ũ" + passage + "2")]
    texts += [(4, other), (4, other), (4, say(80)), (5, None), (6, ""), (7, say(300)), (8, other[:300]), (None, None), (-(1 << 63), say(70))]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text").collect()]
    digests = whole_windows([(k, (t or "").encode()) for k, (_, t) in enumerate(texts)], 400, "none")
    want = []
    for k, (i, t) in enumerate(texts):
        left = t.replace(passage, "") if t and passage in t else t  # of é and ũ the last byte is the same: both stay whole
        if k in (4, 5):
            assert len(other) >= 400
            left = ""
        want.append((i, *digests[k], left))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert all(hashlib.sha256((r[5] or "").encode()).hexdigest() == r[4] for r in rows if "é" not in (r[5] or "") and "ũ" not in (r[5] or ""))
