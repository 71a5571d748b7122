"""The training-data operators against brute force, round trips and held-out accuracy; nulls, empties, ties, repeats."""

import gzip
import hashlib
import io
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, decontam, html_wrappers, mixing, quality, suffix_dedup, superminhash, token_counts, topk_search, warc
from pagemill.llm.common import stored
from pagemill.llm.components import connected_components
from pagemill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 1) for i, t, s in ((*r, "s")[:3] for r in rows)], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    columns, rows = want.columns, want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(rows, key=str)


def test_histogram(spark):
    lengths = spark.createDataFrame([(i, n) for i, n in enumerate([0, 3, 3, 7, 20, None])], "doc_id long, n_tokens long")
    h = token_counts.length_histogram(lengths, block=4)
    rows = {r.n_tokens: r for r in h.collect()}
    for n in (0, 3, 7, 20):
        all_ = [0, 3, 3, 7, 20]
        assert (rows[n].docs_from, rows[n].tokens_from, rows[n].truncated_tokens) == (sum(x >= n for x in all_), sum(x for x in all_ if x >= n), sum(min(x, n) for x in all_))
    assert tuple(token_counts.truncated_total(h, 5).first()) == (5, 2, 16)
    assert token_counts.quantile(h, 0.5).first().n_tokens == 3
    assert token_counts.length_histogram(lengths.limit(0)).count() == 0


def test_encoded_lengths(spark):
    d = docs(spark, [(1, "hello world"), (2, None), (3, ""), (None, "x")])
    encode = token_counts._encoder(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}").encode_ordinary
    assert [r.n_tokens for r in token_counts.encoded_lengths(d).collect()] == [len(encode("hello world")), 0, 0, 1]


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.1, 0.2]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [0.1, 0.1])]
    v = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk_search.top_k(v.where("vec_id = 0"), v, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768)]
    assert topk_search.top_k(v.limit(0), v, 2).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "v", "x"), (5, "v", "x"), (None, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, str(tmp_path / "w")), payloads=True).collect()}
    assert len(got) == 6 and got[2].record_type == "response" and (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[None].refers_to == 2
    assert bytes(got[2].payload) == big.encode() and got[1].payload_bytes == 1400 and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert [got[i].record_type for i in (3, 4, 5)] == ["response"] * 3 and got[3].payload_bytes == 0
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_reader_checks(tmp_path):
    good = warc.record(1, "u", b"a" * 300_000) + warc.record(2, "u", b"b")
    assert [(h["X-Page-ID"], n) for h, n, *_ in warc.read_records(io.BytesIO(good))] == [("1", 300_000), ("2", 1)]
    plain = gzip.decompress(good)
    assert plain.count(b"WARC/1.1") == 2
    for bad in (good[:-10], gzip.compress(plain.replace(b"\r\n\r\nb\r\n", b"\r\n\r\nc\r\n"))):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_longest_previous_factor():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30):
        t = bytes(rng.integers(97, 99, n).astype(np.uint8))
        want = [max([0] + [next(k for k in range(n + 1) if i + k >= n or t[j + k] != t[i + k]) for j in range(i)]) for i in range(n)]
        assert suffix_dedup.longest_previous_factor(t).tolist() == want


def removed(rows, length, keep):
    count, first, out = {}, {}, {}
    for i, t in sorted(rows):
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            count[w] = count.get(w, 0) + 1
            first.setdefault(w, (i, k))
    for i, t in rows:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if count[w] > 1 if keep == "none" else first[w] != (i, k):
                mask[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mask]) if t else b""
        out[i] = (len(t), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("keep", "group"), [("none", 1024), ("none", 6), ("first", 6)])
def test_repeats(spark, keep, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    base = word(500)
    texts = [base, base, base[:200] + "X" + base[201:], "ab" * 150, None, "", base[:20], "é" * 60 + base[300:340], "Und " * 80]
    texts += [word(30) + base[200:260] + word(30) for _ in range(30)] + [base[i * 9 : i * 9 + 50] + word(40) for i in range(15)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, rows), 40, keep).collect()}
    assert got == removed([(i, (t or "").encode()) for i, t in rows], 40, keep)


def test_later_copies_go(spark):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(120)) + "ü"
    d = docs(spark, [(1, "one " + passage + " end"), (2, passage), (3, "three " + passage), (4, None), (None, "no id")])
    got = {r.doc_id: r.text for r in suffix_dedup.without_later_copies(d, 100).collect()}
    assert got == {1: "one " + passage + " end", 3: "thre", 4: None, None: "no id"}  # both texts have "e " before the passage


def test_fill_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.choice(np.arange(0, 14), 4, replace=False).tolist()
        counts = rng.integers(0, 4, 4).tolist()
        budget = int(rng.integers(0, 60))
        best = max(s for s in (sum(n * t for n, t in zip(sizes, take, strict=True)) for take in itertools.product(*(range(c + 1) for c in counts))) if s <= budget)
        take = mixing.fill(budget, sizes, counts)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and sum(n * t for n, t in zip(sizes, take, strict=True)) == best


def reshared(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in names}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), s) for i, s in enumerate(rng.choice(["b", "a", "Z", "é", "big"], 300, p=[0.1, 0.1, 0.1, 0.1, 0.6]).tolist())]
    rows += [(900, None, None), (901, "x y", None), (None, "q", "a"), (5, "dup id", "a")]
    d = docs(spark, rows)
    got = mixing.mixed(d).collect()
    again = mixing.mixed(d.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.source_size)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    by = {}
    for i, t, s in rows:
        by[s] = by.get(s, 0) + len((t or "").split())
    want = reshared(by)
    assert all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    taken = {}
    for r in got:
        taken.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(taken) == sorted((by[s], round(want[s], 6)) for s in by)
    assert all(abs(sum(t) - target) <= 3 for (_, target), t in taken.items())
    assert mixing.mixed(d.limit(0)).count() == 0


def test_html_article():
    page = (
        "<body><header>logo</header><nav>menu</nav><div class='cookie-notice'>c</div><main><article><h1>T &amp; t</h1><p>a\n b<b>c<br><p>d<aside>no</aside>"
        "<form>f</form><div class=comments><p>hey</p></div><ul><li>i<li>j</ul><script>var x='</p>'</script></article><article class=comment>bad</article></main><footer>f</footer>"
    )
    assert html_wrappers.extract(page) == "T & t\na bc\nd\ni\nj"
    assert [html_wrappers.extract(x) for x in ("", "<", "plain", "<!-- open", "</p></p>", "<p>" * 3000 + "x")] == ["", "<", "plain", "", "", "x"]


def test_html_wrappers(spark):
    make = lambda t, n: f"<html><body><div class='top'>Site</div><div><h2>{t}</h2>" + "".join(f"<p>{t} {j}</p>" for j in range(n)) + "<span>Share this</span></div></body></html>"
    rows = [(i, "http://H.example/x", make(f"thing {i}", i % 3 + 1)) for i in range(8)] + [(90, None, None), (91, "odd", ""), (None, "http://h.example", make("z", 1))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    wrappers = html_wrappers.infer(pages)
    regular = html_wrappers.regular_expression(__import__("json").loads(wrappers.where("host = 'h.example'").first().wrapper))
    assert '"Site"' in regular and "<p> # </>+" in regular and "<h0> # </>" in regular
    got = {r.page_id: (r.text, r.n_chars) for r in html_wrappers.main_text(pages, wrappers).collect()}
    assert got[4] == ("thing 4\nthing 4 0\nthing 4 1", 27) and got[90] == ("", 0) and got[91] == ("", 0) and got[None][0] == "z\nz 0"


def wrapper_of(pages):
    items = [html_wrappers._page(p) for p in pages]
    whole = items[0]
    for item in items[1:]:
        whole = html_wrappers._merged(whole, item)
    return whole


def test_the_wrapper_chooses_for_marked_pages():
    # the template's text goes from marked articles too, and marks outside of the host's region don't count
    pages = [f"<body><article><h1>T {i}</h1><p>text {i} {'x' * i}</p><span>Share this</span></article></body>" for i in range(5)]
    assert html_wrappers.extract(pages[3], wrapper_of(pages)) == "T 3\ntext 3 xxx"
    assert html_wrappers.extract(pages[1], wrapper_of(pages[:2])) == "T 1\ntext 1 x\nShare this"
    pages = [f"<body><article>Our best</article><div class=c><h1>T {i}</h1><p>{f'long {i} ' * 9}</p></div></body>" for i in range(5)]
    assert html_wrappers.extract(pages[3], wrapper_of(pages)) == "T 3\n" + "long 3 " * 8 + "long 3"


def test_template_texts_are_whole_texts():
    lead = "common words " * 30
    pages = [f"<body><div><h2>T {i}</h2><p>{lead}{i}</p><span>Share</span></div></body>" for i in range(4)]
    assert html_wrappers.extract(pages[2], wrapper_of(pages)) == f"T 2\n{lead}2"
    copies = ["<body><div><h2>T</h2><p>one</p><p>two</p><div>lone</div></div></body>"] * 5
    assert html_wrappers.extract(copies[0], wrapper_of(copies)) == "T\none\ntwo\nlone"
    near = [f"<body><div><h2>T</h2><div>a long lone text</div><p>{i}</p></div></body>" for i in range(5)]
    assert html_wrappers.extract(near[2], wrapper_of(near)) == "T\na long lone text\n2"
    near = [f"<body><div><h2>T</h2><p>text {i} {'x' * 50}</p><div>Share</div></div></body>" for i in range(5)]
    assert html_wrappers.extract(near[2], wrapper_of(near)) == f"T\ntext 2 {'x' * 50}"


def test_the_region_does_not_depend_on_the_number_of_pages():
    name = lambda i: "k" + "".join("abcdefghij"[int(d)] for d in str(i))
    around = lambda i: f"<div class={name(i % 250)}>around {i}</div>"
    page = lambda i: f"<body>{around(i)}{around(7 * i)}<div class=z><h1>T {i}</h1><p>{f'text {i} ' * 20}</p><b>Share</b></div>{around(3 * i)}</body>"
    texts = []
    for n in (5, 30, 400):
        whole = wrapper_of([page(i) for i in range(n)])
        assert html_wrappers.content_path(whole) == ["body", "div.class=z"]
        texts.append(html_wrappers.extract(page(4), whole))
    assert set(texts) == {"T 4\n" + " ".join(["text 4"] * 20)}
    assert len(whole[3][0][3]) > 192


def test_names_do_not_hide_the_article():
    x = html_wrappers.extract
    assert x("<div class='entry-content no-sidebar'><p>a</p></div><p>b</p>") == "a"
    assert x("<div class='layout has-sidebar'><article>a</article><div class=sidebar>s</div></div>") == "a"
    assert x("<div class='sidebar-layout'><article>the text</article></div><p>b</p>") == "the text"
    assert x("<p>the text</p><div class=related><article>b</article></div>") == "the text"
    assert x("<article><p>a <math><mi>x</mi></math> b</p><object>c</object><noscript>d</noscript><div hidden>e</div></article>") == "a x b\ncd"
    assert x("<article><p>a</p><section class='social-science'>b</section><div class='social-links'>c</div><div class='site-search'>d</div></article>") == "a\nb"
    assert x("<article><p>a</p><div class='share-2'>b</div><div class='social-share-theory'>c</div><div id=notice-theory>d</div></article>") == "a\nd"
    pages = [f"<body><div class=social><p>{f'long {i} ' * 9}</p></div><p>{i}</p><nav>n</nav></body>" for i in range(5)]
    assert x(pages[2], wrapper_of(pages)) == " ".join(["long 2"] * 9) + "\n2"


def test_pages_against_a_plain_reading(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_wrappers.main_text(pages, html_wrappers.infer(pages)).collect()}
    for p in pages.collect():
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", p.html, re.DOTALL)[1].replace("<br>", " "))
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        assert got[p.page_id] == "\n".join(x for x in lines if x)


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(d, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.98 and np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_quality_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "some words here"), (None, "x")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality(d, none).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (3, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(d, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and quality.quality(d.limit(0), labels).count() == 0


def test_chat_escapes_and_folds(spark):
    tricky = ["\\### Assistant: </turn> ok", "", "a: b", "<turn x>\n### y: z </turn>\n", "\\\\", "é#"]
    for role, text in itertools.product(["user", "a: b", "x>\n### x", ""], tricky):
        segment, start, end = chat.render(role, text)
        assert list(chat.parse(segment * 2)) == [(role, text)] * 2 and chat.unescape(segment[start:end]) == text
    log = [
        (1, 0, "start", "a", "user", "he"), (1, 1, "delta", "a", None, "llo"), (1, 2, "start", "b", "assistant", ""), (1, 3, "delta", "b", None, "bad"), (1, 4, "regenerate", "b", None, None),
        (1, 5, "delta", "b", None, "good"), (1, 6, "edit", "a", None, "hi"), (1, 7, None, None, "user", None), (1, 8, "start", "z", "user", "q"), (1, 9, "delete", "z", None, None), (None, None, "message", None, None, "n"),
    ]
    final = chat.messages(spark.createDataFrame(log, chat.EVENTS))
    assert [tuple(r) for r in final.orderBy("conv_id", "seq").collect()] == [(None, None, "", "n"), (1, 0, "user", "hi"), (1, 2, "assistant", "good"), (1, 7, "user", "")]
    got = {r.conv_id: r for r in chat.digests(chat.formatted(final)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"good").hexdigest() and got[None].n_turns == 1


def test_contamination_edges(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    bench = spark.createDataFrame([(10, "A b c"), (2, "c d"), (3, None), (4, "..."), (None, "a"), (5, "x " * 12), (2, "c d")], "item_id long, text string")
    d = docs(spark, [(1, "a B c, d!"), (2, None), (3, "x " * 11), (4, "c-d c"), (5, ""), (1, "c d")])
    rows = decontam.digest(decontam.contamination(d, bench)).collect()
    ids = lambda *x: decontam.hit_hash(list(x))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == sorted(
        [(1, 4, 4, 2, ids(2, 10), True), (2, 0, 0, 0, ids(), False), (3, 11, 11, 1, ids(5), True), (4, 3, 2, 1, ids(2), True), (5, 0, 0, 0, ids(), False), (1, 2, 2, 1, ids(2), True)]
    )
    near = decontam.proximity(docs(spark, [(1, "a x b y a"), (2, "b"), (3, "a")]), ["a b", "..."], 3)
    assert sorted(tuple(r) for r in near.collect()) == [(1, 0, 0), (1, 0, 2)]


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    for n, shared in ((5, 4), (60, 30), (4000, 3000)):
        x = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        a, b = superminhash.signatures([np.sort(x[:n]), np.sort(x[n - shared :])], 288)
        assert abs((a == b).mean() - shared / (2 * n - shared)) < 0.12
    one = superminhash.signatures([np.array([7], np.uint64)], 64)[0]
    assert sorted(one >> 22) == list(range(64))  # a permutation of all ranks


def test_components(spark):
    edges = [(5, 4), (4, 3), (10, 11), (11, 12), (12, 10), (7, 7), (None, 1), (3, 5), (20, 12)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 10: 10, 11: 10, 12: 10, 20: 10} | {100 + i: 100 for i in range(31)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("tile", [512, 16])
def test_near_duplicates(spark, tile, monkeypatch):
    monkeypatch.setattr(superminhash, "TILE", tile)
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in rng.integers(0, 400, 120)], []
    for i in range(60):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            w[p] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "one"), (103, "One "), (104, "a b"), (None, "a b"), (105, "A  B"), (106, "z " * 5000)]
    sets = {i: set(superminhash.shingle_set((t or "").encode(), 2).tolist()) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((group[a], group[b]))
            group = {i: lo if g == hi else g for i, g in group.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(docs(spark, rows), shingle=2).collect()}
    assert got.pop(None) == (1, None, False)
    assert got == {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}


def test_decontamination_drops_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as P

    window = "a b c d e f g h i j"
    spark.createDataFrame([(1, window)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs(spark, [(None, f"x {window} y"), (None, "clean"), (1, window), (1, "clean too", "t"), (2, None), (3, "a b c")])
    got = P.decontamination(spark, d, str(tmp_path))
    assert got.columns == P.COLUMNS and got.schema == d.select(*P.COLUMNS).schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, "clean", "en", "s", 5), (1, "clean too", "en", "t", 9), (2, None, "en", "s", 0), (3, "a b c", "en", "s", 5)], key=str)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in d.collect()}
        d = stored(stage(spark, d, SF), name)
        after = {r.doc_id: r.text for r in d.collect()}
        if name == "quality_classifier":
            assert sum(labels.get(i) == 1 for i in before.keys() - after.keys()) <= 0.05 * len(before)
        elif name == "near_dedup":
            sets = {i: set(superminhash.shingle_set((t or "").encode(), 5).tolist()) for i, t in before.items()}
            alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert not any(alike(a, b) for a, b in itertools.combinations(after, 2))
            assert all(any(alike(i, j) for j in before if j < i) for i in before.keys() - after.keys())
        elif name == "suffix_array_dedup":
            want = removed([(i, t.encode()) for i, t in before.items()], P.PASSAGE, "first")
            assert {i for i, t in before.items() if want[i][1] == 0} <= {i for i, t in after.items() if t == before[i]}
            assert all(len(t.encode()) >= want[i][0] - want[i][1] for i, t in after.items())
        elif name == "decontamination":
            hit = {r.doc_id for r in decontam.digest(decontam.contamination(spark.createDataFrame(list(before.items()), "doc_id long, text string"), bench)).where("contaminated").collect()}
            assert before.keys() - after.keys() == hit
    assert d.where(F.col("taken") > 2 * F.col("size")).count() == 0 and d.count() > 0
