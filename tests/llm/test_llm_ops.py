"""The operators against brute force, references and edge cases."""

import gc
import hashlib
import math
import random
import sys
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeloom.llm import bpe, html, jaccard, licenses, mixing, neighbours, quality, topk, toxicity, warc
from treeloom.llm.common import by_batch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and odd texts, repeated rows.
EDGES = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, " \t\n", "en", None, 3), (4, "one", "en", "src1", 3), (4, "one", "en", "src1", 3), (None, "no key at all here now", "en", "src1", 5), (6, "a b c d e f g h " * 3000, "fr", "src2", 48000), (7, "\x00 nul ퟿ <|endoftext|> &amp;", "en", "src1", 10)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.001"
    return {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "pages", "embeddings")}


# bpe


def test_bpe_equals_the_library():
    own, library = bpe.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    letters = "aeinthrsoldg '\"sΣσßİé́ \t\n\x1c\x85　漢🙂0123!?.,ABC½Ⅷ­"
    texts = ["", "nnn gggs", "<|startoftext|>a<|endoftext|>", "don't I'LL"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        ids, tokens, n = own.text(text)
        assert ids == " ".join(map(str, expected)) and n == len(expected)
        assert tokens == library.decode(expected, skip_special_tokens=False)


def test_bpe_workers_hold_no_encoder_after_their_tasks(spark):
    encoded = bpe.encode(frame(spark, EDGES), VOCABULARY, decoded="back")
    assert len(encoded.collect()) == len(bpe.digests(frame(spark, EDGES), VOCABULARY).collect()) == len(EDGES)
    bpe.decode(encoded, VOCABULARY).collect()

    def held(source):
        for batch in source:
            n = sum(isinstance(x, bpe.Encoder | bpe.Vocabulary) for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 100, 1, 4).mapInArrow(held, "n long").collect()} == {0}


def test_scoring_loads_no_pandas_into_workers(spark, tables):
    docs = tables["documents"].limit(50).select("text")
    own = by_batch(lambda: lambda texts: pa.array(["pandas" in sys.modules] * len(texts)), "boolean")
    spark.sparkContext.environment["TREELOOM_TEST"] = "1"  # other workers than those of the tests before
    try:
        assert {r[0] for r in docs.select(own("text")).collect()} == {False}
    finally:
        del spark.sparkContext.environment["TREELOOM_TEST"]


def test_bpe_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 200_000, raising=False)
    words = ["".join(chr(97 + (k * k + j * k) % 26) for j in range(100)) + f"q{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(600)]
    own, library = bpe.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in [*words, *words[-3:], " ".join(words[:9] * 2), "a" * 5000]:
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids
    held = [x for memo in vars(own).values() if isinstance(memo, dict) for k, v in memo.items() for x in (k, *v)]
    assert 0 < sum(map(len, held)) <= 200_000


def test_bpe_memo_holds_many_words(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 200_000)
    own, made = bpe.Encoder(VOCABULARY), []
    encoded = own.vocabulary.encode_split
    monkeypatch.setattr(own.vocabulary, "encode_split", lambda word: made.append(word) or encoded(word))
    text = " ".join(a + b + c for a in "bcdfghjk" for b in ("a", "ei", "ou", "u", "ie", "io", "oa") for c in "lmnprstv")
    first = own.text(text)
    assert own.text(text) == first and len(made) == 448
    assert first[1] == own.vocabulary.decode(own.ids(text)) and first[2] == len(own.ids(text))


def test_bpe_results_in_several_batches(spark):
    texts = [f"{c} " * n for c, n in zip("abcdefg", (150_000, 150_000, 3, 0, 300_000, 1, 2), strict=True)]
    rows = bpe.encode(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1), VOCABULARY, decoded="back").collect()
    library = Tokenizer.from_file(VOCABULARY)
    assert [r["doc_id"] for r in rows] == list(range(7))
    for r, t in zip(rows, texts, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r["text"], r["token_ids"], r["back"]) == (t, ids, library.decode(ids, skip_special_tokens=False))


def test_bpe_digests(spark):
    rows = bpe.digests(frame(spark, EDGES), VOCABULARY).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGES) and by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[1]["ids_sha256"] == by[3]["decoded_sha256"] == empty
    assert by[6]["n_tokens"] == 24000
    encoded = bpe.encode(frame(spark, EDGES).withColumn("TOKEN_IDS", F.lit(1)), VOCABULARY, decoded="back")
    assert encoded.columns.count("TOKEN_IDS") == 0 and len(encoded.where("doc_id = 6").first()["token_ids"]) == 24000
    assert bpe.decode(encoded, VOCABULARY).where("doc_id = 4").first()["decoded"] == encoded.where("doc_id = 4").first()["back"] == "one</w>"


# jaccard


def brute_components(texts: dict) -> dict:
    sets = {}
    for k, t in texts.items():
        words = (t or "").encode().lower().split()
        n = min(5, len(words))
        sets[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts, k = {}, 0
    for size in (1, 3, 5, 6, 9, 12, 20, 40, 90, 200):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 2, 4, 8):
                own = list(base)
                for _ in range(edits * size // 60 + (edits > 0)):
                    own[rng.randrange(size)] = rng.choice(words)
                texts[k] = " ".join(own) + (f" {shared}" if k % 3 == 0 else "")
                k += 1
    texts |= {k: None, k + 1: "", k + 2: "ONE two", k + 3: "one\x0btwo"}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(texts)


def test_jaccard_edges(spark):
    rows = jaccard.join(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[None][1] is None
    assert jaccard.join(frame(spark, [])).count() == 0
    kept = jaccard.keep_first(frame(spark, EDGES))
    assert kept.columns == frame(spark, EDGES).columns and kept.where("doc_id = 4").count() == 1


def test_sketch_bound():
    """Near sets always share a key, whatever counts as frequent."""
    rng = np.random.default_rng(3)
    for n in (5, 9, 17, 60, 400, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            frequent = jaccard.Frequent(rng.choice(a, int(len(a) * rng.random()), replace=False))
            drop = int(len(a) * 0.2 * rng.random())
            b = np.delete(a, rng.choice(len(a), drop, replace=False)) if drop else a
            room = int((len(b) - 0.8 * len(a)) / 0.8)
            b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, max(0, room), dtype=np.int64).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) != both:
                assert len(np.intersect1d(jaccard.keys_of(a, 80, frequent), jaccard.keys_of(b, 80, frequent)))


def test_bit_sketches_never_refuse_near_sets():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64)) for n in (30, 33, 64, 65, 120, 3000)]
    sets += [np.unique(np.concatenate((s[: int(len(s) * 0.93)], rng.integers(0, 1 << 40, 1 + len(s) // 20).astype(np.uint64)))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    found = {tuple(sorted((i, k))) for i, j, _ in jaccard.near_pairs(sizes, np.arange(len(sets)), [jaccard.bit_sketch(s) for s in sets], 80) for k in j.tolist()}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (sizes[i] + sizes[j] - both)}
    assert near and near <= found and len(found) < len(near) + 4


# searches


def vectors(spark, n=400, dims=16):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in v], 0) for k, v in enumerate(rng.standard_normal((n, dims)))]
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [float("nan")] * dims, 0), (n + 3, [1.0, None] * (dims // 2), 0), (n + 4, [0.0] * dims, 0), (n + 5, rows[0][1], 0), (None, rows[1][1], 0), (n + 6, [1.0, 2.0], 0)]
    return rows, frame(spark, rows, "vec_id long, embedding array<float>, label int")


def test_topk_equals_brute_force(spark):
    rows, df = vectors(spark)
    good = {k: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for k, v, _ in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    expected = set()
    for q in [k for k in good if k % 100 == 0]:
        scores = sorted((-int(good[q] @ good[k]), k) for k in good if k != q and len(good[k]) == len(good[q]))[:10]
        expected |= {(q, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)}
    assert {tuple(r) for r in topk.search(df, F.col("_id") % 100 == 0).collect()} == expected
    assert topk.search(df.limit(0), F.col("_id") % 100 == 0).count() == 0


def test_topk_with_every_row_repeated(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((300, 8)))]
    rows += rows + [(7, [float(c) for c in 3 * rng.standard_normal(8)]) for _ in range(15)] + [(8, [9.0] * 8)] * 12
    exact = [(k, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for k, v in rows]
    expected = set()
    for q in (0, 100, 200):
        best = {}
        for own in (v for k, v in exact if k == q):
            for k, v in exact:
                if k != q:
                    best[k] = max(best.get(k, -(2**63)), int(own @ v))
        expected |= {(q, rank, k, s) for rank, (k, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    got = topk.search(frame(spark, rows, "vec_id long, embedding array<float>"), F.col("_id") % 100 == 0).collect()
    assert len(got) == 30 and {tuple(r) for r in got} == expected


def test_topk_walk_stops_early_and_right():
    rng = np.random.default_rng(4)
    rows = rng.integers(-1000, 1000, (3000, 3))
    lists = topk.Lists(np.arange(3000), rows)
    for q in rng.integers(-50, 50, (20, 3)):
        ids, scores = lists.top(-1, q, 5)
        order = sorted((-int(r @ q), k) for k, r in enumerate(rows))[:5]
        assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == order
    assert lists.scored < 0.3 * lists.walked


def test_neighbours_recall_and_values(spark):
    rows, df = vectors(spark, 600)
    good = {k: np.array(v, np.float32).astype(float) for k, v, _ in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = neighbours.search(df, F.col("_id") % 100 == 0).collect()
    hits = total = 0
    for q in [k for k in good if k % 100 == 0 and len(good[k]) == 16]:
        order = sorted((float(np.sqrt(((good[k] - good[q]) ** 2).sum())), k) for k in good if k != q and len(good[k]) == 16)[:10]
        found = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert len(found) == 10 and all(math.isclose(s, math.sqrt(((good[k] - good[q]) ** 2).sum()), rel_tol=1e-12) for k, s in found.items())
        hits += len(found.keys() & {k for _, k in order})
        total += 10
    assert hits >= 0.9 * total
    few = neighbours.search(df.where("vec_id < 4"), F.col("_id") % 100 == 0).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3)]


@pytest.mark.parametrize("n", [200_000, 1_000_000, 10_000_000])
def test_neighbours_recall_of_large_tables(n):
    """The width of n vectors on 200,000 random directions: more vectors have nearer neighbours, which are found more often."""
    rng, width = np.random.default_rng(3), neighbours.width_for(n)
    rows = rng.standard_normal((200_000, 64), dtype=np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    tables = neighbours.Tables(64, width, 1.41 * math.sqrt(2))
    hits = 0
    for i in range(40):
        score = rows @ rows[i]
        score[i] = -9
        near = rows[np.argpartition(-score, 10)[:10]].astype(float)
        found = np.zeros(10, bool)
        for t in range(neighbours.TABLES):
            place = tables.places(rows[i][None].astype(float), t)[0]
            steps = neighbours.probes(place - np.floor(place), 10 * width)
            cells = np.repeat(np.floor(place)[None], len(steps), axis=0)
            for cell, step in zip(cells, steps, strict=True):
                for direction, by in step:
                    cell[direction] += by
            found |= np.isin(tables.keys(np.floor(tables.places(near, t)), t), tables.keys(cells, t))
        hits += found.sum()
    assert hits >= 0.9 * 400


# warc


def test_warc(spark, tmp_path):
    pages = frame(spark, [(1, "http://www.B.com/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "https://u@a.b.com:8080/q?z#f", None), (4, "http://a.b.com", ""), (None, "x", "y"), (5, "http://c", "long " * 50000)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (9, warc.digest("<p>é</p>".encode()), "revisit", 2), 2: (9, warc.digest("<p>é</p>".encode()), "response", None), 3: (0, warc.digest(b""), "revisit", 4), 4: (0, warc.digest(b""), "response", None), None: (1, warc.digest(b"y"), "response", None), 5: (250000, warc.digest(b"long " * 50000), "response", None)}
    assert warc.url_key("https://u@WWW.a.b.com:8080/Q?z#f") == "com,b,a:8080)/q?z" and warc.url_key(None) == ""
    folder = f"file://{tmp_path}"
    captures = warc.write_archives(pages, f"{folder}/warc").cache()
    captures.count()
    directory = warc.write_index(captures, f"{folder}/cdx").cache()
    wanted = frame(spark, [("com,b)/x", 1), ("com,none)/", 9)], "key string, page_id long")
    assert [bytes(r["payload"]) if r["payload"] else None for r in warc.fetch(wanted, directory, f"{folder}/cdx", f"{folder}/warc").collect()] == [None]
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_warc_repeated_and_null_ids(spark, monkeypatch, large):
    """Every row has a record of its own, in directories of either size; blocks are small, so that equal keys run over several."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    if large:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    rows = [(1, "u", "one"), (1, "u", "two"), (3, "u", "two"), (None, "u", "null"), (None, "u", "null"), (None, None, "two")]
    rows += [(7, "v", "same")] * 9 + [(k, f"http://h{k % 5}/", f"text {k % 11}") for k in range(20, 60)]
    pages = frame(spark, [(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.round_trip(pages).collect())
    whole = duckdb.connect()
    whole.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    whole.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    expected = sorted((r[0] or 0, r[1], r[2], r[3], r[4] or 0) for r in whole.sql(warc.ORACLE).fetchall())
    assert got == expected and len(got) == len(rows)
    assert len({r[2] for r in got if r[0] in (1, 3)}) == 2 and sum(r[0] == 7 and r[3] == "response" for r in got) == 1


# html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>First  <b>bold</b><br>line<p>Second &lt;x&gt;</p><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul>
<aside>Aside</aside><form><input><button>Go</button></form><table><tr><td>cell</td></tr></table><!-- c --></article><section class="comments"><article><p>Reader says</p></article></section></main>
<div id="sidebar">Side</div><footer>&copy; site</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", PAGE.replace("Second", "Other")), (3, None, None), (4, "http://h/4", ""), (5, "http://plain/", "<p>just <a href=x>text</a> here and more</p><p>x"), (1, "http://h/1", PAGE)]
    got = html.extract(frame(spark, rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "Head & line\nFirst bold line\nSecond <x>\none\ntwo\ncell" and by[2] == by[1].replace("Second", "Other")
    assert by[3] == by[4] == "" and by[5] == "just text here and more\nx" and len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def inferred(pages):
    whole = None
    for page in pages:
        own = html.expression(html.parse(page))
        whole = own if whole is None else html.aligned(whole, own)
    return html.finished(whole)


def test_wrapper_inference():
    page = lambda n, more="": f"<ul>{'<li>x</li>' * n}</ul>{more}<p>y</p>"
    whole = inferred([page(3), page(7), page(2, "<div>opt</div>")])
    assert html.shown(whole) == "ul{li}((li{#}(#))+) (div{#}(#))? p{#}(#)"
    assert html.shown(inferred(["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<p>e</p><h2>f</h2>"])) == "((h2{#}(#))+ (p{#}(#))+)+"
    assert html.shown(inferred(["<h1>a</h1>", "<h1>a</h1><p>b</p>", "<p>b</p>"])) == "(h1{#}(#))? (p{#}(#))?"


def plain_page(k, more=""):
    """A page without article element or telling names: menu, notice on some, article with h2 parts, a line that all pages end with, imprint."""
    rng = random.Random(k)
    text = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do tempor magna".split()) for _ in range(n)) + f" {k}."
    notice = "<div><p>This house stores small files on your machine.</p></div>" if k % 2 else ""
    menu = "".join(f"<li><a href=/{i}>{text(2)}</a></li>" for i in range(5))
    title, first = text(5), text(60)
    parts = [(text(3), text(40), text(5), text(6)) for _ in range(k % 4)]
    inner = "".join(f"<h2>{a}</h2><p>{b}</p><ul><li>{c}</li><li>{d}</li></ul>" for a, b, c, d in parts)
    page = f"<body>{notice}<div><ul>{menu}</ul></div><div class=x><div>{text(2)}</div><div><h1>{title}</h1><p>{first}</p>{inner}<p>Pass this on</p></div></div><div><p>Printed in 1 Street</p></div>{more}</body>"
    return page, "\n".join([title, first, *(x for part in parts for x in part)])


def test_articles_by_the_wrapper_alone():
    pages = [plain_page(k) for k in range(24)]
    whole = inferred([p for p, _ in pages])
    for page, expected in pages:
        assert html.text_of(html.parse(page), whole) == expected
    # without the wrapper's counts the same page keeps what the host repeats
    alone = inferred([pages[1][0]])
    assert "Pass this on" in html.text_of(html.parse(pages[1][0]), alone)


def test_pages_of_a_host_may_differ():
    labelled = "<body><div><p>Printed in 1 Street</p></div><article><header>by me</header><h1>T</h1><p>Some body of text that is long enough.</p><p>Printed in 1 Street</p></article></body>"
    pages = [plain_page(k)[0] for k in range(24)] + [labelled]
    whole = inferred(pages)
    assert html.text_of(html.parse(labelled), whole) == "T\nSome body of text that is long enough.\nPrinted in 1 Street"
    assert html.text_of(html.parse(pages[2]), whole) == plain_page(2)[1]
    side = "<article><div class=side><p>The body stands in an oddly named place.</p></div></article>"
    assert html.text_of(html.parse(side), inferred([side])) == "The body stands in an oddly named place."
    copies = [plain_page(3)[0]] * 9 + [plain_page(4)[0]]
    assert plain_page(3)[1] in html.text_of(html.parse(copies[0]), inferred(copies))


def test_long_and_deep_pages():
    import time

    named = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    page = lambda word: "<article>" + "".join(f"<div class={named(i)}><p>{word} {i}</p><h2>h{i}</h2></div>" for i in range(5000)) + "</article>"
    begin = time.time()
    whole = inferred([page("a"), page("b")])
    assert html.text_of(html.parse(page("a")), whole).count("\n") == 9999 and time.time() - begin < 30
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html.text_of(html.parse(deep), inferred([deep, deep])) == "x"


def test_html_edges(spark):
    schema = "page_id long, url string, html string, host string, wrapper string, text int"
    assert html.extract(frame(spark, [], schema)).count() == 0
    rows = [(1, None, "<p>a b</p>", "x", "y", 1), (1, None, "<p>a b</p>", "x", "y", 1), (None, "http://h", "<<<p>&amp;&#65;&nope;", None, None, None), (2, "http://h", "<p>" * 3, None, None, None)]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(frame(spark, rows, schema)).collect())
    assert got[1:] == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)] and got[0][1].endswith("&A&nope;")


def test_html_articles_of_the_table(tables):
    rows = html.extract(tables["pages"]).join(tables["pages"].select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["text"].replace("\n", " ").split() == html.entities.unescape(__import__("re").sub(r"<[^>]*>", " ", inner)).split()


# licences


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x", "nothing to see"), (3, "a/b/y", "some text " * 30 + "\nReleased under the MIT License.\nmore"), (4, "c/z", None), (5, None, ""), (6, "a/c/d/e", "plain")]
    got = {r["doc_id"]: (r["license"], r["license_from"]) for r in licenses.licensed(frame(spark, rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "own"), 2: ("Apache-2.0", "inherited"), 3: ("MIT", "own"), 4: (None, "none"), 5: (None, "none"), 6: ("Apache-2.0", "inherited")}
    scanner = licenses.Scanner(10, {})
    assert scanner.scan("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0" and scanner.scan("the license of the state")[0] is None


def test_license_texts():
    """Headers wrapped as comments, texts that differ by a clause or a word, titles of long texts, identifiers."""
    scan = licenses.Scanner(1000, {b"the": 900, b"of": 900, b"and": 900, b"license": 50}).scan
    wrapped = lambda text, mark="# ": "\n".join(mark + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert scan(f"#!/bin/sh\n#\n{wrapped(text)}\n#\n\nset -e\nrun the thing over and over with many other words\n")[0] == name, text
    for name, title in licenses.TITLES.items():
        body = "\n\n".join(f"{k}. Terms of section {k} with words of their own such as w{k} and v{k}." for k in range(200))
        assert scan(f"{wrapped(title, '      ')}\n\n{body}")[::2] == (name, True)
    assert scan(f"Copyright 2020 Some One\n\n{licenses._GRANT}")[::2] == ("MIT", True)
    assert scan("// SPDX-License-Identifier: ISC\nint main() { return 0; }")[0] == "ISC"
    assert scan("x" * 100_000 + " y" * 50_000) == (None, 0.0, False)


def test_license_edges(spark):
    schema = "doc_id long, path string, text string, _dir string, _found string, found string, folder string, License string"
    files = frame(spark, [(1, "a/L", "Released under the MIT License", "p", "q", "r", "s", "t"), (1, "a/L", "Released under the MIT License", "p", "q", "r", "s", "t"), (2, "a/x", None, "p", "q", "r", "s", "t")], schema)
    got = licenses.licensed(files)
    assert got.columns == ["doc_id", "path", "_dir", "_found", "found", "folder", "own_license", "cosine", "is_license_file", "license", "license_from"]
    assert sorted((r["doc_id"], r["license"], r["license_from"], r["_dir"], r["found"], r["folder"]) for r in got.collect()) == [(1, "MIT", "own", "p", "r", "s")] * 2 + [(2, "MIT", "inherited", "p", "r", "s")]
    assert licenses.licensed(files.limit(0)).count() == 0


def test_license_cosine_is_plain_tf_idf():
    scanner = licenses.Scanner(100, {b"the": 90, b"license": 5})
    line = "Licensed under the Apache License, Version 2.0 today"
    words = Counter(licenses.lower_words(line))
    weight = lambda t: scanner.weight.get(t, scanner.unknown)
    best = 0.0
    for texts in licenses.TEMPLATES.values():
        for x in texts:
            other = Counter(licenses.lower_words(x))
            dot = sum(words[t] * other[t] * weight(t) ** 2 for t in words)
            norm = lambda c: math.sqrt(sum((n * weight(t)) ** 2 for t, n in c.items()))
            best = max(best, dot / norm(words) / norm(other))
    assert math.isclose(scanner.scan(line)[1], best, rel_tol=1e-12)


# quality and toxicity


def brute_kneser_ney(texts, order=quality.ORDER, size=quality.SIZE):
    """Probabilities by the formulas, n-gram by n-gram."""
    counts = Counter()
    for t in texts:
        codes, _, _ = quality.classes([t])
        for k in range(len(codes) - order + 1):
            counts[tuple(codes[k : k + order].tolist())] += 1
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounts(c):
        n = Counter(c.values())
        if not n[1] or not n[2]:
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
        return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]

    off = {n: discounts(c) for n, c in levels.items()}

    def p(gram):
        n = len(gram)
        if not n:
            return 1.0 / size
        below = p(gram[1:])
        seen = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        total = sum(seen.values())
        if not total:
            return below
        d = off[n]
        freed = sum(d[min(c, 3) - 1] for c in seen.values())
        c = seen.get(gram, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + freed / total * below

    return p


def whole_model(table):
    rows = table.collect()
    return quality.Model(np.array([r["key"] for r in rows], np.int64).astype(np.uint64), np.array([r["value"] for r in rows], np.float32))


def test_quality_model_equals_brute_force(spark):
    texts = ["The cat sat on the mat. the cat", "a cat, a hat; the end", "über allen gipfeln ist ruh", "мир и мир", "漢字 12 字"]
    model = whole_model(quality.estimate(quality.count_grams(frame(spark, [(t,) for t in texts], "text string")).cache()))
    p = brute_kneser_ney(texts)
    n = quality.ORDER
    for text in ("the cat", "zq%% x", "h", "мир", "字 7"):
        codes, _, _ = quality.classes([text])
        cost = -sum(math.log(p(tuple(codes[k : k + n].tolist()))) for k in range(len(codes) - n + 1))
        assert math.isclose(model.cost([text])[0][0], cost, rel_tol=1e-5)
    # over the whole alphabet the probabilities after a context sum to one
    context = quality.classes(["the "])[0][-4:]
    every = (sum(int(c) << quality.BITS * (4 - k) for k, c in enumerate(context)) + np.arange(quality.SIZE)).astype(np.uint64)
    assert math.isclose(np.exp(model.each(every)).sum(), 1.0, rel_tol=1e-4)


def test_quality_joined_model_gives_the_same(spark, tables, monkeypatch):
    """A model that is too large for a worker is joined in shards, with the same costs."""
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "SHARD", 20_000)
    docs = tables["documents"].where("length(text) < 3000").unionByName(frame(spark, EDGES)).withColumn("block", F.lit("x"))
    model = quality.estimate(quality.count_grams(docs.where("doc_id % 3 = 0")).cache())
    own = sorted((r["doc_id"] or 0, r["n_chars"] or 0, round(r["cost"], 3), r["cost_chars"], r["block"]) for r in quality.scored(docs, model).collect())
    monkeypatch.setattr(quality, "MODEL_BYTES", 0)
    joined = quality.scored(docs, model)
    assert joined.columns == [*docs.columns, "cost", "cost_chars"]
    assert sorted((r["doc_id"] or 0, r["n_chars"] or 0, round(r["cost"], 3), r["cost_chars"], r["block"]) for r in joined.collect()) == own


def test_quality_keeps_good_and_drops_junk(spark, tables):
    docs = tables["documents"].unionByName(frame(spark, [(10**9 + k, t, lang, s, n) for k, (_, t, lang, s, n) in enumerate(EDGES)]))
    judged = quality.judged(docs.withColumn("KEEP", F.lit(1)), tables["labels"])
    rows = judged.join(tables["labels"], "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good)
    by = {r["doc_id"] - 10**9: r for r in judged.where(f"doc_id >= {10**9}").collect()}
    assert not by[0]["keep"] and not by[1]["keep"] and not by[2]["keep"] and by[2]["perplexity"] is None
    kept = quality.keep_good(docs.withColumns({"KEEP": F.lit(1), "threshold": F.lit("x")}), tables["labels"])
    assert kept.columns == [*docs.columns, "KEEP", "threshold"] and kept.first()["threshold"] == "x"
    assert quality.keep_good(docs.limit(0), tables["labels"].limit(0)).count() == 0


def test_quality_rejects_labelled_junk(spark):
    """On a table with enough labels for quantiles of each language: junk that the model never saw goes, held-out good texts stay."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id % 50 = 1").withColumn("lang", F.lit("xx")))  # repeated rows, in a language without labels of its own
    rows = quality.judged(docs, labels).join(labels, "doc_id").where("lang <> 'xx'").collect()
    good, bad = ([r["keep"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_segments_equal_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        model = toxicity.Model(words={b"x": 2.0, b"y": 0.7, b"z": -1.0}, drift=-0.5)
        words = [rng.choice([b"x", b"y", b"z", b"n", b"n"]) for _ in range(rng.randint(0, 14))]
        scores = [model.words.get(w, model.drift) for w in words]
        best = max((sum(scores[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)), default=0.0)
        found = model.segments(words)
        assert math.isclose(max((s for _, _, s in found), default=0.0), max(best, 0.0), abs_tol=1e-9)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))
        assert all(math.isclose(sum(scores[a:b]), s, abs_tol=1e-9) for a, b, s in found)


def maximal_segments(scores):
    """All maximal scoring segments by their definition: the best one (the shortest of equally good ones, the first of these), then those left and right of it."""
    best = max(((round(sum(scores[a:b]), 9), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return maximal_segments(scores[:a]) + [(a, b)] + [(a2 + b, b2 + b) for a2, b2 in maximal_segments(scores[b:])]


def test_all_segments_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        model = toxicity.Model(words={b"x": 2.25, b"y": 0.75, b"z": -1.5}, drift=-0.625)
        words = [rng.choice([b"x", b"y", b"z", b"n", b"n"]) for _ in range(rng.randint(0, 25))]
        found = [(a, b) for a, b, _ in model.segments(words)]
        assert found == maximal_segments([model.words.get(w, model.drift) for w in words])


def test_segments_in_linear_time():
    import time

    for other in (b"z", b"n"):
        model = toxicity.Model(words={b"x": 1.0, b"z": -1.1}, drift=-1.1)
        words = [b"x", other] * 16_000
        begin = time.time()
        assert len(model.segments(words)) == 16_000 and time.time() - begin < 1


def test_toxicity_edges(spark):
    """Contradicting labels, repeated rows and very long texts; no column but the text is looked at."""
    rows = [(k, f"plain words number {k % 37} are here", "en", "s", k) for k in range(400)] + [(1000 + k, f"you are a vile{k % 5} zounds person {k}", "en", "s", k) for k in range(60)]
    docs = frame(spark, rows + rows[-3:] + [(2000, "zounds " * 200_000, "en", "s", 1), (2001, "calm " * 200_000, "en", "s", 1)])
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in rows] + [(5, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert got[2000] >= 0.5 > got[2001] and all(got[1000 + k] >= 0.5 for k in range(60)) and all(got[k] < 0.5 for k in range(400))


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert b"idiot" in model.words
    rows = toxicity.scored(docs, model).select("doc_id", "text", "score").join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)
    insults = [r["score"] for r in rows if r["toxic"] and b"idiot" in toxicity.lower_words(r["text"])]
    assert all(s >= 0.5 for s in insults)
    text = "and so you IDIOT, idiot scum of it"
    spans = model.passages(text)
    assert spans and "IDIOT" in text[spans[0][0] : spans[-1][1]]
    edges = toxicity.scored(frame(spark, EDGES), model).collect()
    assert all(0 <= r["score"] < 0.5 for r in edges)
    assert toxicity.train(docs.limit(0), labels.limit(0)).words == {}
    clashing = docs.withColumn("Score", F.lit("x"))
    assert toxicity.keep_clean(clashing, labels).columns == clashing.columns


def test_toxicity_takes_all_candidates(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "CANDIDATES", 1)
    joined = toxicity.train(docs, labels)
    assert len(whole.words) > 1 and joined == whole


# mixing


def test_mixing_equals_sql(spark, tables):
    docs = tables["documents"].select("doc_id", "text", "lang", "source", "n_chars").unionByName(frame(spark, EDGES))
    got = mixing.with_leaf(mixing.mix(docs)).select("doc_id", "_leaf.domain", "_leaf.lang", "_leaf.source", "epoch", "n_tokens").collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    expected = con.execute(mixing.oracle()).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, expected))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = frame(spark, [("d", "en", "a", 100), ("d", "en", "b", 1000), ("d", "fr", "c", 10), ("d", "fr", "e", 10)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 50, 1, languages={"en": 1, "fr": 1}).collect()}
    assert got == {"c": 10, "e": 10, "a": 100, "b": 440}


def test_mixing_edges(spark):
    """Ties, repeated rows, white space of all kinds, and columns called like those of the plan."""
    rows = [(1, "a b\tc\n\nd", "en", "s1"), (1, "a b\tc\n\nd", "en", "s1"), (2, " \t\n", "en", "s1"), (3, "x", None, None), (4, "x\x0by", "de", "s2"), (None, "u v", "de", "s2")]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in ("_whole", "_n", "_leaf", "_row", "_rest", "_bucket", "EPOCH", "a.b")})
    got = mixing.mix(docs, percent=100, epochs=1)
    assert [c for c in got.columns] == [c for c in docs.columns if c != "EPOCH"] + ["epoch", "n_tokens"]
    found = sorted(((r["doc_id"] or 0, r["n_tokens"], r["_n"], r["_whole"]) for r in got.collect()))
    assert found == [(0, 2, "_n", "_whole"), (1, 4, "_n", "_whole"), (1, 4, "_n", "_whole"), (3, 1, "_n", "_whole"), (4, 2, "_n", "_whole")]
