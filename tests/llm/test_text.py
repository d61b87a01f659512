"""Operators 1, 4, 5, 7 and 8."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html.parser
import itertools
import time
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.llm import crf, op1_warc, op4_language, op5_decontaminate, op7_line_frequency, op8_quality_pu, queries
from sitelens.llm.common import store
from sitelens.llm.words import hashed_words, words
from tests import oracle
from tests.llm.cases import LONG, ODD, SCHEMA, frame, prose

# ---- SQL ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])


# ---- 1 ------------------------------------------------------------------------------------------------------------------


class Reader(html.parser.HTMLParser):
    """Visible text by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.off.append(tag)
        elif tag in op1_warc.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.off and tag == self.off[-1]:
            self.off.pop()
        elif tag in op1_warc.BLOCKS:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" " if not self.off else "")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_conversions_hold_the_visible_text(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    made = op1_warc.derive(op1_warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()
    assert len(made) == 2 * len(pages)
    by_id = {r["record_id"]: r for r in made}
    assert len(by_id) == len(made)
    for r in made:
        page = pages[r["id"]]
        other = by_id[r["concurrent_to"]]
        assert (other["refers_to"], other["id"], {other["record_type"], r["record_type"]}) == (r["refers_to"], r["id"], {"metadata", "conversion"})
        assert r["target_uri"] == page["url"]
        assert r["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page["html"].encode()).digest()).decode()
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["block"])).digest()).decode()
        if r["record_type"] == "conversion":
            assert bytes(r["block"]).decode() == Reader(page["html"]).text()
        else:
            assert f"source-payload-digest: {r['source_payload_digest']}\r\n" in bytes(r["block"]).decode()


def test_odd_responses():
    png = op1_warc.derive_one("<urn:uuid:1>", None, None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")
    assert [r["record_type"] for r in png] == ["metadata"] and png[0]["concurrent_to"] is None
    latin = op1_warc.derive_one(None, "x", "d", b"HTTP/1.0 200 OK\nContent-Type: text/plain; charset=latin-1\nX: a\n b\n\n\xe9 <b>")
    assert bytes(latin[1]["block"]).decode() == "é <b>" and '["X", "a b"]' in latin[0]["source_headers"]
    for block in (b"", b"no header", b"HTTP/1.1 200 OK\r\n\r\n<p>\xff<script>", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=bogus\r\n\r\na<b"):
        assert len(op1_warc.derive_one(None, None, None, block)) == 2
    assert op1_warc.plain_text("a" + "<a \"" * 3000).startswith("a")


def test_head_without_its_end_tag():
    inside = "<meta charset=utf-8><title>a <b> t</title><script>'<div>no</div>'</script><!-- <p>no --><link rel=x><style>p{}</style>\n"
    for rest in ("<body><p>one</p>two", "<div>one</div>two", "<h1 class='x'>one</h1>two", "</head><p>one</p>two", "</head><body><p>one</p>two", "<header>one</header>two"):
        assert op1_warc.plain_text(f"<!doctype html><html><head lang=en>{inside}{rest}") == "one\ntwo", rest
    assert op1_warc.plain_text("<head><title>t</title><svg>no</svg>yes") == "yes"
    assert op1_warc.plain_text("<p>one<script>no<p>no") == "one" and op1_warc.plain_text("<head><style>no") == ""


PAGE = "<html><head><title>é</title></head><body><p>one<p>two</body></html>".encode()


def chunked(body, size):
    return b"".join(f"{len(body[k : k + size]):X};x=1\r\n".encode() + body[k : k + size] + b"\r\n" for k in range(0, len(body), size)) + b"0\r\n\r\n"


@pytest.mark.parametrize(
    ("headers", "body"),
    [
        ("Content-Encoding: gzip", gzip.compress(PAGE)),
        ("content-encoding: X-GZIP", gzip.compress(PAGE[:9]) + gzip.compress(PAGE[9:])),
        ("Content-Encoding: gzip", PAGE),
        ("Content-Encoding: deflate", zlib.compress(PAGE)),
        ("Content-Encoding: deflate", zlib.compress(PAGE)[2:-4]),
        ("Content-Encoding: zstd", zstandard.compress(PAGE)),
        ("Transfer-Encoding: chunked", chunked(PAGE, 7)),
        ("Transfer-Encoding: chunked", PAGE),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(PAGE), 10)),
        ("Content-Encoding: identity", PAGE),
    ],
)
def test_encodings_are_undone(headers, body):
    meta, text = op1_warc.derive_one("<urn:uuid:1>", "u", "d", f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body)
    assert bytes(text["block"]).decode() == "one\ntwo" and b"title: \xc3\xa9\r\n" in meta["block"]
    assert meta["source_payload_digest"] == op1_warc.digest(body)


def test_bodies_that_stay_packed(monkeypatch):
    monkeypatch.setattr(op1_warc.unpacked, "__defaults__", (1000,))
    bomb = gzip.compress(b"x" * 100_000)
    for headers, body, why in (("Content-Encoding: br", b"\x0b\x02", b"encoding br"), ("Content-Encoding: gzip", bomb, b"unpacks to over 1000 bytes"), ("Content-Encoding: zstd", zstandard.compress(b"x" * 9000), b"unpacks to over 1000 bytes")):
        (meta,) = op1_warc.derive_one("<urn:uuid:1>", "u", "d", f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body)
        assert b"conversion-left-out: " + why in meta["block"] and meta["concurrent_to"] is None
    assert op1_warc.unpacked(gzip.compress(PAGE)[:-9], [("Content-Encoding", "gzip")])[:10] == PAGE[:10]
    assert op1_warc.unchunked(b"5\r\nabc") == b"abc" and op1_warc.unchunked(b"3\nabc\n2\nde") == b"abcde" and op1_warc.unchunked(b"") == b""


def test_tags_without_bounds():
    began = time.time()
    assert op1_warc.plain_text(f"<p title='{'x' * 200_000}' {'y ' * 100_000}>one</p><img src=\"data:{'z' * 3_000_000}\">two") == "one\ntwo"
    assert op1_warc.plain_text("one" + "<a \"" * 200_001).startswith("one")
    assert op1_warc.plain_text("one <b title=") == "one"
    long = "<p>" + "word " * 800_000
    assert len(op1_warc.plain_text(long)) == 5 * 800_000 - 1
    assert time.time() - began < 20


def test_dates_are_utc_in_any_zone(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (-1_700_000_001, "u", "x"), (100_000_000, "u", "x"), (None, "u", "x")], "page_id long, url string, html string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r["warc_date"] for r in op1_warc.responses(pages).collect()] == ["2023-11-14T22:13:21Z", "1969-12-31T23:59:59Z", "2027-01-15T08:00:00Z", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_warc_files_are_read(spark, sf_dir, tmp_path):
    """Responses written as WARC and read back give the derivatives of the table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = op1_warc.responses(pages).collect()
    for k, part in enumerate((rows[:7], rows[7:], [])):
        data = [b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
        data += [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['target_uri']}\r\nWARC-Date: {r['warc_date']}\r\nContent-Length: {len(r['block'])}\r\n\r\n".encode() + bytes(r["block"]) + b"\r\n\r\n" for r in part]
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(map(gzip.compress, data)) if k else b"".join(data))
    found = op1_warc.derive(op1_warc.read_warc(spark, f"file://{tmp_path}/*.warc.gz")).drop("id").collect()
    want = op1_warc.derive(op1_warc.responses(pages.withColumns({"block": F.lit(1), "record_id": F.lit(2), "id": F.lit(3)}))).drop("id").collect()
    assert sorted(found) == sorted(want) and len(want) == 2 * len(rows)


def test_folders_that_can_t_be_written(spark):
    made = op1_warc.derive(op1_warc.responses(spark.createDataFrame([], "page_id long, url string, html string")))
    with pytest.raises(ValueError):
        op1_warc.write_warc(made, "ftp://somewhere/x")
    assert store("dbfs:/tmp/x")[1] == "/dbfs/tmp/x" and store("file:///tmp/x")[1] == "/tmp/x"


def test_null_and_repeated_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.example/", None), (2, "u", "<p>x"), (2, "u", "<p>x")], "page_id long, url string, html string")
    made = op1_warc.derive(op1_warc.responses(pages)).collect()
    assert len(made) == 8
    assert len({r["record_id"] for r in made if r["id"] == 2}) == 2
    assert op1_warc.derive(op1_warc.responses(pages.limit(0))).count() == 0


def test_files_read_back(spark, sf_dir, tmp_path):
    made = op1_warc.derive(op1_warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    files = op1_warc.write_warc(made, f"file://{tmp_path}/w", file_bytes=20_000).collect()
    assert len(files) > 1
    found = [(h["WARC-Record-ID"], h["WARC-Refers-To"], block) for f in files for h, block in op1_warc.parse_warc((tmp_path / "w" / f["file"]).read_bytes())]
    assert sorted(found) == sorted((r["record_id"], r["refers_to"], bytes(r["block"])) for r in made.collect())
    assert list(op1_warc.parse_warc(gzip.compress(b""))) == []


# ---- 4 ------------------------------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    e, a = r.normal(size=(5, 3)), r.normal(size=(3, 3))
    total, mass = np.zeros((5, 3)), 0.0
    for y in itertools.product(range(3), repeat=5):
        w = np.exp(sum(e[t, y[t]] for t in range(5)) + sum(a[y[t], y[t + 1]] for t in range(4)))
        mass += w
        for t in range(5):
            total[t, y[t]] += w
    assert np.allclose(crf.marginals(e, np.array([0]), a), total / mass)
    assert np.isclose(crf.forward_backward(e[None], a)[2][0], np.log(mass))


@pytest.mark.parametrize("scale", [0.05, 3.0])
def test_lanes_equal_one_run(scale):
    r = np.random.default_rng(1)
    sizes = [1, 2, 31, 32, 33, 64, 65, 100, 7, 300]
    e, a = r.normal(size=(sum(sizes), 4)) * scale, np.eye(4) * 9 + r.normal(size=(4, 4)) * 0.1
    first = np.cumsum([0, *sizes[:-1]])
    got = crf.marginals(e, first, a)
    for f, n in zip(first, sizes, strict=True):
        assert np.allclose(got[f : f + n], crf.forward_backward(e[None, f : f + n], a)[0][0], atol=1e-8)
    assert np.allclose(crf.side_by_side(e, first, a), got, atol=1e-8)


def test_gradient_follows_the_likelihood():
    weights, transition = crf.train([["aba", "abb"] * 40, ["zyz", "zzy"] * 40], steps=60)
    e = crf.emissions(weights, ["aba", "aba", "zyz", "zyz"])
    assert crf.marginals(e, np.array([0]), transition).argmax(axis=1).tolist() == [0, 0, 1, 1]
    assert transition[0, 0] > transition[0, 1]


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_language_crf"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, "aaa bbb " * 20 if i % 2 else "xxx yyy " * 20, "p" if i % 2 else "q") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spoilt = df.withColumn("lang", F.when(op4_language.remainder(4) == 2, "wrong").otherwise(F.col("lang")))
    langs, _, _ = op4_language.learn(spoilt)
    assert langs == ["p", "q"]


def test_odd_texts_have_a_language(spark):
    df = frame(spark, [*ODD, "x"], [*range(len(ODD)), None])
    langs, w, t = op4_language.learn(spark.createDataFrame([(i, "un deux trois" if i % 2 else "one two three", "fr" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in op4_language.languages(df, langs, w, t).collect()}
    assert len(got) == len(ODD) + 1
    for i, text in enumerate(ODD):
        assert (got[i]["lang_pred"] == "und") is (not any(c.isalpha() for c in text or "")), text
        assert 0 <= got[i]["score"] <= 1
    none = op4_language.languages(df, *op4_language.learn(frame(spark, ODD))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = op4_language.languages(df, *op4_language.learn(spark.createDataFrame([(0, "a b", "en"), (1, "c", "en"), (3, "d", "en")], "doc_id long, text string, lang string"))).collect()
    assert {r["lang_pred"] for r in one} == {"und", "en"}


def test_runs_split_text_that_switches(spark):
    english, french = "the cat sat on that mat with her hat ", "le chat est sur une table avec mon chapeau "
    learnt = op4_language.learn(spark.createDataFrame([(i, (french if i % 2 else english) * 5, "fr" if i % 2 else "en") for i in range(80)], "doc_id long, text string, lang string"))
    texts = [english * 4 + french * 3 + english * 2, french * 3 + "12 -- " + english * 5, *ODD]
    got = {r["doc_id"]: r for r in op4_language.runs(frame(spark, texts), *learnt).collect()}
    assert [(x["lang"], x["first"], x["words"]) for x in got[0]["runs"]] == [("en", 0, 36), ("fr", 36, 27), ("en", 63, 18)]
    assert [(x["lang"], x["first"], x["words"]) for x in got[1]["runs"]] == [("fr", 0, 27), ("en", 27, 45)]
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "en"
    langs, weights, transition = learnt
    for i, t in enumerate(texts):
        own = op4_language.words(t or "")
        if own:
            p = crf.forward_backward(crf.emissions(weights, own)[None].astype(float), transition)[0][0]
            want, at = [], 0
            for k, g in itertools.groupby(p.argmax(axis=1).tolist()):
                n = len(list(g))
                want.append((langs[k], at, n, p[at : at + n, k].mean()))
                at += n
            assert [tuple(x)[:3] for x in got[i]["runs"]] == [x[:3] for x in want]
            assert np.allclose([x["probability"] for x in got[i]["runs"]], [x[3] for x in want], atol=1e-5)
            assert got[i]["lang_pred"] == langs[p.sum(axis=0).argmax()] and np.isclose(got[i]["score"], p.mean(axis=0).max(), atol=1e-5)
        else:
            assert (got[i]["runs"], got[i]["lang_pred"], got[i]["score"]) == ([], "und", 0.0)


def test_language_of_long_documents_is_learnt(spark):
    rows = [(i, "le chat est sur une table " * 2000 if i % 2 else "the cat sat on that mat " * 5, "fr" if i % 2 else "en") for i in range(24)]
    assert min(len(t) for i, t, x in rows if x == "fr") > op4_language.SAMPLE_CHARS
    learnt = op4_language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learnt[0] == ["en", "fr"]
    assert [r["lang_pred"] for r in op4_language.languages(frame(spark, ["le chat est sur la table"]), *learnt).collect()] == ["fr"]


def test_every_language_is_learnt(spark):
    """More languages than have whole weights, most of them rare."""
    names = [f"l{k:03d}" for k in range(140)]
    word = lambda k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ane", "ore", "uli", "esk")]
    rows = [(i, " ".join(word(k) * 4), names[k]) for k in range(140) for i in range(k * 4, k * 4 + 4)]
    learnt = op4_language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20, total_chars=100_000)
    assert learnt[0] == sorted({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}) and learnt[1].shape == (1 << 16, len(learnt[0]))
    got = [r["lang_pred"] for r in op4_language.languages(frame(spark, [" ".join(word(k)[::-1]) for k in range(140)]), *learnt).collect()]
    assert sum(g == n for g, n in zip(got, names, strict=True)) > 0.9 * 140
    assert op4_language.languages(frame(spark, []), *learnt).count() == 0


def test_query_labels_every_text_by_its_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, weights, transition = op4_language.learn(docs)
    got = {r["doc_id"]: r for r in op4_language.op4_language_crf(spark, sf_dir).collect()}
    for r in docs.collect():
        own, words_ = got.pop(r["doc_id"]), op4_language.words(r["text"] or "")
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if words_:
            e = np.array([weights[crf.features(w)].astype(float).sum(axis=0) for w in words_])
            p = crf.forward_backward(e[None], transition)[0][0].mean(axis=0)
            assert own["lang_pred"] == langs[p.argmax()] and np.isclose(own["score"], p.max(), atol=1e-4)
        else:
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
    assert not got


# ---- 5 ------------------------------------------------------------------------------------------------------------------


def brute_contamination(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for s in range(len(own) - m + 1):
                if own[s : s + m] == w[i : i + m]:
                    hit.update(range(s, s + m))
                    if item is not None:
                        found.add(item)
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


small = st.lists(st.sampled_from(["a", "b", "C", "é", "1"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(small, st.lists(small, max_size=6), st.integers(1, 6))
def test_search_equals_brute_force(text, items, window):
    numbered = list(enumerate(items))
    spans, found = op5_decontaminate.WuManber([(i, words(t)) for i, t in numbered], window).search(words(text))
    want = brute_contamination(text, numbered, window)
    assert op5_decontaminate.covered(spans) == want[1] and len(found) == want[2]


@pytest.mark.parametrize("block_bytes", [4_000_000, 40])
def test_contamination_in_blocks(spark, block_bytes):
    items = [(0, prose(3, 15)), (10, prose(4, 30)), (2, "short one"), (2, "other"), (None, "null item"), (5, None), (6, "..."), (7, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit("x"))
    texts = [*ODD, prose(9, 5) + " " + prose(3, 15).upper() + "! tail", "a short, one", "x null item y", prose(4, 30) + " " + prose(4, 30), "other\nother"]
    got = {r["doc_id"]: tuple(r)[1:] for r in op5_decontaminate.contamination(frame(spark, texts), bench, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        if t is not LONG:
            assert got[i] == brute_contamination(t, items), t
    kept = op5_decontaminate.clean(frame(spark, texts), bench, block_bytes=block_bytes)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if not r[4])
    assert kept.columns == frame(spark, []).columns


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in op5_decontaminate.contamination(frame(spark, ODD), none).collect())
    assert op5_decontaminate.contamination(frame(spark, []), none).count() == 0


# ---- 7 ------------------------------------------------------------------------------------------------------------------


def test_word_hashes_follow_the_words(spark, sf_dir):
    texts = [t for t in ODD if t is not LONG] + ["Ab aB AB", "a-b a_b a b", "production productive constantinople constantiXYZle", "x" * 200 + "y", "x" * 200 + "z"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    h, n, digests = hashed_words(texts)
    want = [w for t in texts for w in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts]
    seen, named = {}, {}
    for w, x in zip(want, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for t, d in zip(texts, digests, strict=True):
        assert (d is None) == (not words(t)) and named.setdefault(tuple(words(t)), d) == d
    assert len(set(named.values())) == len(named)
    assert [len(x) for x in hashed_words([])] == [0, 0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=15), max_size=4))
def test_repeated_windows(texts):
    want = []
    for own in texts:
        count, hit = {}, set()
        for i in range(len(own) - 2):
            count.setdefault(tuple(own[i : i + 3]), []).append(i)
        for places in count.values():
            if len(places) > 1:
                hit.update(p + k for p in places for k in range(3))
        want.append(len(hit))
    assert op7_line_frequency.repeat_words(texts) == want


def test_boilerplate_depletes_a_document(spark):
    body = lambda k: prose(k, 60)
    rows = [(k, "MENU  home\nmenu home\n" + body(k), "a") for k in range(40)]
    rows += [(100 + k, prose(7, 80) + "\n" + prose(500 + k, 10), "a") for k in range(6)]
    rows += [(200, prose(7, 80) + "\n" + prose(600, 10), "b"), (201, prose(7, 80), None), (202, None, "a"), (203, "", "a"), (0, "MENU  home\nmenu home\n" + body(0), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit(1), "lines": F.lit("x"), "row": F.lit(2)})
    got = op7_line_frequency.line_frequency(df).toPandas()
    assert len(got) == len(rows)
    of = lambda i: got[got.doc_id == i].iloc[0]
    assert of(3).kept and of(3).n_words_cut == 4 and of(3).n_dup_lines == 0
    assert not of(102).kept and not of(102).base_failed and of(102).n_words_cut == 80
    assert of(200).kept and of(201).kept and of(202).base_failed and of(203).n_words == 0
    assert op7_line_frequency.line_frequency(df.limit(0)).count() == 0


def test_figures_of_odd_texts(spark):
    got = {r["doc_id"]: r for r in op7_line_frequency.line_frequency(frame(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        own = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_dup_lines"]) == (len(own), sum(len(w.decode()) for w in own), len(lines) - len(set(lines)))
        assert got[i]["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")


def brute_clean(rows):
    """Kept (doc_id, text) of op7 by plain counting."""
    norm = lambda line: b" ".join(line.encode().lower().split())
    docs, often, out = {}, {}, []
    for _, text, host in rows:
        docs[host] = docs.get(host, 0) + 1
        for x in {norm(line) for line in (text or "").split("\n")} - {b""}:
            often[host, x] = often.get((host, x), 0) + 1
    for i, text, host in rows:
        bad = lambda line: often.get((host, norm(line)), 0) >= 5 and often[host, norm(line)] > 0.02 * docs[host]  # noqa: B023, E731
        lines = (text or "").split("\n")
        own = (text or "").encode().split()
        windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        repeated = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        cut = sum(len(line.encode().split()) for line in lines if bad(line))
        if len(own) >= 50 and 100 * len(repeated) <= 50 * len(own) and cut <= 0.5 * len(own):
            out.append((i, "\n".join(line for line in lines if not bad(line))))
    return out


def test_clean_takes_boilerplate_out(spark):
    rows = [(k, f"Menu  HOME\n\n{prose(k, 30)} é\r\nmenu home\t\n{prose(900 + k, 25)}\nshare | print", "a" if k % 3 else None) for k in range(60)]
    rows += [(100 + k, prose(7, 80) + "\n" + prose(500 + k, 10), "a") for k in range(6)]
    rows += [(200 + k, prose(8, 20) + "\n" + prose(700 + k, 60), f"h{k % 3}") for k in range(14)]
    rows += [rows[0], rows[1], (None, rows[2][1], "a"), (None, None, "a"), (300, prose(7, 80), "b"), (301, "", None), (302, "menu home\n" * 80, "a")]
    rows += [(400 + k, f"x{k} " * 60 + "\nmenu home", "a") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("host", "key", "gone", "lines", "row", "kept", "n_words")})
    got = op7_line_frequency.clean(df)
    assert got.columns == df.columns
    want = brute_clean(rows)
    order = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == sorted(want, key=order)
    assert 60 < len(want) < len(rows) and not any("menu home" in t.lower() for i, t in want if i is not None and 0 < i < 60)
    short = op7_line_frequency.clean(df, min_words=0).where("doc_id is null and text is null").count()
    assert short == 1 and op7_line_frequency.clean(df.limit(0)).count() == 0


# ---- 8 ------------------------------------------------------------------------------------------------------------------


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_quality_pu"](spark, sf).toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = both[both.held_out]
    assert (held.quality == held.predicted).mean() > 0.97
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()


def test_risk_recovers_the_posterior():
    r = np.random.default_rng(0)
    good = r.normal(1.5, 1, (3000, 2))
    mixed = np.concatenate([r.normal(1.5, 1, (1500, 2)), r.normal(-1.5, 1, (1500, 2))])
    model = op8_quality_pu.train(good, mixed, 0.5)
    assert (op8_quality_pu.score(model, r.normal(1.5, 1, (500, 2))) > 0.5).mean() > 0.95
    assert (op8_quality_pu.score(model, r.normal(-1.5, 1, (500, 2))) < 0.5).mean() > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = frame(spark, [prose(k, 80) if k % 3 else "x " * 80 for k in range(120)])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), None) for k in range(120)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    spoilt = labels.withColumn("quality", F.when(op8_quality_pu.remainder(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = op8_quality_pu.learn(docs, labels), op8_quality_pu.learn(docs, spoilt)
    assert all((a[k] == b[k]).all() for k in a)


def test_steps_follow_the_risk():
    r = np.random.default_rng(3)
    for prior, shift in ((0.4, 0.0), (0.9, -3.0), (None, 0.0)):
        zg, zu = r.normal(size=7), r.normal(size=9) + shift

        def loss(zg, zu):
            if prior is None:
                return np.logaddexp(0, -zg).mean() + np.logaddexp(0, zu).mean()
            good, bad = op8_quality_pu.risk(zg, zu, prior)
            return good + bad if bad >= 0 else -bad

        assert prior is None or (op8_quality_pu.risk(zg, zu, prior)[1] < 0) == (shift < 0)
        got = np.concatenate(op8_quality_pu.slopes(zg, zu, prior))
        for k in range(16):
            e = np.zeros(16)
            e[k] = 1e-6
            assert np.isclose((loss(zg + e[:7], zu + e[7:]) - loss(zg - e[:7], zu - e[7:])) / 2e-6, got[k], atol=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_good_and_unlabelled(share):
    """The share of good ones among the unlabelled, however many good ones are marked."""
    r = np.random.default_rng(5)
    x = lambda n, mean: r.normal(mean, 1, (n, 2))
    n = 3000
    other = [np.concatenate([x(int(n * share), 2.0), x(n - int(n * share), -2.0)]) for _ in range(2)]
    for marked in (300, 3000):
        assert abs(op8_quality_pu.class_prior([x(marked, 2.0) for _ in range(2)], other) - share) < 0.1


def test_uneven_labels_change_little(spark):
    """Bad rows without a label, or with one in ten of the good ones marked, leave the predictions as they are."""
    texts = [prose(k, 60) if k % 3 else "$$ %% x " * 40 for k in range(900)]
    docs = frame(spark, texts)
    marks = [(k, int(k % 3 > 0)) for k in range(900)]
    for labels in (marks, [m for m in marks if m[1]], [m for k, m in enumerate(marks) if k % 10 < 2]):
        model = op8_quality_pu.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert abs(float(model["prior"]) - 2 / 3) < 0.12
        got = op8_quality_pu.predict(model, texts) >= 0.5
        assert (got == np.array([k % 3 > 0 for k in range(900)])).mean() > 0.99


def slow_said(text, table):
    raw = (text or "").encode().lower()
    own = words(text)
    h = [int(hashed_words([w])[0][0]) for w in own]
    top = lambda v: int(v) >> 49
    pairs = [top(op8_quality_pu.mix64(np.array([(x * 0x9E3779B97F4A7C15 + y) % 2**64], np.uint64))[0]) for x, y in zip(h, h[1:], strict=False)]
    bits = [(int.from_bytes(raw[k : k + 4], "little") * 0x9E3779B1) % 2**32 >> 17 for k in range(len(raw) - 3)]
    return [float(np.mean([table[kind][b] for b in own])) if own else 0.0 for kind, own in enumerate(([top(v) for v in h], pairs, bits))]


def test_query_scores_every_text_by_its_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op8_quality_pu.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r["doc_id"]: r for r in op8_quality_pu.op8_quality_pu(spark, sf_dir).collect()}
    for r in docs.collect():
        x = np.array([*op8_quality_pu.shapes([r["text"]])[0], *slow_said(r["text"], model["table"])])
        x = np.clip((x - model["mean"]) / model["spread"], -6, 6)
        z = sum(np.tanh(x @ model["a"][:, k] + model["b"][k]) * model["c"][k] for k in range(op8_quality_pu.HIDDEN)) + x @ model["e"] + model["d"][0]
        own = got.pop(r["doc_id"])
        assert np.isclose(own["score"], 1 / (1 + np.exp(-z)), atol=1e-6) and own["predicted"] == int(own["score"] >= 0.5)
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert not got


def test_long_texts_are_read_in_pieces(monkeypatch):
    table = np.random.default_rng(1).normal(size=(3, op8_quality_pu.BUCKETS)).astype(np.float32)
    whole = op8_quality_pu.said([LONG[:5000], "x" * 300], table)
    monkeypatch.setattr(op8_quality_pu, "PIECE", 100)
    parts = op8_quality_pu.said([LONG[:5000], "x" * 300], table)
    assert np.isclose(whole[0, 0], parts[0, 0]) and np.allclose(whole[0], parts[0], atol=0.2) and np.isfinite(parts).all()
    assert op8_quality_pu.said([None, "", "?"], table).tolist() == [[0.0] * 3] * 3


def test_odd_texts_have_a_score(spark):
    df = frame(spark, [*ODD, ODD[4]], [*range(len(ODD)), 4])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(ODD))], "doc_id long, quality int, toxic int")
    for model in (op8_quality_pu.learn(df, labels), op8_quality_pu.learn(df, labels.limit(0)), op8_quality_pu.learn(df.limit(0), labels)):
        got = op8_quality_pu.scores(df, model, "own").collect()
        assert len(got) == len(ODD) + 1 and all(0 <= r["own"] <= 1 for r in got)
    assert op8_quality_pu.scores(df, None, "own").columns == [*[c.split()[0] for c in SCHEMA.split(", ")], "own"]
    assert op8_quality_pu.scores(df.limit(0), None, "own").count() == 0
    assert op8_quality_pu.clean(df, None).columns == df.columns and op8_quality_pu.clean(df, None).count() == len(ODD) + 1
    with pytest.raises(ValueError):
        op8_quality_pu.scores(df, None, "Score")
