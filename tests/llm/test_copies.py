"""Operators 9 and 10, the sort and the graph beneath them, and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import op2_bpe, op5_decontaminate, op8_quality_pu, op9_suffix_dedup, op10_probminhash
from sitelens.llm.common import remove_steps, shared_dir, written
from sitelens.llm.graph import components
from sitelens.llm.suffix_sort import deep_shallow
from sitelens.llm.words import words
from tests.llm.cases import LONG, ODD, frame, prose

# ---- sorting ------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 90), st.binary(max_size=12)), max_size=25), st.sampled_from([8, 16, 32]))
def test_deep_shallow_sorts(items, shallow):
    bases = [b"ab\x00" * 40, b"a" * 100, bytes(range(100))]
    strings = [bases[b][:n] + tail for _, b, n, tail in items]
    group = np.array([g for g, *_ in items], dtype=np.int64)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    buf = np.frombuffer(b"".join(strings) + bytes(48), np.uint8)
    order, common = deep_shallow(buf, np.cumsum(size) - size, size, group, shallow)
    found = [(group[i], strings[i]) for i in order]
    assert found == sorted(found)
    for k in range(1, len(found)):
        if found[k][0] == found[k - 1][0]:
            x, y = found[k][1], found[k - 1][1]
            n = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
            assert common[k] == n


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    """What op9 returns for rows (doc_id, text) with distinct doc_ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, x in zip(raw, gone, strict=True) if not x)
        runs = sum(x and (k == 0 or not gone[k - 1]) for k, x in enumerate(gone))
        out[i] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n=60):
    """Texts that share passages, are copies with edits, or repeat themselves."""
    r = random.Random(seed)
    shared = [prose(1000 + k, r.choice([8, 20, 60, 200])) for k in range(6)]
    texts = []
    for k in range(n):
        kind = r.random()
        if kind < 0.4:
            texts.append(" ".join([prose(seed * 100 + k, r.randint(0, 20)), r.choice(shared), prose(seed * 100 + k + 50, r.randint(0, 20)), r.choice(shared)]))
        elif kind < 0.7 and texts:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, 4)):
                if t:
                    t[r.randrange(len(t))] = r.choice("xyzé")
            texts.append("".join(t))
        else:
            texts.append((prose(seed + k, 3) + " ") * r.randint(1, 40))
    return texts


@pytest.mark.parametrize(("hot", "piece", "records"), [(1000, 1_000_000, 2_000_000), (2, 1_000_000, 40), (1000, 150, 40)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, piece, records):
    texts = passages(hot + piece) + [t for t in ODD if t is not LONG] + ["z" * 400, "yx" * 150]
    ids = random.Random(2).sample(range(1000), len(texts))
    monkeypatch.setattr(op9_suffix_dedup.pieces, "__defaults__", (piece,))
    df = frame(spark, texts, ids).repartition(3)
    rows = spark.sparkContext.broadcast(records)  # the workers' PASS

    def in_passes(f):
        def run(*args):
            op9_suffix_dedup.PASS = rows.value
            return f(*args)

        return run

    for name in ("meet", "compare"):
        monkeypatch.setattr(op9_suffix_dedup, name, in_passes(getattr(op9_suffix_dedup, name)))
    got = {r["doc_id"]: op9_suffix_dedup.remove((r["text"] or "").encode(), [(s["a"], s["e"]) for s in r["spans"] or ()]) for r in op9_suffix_dedup.repeated_spans(df, hot=hot).collect()}
    for i, want in brute_repeats(zip(ids, texts, strict=True)).items():
        kept, gone = got[i]
        assert (len(gone), hashlib.sha256(kept).hexdigest()) == (want[2], want[3]), i


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(" 47", min_size=0, max_size=400), max_size=6), st.integers(17, 40))
def test_equal_runs_have_equal_bytes(texts, length):
    """Runs and single windows of texts over three letters: equal digests are equal bytes, and all windows are there."""
    raws = [t.encode() for t in texts]
    for found in (op9_suffix_dedup.runs(raws, length), op9_suffix_dedup.windows(raws, length)):
        seen, windows = {}, set()
        for doc, c, d, a, n in zip(*(found[k].tolist() for k in ("doc", "c", "d", "a", "n")), strict=True):
            own = raws[doc][a : a + n - 1 + length]
            assert seen.setdefault((c, d), own) == own and len(own) == n - 1 + length
            windows |= {(doc, a + k) for k in range(n)}
        assert windows == {(i, s) for i, r in enumerate(raws) for s in range(len(r) - length + 1)}
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("hot", "length"), [(1000, 100), (1, 100), (1000, 300)])
def test_tables_of_figures_are_no_repeats(spark, hot, length):
    """Lines with the same figures in other places, columns 15 blanks apart: sums over the grams are the same."""
    r = random.Random(7)
    blank = " " * 15
    line = lambda order: blank + blank.join(order) + blank
    texts = []
    for _ in range(24):
        texts.append("\n".join(line(r.choice(["4774", "7447", "4747", "7474"])) for _ in range(r.randint(1, 8))))
    got = {x["doc_id"]: op9_suffix_dedup.remove(x["text"].encode(), [(s["a"], s["e"]) for s in x["spans"] or ()]) for x in op9_suffix_dedup.repeated_spans(frame(spark, texts), length=length, hot=hot).collect()}
    for i, want in brute_repeats(enumerate(texts), length).items():
        kept, gone = got[i]
        assert (len(gone), hashlib.sha256(kept).hexdigest()) == (want[2], want[3]), i


def test_repeats_of_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in op9_suffix_dedup.op9_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_repeats((r["doc_id"], r["text"]) for r in docs.collect())


def test_repeated_rows_and_null_ids(spark):
    t = prose(1, 60)
    got = op9_suffix_dedup.dedup(frame(spark, [t, t, t, None, t, t + " x"], [4, 4, 2, 3, None, 2])).collect()
    gone = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got), key=repr)
    first = [r for r in gone if r[0] == 2]
    assert sum(r[2] == 0 for r in first) == 1  # one of the two texts of document 2 comes first
    assert [r[2] for r in gone if r[0] == 4] == [len(t)] * 2 and [r[2] for r in gone if r[0] is None] == [len(t)]
    assert op9_suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert [r["n_removed"] for r in op9_suffix_dedup.dedup(frame(spark, [t, t], [7, 7])).collect()] == [0, 0]


def test_a_long_text(spark):
    got = {r["doc_id"]: r for r in op9_suffix_dedup.dedup(frame(spark, [LONG, "head " + LONG[1000:200_000]])).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 199_000 and got[1]["n_spans"] == 1


# ---- 10 -----------------------------------------------------------------------------------------------------------------


def slow_similarity(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in x if i in y)


def bag(text):
    w = words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def brute_classes(rows, threshold=0.8):
    bags = [(i, bag(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(bags):
        for j, y in bags[:k]:
            if x and y and len(set(x) & set(y)) * 3 > min(len(x), len(y)) and slow_similarity(x, y) >= threshold - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}




@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.integers(1, 5), min_size=1), st.dictionaries(st.integers(0, 20), st.integers(1, 5), min_size=1))
def test_exact_similarity(x, y):
    side = lambda c: (np.array(sorted(c)), np.array([float(c[k]) for k in sorted(c)]))
    assert op10_probminhash.probability_jaccard(side(x), side(y)) == pytest.approx(slow_similarity(x, y))


def test_registers_agree_as_often_as_the_similarity():
    base = prose(1, 200)
    copy = " ".join(w if k % 40 else "zz" for k, w in enumerate(base.split())) + " " + base[:300]
    texts = [base, copy, "a b c", "a b c", "one"]
    doc, h, w, keys = op10_probminhash.shingles(texts)
    held = op10_probminhash.prob_min_hash(doc, h, w, len(texts), m=4000)
    want = slow_similarity(bag(base), bag(copy))
    assert abs((held[0] == held[1]).mean() - want) < 0.04
    assert (held[2] == held[3]).all() and keys[2] == keys[3] and keys[0] != keys[1]


def near_texts(seed):
    r = random.Random(seed)
    texts = []
    for k in range(6):
        base = prose(seed * 10 + k, 120).split()
        for _ in range(r.choice([1, 3, 12])):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    return texts + texts[:3] + ["a b c d e f " * 30, "a b c d e f " * 31, "short text", "Short, text!"]


@pytest.mark.parametrize("tile", [512, 4])
def test_classes_equal_brute_force(spark, tile):
    texts = near_texts(tile) + [t for t in ODD if t is not LONG]
    ids = random.Random(3).sample(range(1000), len(texts))
    got = {r["doc_id"]: r["class_id"] for r in op10_probminhash.near_duplicates(frame(spark, texts, ids), tile=tile).collect()}
    assert got == brute_classes(list(zip(ids, texts, strict=True)))


def test_tiles_find_what_no_leader_links(spark):
    """A chain: every text is near the next one only."""
    w = prose(5, 200).split()
    chain = [" ".join([*(f"n{k}x{j}" for j in range(9 * k)), *w[9 * k :]]) for k in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in op10_probminhash.near_duplicates(frame(spark, chain), tile=3).collect()}
    assert got == brute_classes(list(enumerate(chain)))


def test_classes_of_odd_rows(spark):
    t = prose(1, 40)
    got = [tuple(r) for r in op10_probminhash.near_duplicates(frame(spark, [t, t, t.upper(), t, None, "", None], [9, 9, 3, None, 5, 6, None])).collect()]
    assert sorted(got, key=repr) == sorted([(9, 3, 1), (9, 3, 1), (3, 3, 1), (None, None, None), (5, 5, 1), (6, 6, 1), (None, None, None)], key=repr)
    assert op10_probminhash.near_duplicates(frame(spark, [])).count() == 0


def test_unlike_texts_stay_apart(spark):
    """Words that share their first letters, and the same words or paragraphs in another order."""
    p, q = prose(31, 50), prose(32, 50)
    texts = ["the production contacted interested consumers before transport", "the productive contained intervened construct before transform", "red blue blue red", "blue red red blue"]
    texts += [" ".join(" ".join([x, y, y, x]) for x, y in zip(a.split(), b.split(), strict=True)) for a, b in ((p, q), (q, p))]
    stem = prose(33, 60).split()
    texts += [" ".join(w[:4] + end + w[4:] for w in stem) for end in ("aaaa", "bbbb", "cccc")]
    got = {r["doc_id"]: (r["class_id"], r["class_texts"]) for r in op10_probminhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (i, 1) for i in range(len(texts))}
    assert brute_classes(list(enumerate(texts))) == {i: i for i in range(len(texts))}


def test_different_texts_under_one_id(spark):
    u, v = prose(1, 40), prose(2, 40)
    rows = [(3, u), (9, u), (9, v), (9, v), (3, v.upper()), (3, v), (4, None), (4, "")]
    got = [(r["doc_id"], r["class_id"], r["class_texts"]) for r in op10_probminhash.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    assert sorted(got) == [(3, 3, 1)] * 3 + [(4, 4, 1)] * 2 + [(9, 3, 1)] * 3
    rows = [(3, u), (9, u), (9, v), (9, v), (10, v.upper()), (4, None), (4, None)]
    kept = op10_probminhash.first_of_each(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(3, u), (9, v), (4, "")])


def linked(rows, threshold=0.8):
    """Classes of rows by brute force, with pairs found through the shingles they share."""
    bags = [(i, bag(t)) for i, t in rows]
    holders = {}
    for k, (_, x) in enumerate(bags):
        for g in x or ():
            holders.setdefault(g, []).append(k)
    common = Counter((a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k])
    parent = list(range(len(bags)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for (a, b), n in common.items():
        x, y = bags[a][1], bags[b][1]
        if n * 2 > min(len(x), len(y)) and slow_similarity(x, y) >= threshold - 1e-9:
            pairs.append((a, b))
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    names = {}
    for k, (i, _) in enumerate(bags):
        names[find(k)] = min(names.get(find(k), i), i)
    return {i: names[find(k)] for k, (i, _) in enumerate(bags)}, [(bags[a][0], bags[b][0]) for a, b in pairs]


def test_query_equals_brute_force(spark):
    """Every pair of the whole table at 0.8 or more ends in one class, and nothing else does."""
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want, pairs = linked(rows)
    got = {r["doc_id"]: r["class_id"] for r in op10_probminhash.op10_probminhash(spark, folder).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) > 0
    assert got == want


# ---- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op8_quality_pu.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r, s in zip(rows, op8_quality_pu.predict(model, [t for _, t in rows]), strict=True) if s >= 0.5]
    classes = brute_classes(rows)
    rows = [r for r in rows if classes[r[0]] == r[0]]
    seen, left = set(), []
    for i, t in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        left.append((i, bytes(c for c, x in zip(raw, gone, strict=True) if not x).decode("utf-8", "ignore")))
    items = op5_decontaminate.WuManber([(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    left = [(i, t) for i, t in left if not items.search(words(t))[0]]
    m = op2_bpe.model(public_tokenizers.path(op2_bpe.TOKENIZER))
    want = {(i, len(x := m.encode(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(m.decode(x).encode()).hexdigest()) for i, t in left}
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_stages_take_odd_rows(spark, sf_dir):
    t = prose(1, 80)
    texts, ids = [*ODD, t, t, t + " tail", t], [*range(len(ODD)), 50, 50, 51, None]
    docs = frame(spark, texts, ids)
    clashing = ["__score", "spans", "__id", "__mark", "__row", "Own_id", "own_mark", "asked", "class_id", "good", "other", "shape", "odd.name", "odd`tick"]
    for k, name in enumerate(clashing):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id"), F.lit(-1))))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = out.collect()
        for r in kept:
            assert [r[c] for c in clashing] == [f"{k}:{-1 if r['doc_id'] is None else r['doc_id']}" for k in range(len(clashing))], name
        kept = [r["doc_id"] for r in kept]
        assert None in kept or name == "quality classifier", name
        if name == "near-duplicates":
            assert kept.count(50) == 1 and 51 not in kept
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == len(texts)


def test_a_unique_text_stays_beside_a_copy(spark, sf_dir):
    u, v = prose(1, 80), prose(2, 80)
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, [u, u, v], [3, 9, 9]), sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, u), (9, v)]


def test_steps_are_removed(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    mark = written()
    assert op10_probminhash.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f"])).count() == 2
    assert set(os.listdir(folder)) > before
    remove_steps(spark, mark)
    assert set(os.listdir(folder)) == before and written() == mark
