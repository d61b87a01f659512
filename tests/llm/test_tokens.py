"""Operators 2, 3 and 6 against the tokenizers library."""

from __future__ import annotations

import hashlib
import io
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitelens.llm import bpe, op2_bpe, op3_token_counts, op6_token_files
from tests.llm.cases import ODD, frame, prose

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(WORDS)


@pytest.fixture(scope="module")
def counter():
    return op3_token_counts.Counter(BYTES)


any_text = st.text(max_size=60) | st.lists(st.sampled_from(["the", "aaaa", "Été", "'ll", "<|endoftext|>", "  ", "\n", "12", "!!", "日本", "́", "İ", "zz" * 9]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(any_text)
def test_encoding_is_the_library_s(model, word_library, text):
    want = word_library.encode(text, add_special_tokens=False).ids
    assert model.encode(text) == want
    assert model.encode_batch([text])[0].tolist() == want
    assert model.decode(want) == word_library.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself(model):
    for token, i in model.vocab.items():
        if token.endswith("</w>"):
            assert model.encode_word(token[:-4]) == (i,)


def merged(model, word):
    """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
    ids = [model.vocab[c + ("</w>" if k == len(word) - 1 else "")] for k, c in enumerate(word)]
    while True:
        ranks = [(model.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:], strict=False))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return tuple(ids)
        k = min(ranks)[1]
        ids[k : k + 2] = [model.vocab[model.by_id[ids[k]] + model.by_id[ids[k + 1]]]]


@settings(max_examples=300, deadline=None)
@given(st.text("abehinorst", min_size=1, max_size=18))
def test_dynamic_programming_equals_merging(model, word):
    assert model.encode_word(word) == merged(model, word)


def test_many_words_at_once_survive_full_tables(model, word_library):
    small = bpe.BatchEncoder(model)
    small.MOST, small.SLOTS = 50, 1 << 21
    texts = [prose(k, 30) for k in range(20)]
    for t in texts:
        assert small.encode([t, "a"])[0].tolist() == word_library.encode(t, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(any_text | st.text(" \n\t'srtvelmdaé1!日\x85\u3000", max_size=40), st.integers(1, 20))
def test_counts_are_the_library_s_for_any_chunk(counter, byte_library, text, chunk):
    want = len(byte_library.encode(text, add_special_tokens=False).ids)
    assert counter.count(text, chunk) == want
    assert counter.counts([None, text, "", text + text]) == [0, want, 0, len(byte_library.encode(text + text, add_special_tokens=False).ids)]
    offsets = counter.offsets(text, chunk)
    assert [n for _, n in offsets] == sorted(n for _, n in offsets) or len(offsets) > 1
    assert not text or text.endswith("|>") or offsets[-1] == (len(text), want)


def test_chunk_maps_compose_associatively(counter):
    r = random.Random(3)
    machine = counter.machine
    for _ in range(200):
        text = "".join(r.choices("ab  \n'<sre1", k=24))
        maps = [op3_token_counts.Chunk(machine, text, a, b) for a, b in ((0, 5), (5, 6), (6, 14), (14, 24))]
        x, y = op3_token_counts.Composed, maps
        left, right = x(x(x(y[0], y[1]), y[2]), y[3]), x(y[0], x(y[1], x(y[2], y[3])))
        entering = [op3_token_counts.BEGIN, *(machine.run(op3_token_counts.BEGIN, "".join(r.choices("ab 'r\n", k=r.randint(1, 6))))[0] for _ in range(5))]
        for state in entering:
            want = machine.run(state, text)
            assert left.of(state) == right.of(state) == op3_token_counts.reduced(maps).of(state) == want
        for k, m in enumerate(op3_token_counts.scan(maps)):
            assert (m.leaves, m.total) == machine.run(op3_token_counts.BEGIN, text[: maps[k].b])


def test_transducer_starts_anew_at_its_limit(counter, byte_library, monkeypatch):
    monkeypatch.setattr(op3_token_counts.Transducer, "MOST", 100)
    own = op3_token_counts.Counter(BYTES)
    for k in range(40):
        t = prose(k, 200) + "日本" * 30
        assert own.counts([t, "a"])[0] == own.count(t, 16) == len(byte_library.encode(t, add_special_tokens=False).ids)
    assert len(own.machine.states) < 5000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), unique=True, max_size=200), st.integers(1, 7))
def test_table_of_transitions(keys, n):
    table, keys = op3_token_counts.Table(3), np.array(keys, dtype=np.int64)
    for k in range(n):
        table.put(keys[k::n], np.arange(len(keys), dtype=np.int32)[k::n])
    assert table.get(keys).tolist() == list(range(len(keys))) and (table.get(keys + (1 << 41)) == -1).all()


@pytest.mark.parametrize("alphabet", ["漢字仮名交文", "ABCDabcd0123+/", " ", "\n", "a", "=-"])
def test_long_texts_without_borders(counter, byte_library, alphabet):
    """Memory beside the text is small, whatever the text."""
    r = random.Random(1)
    text = "".join(r.choices(alphabet, k=300_000)) if len(alphabet) > 1 else alphabet * 300_000
    tracemalloc.start()
    got = counter.counts([text])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60_000_000
    if len(alphabet) > 1:
        assert got == len(byte_library.encode(text, add_special_tokens=False).ids)
    else:
        assert got == counter.count(text, 1 << 20)


def test_digests(spark, word_library):
    ids = [*range(len(ODD)), 3, None]
    texts = [*ODD, ODD[3], "null id"]
    got = sorted(map(tuple, op2_bpe.digests(frame(spark, texts, ids), WORDS).collect()), key=repr)
    want = []
    for i, t in zip(ids, texts, strict=True):
        x = word_library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(word_library.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert op2_bpe.digests(frame(spark, []), WORDS).count() == 0


def test_encode_then_decode(spark, word_library):
    out = {r["doc_id"]: r["text"] for r in op2_bpe.decode(op2_bpe.encode(frame(spark, ODD), WORDS), WORDS).collect()}
    assert out[10] == word_library.decode(word_library.encode(ODD[10], add_special_tokens=False).ids, skip_special_tokens=False)
    assert out[0] == ""


def test_counts(spark, byte_library, sf_dir):
    rows = [*enumerate(ODD), (3, ODD[3]), (3, "other"), (None, "null id"), (None, None), *((1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(map(tuple, op3_token_counts.token_counts(df, BYTES).collect()), key=repr)
    want = []
    for i, t in rows:
        n = len(byte_library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)
    assert op3_token_counts.token_counts(frame(spark, []), BYTES).count() == 0


def test_offsets_cut_a_text_at_its_tokens(spark, byte_library):
    texts = [*ODD, "x" * 3000 + " y" * 3000]
    got = {r["doc_id"]: [tuple(x) for x in r["offsets"]] for r in op3_token_counts.token_offsets(frame(spark, texts), BYTES, 1000).collect()}
    for i, t in enumerate(texts):
        if not t or "<|" in t:
            assert t or got[i] == []
            continue
        assert got[i][-1] == (len(t), len(byte_library.encode(t, add_special_tokens=False).ids)) and [x for x, _ in got[i][:-1]] == list(range(1000, len(t), 1000))


@pytest.mark.parametrize("bits", [True, False])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=40), max_size=12), st.integers(1, 30))
def test_files_round_trip(bits, docs, block):
    rows = [(None if k == 1 else k - 3, np.array(d, dtype="<u2")) for k, d in enumerate(docs)]
    data = op6_token_files.write_file(rows, bits=bits, block_ids=block)
    f = op6_token_files.TokenFile(io.BytesIO(data))
    assert [(d, x.tolist()) for d, _, x in f.documents()] == [(d, x.tolist()) for d, x in rows]
    flat = [x for d in docs for x in d]
    assert f.ids(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3 :][: len(flat) // 2]


def test_wide_ids_and_cut_files():
    ids = np.array([1, 1 << 30, 7], dtype="<u4")
    assert next(op6_token_files.TokenFile(io.BytesIO(op6_token_files.write_file([(5, ids)], width=4, bits=True))).documents())[2].tolist() == ids.tolist()
    with pytest.raises(ValueError):
        op6_token_files.write_file([(5, ids)], width=2)
    with pytest.raises(ValueError):
        op6_token_files.TokenFile(io.BytesIO(op6_token_files.write_file([(5, ids)], width=4)[:-3]))


@pytest.mark.parametrize("file_ids", [1 << 24, 50])
def test_token_files(spark, tmp_path, word_library, file_ids):
    texts = [*ODD, "same id a", "same id b", "null id"]
    ids = [*range(100, 100 - len(ODD), -1), 7, 7, None]
    folder = f"file://{tmp_path}/tokens"
    manifest = op6_token_files.write(frame(spark, texts, ids), folder, WORDS, shard_rows=5, file_ids=file_ids)
    got = [tuple(r) for r in op6_token_files.read(manifest, folder).orderBy("start").collect()]
    start, want = 0, []
    encoded = [np.array([*word_library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, encoded[k].astype("<u2").tobytes()))
    for k in order:
        want.append((ids[k], start, len(encoded[k]), zlib.crc32(encoded[k].tobytes())))
        start += len(encoded[k])
    assert got == want


def test_token_files_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert op6_token_files.read(op6_token_files.write(frame(spark, []), folder, WORDS), folder).count() == 0
