"""Operator 9: removal of repeated passages by a sparse suffix array, sorted deep and shallow.

Each byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or the same document and an earlier
start) is removed; the strings are judged on the input. All strings are found, by these steps:

1. Anchors. Among the GRAM-byte grams of a window of LENGTH bytes, the one of least hash (the leftmost of equals) is its
   anchor: equal windows have equal anchors at equal places. Neighbouring windows mostly share theirs and form a run, about
   one in 43 bytes. A run is sent on as 24 bytes or so: hash of its anchor, digest of all its bytes, place and extent.
   Equal runs of one flush are folded into the earliest of them first, so that a hot passage takes one record a flush.
2. Runs of one anchor meet. Of those with the same bytes, all but the earliest are covered. Where an anchor is left with
   runs of different bytes (at the ends of repeated passages, around edits), the earliest of each kind goes on.
3. Their bytes are fetched. Suffixes that start at the anchor, and the bytes before it read backwards, are sorted by
   deep_shallow(); from the common prefixes r to the right and l to the left, two runs of one anchor share exactly the windows
   that start o bytes before it for LENGTH - r <= o <= l. A later run is covered by those it shares with an earlier one.
   An anchor with more than HOT kinds of run (a frequent short line between different neighbours) isn't brought together:
   digests of its windows, one by one, are dealt out and folded as in 1 and 2; the result is the same.
4. What is covered is gathered per document and taken out.

Documents are told apart by doc_id and a hash of the text, so a row that is repeated counts as one document given several
times, and different texts under one doc_id are ordered by that hash. A null doc_id comes after all others. Null is empty.
Texts of under LENGTH bytes lose nothing; an empty table gives an empty result. Runs are equal if 96 bits of BLAKE2 of their
bytes are; what step 3 finds is compared byte by byte. Long texts are worked on in pieces of PIECE bytes. Other columns, of any
name, pass through.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import fresh, map_arrow, materialise, mix64, named, read_table
from sitelens.llm.suffix_sort import SHALLOW, deep_shallow, words_at

LENGTH = 100
GRAM = 16
HOT = 1000
PIECE = 1_000_000
#: Bytes of text whose runs are folded before they are sent.
FLUSH = 24_000_000
#: Bytes of text for each bucket of anchors, and how many buckets there are at most; a larger bucket is worked on in passes
#: over parts of its anchors, each of about PASS records.
BUCKET_BYTES, BUCKETS = 32_000_000, 50_000
PASS = 2_000_000

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PLACE = np.uint64((1 << 24) - 1)
LAST_ID = 2**63 - 1


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position; buf ends in GRAM + 8 bytes of padding."""
    w = words_at(buf)
    n = len(buf) - 8 - GRAM
    x = w[:n] * C1
    x ^= x >> np.uint64(32)
    x += w[8 : n + 8] * C2
    return mix64(x)


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (leftmost of equals) in h[s : s + width] for each s."""
    n = len(h)
    key = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : n + width - 1]) & PLACE).astype(np.int64)


class Hashed:
    """Gram hashes of texts laid end to end, and the windows that lie within one text."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.raw = b"".join(texts)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(size) - size
        mark = np.zeros(len(self.raw) + 1, dtype=np.int8)
        some = size >= length
        mark[self.first[some]] += 1
        np.add.at(mark, self.first[some] + size[some] - length + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(mark, dtype=np.int8)[:-1])

    def grams(self) -> np.ndarray:
        return gram_hashes(np.frombuffer(self.raw + bytes(GRAM + 8), dtype=np.uint8))

    def digests(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of BLAKE2 of the bytes from the window at a to the end of the window at b, as 64 and 32."""
        raw, digest = self.raw, hashlib.blake2b
        found = b"".join([digest(raw[x:y], digest_size=12).digest() for x, y in zip(a.tolist(), (b + self.length).tolist(), strict=True)])
        cells = np.frombuffer(found, "<u4").reshape(-1, 3).astype(np.uint64)
        return cells[:, 0] | cells[:, 1] << np.uint64(32), cells[:, 2]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def runs(texts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """text number, h (anchor), c and d (digest), a (first window), n (windows), p (anchor less a); places are within the text."""
    x = Hashed(texts, length)
    s = x.starts
    if not len(s):
        empty, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return {"doc": empty, "h": none, "c": none, "d": none, "a": empty, "n": empty, "p": empty}
    grams = x.grams()
    anchor = least_in_window(grams, length - GRAM + 1)[s]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
    k = np.flatnonzero(new)
    a, b, p = s[k], s[np.append(k[1:], len(s)) - 1], anchor[k]
    doc = x.owner(a)  # no run crosses texts: the last length - 1 bytes of a text start no window
    c, d = x.digests(a, b)
    return {"doc": doc, "h": grams[p] >> np.uint64(16), "c": c, "d": d, "a": a - x.first[doc], "n": b - a + 1, "p": p - a}


def windows(texts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Every window on its own, as a run of one, dealt out by its digest."""
    x = Hashed(texts, length)
    s = x.starts
    doc = x.owner(s)
    c, d = x.digests(s, s)
    zero = np.zeros(len(s), np.int64)
    return {"doc": doc, "h": c >> np.uint64(16), "c": c, "d": d, "a": s - x.first[doc], "n": zero + 1, "p": zero}


#: Fields of a record and their bytes; n and p are at most the length of a window.
FIELDS = (("h", 6), ("c", 8), ("d", 4), ("doc", 4), ("a", 4), ("n", 2), ("p", 2))
LONGEST = 60_000


def pack(ids: np.ndarray, marks: np.ndarray, r: dict[str, np.ndarray]) -> bytes:
    """Records whose field doc numbers the documents (ids, marks), column after column, compressed."""
    used, own = np.unique(r["doc"], return_inverse=True)
    n = len(own)
    parts = [struct.pack("<II", len(used), n), ids[used].astype("<i8").tobytes(), marks[used].astype("<i8").tobytes()]
    for name, width in FIELDS:
        value = own if name == "doc" else r[name]
        parts.append(np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blobs: list[bytes], part: int = 0, parts: int = 1) -> dict[str, np.ndarray]:
    """Records of many blobs whose anchors fall in one of the parts; id and mark name the document of each."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("id", "mark", "h", "c", "d", "a", "n", "p")}
    squeeze = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = squeeze.decompress(blob)
        docs, n = struct.unpack_from("<II", raw)
        ids = np.frombuffer(raw, "<i8", docs, 8)
        marks = np.frombuffer(raw, "<i8", docs, 8 + 8 * docs)
        at, own = 8 + 16 * docs, slice(None)
        for name, width in FIELDS:
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            value = wide.reshape(-1).view("<u8")
            at += n * width
            if name == "h" and parts > 1:
                own = np.flatnonzero(value % np.uint64(parts) == part)
            value = value[own]
            if name == "doc":
                out["id"].append(ids[value.astype(np.int64)])
                out["mark"].append(marks[value.astype(np.int64)])
            else:
                out[name].append(value if name in ("h", "c", "d") else value.astype(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def fold(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of anchor, bytes and place; for each whether it is the earliest of its kind, and the number of it."""
    order = np.lexsort((r["a"], r["mark"], r["id"], r["d"], r["c"], r["h"]))
    first = np.ones(len(order), dtype=bool)
    first[1:] = np.any([r[k][order[1:]] != r[k][order[:-1]] for k in ("h", "c", "d")], axis=0)
    lead = np.flatnonzero(first)
    kind = np.cumsum(first) - 1
    head = order[lead[kind]] if len(order) else order
    # the same place given twice is one occurrence
    same = (r["id"][order] == r["id"][head]) & (r["mark"][order] == r["mark"][head]) & (r["a"][order] == r["a"][head])
    return order, first, same


def pieces(text: bytes, length: int, piece: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """A long text in overlapping pieces, each window in one of them."""
    for at in range(0, max(1, len(text) - length + 1), piece):
        yield at, text[at : at + piece + length - 1]


RECORDS = "bucket int, kind int, id long, mark long, a long, e long, data binary"
COVER, RUNS, WINDOWS, CONTEXTS = 0, 1, 2, 3


def records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "kind", "id", "mark", "a", "e", "data"])


def cover_rows(bucket: int, ids: np.ndarray, marks: np.ndarray, a: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Covered bytes a to e of documents; touching ones are joined first."""
    order = np.lexsort((a, marks, ids))
    ids, marks, a, e = ids[order], marks[order], a[order], e[order]
    if not len(a):
        return
    owner = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))])
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(e + owner * far) - owner * far
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (a[1:] > reach[:-1])])
    k = np.flatnonzero(new)
    end = reach[np.append(k[1:], len(a)) - 1]
    for at in range(0, len(k), 50_000):
        part = k[at : at + 50_000]
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, COVER, np.int32)), pa.array(ids[part]), pa.array(marks[part]), pa.array(a[part]), pa.array(end[at : at + 50_000]), pa.nulls(n, pa.binary())], names=["bucket", "kind", "id", "mark", "a", "e", "data"])


def send(kind: int, r: dict[str, np.ndarray], ids: np.ndarray, marks: np.ndarray, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Folds the records of one flush, and deals out the earliest of each kind by their anchors."""
    full = r | {"id": ids[r["doc"]], "mark": marks[r["doc"]]}
    order, first, same = fold(full)
    late = order[~same]
    yield from cover_rows(-1, full["id"][late], full["mark"][late], full["a"][late], full["a"][late] + full["n"][late] - 1 + length)
    lead = order[first]
    bucket = (mix64(r["h"][lead]) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((r["a"][lead], r["doc"][lead], bucket))
    lead, bucket = lead[by], bucket[by]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(lead) else [0]
    rows = [(int(bucket[lo]), kind, None, None, int(hi - lo), None, pack(ids, marks, {k: v[lead[lo:hi]] for k, v in r.items()})) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    if rows:
        yield records(rows)


def spread(batches: Iterator[pa.RecordBatch], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Step 1, over columns id, mark, text."""
    held: list[dict[str, np.ndarray]] = []
    ids: list[int] = []
    marks: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, ids, marks, size
        if held:
            joined = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            yield from send(RUNS, joined, np.array(ids, np.int64), np.array(marks, np.int64), buckets, length)
        held, ids, marks, size = [], [], [], 0

    for batch in batches:
        part: list[bytes] = []
        owner: list[int] = []
        shift: list[int] = []

        def work() -> None:
            if part:
                r = runs(part, length)
                own, off = np.array(owner, np.int64), np.array(shift, np.int64)
                r["a"] = r["a"] + off[r["doc"]]
                r["doc"] = own[r["doc"]]
                held.append(r)
                part.clear()
                owner.clear()
                shift.clear()

        inside = 0
        for d, m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            ids.append(d)
            marks.append(m)
            for at, piece in pieces(raw, length):
                if inside + len(piece) > PIECE:
                    work()
                    inside = 0
                part.append(piece)
                owner.append(len(ids) - 1)
                shift.append(at)
                inside += len(piece)
            size += len(raw)
        work()
        if size >= FLUSH:
            yield from flush()
    yield from flush()


REQUESTS = "kind int, h long, id long, mark long, a long, e long, p int"


def requests(kind: int, h: np.ndarray, ids: np.ndarray, marks: np.ndarray, a: np.ndarray, e: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(h.astype(np.int64)), pa.array(ids), pa.array(marks), pa.array(a), pa.array(e), pa.array(p.astype(np.int32))], names=["kind", "h", "id", "mark", "a", "e", "p"])


def meet(batches: Iterator[pa.RecordBatch], length: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Step 2, over the records of one bucket: what is covered, and the runs whose bytes are needed."""
    blobs: list[bytes] = []
    held = 0
    for batch in batches:
        kinds = batch.column(1)
        covers = batch.filter(pc.equal(kinds, COVER))
        if covers.num_rows:
            z = [covers.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
            yield requests(COVER, np.zeros(len(z[0]), np.int64), *z, np.zeros(len(z[0]), np.int64))
        sent = batch.filter(pc.equal(kinds, RUNS))
        blobs += sent.column(6).to_pylist()
        held += pc.sum(sent.column(4)).as_py() or 0
    parts = -(-held // PASS)
    for k in range(parts):
        yield from resolve(unpack(blobs, k, parts), length, hot)


def resolve(r: dict[str, np.ndarray], length: int, hot: int) -> Iterator[pa.RecordBatch]:
    if not len(r["h"]):
        return
    order, first, same = fold(r)
    late = order[~same]
    for c in cover_rows(0, r["id"][late], r["mark"][late], r["a"][late], r["a"][late] + r["n"][late] - 1 + length):
        z = [c.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
        yield requests(COVER, np.zeros(len(z[0]), np.int64), *z, np.zeros(len(z[0]), np.int64))
    lead = order[first]
    h = r["h"][lead]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    count = np.repeat(np.diff(cut), np.diff(cut))
    for kind, which in ((CONTEXTS, (count > 1) & (count <= hot)), (WINDOWS, count > hot)):
        k = lead[which]
        if len(k):
            yield requests(kind, r["h"][k], r["id"][k], r["mark"][k], r["a"][k], r["a"][k] + r["n"][k] - 1 + length, r["p"][k])


def fetch(batches: Iterator[pa.RecordBatch], names: tuple[str, str, str], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """Step 3, over id, mark (by those names), text and the runs asked for: contexts by anchor, windows by their digest."""
    for batch in batches:
        ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in names[:2])
        texts, asked = batch.column("text"), batch.column(names[2])
        flat = asked.flatten()
        fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "h", "a", "e", "p")}
        sizes = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        for lo in range(0, len(row), 20_000):
            own = slice(lo, lo + 20_000)
            raws = {i: texts[i].as_buffer().to_pybytes() for i in np.unique(row[own]).tolist()}
            cut = [raws[i][a:e] for i, a, e in zip(row[own].tolist(), fields["a"][own].tolist(), fields["e"][own].tolist(), strict=True)]
            kind, h = fields["kind"][own], fields["h"][own].astype(np.uint64)
            bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
            near = np.flatnonzero(kind == CONTEXTS)
            near = near[np.argsort(bucket[near], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[near]) != 0, [True]])) if len(near) else []
            rows = []
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                k = near[x:y]
                cols = [h[k].astype(np.int64), ids[row[own][k]], marks[row[own][k]], fields["a"][own][k], fields["p"][own][k]]
                rows.append((int(bucket[k[0]]), CONTEXTS, None, None, len(k), None, pack_contexts(cols, [cut[i] for i in k.tolist()])))
            if rows:
                yield records(rows)
            far = np.flatnonzero(kind == WINDOWS)
            if len(far):
                r = windows([cut[i] for i in far.tolist()], length)
                r["a"] = r["a"] + fields["a"][own][far][r["doc"]]
                yield from send(WINDOWS, r, ids[row[own][far]], marks[row[own][far]], buckets, length)


def pack_contexts(cols: list[np.ndarray], raws: list[bytes]) -> bytes:
    parts = [struct.pack("<I", len(raws)), *(c.astype("<i8").tobytes() for c in cols), np.array([len(x) for x in raws], "<u4").tobytes(), *raws]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_contexts(blobs: list[bytes], part: int = 0, parts: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the contexts whose anchors fall in one of the parts, and their bytes, end to end."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    raws = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<I", raw)[0]
        own = [np.frombuffer(raw, "<i8", n, 4 + 8 * n * k) for k in range(5)] + [np.frombuffer(raw, "<u4", n, 4 + 40 * n).astype(np.int64)]
        text = np.frombuffer(raw, np.uint8, offset=4 + 44 * n)
        if parts > 1:
            keep = own[0] % parts == part
            text = text[np.repeat(keep, own[5])]
            own = [c[keep] for c in own]
        for k in range(6):
            cols[k].append(own[k])
        raws.append(text)
    return [np.concatenate(c) for c in cols], np.concatenate(raws)


def compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Steps 3 and 4 over one bucket: bytes covered because of runs that differ."""
    contexts: list[bytes] = []
    loose: list[bytes] = []
    held = {CONTEXTS: 0, WINDOWS: 0}
    for batch in batches:
        kinds = batch.column(1)
        yield batch.filter(pc.equal(kinds, COVER))
        for kind, blobs in ((CONTEXTS, contexts), (WINDOWS, loose)):
            sent = batch.filter(pc.equal(kinds, kind))
            blobs += sent.column(6).to_pylist()
            held[kind] += pc.sum(sent.column(4)).as_py() or 0
    parts = -(-held[WINDOWS] // PASS)
    for k in range(parts):
        r = unpack(loose, k, parts)
        order, _, same = fold(r)
        late = order[~same]
        yield from cover_rows(0, r["id"][late], r["mark"][late], r["a"][late], r["a"][late] + length)
    parts = -(-held[CONTEXTS] * 10 // PASS)  # a context is larger than a record
    for k in range(parts):
        (h, ids, marks, a, p, size), raw = unpack_contexts(contexts, k, parts)
        if len(h):
            yield from cover_rows(0, *shared(h, ids, marks, a, p, size, raw, length))


def shared(h: np.ndarray, ids: np.ndarray, marks: np.ndarray, a: np.ndarray, p: np.ndarray, size: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """id, mark, start and end of what runs share with earlier runs of the same anchor. raw: bytes of the runs, end to end."""
    pad = np.zeros(SHALLOW + 16, np.uint8)
    start = np.cumsum(size) - size
    group = np.unique(h, return_inverse=True)[1]
    right, common_right = deep_shallow(np.concatenate([raw, pad]), start + p, size - p, group)
    # the bytes before an anchor, read backwards: a suffix of the whole read backwards, cut after p bytes
    left, common_left = deep_shallow(np.concatenate([raw[::-1], pad]), len(raw) - (start + p), p, group)
    cut = np.flatnonzero(np.concatenate([[True], np.diff(group[right]) != 0, [True]]))
    place = a + p
    # the later run, and the bytes before and after its anchor that earlier ones share. All that one run shares lies around its
    # anchor, so the farthest to both sides is all of it.
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pairs = np.diff(cut) == 2
    lo = cut[:-1][pairs]
    if len(lo):  # the many groups of two, at once
        x, y = right[lo], right[lo + 1]
        later = np.where(before(ids, marks, place, x, y), y, x)
        l, r = common_left[lo + 1], common_right[lo + 1]
        own = (before(ids, marks, place, x, y) | before(ids, marks, place, y, x)) & (l + r >= length)
        out.append((later[own], l[own], r[own]))
    for lo, hi in zip(cut[:-1][~pairs].tolist(), cut[1:][~pairs].tolist(), strict=True):
        if hi - lo < 2:
            continue
        items = right[lo:hi]
        by = items[np.lexsort((place[items], marks[items], ids[items]))]  # in order of place
        number = {i: k for k, i in enumerate(by.tolist())}
        r = matrix([number[i] for i in right[lo:hi].tolist()], common_right[lo:hi])
        f = matrix([number[i] for i in left[lo:hi].tolist()], common_left[lo:hi])
        # the same place given twice is no earlier one
        turn = np.concatenate([[0], np.cumsum((ids[by][1:] != ids[by][:-1]) | (marks[by][1:] != marks[by][:-1]) | (place[by][1:] != place[by][:-1]))])
        share = (r + f >= length) & (turn[:, None] < turn)
        own = share.any(axis=0)
        out.append((by[own], np.where(share, f, 0).max(axis=0)[own], np.where(share, r, 0).max(axis=0)[own]))
    who, l, r = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return ids[who], marks[who], place[who] - l, place[who] + r


def before(ids: np.ndarray, marks: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (ids[x] < ids[y]) | (ids[x] == ids[y]) & ((marks[x] < marks[y]) | (marks[x] == marks[y]) & (place[x] < place[y]))


def matrix(numbers: list[int], common: np.ndarray) -> np.ndarray:
    """Common prefixes of all pairs, by number, from those of neighbours in sorted order."""
    c = len(numbers)
    out = np.zeros((c, c), dtype=np.int32)
    own = np.array(numbers)
    for k in range(c - 1):
        least = np.minimum.accumulate(common[k + 1 :])
        out[own[k], own[k + 1 :]] = least
        out[own[k + 1 :], own[k]] = least
    return out


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of text, and the maximal runs removed."""
    merged: list[list[int]] = []
    for a, e in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    kept, at = [], 0
    for a, e in merged:
        kept.append(text[at:a])
        at = e
    kept.append(text[at:])
    return b"".join(kept), [(a, e) for a, e in merged]


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, into: str = "spans") -> DataFrame:
    """All columns of docs and, in a new one of a name that docs doesn't have (common.fresh gives one), ARRAY<STRUCT<a, e>>: covered
    byte ranges, unordered and overlapping; null for none. docs needs doc_id and text; other columns pass through."""
    if not GRAM < length <= LONGEST:
        raise ValueError(f"length must be over {GRAM} and at most {LONGEST}")
    if fresh(docs, into) != [into]:
        raise ValueError(f"docs has a column {into}")
    spark = docs.sparkSession
    own, mark, asked = names = fresh(docs, "own_id", "own_mark", "asked")
    marked = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), mark: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS, -(-total // BUCKET_BYTES)))
    deal = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.hash("id"), F.lit(buckets))).cast("int")
    sent = map_arrow(marked.where(F.octet_length("text") >= length).select(own, mark, "text"), lambda x: spread(x, buckets, length), RECORDS)
    met = materialise(map_arrow(sent.repartitionById(buckets, deal), lambda x: meet(x, length, hot), REQUESTS), "runs")
    key = [F.col("id").alias(own), F.col("mark").alias(mark)]
    wanted = met.where(F.col("kind") != COVER).select(*key, "kind", "h", "a", "e", "p").groupBy(own, mark).agg(F.collect_list(F.struct("kind", "h", "a", "e", "p")).alias(asked))
    # both joins read the same columns of marked, so that its texts are shuffled once
    fetched = map_arrow(marked.join(wanted, [own, mark]), lambda x: fetch(x, names, buckets, length), RECORDS)
    more = map_arrow(fetched.repartitionById(buckets, deal), lambda x: compare(x, length), RECORDS)
    covers = met.where(F.col("kind") == COVER).select(*key, "a", "e").union(more.select(*key, "a", "e"))
    covers = covers.groupBy(own, mark).agg(F.collect_list(F.struct("a", "e")).alias(into))
    return marked.join(covers, [own, mark], "left").select(*named(*docs.columns, into))


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages taken out of the texts; a character that loses only some of its bytes goes whole."""
    (into,) = fresh(docs, "spans")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True):
                text = text.as_py()
                texts.append(remove(text.encode(), [(s["a"], s["e"]) for s in found])[0].decode("utf-8", "ignore") if found else text)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(repeated_spans(docs, length, into=into), run, docs.schema)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                kept, gone = remove(raw, [(s["a"], s["e"]) for s in spans or ()])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            if rows:
                n, r, s, h = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(repeated_spans(own, length).select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
