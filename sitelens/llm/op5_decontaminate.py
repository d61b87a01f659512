"""Operator 5: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the WINDOW-word windows of every benchmark item; an item of fewer words, but not none, is one pattern. For the
patterns of one length m, a shift table says for each block of two words how far the search may move on when a text has that
block at the end of its window; a block that no pattern holds skips m - 1 words at once. Where the shift is 0, the patterns
that end in this block are found by the suffix hash table, kept apart by their first block, and compared word by word.

Tables are built from blocks of items of at most BLOCK_BYTES bytes and shipped to the tasks; a larger benchmark is searched
block after block, so what is shipped never grows with it. Documents are never shuffled.

Null and empty texts have no words. A null item_id takes part in the search but isn't listed; repeated items count once.
An empty benchmark contaminates nothing. Every document row gives one row.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import id_text, map_arrow, map_batches, materialise, read_table
from sitelens.llm.words import words

WINDOW = 10
#: Most bytes of benchmark text in the tables of one pass.
BLOCK_BYTES = 4_000_000
#: So many passes are stacked in one task before their results are written out.
STACKED = 4


class WuManber:
    """Search tables of word sequences. patterns: sequence of words -> positions of its items in `items`."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.items = [item for item, _ in items]
        self.number: dict[bytes, int] = {}
        sets: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, (_, own) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in own]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                sets[m][tuple(ids[i : i + m])].add(k)
        self.tables = []
        for m, patterns in sorted(sets.items()):
            block = min(2, m)
            shift: dict = {}
            ends: dict = defaultdict(lambda: defaultdict(list))
            for p, own in patterns.items():
                for j in range(block, m + 1):
                    key = p[j - block : j] if block == 2 else p[j - 1]
                    shift[key] = min(shift.get(key, m - block + 1), m - j)
                ends[p[-2:] if block == 2 else p[-1]][p[:block]].append((p, sorted(own)))
            self.tables.append((m, block, shift, {k: dict(v) for k, v in ends.items()}))

    def search(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of every occurrence, in words, and the numbers of the items found."""
        ids = list(map(self.number.get, own))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        n = len(ids)
        for m, block, shift, ends in self.tables:
            skip = m - block + 1
            at = m - 1  # the last word of the window
            while at < n:
                key = (ids[at - 1], ids[at]) if block == 2 else ids[at]
                step = shift.get(key, skip)
                if step:
                    at += step
                    continue
                start = at - m + 1
                for p, own_items in ends[key].get(tuple(ids[start : start + block]), ()):
                    if all(ids[start + j] == w for j, w in enumerate(p)):
                        spans.append((start, at + 1))
                        found.update(own_items)
                at += 1
        return spans, found


def covered(spans) -> int:
    """Words inside any span."""
    total = reach = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


FOUND = "doc_id long, text string, spans array<int>, items array<long>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[int, int, list[tuple[int | None, str]]]]:
    """Number, count and items of the benchmark's blocks , each of about block_bytes, one at least."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / block_bytes))
    for k in range(passes):
        yield k, passes, [(r[0], r[1]) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]


def _search_pass(df: DataFrame, items: list[tuple[int | None, str]], window: int) -> DataFrame:
    """Adds what one block of items finds to spans (start, end, start, end ...) and items."""
    shipped = df.sparkSession.sparkContext.broadcast(items)
    kept: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "tables" not in kept:
            kept["tables"] = WuManber([(i, words(t)) for i, t in shipped.value], window)
        tables = kept["tables"]
        spans_out, items_out = [], []
        for text, spans, found in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            new, own = tables.search(words(text.as_py()))
            flat = list(spans or ())
            flat.extend(x for s in new for x in s)
            spans_out.append(flat)
            items_out.append(sorted(set(found or ()) | {tables.items[k] for k in own if tables.items[k] is not None}))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.int64()))], names=["doc_id", "text", "spans", "items"])

    return map_batches(df, run, FOUND)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, spans (word starts and ends, in turn), items (ids of the items found, in order)."""
    out = id_text(docs).select("doc_id", "text", F.array().cast("array<int>").alias("spans"), F.array().cast("array<long>").alias("items"))
    for k, passes, items in _blocks(benchmark, block_bytes):
        out = _search_pass(out, items, window)
        if k % STACKED == STACKED - 1 and k + 1 < passes:
            out = materialise(out, "occurrences")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of any item."""
    at = docs.columns.index("text")
    for k, passes, items in _blocks(benchmark, block_bytes):
        docs = map_arrow(docs, _without(docs.sparkSession.sparkContext.broadcast(items), at, window), docs.schema)
        if k % STACKED == STACKED - 1 and k + 1 < passes:
            docs = materialise(docs, "clean")
    return docs


def _without(shipped, at: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = WuManber([(i, words(t)) for i, t in shipped.value], window)
        for batch in batches:
            yield batch.filter(pa.array([not tables.search(words(t.as_py()))[0] for t in batch.column(at)], pa.bool_()))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans found."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans, items in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
            flat = np.asarray(spans.as_py(), dtype=np.int64).reshape(-1, 2)
            hit = covered(map(tuple, flat.tolist()))
            rows.append((len(words(text.as_py())), hit, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), hit > 0))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_batches(occurrences(docs, benchmark, window, block_bytes), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS pattern
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
o AS (SELECT x.doc_id, x.s, x.n, p.item_id
      FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS pattern
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)) x
      JOIN p ON p.n = x.n AND p.pattern = x.pattern),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM o) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""
