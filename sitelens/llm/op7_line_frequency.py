"""Operator 7: cross-document line frequency, with the quality rules it refines.

Normalised lines (A-Z in lower case, white space runs as one blank) are hashed; for each host (documents.source), distinct
documents are counted for each hash. A line is boilerplate of a host if at least LEAST_DOCS of its documents hold it, and
more than SHARE of them. Such lines are taken out, and a document that loses more than DEPLETED of its words is rejected.
The limits are shares of a host's documents, so they mean the same at every size.

A first pass over the texts gives the hashes of each document's distinct lines. Counts are summed before they are shuffled, so
a line on every page costs a row for each task. Back on the documents' lines, the few boilerplate lines are copied to SALTS
partitions each and met by a part of the documents in each. The texts are read again and shuffled once, to meet the boilerplate
lines they hold: a second pass takes these out and counts the figures of the query. Documents meet their lines by host and a
hash of doc_id, host and text; were two documents of a host to share it, each would be given boilerplate of that host only.

Base rules: fewer than 50 words, or more than half of the words in three-word windows that the text repeats.
Null and empty texts have no words and fail the base rules. A null host is a host of its own. Repeated rows count as
documents of their own and each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sitelens.llm.common import map_arrow, materialise, read_table

LEAST_DOCS = 5
SHARE = 0.02
DEPLETED = 0.5
MIN_WORDS = 50
SALTS = 64
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

LINES = "host string, key long, lines array<long>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_cut")


def repeat_words(words: list[list[bytes]]) -> list[int]:
    """For each text, its words inside three-word windows that occur twice or more in it."""
    number: dict[bytes, int] = {}
    size = np.array([len(w) for w in words], dtype=np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), dtype=np.int64, count=int(size.sum()))
    out = np.zeros(len(words), dtype=np.int64)
    if len(ids) < 4:
        return out.tolist()
    doc = np.repeat(np.arange(len(words)), size)
    start = np.flatnonzero(doc[2:] == doc[:-2])
    # exact numbers for pairs and then for triples of words; equal triples of one document stand together after the sort
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    triple = np.unique(pair[start] * len(number) + ids[start + 2], return_inverse=True)[1]
    order = np.lexsort((triple, doc[start]))
    same = (triple[order][1:] == triple[order][:-1]) & (doc[start][order][1:] == doc[start][order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(ids) + 3, dtype=bool)
    for k in range(3):
        hit[start[order[twice]] + k] = True
    np.add.at(out, doc[np.flatnonzero(hit[: len(ids)])], 1)
    return out.tolist()


def hashed_line(line: bytes) -> tuple[int | None, int]:
    """Hash of a normalised line and its number of words; a blank line has no hash."""
    w = line.lower().split()
    return (xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) if w else None), len(w)


def document_lines(docs: DataFrame) -> DataFrame:
    """Host, key and hashes of the distinct normalised lines of every row of docs (host, key, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lines = [list({h for h, n in map(hashed_line, (t or "").encode().split(b"\n")) if n}) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.list_(pa.int64()))], names=["host", "key", "lines"])

    return map_arrow(docs, run, LINES)


def boilerplate(docs: DataFrame, least_docs: int, share: float) -> DataFrame:
    """Host, key and the hashes of the boilerplate lines of the rows of docs (host, key, text) that hold any."""
    seen = materialise(document_lines(docs).withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = seen.select("row", "host", "key", F.explode("lines").alias("h"))
    hosts = seen.groupBy("host").agg(F.count("*").alias("docs"))
    often = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    often = often.join(hosts, often["host"].eqNullSafe(hosts["host"])).where(F.col("n") > share * F.col("docs")).select(often["host"], "h")
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    found = salted.join(often, salted["host"].eqNullSafe(often["host"]) & (salted["h"] == often["h"]) & (salted["salt"] == often["salt"]), "left_semi")
    return found.groupBy("host", "key").agg(F.collect_set("h").alias("gone"))


def refine(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, depleted: float = DEPLETED, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs with the boilerplate lines of its host taken out of its text, its figures (COUNTS, of the text as it
    came), base_failed and the verdict kept; the names of the new columns begin with two underscores."""
    host, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("long"), host, text)
    gone = boilerplate(docs.select(host.alias("host"), key.alias("key"), text.alias("text")), least_docs, share)
    own = docs.withColumn("text", text).withColumns({"__host": host, "__key": key})
    met = own.join(gone, own["__host"].eqNullSafe(gone["host"]) & (own["__key"] == gone["key"]), "left").select(*[own[c] for c in docs.columns], gone["gone"].alias("__gone"))
    at_text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                given = part.column(at_text).to_pylist()
                raws = [(t or "").encode() for t in given]
                words = [r.split() for r in raws]
                rows, left = [], []
                for text, raw, own, cut in zip(given, raws, words, part.column(part.num_columns - 1).to_pylist(), strict=True):
                    lines = raw.split(b"\n")
                    filled = [line for line in lines if line.strip()]
                    n_cut = 0
                    if cut:
                        cut, stay = set(cut), []
                        for line in lines:
                            h, n = hashed_line(line)
                            if n and h in cut:
                                n_cut += n
                            else:
                                stay.append(line)
                        left.append(b"\n".join(stay).decode())
                    else:
                        left.append(text)
                    text = text or ""
                    rows.append((len(own), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), n_cut))
                columns = [pa.array(left, pa.string()) if k == at_text else part.column(k) for k in range(part.num_columns - 1)]
                counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                counts.insert(4, pa.array(repeat_words(words), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns + counts, names=names)

    schema = StructType([*met.drop("__gone").schema.fields, *(StructField(f"__{c}", LongType()) for c in COUNTS)])
    names = schema.names
    out = map_arrow(met, run, schema)
    failed = (F.col("__n_words") < min_words) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    return out.withColumns({"__base_failed": failed, "__kept": ~failed & ~(F.col("__n_words_cut") > depleted * F.col("__n_words"))})


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without the boilerplate lines of their host."""
    return refine(docs, **limits).where("__kept").select(*docs.columns)


def line_frequency(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, depleted: float = DEPLETED, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, base figures, base_failed, words in boilerplate lines, and the verdict, of every row."""
    out = refine(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), least_docs, share, depleted, min_words)
    return out.select("doc_id", *(F.col(f"__{c}").alias(c) for c in (*COUNTS[:-1], "base_failed", "kept", "n_words_cut")))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(read_table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT r, host, line, regexp_extract_all(line, '{_WORD}') AS lw FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT r, host, line, len(lw) AS n, {_LOWER.format("array_to_string(lw, ' ')")} AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY r),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
often AS (SELECT f.host, f.norm FROM f JOIN hosts h ON h.host IS NOT DISTINCT FROM f.host GROUP BY f.host, f.norm, h.docs
          HAVING count(DISTINCT r) >= {LEAST_DOCS} AND count(DISTINCT r) > {SHARE} * h.docs),
cut AS (SELECT f.r, sum(f.n) AS n_words_cut FROM f JOIN often o ON o.host IS NOT DISTINCT FROM f.host AND o.norm = f.norm GROUP BY f.r),
g AS (SELECT r, s, [w[s], w[s + 1], w[s + 2]] AS tri FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2)),
twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, tri) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM twice) GROUP BY r),
x AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
             (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(cut.n_words_cut, 0)::BIGINT AS n_words_cut
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT n_words_cut > {DEPLETED} * n_words AS kept, n_words_cut
FROM x
"""
