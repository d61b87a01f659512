"""Operator 4: language of texts by a linear-chain conditional random field over their words (see crf.py).

The field labels each word, so that text which switches between languages is split: runs() gives the runs of words of one
label, with the number of the first word (as words() counts them), the number of words and the label's mean probability there.
A text's language is the label with the most probability over its runs, and its score is that label's mean probability.

It learns every language of the rows with text and language whose crc32(doc_id as text) mod 4 isn't 2 and that has a word: from
each language's rows a sample by hash of about SAMPLE documents, of each its first SAMPLE_CHARS characters, the same in every
run; where there are so many languages that this would be over TOTAL_CHARS in all, fewer and shorter ones. Every word of a sampled
piece is taken as a word of its language. lang, source and doc_id aren't read when predicting. The model has a weight for each
hashed feature and language, at most WEIGHTS: with over 128 languages, features share weights. So what the driver and a worker
hold is bounded, but for the transitions (a weight for each pair of languages).

Null texts and texts without a letter are `und`, score 0. With no row to learn from, every text is. Of languages of equal
probability the first by name is taken. A null doc_id isn't held out and isn't learnt from. Repeated rows each give a row; an
empty table gives an empty result; other columns, of any name, aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import map_arrow, read_table
from sitelens.llm.crf import BUCKETS, LANE_LABELS, emissions, marginals, train

SAMPLE = 400
SAMPLE_CHARS = 20_000
TOTAL_CHARS = 64_000_000
WEIGHTS = 1 << 24
BREAK = "\x01"
WORD = re.compile(r"[^\W\d_]+|\x01")
#: Words and labels whose emissions a worker keeps.
MOST = 16_000_000


def words(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def learn(docs: DataFrame, sample: int = SAMPLE, total_chars: int = TOTAL_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, feature weights and transitions."""
    open_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in open_rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, 0)), np.zeros((0, 0))
    sample = max(10, min(sample, total_chars // (200 * len(counts))))
    chars = max(20, min(SAMPLE_CHARS, total_chars // (sample * len(counts))))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    drawn = open_rows.join(F.broadcast(shares), "lang").where(draw < F.col("share"))
    # at most twice the sample of each language, the same documents in every run; of one with many texts, some by hash
    per = drawn.groupBy("lang", "doc_id").agg(F.count("*").alias("texts"))
    chosen = per.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where(F.col("place") <= 2 * sample).select("lang", "doc_id", "texts")
    picked = drawn.join(F.broadcast(chosen), ["lang", "doc_id"]).withColumn("mark", F.xxhash64("text")).where("texts <= 4 OR pmod(mark, texts) < 4")
    rows = picked.select("lang", "doc_id", "mark", F.substring("text", 1, chars).alias("text")).dropDuplicates(["lang", "doc_id", "mark"]).collect()
    streams: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["mark"])):
        if own := words(r["text"]):
            streams.setdefault(r["lang"], []).extend(own)
    langs = sorted(streams)
    if len(langs) < 2:
        return langs, np.zeros((BUCKETS, len(langs))), np.zeros((len(langs), len(langs)))
    buckets = min(BUCKETS, 1 << (WEIGHTS // len(langs)).bit_length() - 1)
    weights, transition = train([streams[x] for x in langs], buckets, steps=max(240, len(langs) // 2))
    return langs, weights.astype(np.float32), transition


class Labeller:
    """Label probabilities of the words of many texts; emissions of words met before are kept."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray):
        self.weights, self.transition = weights, transition
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, self.transition.shape[0]), dtype=np.float32)
        self.used = 0

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words of the texts, and the text of each word."""
        if self.table.size > MOST:
            self.clear()
        joined = BREAK.join(t.replace(BREAK, " ") for t in texts) + BREAK
        found = WORD.findall(joined.lower())
        self.number[BREAK] = -1
        new = [w for w in set(found).difference(self.number)]
        lettered = [w for w in new if any(map(str.isalpha, w))]
        self.number.update(dict.fromkeys(new, -2))
        self.number.update(zip(lettered, range(self.used, self.used + len(lettered)), strict=True))
        while self.used + len(lettered) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(lettered), 20_000):
            part = lettered[at : at + 20_000]
            self.table[self.used : self.used + len(part)] = emissions(self.weights, part)
            self.used += len(part)
        ids = np.fromiter(map(self.number.__getitem__, found), dtype=np.int64, count=len(found))
        ids = ids[ids != -2]
        doc = np.cumsum(ids == -1)
        doc = doc[ids >= 0]
        ids = ids[ids >= 0]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        return marginals(self.table[ids].astype(np.float64), first, self.transition), doc

    def runs(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of each run of words of one label, in order: its text, label, first word, number of words, and the sums of all label
        probabilities over its words."""
        found, doc = self.words(texts)
        label = found.argmax(axis=1)
        begin = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        sums = np.add.reduceat(found, begin, axis=0) if len(begin) else np.zeros((0, found.shape[1]))
        count = np.bincount(doc, minlength=len(texts))
        return doc[begin], label[begin], begin - (np.cumsum(count) - count)[doc[begin]], np.diff(np.append(begin, len(doc))), sums


RUN = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("probability", pa.float64())])


def runs(docs: DataFrame, langs: list[str], weights: np.ndarray, transition: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and runs of every row; a text without a letter has no run."""
    shipped = docs.sparkSession.sparkContext.broadcast((langs, weights, transition))
    kept: dict = {}

    def run(batches):
        names, w, t = shipped.value
        if "labeller" not in kept and names:
            kept["labeller"] = Labeller(w, t)
        rows = min(400, max(1, 400 * LANE_LABELS // max(1, len(names))))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [x or "" for x in part.column(1).to_pylist()]
                pred, score, found = ["und"] * len(texts), np.zeros(len(texts)), pa.array([[]] * len(texts), pa.list_(RUN))
                if names:
                    doc, label, first, size, sums = kept["labeller"].runs(texts)
                    here, begin = np.unique(doc, return_index=True)
                    if len(here):
                        total = np.add.reduceat(sums, begin, axis=0)
                        best = total.argmax(axis=1)
                        count = np.add.reduceat(size, begin)
                        score[here] = np.clip(total[np.arange(len(here)), best] / count, 0.0, 1.0)
                        for d, b in zip(here.tolist(), best.tolist(), strict=True):
                            pred[d] = names[b]
                        mean = np.clip(sums[np.arange(len(label)), label] / size, 0.0, 1.0)
                        fields = [pa.array(names, pa.string()).take(pa.array(label)), pa.array(first), pa.array(size), pa.array(mean)]
                        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), found], names=["doc_id", "lang_pred", "score", "runs"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, runs array<struct<lang:string,first:long,words:long,probability:double>>")


def languages(docs: DataFrame, langs: list[str], weights: np.ndarray, transition: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    return runs(docs, langs, weights, transition).select("doc_id", "lang_pred", "score")


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return languages(docs, *learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
