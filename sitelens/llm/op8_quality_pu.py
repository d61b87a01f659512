"""Operator 8: quality of texts by positive-unlabelled learning.

Only documents marked good are trusted; the others of the corpus are an unlabelled mixture. With the class prior p, a network g
is trained to the least non-negative unbiased risk of du Plessis and Kiryo,
    p E_good[l(g)] + max(0, E_unlabelled[l(-g)] - p E_good[l(-g)]),   l the logistic loss;
where the second part falls below zero, the step goes against it instead. Its least is at the log odds of a good text, so the
score is the logistic function of g.

p is estimated from good and unlabelled texts alone, so labels may be drawn unevenly and bad ones are never looked at: a network
that tells the two apart is trained on one half of the sample; on the other half, the share of unlabelled over that of good
texts with at least a score is never below p, and the least such ratio (with a bound on its error) is the estimate; the two
halves' estimates are averaged.

Inputs are taken from the whole text only: SHAPES figures (shares of byte classes, lengths of words and lines, how much it repeats
itself) and, for words, pairs of words and GRAM-byte grams, the mean log ratio of how often good and unlabelled texts hold them,
in BUCKETS hash buckets each (a text over PIECE bytes is read in pieces cut at blanks). The ratios of one half of the sample
score the other half in training, those of all of it any text.

Labels are learnt from rows whose crc32(doc_id as text) mod 3 isn't 1: samples by hash of about POSITIVES good documents and
UNLABELLED documents, twice that at most, the same in every run. The driver holds their figures and the ratios, not their texts.
Without a good document to learn from, every score is 0.5. Null is an empty text; repeated rows each give a row; a null doc_id
isn't held out nor learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sitelens.llm.common import fresh, map_arrow, materialise, mix64, named, read_table
from sitelens.llm.op7_line_frequency import repeat_words
from sitelens.llm.words import hashed_words

POSITIVES = 6_000
UNLABELLED = 12_000
HIDDEN = 16
BUCKETS = 1 << 15
GRAM = 4
PIECE = 1 << 20
#: Counts are whole numbers of this share of a text, so that sums don't depend on their order.
UNIT = 1 << 24
SMOOTH = 0.05

_CLASSES = np.zeros((256, 9))
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!?", b"#$%&*@^~+=<>", b"|_/\\", b".,;:", b"\n", range(0xC0, 0x100))):
    _CLASSES[list(_set), _k] = 1.0
SHAPES = 19


def shapes(texts: list[str | None]) -> np.ndarray:
    """A row of SHAPES figures for each text."""
    raws = [(t or "").encode() for t in texts]
    words = [r.split() for r in raws]
    n = np.array([len(w) for w in words], dtype=np.float64)
    size = np.array([len(r) for r in raws], dtype=np.float64)
    classes = np.stack([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raws]) @ _CLASSES if raws else np.zeros((0, 9))
    distinct, top, next_to, lines = (np.zeros(len(raws)) for _ in range(4))
    for i, (raw, own) in enumerate(zip(raws, words, strict=True)):
        if own:
            count: dict[bytes, int] = {}
            for w in own:
                count[w] = count.get(w, 0) + 1
            distinct[i], top[i] = len(count), max(count.values())
            next_to[i] = sum(map(bytes.__eq__, own, own[1:]))
            filled = [line for line in raw.split(b"\n") if line]
            lines[i] = 1 - len(set(filled)) / max(1, len(filled))
    some, letters = np.maximum(n, 1), np.maximum(classes[:, 0] + classes[:, 1], 1)
    bytes_ = np.maximum(size, 1)
    repeated = np.array(repeat_words(words), dtype=np.float64)
    columns = [
        *(np.sqrt(classes[:, k] / bytes_) for k in range(1, 9)),
        classes[:, 0] / letters,
        np.log1p(n),
        np.log1p(size),
        size / some / 10,
        distinct / some,
        np.log1p(distinct) - 0.8 * np.log1p(n),
        top / some,
        next_to / some,
        repeated / some,
        lines,
        (n == 0).astype(np.float64),
    ]
    return np.stack(columns, axis=1)


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, kind, buckets) of the words, pairs of words and byte grams of each text, in lower case, piece by piece."""
    shift = np.uint64(64 - 15)
    for i, text in enumerate(texts):
        raw, at = (text or "").encode().lower(), 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= PIECE else raw.rfind(b" ", at, at + PIECE) + 1 or at + PIECE
            piece = raw[at:end]
            at = end
            flat = hashed_words([piece])[0]
            yield i, 0, flat >> shift
            yield i, 1, mix64(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]) >> shift
            if len(piece) >= GRAM:
                b = np.frombuffer(piece, np.uint8).astype(np.uint32)
                n = len(b) - GRAM + 1
                value = sum(b[k : k + n] << np.uint32(8 * k) for k in range(GRAM))
                yield i, 2, (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def said(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's words, pairs and grams; table: 3 x BUCKETS."""
    total, n = np.zeros((len(texts), 3)), np.zeros((len(texts), 3))
    for i, kind, bucket in grams(texts):
        total[i, kind] += table[kind][bucket].sum(dtype=np.float64)
        n[i, kind] += len(bucket)
    return total / np.maximum(n, 1)


def shares(texts: list[str | None]) -> list[list[np.ndarray]]:
    """For each text and kind, the share of each bucket in units."""
    counts = [[np.zeros(0, np.int64)] * 3 for _ in texts]
    for i, kind, bucket in grams(texts):
        own = np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
        counts[i][kind] = own + counts[i][kind] if len(counts[i][kind]) else own
    return [[np.rint(c * (UNIT / max(1, c.sum()))).astype(np.int64) for c in own] for own in counts]


def log_ratios(good: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Of how often good and unlabelled texts hold what falls into each bucket, from sums of shares (kinds x BUCKETS)."""
    smooth = lambda x: (x / UNIT + SMOOTH) / (x.sum(axis=1, keepdims=True) / UNIT + SMOOTH * BUCKETS)
    return np.clip(np.log(smooth(good) / smooth(unlabelled)), -3, 3).astype(np.float32)


def risk(z_good: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of good texts, and of bad ones (to be taken as 0 where it is below)."""
    return prior * np.logaddexp(0, -z_good).mean(), np.logaddexp(0, z_unlabelled).mean() - prior * np.logaddexp(0, z_good).mean()


def slopes(z_good: np.ndarray, z_unlabelled: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The step's derivatives by z. prior None: of the loss of telling good from unlabelled texts."""
    qg, qu = (1 / (1 + np.exp(-z)) for z in (z_good, z_unlabelled))  # derivatives of l(z) and l(-z) are q - 1 and q
    if prior is None:
        return (qg - 1) / len(qg), qu / len(qu)
    if risk(z_good, z_unlabelled, prior)[1] >= 0:
        return prior * ((qg - 1) - qg) / len(qg), qu / len(qu)
    return prior * qg / len(qg), -qu / len(qu)


def train(good: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 1200, batch: int = 512, rate: float = 0.01, seed: int = 11) -> dict[str, np.ndarray]:
    """The network that has the least non-negative risk, by Adam over seeded batches."""
    random = np.random.default_rng(seed)
    mean, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    x_good, x_all = (np.clip((x - mean) / spread, -6, 6) for x in (good, unlabelled))
    d = x_good.shape[1]
    p = {"a": random.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b": np.zeros(HIDDEN), "c": random.normal(0, 0.1, HIDDEN), "d": np.zeros(1), "e": np.zeros(d)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        x = np.concatenate([x_good[random.integers(len(x_good), size=batch)], x_all[random.integers(len(x_all), size=2 * batch)]])
        h = np.tanh(x @ p["a"] + p["b"])
        z = h @ p["c"] + x @ p["e"] + p["d"][0]
        dz = np.concatenate(slopes(z[:batch], z[batch:], prior))
        dh = dz[:, None] * p["c"] * (1 - h * h)
        grads = {"a": x.T @ dh + 1e-4 * p["a"], "b": dh.sum(axis=0), "c": h.T @ dz + 1e-4 * p["c"], "d": np.array([dz.sum()]), "e": x.T @ dz + 1e-4 * p["e"]}
        for k, v in grads.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.001 * (v * v - second[k])
            p[k] = p[k] - rate * (1 - t / (steps + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return p | {"mean": mean, "spread": spread}


def class_prior(good: list[np.ndarray], unlabelled: list[np.ndarray], doubt: float = 0.1) -> float:
    """Share of good texts among the unlabelled, from the inputs of the two halves of each sample."""
    if not all(len(x) for x in (*good, *unlabelled)):
        good, unlabelled = ([np.concatenate(x)] * 2 for x in (good, unlabelled))
    found = []
    for k in (0, 1):
        apart = train(good[k], unlabelled[k], None, steps=400)
        p, u = (np.sort(score(apart, x)) for x in (good[1 - k], unlabelled[1 - k]))
        at = np.unique(np.concatenate([p, u]))
        over_p, over_u = (1 - np.searchsorted(x, at, "left") / len(x) for x in (p, u))
        error = np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        some = over_p > 0
        best = np.argmin((over_u[some] + error) / over_p[some])
        found.append(over_u[some][best] / over_p[some][best])
    return float(np.clip(np.mean(found), 0.01, 0.99))


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    x = np.clip((x - model["mean"]) / model["spread"], -6, 6)
    z = np.tanh(x @ model["a"] + model["b"]) @ model["c"] + x @ model["e"] + model["d"][0]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def predict(model: dict[str, np.ndarray] | None, texts: list[str | None]) -> np.ndarray:
    return score(model, inputs(texts, model["table"])) if model else np.full(len(texts), 0.5)


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame | None:
    """doc_id, half, good, other, text of the rows to learn from, written; None if there is nothing to learn from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(remainder(3) != 1)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where((remainder(3) != 1) & (F.col("quality") == 1))
    marks, rows = labels.count(), docs.count()
    if not marks or not rows:
        return None
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    trusted = labels.where(draw(0) < min(1.0, positives / marks)).select("doc_id").distinct().orderBy("doc_id").limit(2 * positives)
    flagged = docs.join(F.broadcast(trusted.withColumn("good", F.lit(True))), "doc_id", "left")
    flagged = flagged.withColumns({"good": F.coalesce("good", F.lit(False)), "other": draw(1) < min(1.0, unlabelled / rows), "half": (F.xxhash64("doc_id", F.lit(2)) % 2 == 0).cast("int")}).where("good OR other")
    # documents are chosen without reading texts: at most so many, the same ones in every run; of one with many texts, some by hash
    chosen = flagged.groupBy("doc_id").agg(F.count("*").alias("texts")).orderBy("doc_id").limit(2 * (positives + unlabelled))
    drawn = flagged.join(F.broadcast(chosen), "doc_id").withColumn("mark", F.xxhash64("text")).where("texts <= 4 OR pmod(mark, texts) < 4").dropDuplicates(["doc_id", "mark"])
    return materialise(drawn.select("doc_id", "mark", "half", "good", "other", "text"), "quality-sample")


def tables(drawn: DataFrame) -> np.ndarray:
    """Sums of shares by half, class (good, other), kind and bucket."""

    def run(batches):
        for batch in batches:
            total = np.zeros((2, 2, 3, BUCKETS), dtype=np.int64)
            for at in range(0, batch.num_rows, 50):
                half, good, other, text = (batch.column(k).slice(at, 50).to_pylist() for k in (2, 3, 4, 5))
                for own, h, g, o in zip(shares(text), half, good, other, strict=True):
                    for kind, c in enumerate(own):
                        if len(c):
                            total[h, 0, kind] += c * g
                            total[h, 1, kind] += c * o
            place = np.flatnonzero(total.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place])], names=["place", "units"])

    out = np.zeros(12 * BUCKETS, dtype=np.int64)
    sums = map_arrow(drawn, run, "place long, units long").groupBy("place").agg(F.sum("units").alias("units")).toArrow()
    out[sums.column("place").to_numpy()] = sums.column("units").to_numpy()
    return out.reshape(2, 2, 3, BUCKETS)


def inputs(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """What the network reads of each text."""
    return np.concatenate([shapes(texts), said(texts, table)], axis=1)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict[str, np.ndarray] | None:
    """The model, or None if no row may be learnt from."""
    drawn = sample(docs, labels, positives, unlabelled)
    if drawn is None:
        return None
    sums = tables(drawn)
    crossed = drawn.sparkSession.sparkContext.broadcast([log_ratios(*sums[1 - half]) for half in (0, 1)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                half, text = np.array(part.column(2).to_pylist()), part.column(5).to_pylist()
                x = np.zeros((part.num_rows, SHAPES + 3))
                for k in (0, 1):
                    own = np.flatnonzero(half == k)
                    if len(own):
                        x[own] = inputs([text[i] for i in own.tolist()], crossed.value[k])
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "mark", "half", "good", "other", "x"])

    found = map_arrow(drawn, run, "doc_id long, mark long, half int, good boolean, other boolean, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["mark"]))
    of = lambda kind, half: np.array([r["x"] for r in found if r[kind] and r["half"] == half]).reshape(-1, SHAPES + 3)
    good, other = ([of(kind, half) for half in (0, 1)] for kind in ("good", "other"))
    if not sum(map(len, good)) or not sum(map(len, other)):
        return None
    prior = class_prior(good, other)
    return train(np.concatenate(good), np.concatenate(other), prior) | {"table": log_ratios(*sums.sum(axis=0)), "prior": np.array(prior)}


def scores(docs: DataFrame, model: dict[str, np.ndarray] | None, into: str = "score") -> DataFrame:
    """All columns of docs and the score, in a new column of a name that docs doesn't have (common.fresh gives one)."""
    if fresh(docs, into) != [into]:
        raise ValueError(f"docs has a column {into}")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [predict(shipped.value, batch.column(at).slice(k, 500).to_pylist()) for k in range(0, batch.num_rows, 500)]
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, into])

    return map_arrow(docs, run, StructType([*docs.schema.fields]).add(into, DoubleType()))



def clean(docs: DataFrame, model: dict[str, np.ndarray] | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score least or more."""
    (into,) = fresh(docs, "score")
    return scores(docs, model, into).where(F.col(into) >= least).select(*named(*docs.columns))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    return scores(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
