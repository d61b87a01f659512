"""Operator 10: near-duplicate classes by ProbMinHash, banding and verification.

A text's shingles are its SHINGLE-word windows, weighted by how often they occur (a shorter text, but not one without words,
is one shingle). Every shingle sends arrivals of a Poisson process whose rate is its weight; each arrival falls on one of M
registers, and a register keeps the shingle of its earliest arrival. A shingle stops once its next arrival comes later than
the latest register. Two texts agree in a register with the probability Jaccard similarity
J_P = sum over shingles i of 1 / sum over shingles j of max(x_j / x_i, y_j / y_i), which is plain Jaccard for equal weights.

Classes are the connected components of the pairs of texts that share one of BANDS bands of ROWS registers (a pair at 0.8 fails
to with probability (1 - 0.8^ROWS)^BANDS = 7e-6) and whose exact J_P is THRESHOLD or more:
1. Texts with the same words are one node, numbered as written; copies are never paired.
2. In each band's bucket, the node that shares the most buckets is the leader; each node is verified against the leader it
   meets most often. In a group of copies of one text this finds the text, and one pair a node joins the group.
3. Buckets whose nodes are in one class are done. Of the others, those of two nodes are one pair, verified if it wasn't yet.
   Larger ones are dealt out in tiles of about TILE nodes a side; a task holds two tiles, compares all their nodes of
   different classes through an inverted index of shingles, each pair in its first common band, and gives one link for each
   node and class. So no link is lost to the choice of leaders, and a bucket of any size is worked on by many tasks.

Texts have the same words if a 128-bit BLAKE2 digest of all their words in order is the same; a word is hashed with all its bytes.
Null texts and texts without words are classes of their own. A null doc_id has a null class and links nothing. Repeated rows
give repeated rows. Different texts under one doc_id are different nodes, told apart by a hash of the text (mark): a class is
named by the smallest (doc_id, mark) in it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import fresh, id_text, map_arrow, map_batches, materialise, mix64, named, read_table
from sitelens.llm.graph import components
from sitelens.llm.words import hashed_words

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 30
M = ROWS * BANDS
TILE = 128
SALTS = 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SALT = np.uint64(0xD1B54A32D192ED03)
#: Shingle hashes have 54 bits, so that with the number of a text (of TEXTS) they are one sortable integer.
BITS = np.uint64(54)
TEXTS = 1000
EPSILON = 1e-9


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Rows (text number, shingle hash, weight), sorted by the first two, and a 128-bit key of each text's words (null without
    words). At most TEXTS texts."""
    if len(texts) > TEXTS:
        raise ValueError("too many texts at once")
    flat, n, keys = hashed_words(texts)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), keys
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(flat)) - first[doc]
    h = np.zeros(len(flat), dtype=np.uint64)
    factor = GOLDEN
    for k in range(size):
        h[: len(flat) - k] += flat[k:] * factor
        factor = np.uint64(int(factor) * int(GOLDEN) % 2**64)
    full = place + size <= n[doc]
    short = np.flatnonzero((n > 0) & (n < size))
    h[first[short]] = [int.from_bytes(keys[i][:8]) for i in short.tolist()]
    full[first[short]] = True
    key = np.sort(doc[full].astype(np.uint64) << BITS | mix64(h[full]) >> (np.uint64(64) - BITS))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(at, len(key))).astype(np.float64)
    return (key[at] >> BITS).astype(np.int64), key[at] & ((np.uint64(1) << BITS) - np.uint64(1)), weight, keys


def prob_min_hash(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs x m registers; a document without shingles has zeros."""
    time = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, dtype=np.uint64)
    at, arrival, turn = np.arange(len(h)), np.zeros(len(h)), 0
    while len(at):
        turn += 1
        r = mix64(h[at] + np.uint64(turn * int(GOLDEN) % 2**64))
        arrival = arrival - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / w[at]
        place = doc[at] * m + ((r * SALT >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(time, place, arrival)
        lead = arrival == time[place]
        held[place[lead]] = h[at[lead]]
        if len(at) * 4 < n_docs:
            live = np.unique(doc[at])
            latest = np.zeros(n_docs)
            latest[live] = time.reshape(n_docs, m)[live].max(axis=1)
        else:
            latest = time.reshape(n_docs, m).max(axis=1)
        on = arrival < latest[doc[at]]
        at, arrival = at[on], arrival[on]
    return held.reshape(n_docs, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets given as sorted hashes and weights."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # sum over common j of max(x_j / x_i, y_j / y_i): by the order of the ratios x / y, one side or the other is larger
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    xs, ys, rs = x[order], y[order], ratio[order]
    upto_y = np.concatenate([[0.0], np.cumsum(ys)])
    from_x = np.concatenate([np.cumsum(xs[::-1])[::-1], [0.0]])
    split = np.searchsorted(rs, ratio, side="left")  # below: x_j / y_j < x_i / y_i, so y_j / y_i is larger
    return float((1.0 / ((from_x[split] + only_a) / x + (upto_y[split] + only_b) / y)).sum())


def slices(column: pa.Array, rows: int = TEXTS, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows and bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= rows or total + n > size):
            yield at, i - at
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths) - at


def weighted_sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and weights of each text."""
    out = []
    for at, size in slices(column):
        doc, h, w, _ = shingles(column.slice(at, size).to_pylist())
        cut = np.searchsorted(doc, np.arange(size + 1))
        out += [(h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]) for i in range(size)]
    return out


def mark() -> Column:
    """What tells different texts under one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), key of the words (null without words) and band hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys_out, bands_out = [], []
        for at, size in slices(batch.column(2)):
            doc, h, w, keys = shingles(batch.column(2).slice(at, size).to_pylist())
            held = prob_min_hash(doc, h, w, size)
            band = np.zeros((size, BANDS), dtype=np.uint64)
            for k in range(ROWS):
                band = mix64((band ^ held[:, k::ROWS]) + GOLDEN)
            band = mix64(band ^ np.arange(BANDS, dtype=np.uint64) * SALT).view(np.int64)
            keys_out += keys
            bands_out += [row if key is not None else None for row, key in zip(band, keys, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys_out, pa.binary()), pa.array(bands_out, pa.list_(pa.int64()))], names=["doc_id", "mark", "key", "bands"])

    return map_batches(id_text(docs).select("doc_id", mark(), "text"), run, "doc_id long, mark long, key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts have a J_P of threshold or more."""
    own = texts.select("node", "text").hint("merge")
    # a text that many pairs name is copied to SALTS places at most, each for a part of its pairs
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    left = salted.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    right = salted.select("b", "salt").distinct().join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(right.hint("merge"), ["b", "salt"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for at in range(0, batch.num_rows, TEXTS):
            sides = []
            for k in (2, 3):
                coded = batch.column(k).slice(at, TEXTS).dictionary_encode()
                sets = weighted_sets(coded.dictionary)
                sides.append([sets[i] for i in coded.indices.to_pylist()])
            keep += [probability_jaccard(x, y) >= threshold - EPSILON for x, y in zip(*sides, strict=True)]
        mask = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def tiled(postings: DataFrame, tile: int = TILE) -> DataFrame:
    """Deals the nodes of each bucket (band, node, label) into tiles and names the pairs of tiles each takes part in: x a tile
    of nodes outside the bucket's largest class, y another such tile, or one of the largest class, numbered below 0. Nodes of
    the largest class aren't compared with each other."""
    sizes = postings.groupBy("band", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n"))
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / tile)).cast("int")
    dealt = postings.join(top, "band").select("band", "node", "label", (F.col("label") == F.col("top")).alias("in_top"), tiles(F.col("n_top")).alias("a"), tiles(F.col("n") - F.col("n_top")).alias("b"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("in_top"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    with_top = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda r: F.struct(r.alias("x"), (-1 - F.col("own")).alias("y")))
    rest_top = F.transform(F.sequence(F.lit(1), F.col("a")), lambda t: F.struct(F.col("own").alias("x"), (-t).alias("y")))
    rest_rest = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda r: F.struct(F.least(r, "own").alias("x"), F.greatest(r, "own").alias("y")))
    spread = dealt.withColumn("tile", F.explode(F.when(F.col("in_top"), with_top).otherwise(F.concat(rest_top, rest_rest))))
    return spread.select("band", "tile.x", "tile.y", "node", "label", "in_top", "own")


def compare(band: int, x: int, y: int, rows: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links between the nodes of two tiles: for each node of the first, one with each class of the second it has a link to."""
    ids, label, own = (rows.column(k).to_numpy() for k in ("node", "label", "own"))
    in_top = rows.column("in_top").to_numpy()
    left = np.flatnonzero(~in_top & (own == x))
    right = np.flatnonzero(in_top if y < 0 else ~in_top & (own == y))
    if not len(left) or not len(right):
        return []
    sets = weighted_sets(rows.column("text").combine_chunks())
    bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
    mine = int(np.flatnonzero(bands[0] == band)[0])
    flat = np.concatenate([sets[i][0] for i in right])
    size = np.array([len(sets[i][0]) for i in right])
    share = np.concatenate([sets[i][1] / sets[i][1].sum() for i in right])
    order = np.argsort(flat, kind="stable")
    flat, share, owner = flat[order], share[order], np.repeat(np.arange(len(right)), size)[order]
    plain = np.array([bool((s[1] == 1).all()) for s in sets])
    found = []
    for i in left.tolist():
        h, w = sets[i]
        lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        may = (label[right] != label[i]) & (ids[right] != ids[i]) & ((ids[right] > ids[i]) | (x != y))
        if mine:
            may &= ~(bands[right, :mine] == bands[i, :mine]).any(axis=1)
        # a register agrees with at most the mass that the two share; where all weights are 1, J_P is |common| / |either|
        mass = np.bincount(owner[at], np.minimum(share[at], np.repeat(w / w.sum(), n)), len(right))
        may &= mass >= threshold - EPSILON
        if plain[i]:
            common = np.bincount(owner[at], minlength=len(right))
            may &= ~plain[right] | (common >= (threshold - EPSILON) * (size + len(h) - common))
        done: set[int] = set()
        for k in np.flatnonzero(may)[np.argsort(-mass[may], kind="stable")].tolist():
            other = int(right[k])
            if label[other] not in done and (plain[i] and plain[other] or probability_jaccard(sets[i], sets[other]) >= threshold - EPSILON):
                done.add(label[other])
                found.append((int(ids[i]), int(ids[other])))
    return found


def cross_links(tiles: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) within pairs of tiles; nodes: node, bands, text. A task holds one pair of tiles at a time."""
    rows = tiles.join(nodes.hint("merge"), "node").select("band", "x", "y", "node", "label", "in_top", "own", "bands", "text")
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def finish() -> list[tuple[int, int]]:
            return compare(*name, pa.Table.from_batches(held), threshold) if held else []

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            found: list[tuple[int, int]] = []
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != name:
                    found += finish()
                    held, name = [], keys[at]
                held.append(batch.slice(at, end - at))
                at = end
            yield links_batch(found)
        yield links_batch(finish())

    return map_arrow(rows, run, "a long, b long")


def links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def classes(docs: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """doc_id, mark, class_id and class_mark (smallest doc_id of the class, and of its texts under that the one of least mark),
    class_texts (different word sequences in it) for every row."""
    docs = id_text(docs)
    sigs = materialise(signatures(docs), "signatures")
    # equal words have equal bands
    same = sigs.where("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "mark", "bands")).alias("first"))
    same = materialise(same.select("key", "first.*", F.monotonically_increasing_id().alias("node")), "same-words")
    postings = same.select("node", F.explode("bands").alias("band"))
    buckets = postings.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(postings.join(buckets.hint("merge"), "band"), "buckets")

    # the node that meets the most others is the leader of its buckets
    rank = materialise(shared.groupBy("node").agg(F.sum("n").alias("met")), "candidates")
    ranked = shared.join(rank.hint("merge"), "node").select("band", "node", "met")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("leader"), F.col("top.met").alias("leader_met"))
    met = shared.join(leaders.hint("merge"), "band").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("times"), F.max("leader_met").alias("leader_met"))
    best = met.groupBy("node").agg(F.max(F.struct("times", "leader_met", (-F.col("leader")).alias("minus"))).alias("top")).select(F.col("node").alias("a"), (-F.col("top.minus")).alias("b"))
    best = materialise(best, "led")
    # texts of the nodes that meet any other; the only shuffle of all texts
    own = same.join(rank.select("node").hint("merge"), "node").select("doc_id", "mark", "node", "bands")
    texts = docs.select("doc_id", mark(), "text").join(own.hint("merge"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    texts = materialise(texts.select("node", "bands", "text"), "texts")
    edges = materialise(verified(best, texts, threshold), "links")
    labels = components(edges)

    # what is left between classes
    classed = shared.join(labels.select("node", "label").hint("merge"), "node", "left").select("band", "node", "n", F.coalesce("label", "node").alias("label"))
    classed = materialise(classed, "classed")
    mixed = classed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("a"), F.max("node").alias("b"), F.max("n").alias("n")).where("low <> high")
    mixed = materialise(mixed, "mixed-buckets")
    tested = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    twos = materialise(mixed.where("n = 2").select("a", "b").distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    rest = classed.join(mixed.where("n > 2").select("band").hint("merge"), "band", "left_semi").select("band", "node", "label")
    more = materialise(verified(twos, texts, threshold).union(cross_links(tiled(rest, tile), texts, threshold)), "links")
    if more.limit(1).count():
        labels = components(edges.union(more))

    found = same.select("key", "doc_id", "mark", "node").join(labels.select("node", "label").hint("merge"), "node", "left")
    found = materialise(found.select("key", "doc_id", "mark", F.coalesce("label", "node").alias("label")), "classes")
    sizes = found.groupBy("label").agg(F.count("*").alias("class_texts"), F.min(F.struct("doc_id", "mark")).alias("first"))
    of_key = materialise(found.join(sizes.hint("merge"), "label").select("key", "first", "class_texts"), "named-classes")
    out = sigs.select("doc_id", "mark", "key").join(of_key, "key", "left")
    own_class = F.col("doc_id").isNotNull()
    alone = F.struct("doc_id", "mark")
    first = F.when(own_class, F.coalesce("first", alone))
    return out.select("doc_id", "mark", first["doc_id"].alias("class_id"), first["mark"].alias("class_mark"), F.when(own_class, F.coalesce("class_texts", F.lit(1))).cast("long").alias("class_texts"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_texts (different word sequences in it) for every row."""
    return classes(docs, threshold, tile).select("doc_id", "class_id", "class_texts")


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text is the first of its class; repeated rows once, and all rows that
    have no doc_id."""
    own_id, own_mark, row = fresh(docs, "own_id", "own_mark", "row")
    found = classes(docs, threshold).where("doc_id <> class_id OR mark <> class_mark").select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).distinct()
    copies = materialise(found, "copies")
    own = F.col("doc_id").cast("long")
    marks = {own_id: own, own_mark: mark(), row: F.when(own.isNull(), F.monotonically_increasing_id())}
    kept = docs.withColumns(marks).join(copies.hint("shuffle_hash"), [own_id, own_mark], "left_anti").dropDuplicates([own_id, own_mark, row])
    return kept.select(*named(*docs.columns))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
