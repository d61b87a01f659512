"""Operator 3: token counts by a compiled finite-state transducer.

The transducer reads characters. Its state is where the tokenizer's pattern stands in a word (a run of letters, of numbers, of
other characters, of white space whose last character may still go to the next word, or what may become a contraction) and
where the BPE stands in that word's bytes: for every start k from which the text read so far can still grow into a vocabulary
token, the trie node reached from k, the last token of the (unique) BPE encoding of the prefix before k, and that prefix's token
count less that of the first such start. Reading a byte, the one token that ends here and is compatible with the last token
before it is the last token of the longer prefix. What moves the first start forward is emitted, as is what is left when a word
ends: each transition is annotated with the number of tokens it emits, each state with the number it emits at the end. Tokens are
of bounded length, so the states are finite; they are compiled when first reached. Classes of characters are the tokenizer's.

Chunk maps: a long text is cut into chunks of CHUNK characters. A chunk's map takes the state that enters it to the state that leaves
it and the tokens emitted between. It is held as the path from the state of a text's beginning, noted every STEP characters: another
state that enters is followed until its path meets that one, which in text is after a few words, and from there on both leave in the
same state. Two maps compose to one that holds both and its own path; composition is associative, and an inclusive prefix scan over
the chunks (offsets) or their reduction (counts) gives the states and tokens at the ends of all chunks or of the text. No map holds
any text. The scan over one text runs in the task that holds its row. Texts of up to LONG characters are cut where visible characters
meet white space instead, where the state that enters is the one of a text's beginning.

Chunks are worked on side by side, a character of each at a time, through a hash table of transitions; a chunk with other
characters than the COLUMNS first met is read by itself, through the states' own edges.

Null and empty texts count no bytes and no tokens. Every row gives one row, repeated rows and null doc_ids included; an empty table
gives an empty result; other columns, of any name, aren't read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.bpe import BYTE_LEVEL, BpeModel
from sitelens.llm.common import Memo, id_text, map_batches, read_table, worker_cache

TOKENIZER = "byte_bpe_50k.json"
LONG = 1 << 16
CHUNK = 1 << 12
STEP = 64
LIMIT = 1024
#: Characters that transitions of the table read, bits of an entry that hold the tokens emitted, and what is added to them there: a longer prefix can
#: have fewer tokens, so some transitions take back one.
COLUMNS = 1 << 14
EMITS, OVER = 7, 32
#: Characters worked on at once.
BATCH = 1 << 20

#: Where the pattern stands: at the start of a word, or in one of letters, numbers, other characters or white space, or after an
#: apostrophe that starts a word.
START, LETTERS, NUMBERS, OTHERS, SPACES, APOSTROPHE = range(6)
#: Contractions of the tokenizer's pattern: what follows the apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

State = tuple  # (where the pattern stands, characters not yet given to the BPE, state of the BPE or None)
BEGIN: State = (START, "", None)


class Table:
    """Numbers by numbers of 0 or more, many at a time: open addressing, the next free slot after the hashed one."""

    GOLDEN = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int = 12):
        self.shift, self.used = np.uint64(64 - bits), 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.GOLDEN >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; -1 for those that aren't there."""
        slot = self.slots(keys)
        found = self.keys[slot]
        value = self.values[slot]
        off = np.flatnonzero(found != keys)
        while len(off):
            value[off[found[off] < 0]] = -1
            off = off[found[off] >= 0]
            slot[off] = (slot[off] + 1) % len(self.keys)
            found[off], value[off] = self.keys[slot[off]], self.values[slot[off]]
            off = off[found[off] != keys[off]]
        return value

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't there yet."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            bits = int(2 * (self.used + len(keys))).bit_length() + 1
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(bits)
        self.used += len(keys)
        slot = self.slots(keys)
        while len(keys):
            free, first = np.unique(slot, return_index=True)
            first = first[self.keys[free] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), dtype=bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) % len(self.keys)


class Transducer:
    """Counts the tokens of texts without special tokens."""

    NONE = -1
    FIRST = ((0, NONE, 0),)
    #: States at which all are compiled anew.
    MOST = 300_000

    def __init__(self, model: BpeModel):
        self.model = model
        if [w for w, _ in model.split("it's!'s  a1")] != ["it", "'s", "!'", "s", "Ġ", "Ġa", "1"]:
            raise ValueError("another pattern of words")
        self.child: dict[tuple[int, str], int] = {}
        self.ends: dict[int, int] = {}  # trie node to token
        self.grows: set[int] = set()
        nodes = 1
        for token, i in model.vocab.items():
            at = 0
            for c in token:
                self.grows.add(at)
                to = self.child.get((at, c))
                if to is None:
                    to = self.child[at, c] = nodes
                    nodes += 1
                at = to
            self.ends[at] = i
        self.classes = Memo(self._class, 1 << 20)
        self.columns: list[str] = []
        self.code = np.full(0x110000, -1, dtype=np.int16)
        self.space = np.zeros(COLUMNS + 1, dtype=bool)  # the last one stands for characters without a column
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.edges: dict[int, dict[str, tuple[int, int]]] = {}
        self.held = 0
        self.table = Table()
        self.at(BEGIN)

    def at(self, state: State) -> int:
        """Number of a state; it holds until the next reset."""
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def _class(self, c: str) -> int:
        for kind, x in ((LETTERS, "a"), (NUMBERS, "1"), (OTHERS, "!")):
            if len(self.model.split(x + c)) == 1:
                return kind
        return SPACES

    def feed(self, live: tuple, text: str) -> tuple[tuple, int]:
        """State of the BPE after more characters of a word, and the tokens emitted on the way."""
        total = 0
        for b in text.encode().decode("latin-1").translate(BYTE_LEVEL):
            live, n = self.byte(live, b)
            total += n
        return live, total

    def byte(self, live: tuple, b: str) -> tuple[tuple, int]:
        made, count, on = None, 0, []
        for node, last, ahead in live:
            to = self.child.get((node, b))
            if to is None:
                continue
            token = self.ends.get(to)
            if token is not None and made is None and (last == self.NONE or self.model.compatible(last, token)):
                made, count = token, ahead + 1
            if to in self.grows:
                on.append((to, last, ahead))
        if made is None:
            raise ValueError(f"no token ends at {b!r}")
        on.append((0, made, count))
        base = on[0][2]
        return tuple((node, last, ahead - base) for node, last, ahead in on), base

    def whole(self, text: str, live: tuple = FIRST) -> int:
        """Tokens of a word, or of what is left of one, that ends after text."""
        live, n = self.feed(live, text)
        return n + live[-1][2]

    def begin(self, c: str) -> tuple[State, int]:
        kind = self.classes[c]
        if kind == SPACES:
            return (SPACES, c, None), 0
        if c == "'":
            return (APOSTROPHE, c, None), 0
        live, n = self.feed(self.FIRST, c)
        return (kind, "", live), n

    def read(self, state: State, c: str) -> tuple[State, int]:
        """The state after reading c and the tokens emitted on the way."""
        where, held, live = state
        kind = self.classes[c]
        if where == SPACES:
            if kind == SPACES:  # what was held back wasn't the last one
                live, n = self.feed(live or self.FIRST, held)
                return (SPACES, c, live), n
            n = live[-1][2] if live else 0
            if held == " ":
                live, more = self.feed(self.FIRST, held + c)
                return (kind, "", live), n + more
            state, more = self.begin(c)
            return state, n + self.whole(held) + more
        if where == APOSTROPHE:
            longer = held[1:] + c
            if longer in ENDINGS:
                return BEGIN, self.whole(held + c)
            if any(x.startswith(longer) for x in ENDINGS):
                return (APOSTROPHE, held + c, None), 0
            if len(held) == 1:
                live, n = self.feed(self.FIRST, held)
                state = (OTHERS, "", live)
            else:  # the apostrophe is a word, and a letter starts the next
                live, n = self.feed(self.FIRST, held[1:])
                n += self.whole("'")
                state = (LETTERS, "", live)
            state, more = self.read(state, c)
            return state, n + more
        if where == kind:
            live, n = self.feed(live, c)
            return (kind, "", live), n
        state, n = self.begin(c)
        return state, n + (live[-1][2] if live else 0)

    def ending(self, state: State) -> int:
        """Tokens that a state emits where the text ends."""
        where, held, live = state
        if where == SPACES:
            return self.whole(held, live or self.FIRST)
        if where == APOSTROPHE:
            return self.whole("'") + (self.whole(held[1:]) if held[1:] else 0)
        return live[-1][2] if live else 0

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after reading text, and the tokens emitted on the way."""
        self.refresh()
        now, total = self.at(state), 0
        for c in text:
            own = self.edges.get(now)
            if own is None:
                own = self.edges[now] = {}
            step = own.get(c)
            if step is None:
                to, n = self.read(self.states[now], c)
                step = own[c] = self.at(to), n
                self.held += 1
            now = step[0]
            total += step[1]
        return self.states[now], total

    def refresh(self) -> None:
        if len(self.states) > self.MOST or self.held > 2 * self.MOST:
            self.reset()

    def codes(self, text: str) -> np.ndarray:
        """Column of each character; -1 for one that has none."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        codes = self.code[points]
        if len(self.columns) < COLUMNS and codes.min(initial=0) < 0:
            new, often = np.unique(points[codes < 0], return_counts=True)
            for point in new[np.argsort(-often, kind="stable")][: COLUMNS - len(self.columns)].tolist():
                self.code[point] = len(self.columns)
                self.space[len(self.columns)] = self.classes[chr(point)] == SPACES
                self.columns.append(chr(point))
            codes = self.code[points]
        return codes

    def compile(self, keys: np.ndarray) -> None:
        """Adds what the table lacks; keys are states and columns in one number."""
        keys = np.unique(keys)
        values = []
        for key in keys.tolist():
            state, column = divmod(key, COLUMNS)
            to, n = self.read(self.states[state], self.columns[column])
            if (n + OVER) >> EMITS or len(self.states) > 2 * self.MOST:
                raise OverflowError
            values.append(self.at(to) << EMITS | n + OVER)
        self.table.put(keys, np.array(values, dtype=np.int32))

    def side_by_side(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, every: int = 0) -> tuple[list[State], np.ndarray, list[list[tuple[State, int]]]]:
        """State and tokens after each chunk of codes (none below 0, none empty) from the state of a text's beginning, and the path
        there, noted after every so many characters and at the end. OverflowError: read the chunks by themselves."""
        self.refresh()
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # chunks of more than so many characters
        state, total = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        path: list[list[tuple[State, int]]] = [[] for _ in size]
        for t, m in enumerate(live.tolist()):
            key = state[:m] * COLUMNS + codes[begin[:m] + t]
            value = self.table.get(key)
            if value.min() < 0:
                self.compile(key[value < 0])
                value = self.table.get(key)
            np.right_shift(value, EMITS, out=state[:m], casting="same_kind")
            total[:m] += (value & ((1 << EMITS) - 1)) - OVER
            if every and (t + 1) % every == 0:
                for k, (s, n) in enumerate(zip(state[:m].tolist(), total[:m].tolist(), strict=True)):
                    if size[k] > t + 1:
                        path[order[k]].append((self.states[s], n))
        back = np.argsort(order, kind="stable")
        states = [self.states[s] for s in state[back].tolist()]
        if every:
            for own, s, n in zip(path, states, total[back].tolist(), strict=True):
                own.append((s, n))
        return states, total[back], path


class Chunk:
    """The map of the characters a to b of a text, held as the path from the state of a text's beginning."""

    def __init__(self, machine: Transducer, text: str, a: int, b: int, path: list[tuple[State, int]] | None = None):
        self.machine, self.text, self.a, self.b = machine, text, a, b
        if path is None:
            path, state, total = [], BEGIN, 0
            for at in range(a, b, STEP):
                state, n = machine.run(state, text[at : min(at + STEP, b)])
                total += n
                path.append((state, total))
        self.path = path
        self.leaves, self.total = path[-1]

    def of(self, state: State) -> tuple[State, int]:
        """The state that leaves when this one enters, and the tokens emitted between."""
        total = 0
        if state == BEGIN:
            return self.leaves, self.total
        for k, (met, upto) in enumerate(self.path):
            at = self.a + k * STEP
            state, n = self.machine.run(state, self.text[at : min(at + STEP, self.b)])
            total += n
            if state == met:
                return self.leaves, total + self.total - upto
        return state, total


class Composed:
    """First one map, then another."""

    def __init__(self, first: Map, then: Map):
        self.first, self.then = first, then
        self.leaves, n = then.of(first.leaves)
        self.total = first.total + n

    def of(self, state: State) -> tuple[State, int]:
        between, n = self.first.of(state)
        if between == self.first.leaves:
            return self.leaves, n + self.total - self.first.total
        state, more = self.then.of(between)
        return state, n + more


Map = Chunk | Composed


def reduced(maps: list[Map]) -> Map:
    """All maps composed, in a balanced tree."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def scan(maps: list[Map]) -> list[Map]:
    """Inclusive prefix scan: neighbours are paired, the pairs scanned, and the others filled in between."""
    if len(maps) < 2:
        return maps
    pairs = scan([Composed(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
    return [pairs[i // 2] if i % 2 else Composed(pairs[i // 2 - 1], m) if i else m for i, m in enumerate(maps)]


class Counter:
    """The transducer over the pieces of texts between special tokens."""

    def __init__(self, path: str):
        self.model = BpeModel(path)
        self.machine = Transducer(self.model)

    def pieces(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, special tokens after it) of what stands between special tokens."""
        at = 0
        if self.model.cut is not None:
            for m in self.model.cut.finditer(text):
                yield at, m.start(), 1
                at = m.end()
        yield at, len(text), 0

    def maps(self, text: str, a: int, b: int, chunk: int) -> list[Map]:
        out: list[Map] = []
        at_once = max(1, BATCH // chunk) * chunk
        for lo in range(a, b, at_once):
            hi = min(b, lo + at_once)
            codes = self.machine.codes(text[lo:hi])
            begin = np.arange(0, hi - lo, chunk)
            paths: list = [None] * len(begin)
            known = np.flatnonzero(np.minimum.reduceat(codes, begin) >= 0)
            with contextlib.suppress(OverflowError):
                if len(known):
                    found = self.machine.side_by_side(codes, begin[known], np.minimum(chunk, hi - lo - begin[known]), STEP)[2]
                    for k, path in zip(known.tolist(), found, strict=True):
                        paths[k] = path
            out += [Chunk(self.machine, text, lo + x, min(lo + x + chunk, hi), path) for x, path in zip(begin.tolist(), paths, strict=True)]
        return out

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of one text, through chunk maps."""
        total = 0
        for a, b, special in self.pieces(text or ""):
            total += special
            if b > a:
                whole = reduced(self.maps(text, a, b, chunk))
                total += whole.total + self.machine.ending(whole.leaves)
        return total

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        plain: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > LONG or (self.model.cut is not None and "<" in text and self.model.cut.search(text)):
                out[i] = self.count(text)
                continue
            plain.append(i)
            held += len(text)
            if held > BATCH:
                self.short(texts, plain, out)
                plain, held = [], 0
        self.short(texts, plain, out)
        return out

    def short(self, texts: list[str | None], which: list[int], out: list[int]) -> None:
        """Counts the texts of those numbers, cut where a visible character meets white space."""
        if not which:
            return
        joined = "".join(texts[i] for i in which)
        size = np.array([len(texts[i]) for i in which])
        first = np.cumsum(size) - size
        codes = self.machine.codes(joined)
        space = self.machine.space[codes]
        border = np.flatnonzero(space[1:] & ~space[:-1] & (codes[:-1] >= 0)) + 1
        begin = np.unique(np.concatenate([first, border[np.unique(border // 256, return_index=True)[1]]]))
        length = np.diff(np.append(begin, len(codes)))
        owner = np.searchsorted(first, begin, side="right") - 1
        total = np.zeros(len(begin), dtype=np.int64)
        left = np.ones(len(begin), dtype=bool)
        known = np.flatnonzero(np.minimum.reduceat(codes, begin) >= 0)
        with contextlib.suppress(OverflowError):
            if len(known):
                states, n, _ = self.machine.side_by_side(codes, begin[known], length[known])
                endings = {s: self.machine.ending(s) for s in set(states)}
                total[known] = n + [endings[s] for s in states]
                left[known] = False
        for k in np.flatnonzero(left).tolist():
            state, n = self.machine.run(BEGIN, joined[begin[k] : begin[k] + length[k]])
            total[k] = n + self.machine.ending(state)
        for i, n in zip(which, np.bincount(owner, total, len(which)).astype(np.int64).tolist(), strict=True):
            out[i] = n

    def offsets(self, text: str | None, chunk: int = CHUNK) -> list[tuple[int, int]]:
        """(characters, tokens that end within them) at the end of each chunk; at the end of the text, all tokens."""
        out, total = [], 0
        for a, b, special in self.pieces(text or ""):
            states = scan(self.maps(text, a, b, chunk)) if b > a else []
            out += [(min(a + (k + 1) * chunk, b), total + m.total) for k, m in enumerate(states)]
            if states:
                total += states[-1].total + self.machine.ending(states[-1].leaves)
                out[-1] = (b, total)
            total += special
        return out


def counter(path: str) -> Counter:
    return worker_cache(f"count:{path}", lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        n_tokens = c.counts(batch.column(1).to_pylist())
        over = [n > limit for n in n_tokens]
        return pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(id_text(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "count:")


def token_offsets(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id and, for the end of each chunk of the text, the characters before it and the tokens that end within them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        found = [[{"chars": x, "tokens": n} for x, n in c.offsets(text.as_py(), chunk)] for text in batch.column(1)]
        kind = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "offsets"])

    return map_batches(id_text(docs), run, "doc_id long, offsets array<struct<chars:long,tokens:long>>", "count:")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
