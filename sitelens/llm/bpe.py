"""BPE encoding and decoding by per-prefix dynamic programming.

For BPE, the encoding of every prefix of a word is unique, and so is its last token. For each prefix, the automaton gives
the vocabulary tokens that are suffixes of it, longest first; the one that is compatible with the last token of the
prefix before it is the last token of this prefix. Following these back-pointers from the end gives the exact ids.
Two tokens are compatible if BPE, run over the two together, never merges across the border between them.

Normalisation and the split into words are those of the tokenizer file, taken from the tokenizers library; the merges are ours.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from sitelens.llm.common import Memo

#: Stands for the end of a word; byte-level alphabets don't hold it.
END = "\x00"
NEVER = 1 << 60


class BpeModel:
    """Vocabulary, merge ranks and the suffix-matching automaton of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only byte-level BPE is handled")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens are expected as plain strings of the raw text")
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids of more than 16 bits")
        self.by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        lib = Tokenizer.from_file(path)
        self.normalise = lib.normalizer.normalize_str if lib.normalizer else lambda s: s
        self.split = lib.pre_tokenizer.pre_tokenize_str
        #: For Latin letters the file's rules are known to be LATIN_WORD's over lower case; the rest goes through the library.
        self.lowers = self.suffix != "" and self.normalise("É A") == "é a" and [w for w, _ in self.split("it's é1 2,3.")] == ["it", "'s", "Ã©", "1", "2", ",", "3", "."]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}  # rank of the merge that makes a token; -1 for a symbol
        self.parts: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((left, right), r)
            if made not in self.born:
                self.born[made], self.parts[made] = r, (left, right)
        self._build_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = Memo(self.encode_word, 300_000)
        self.latin = Memo(self._latin_word, 400_000)
        self.batch: BatchEncoder | None = None
        self.segments = Memo(self._segment, 500_000)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between these two adjacent tokens alone."""
        key = left << 16 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, x: int, y: int) -> bool:
        """Undo merges on both sides of the border, latest first. x lives until the merge of rank x_until takes it, y until
        y_until; a merge of (x, y) comes first if its rank is lower, and at equal rank if it stands further left, so before y's."""
        x_until = y_until = NEVER
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < x_until and r <= y_until:
                return False
            bx, by = self.born.get(x, -1), self.born.get(y, -1)
            if bx < 0 and by < 0:
                return True
            if bx > by:
                x_until, x = bx, self.parts[x][1]
            else:
                y_until, y = by, self.parts[y][0]

    def _build_automaton(self) -> None:
        """Trie of the vocabulary with suffix links. token_of: the longest token that is a suffix of what leads to a state;
        shorter: for each token, the longest other token that is a suffix of it. Missing steps are filled in when first taken."""
        self.steps: list[dict[str, int]] = [{}]
        self.token_of, self.link, self.size = [-1], [0], {}
        self.shorter: dict[int, int] = {}
        for token, i in self.vocab.items():
            if token == self.suffix:
                continue
            if self.suffix and token.endswith(self.suffix):
                token = token[: -len(self.suffix)] + END
            self.size[i] = len(token)
            at = 0
            for c in token:
                to = self.steps[at].get(c)
                if to is None:
                    to = self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.token_of.append(-1)
                    self.link.append(0)
                at = to
            self.token_of[at] = i
        level = list(self.steps[0].values())
        for state in level:
            self._own(state)
        while level:
            below = []
            for state in level:
                for c, to in self.steps[state].items():
                    at = self.link[state]
                    while at and c not in self.steps[at]:
                        at = self.link[at]
                    self.link[to] = self.steps[at].get(c, 0)
                    self._own(to)
                    below.append(to)
            level = below

    def _own(self, state: int) -> None:
        suffix = self.token_of[self.link[state]]
        if self.token_of[state] < 0:
            self.token_of[state] = suffix
        else:
            self.shorter[self.token_of[state]] = suffix

    def _step(self, state: int, c: str) -> int:
        at = state
        while at and c not in self.steps[at]:
            at = self.link[at]
        to = self.steps[state][c] = self.steps[at].get(c, 0)
        return to

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the byte-level alphabet."""
        if self.suffix:
            word += END
        steps, token_of, size, shorter, pairs = self.steps, self.token_of, self.size, self.shorter, self.pairs
        state, token_at = 0, []  # last token of the prefix that ends here
        for end, c in enumerate(word, 1):
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            token = token_of[state]
            while token >= 0:
                start = end - size[token]
                if not start:
                    break
                before = token_at[start - 1]
                if before >= 0:
                    fits = pairs.get(before << 16 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            token_at.append(token)
        ids, end = [], len(word)
        while end:
            token = token_at[end - 1]
            if token < 0:
                raise ValueError(f"no encoding for {word!r}")
            ids.append(token)
            end -= size[token]
        return tuple(ids[::-1])

    def _latin_word(self, word: str) -> tuple[int, ...]:
        return self.encode_word(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL))

    def _segment(self, segment: str) -> tuple[int, ...]:
        """Ids of text between white space; strings of special tokens stand for themselves."""
        if self.cut is not None and "<" in segment:
            pieces = self.cut.split(segment)
        else:
            pieces = (segment,)
        ids: list[int] = []
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
            elif self.lowers and LATIN.fullmatch(piece):
                for word in LATIN_WORD.findall(piece.lower()):
                    ids.extend(self.latin[word])
            elif piece:
                for word, _ in self.split(self.normalise(piece)):
                    ids.extend(self.words[word])
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text. White space separates words in this tokenizer, so what stands between is encoded alone."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.segments.__getitem__, split_space(text))))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 16-bit integers. The words of Latin texts that aren't known yet are worked on at once."""
        out: list = [None] * len(texts)
        plain: list[int] = []
        for i, t in enumerate(texts):
            if t and self.lowers and LATIN_TEXT.fullmatch(t) and not ("<|" in t and self.cut.search(t)):
                plain.append(i)
            else:
                out[i] = np.array(self.encode(t), dtype="<u2")
        if plain:
            if self.batch is None:
                self.batch = BatchEncoder(self)
            for i, ids in zip(plain, self.batch.encode([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def decode(self, ids) -> str:
        """The library's decode() of a tokenizer without a decoder: tokens joined by blanks, special tokens kept."""
        return " ".join(map(self.by_id.__getitem__, ids))


class BatchEncoder:
    """The same dynamic programming for many words at once: one step of the automaton for all words, then one compatibility
    test for all that have none yet, until every word has the last token of its prefix."""

    MOST = 300_000
    SLOTS = 1 << 21
    LONGEST = 40

    def __init__(self, model: BpeModel):
        self.model = model
        level = {c: b for b, c in BYTE_LEVEL.items()} | {chr(b): b for b in VISIBLE}
        used = [*range(ord("a"), ord("z") + 1), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]
        self.column = np.zeros(257, dtype=np.uint8)
        self.column[used] = np.arange(1, len(used) + 1)
        self.column[256] = len(used) + 1  # the end of a word
        # trie of the tokens made of these bytes, with a complete table of steps
        steps: list[dict[int, int]] = [{}]
        token_of = [-1]
        for token, i in model.vocab.items():
            ends = bool(model.suffix) and token.endswith(model.suffix)
            path = [int(self.column[level[c]]) for c in (token[: -len(model.suffix)] if ends else token)] + [len(used) + 1] * ends
            if not all(path) or not path:
                continue
            at = 0
            for c in path:
                to = steps[at].get(c)
                if to is None:
                    to = steps[at][c] = len(steps)
                    steps.append({})
                    token_of.append(-1)
                at = to
            token_of[at] = i
        self.token_of = np.array(token_of, dtype=np.int32)
        self.table = np.zeros((len(steps), len(used) + 2), dtype=np.int32)
        self.shorter = np.full(1 << 16, -1, dtype=np.int32)
        self.size = np.ones(1 << 16, dtype=np.int16)
        for i, n in model.size.items():  # in bytes: a character of the byte-level alphabet is one
            self.size[i] = n
        for c, to in steps[0].items():
            self.table[0, c] = to
        link = np.zeros(len(steps), dtype=np.int32)
        order = list(steps[0].values())
        while order:
            below = []
            for state in order:
                own, suffix = self.token_of[state], self.token_of[link[state]]
                if own < 0:
                    self.token_of[state] = suffix
                else:
                    self.shorter[own] = suffix
                row = self.table[link[state]].copy()
                for c, to in steps[state].items():
                    link[to] = row[c]
                    row[c] = to
                    below.append(to)
                self.table[state] = row
            order = below
        self.known: dict[str, bytes] = {}
        self._clear_pairs()

    def _clear_pairs(self) -> None:
        self.keys = np.full(self.SLOTS, -1, dtype=np.int64)
        self.fits = np.zeros(self.SLOTS, dtype=bool)
        self.held = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Of pairs left << 16 | right."""
        slot = self._slot(keys)
        out = np.zeros(len(keys), dtype=bool)
        at = np.arange(len(keys))
        missing = []
        while len(at):
            found = self.keys[slot[at]]
            hit = found == keys[at]
            out[at[hit]] = self.fits[slot[at[hit]]]
            missing.append(at[found == -1])
            at = at[~hit & (found != -1)]
            slot[at] = (slot[at] + 1) & (self.SLOTS - 1)
        lost = np.concatenate(missing) if missing else at
        if len(lost):
            new, back = np.unique(keys[lost], return_inverse=True)
            if self.held + len(new) > self.SLOTS // 2:
                self._clear_pairs()
            fits = np.array([self.model._border_holds(k >> 16, k & 0xFFFF) for k in new.tolist()], dtype=bool)
            out[lost] = fits[back]
            for k, s, f in zip(new.tolist(), self._slot(new).tolist(), fits.tolist(), strict=True):
                while self.keys[s] != -1:
                    s = (s + 1) & (self.SLOTS - 1)
                self.keys[s], self.fits[s] = k, f
            self.held += len(new)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words and keeps their ids."""
        raw = [w.encode() for w in words]
        n = np.array([len(r) for r in raw])
        flat = self.column[np.frombuffer(b"".join(raw), np.uint8)]
        first = np.cumsum(n) - n
        odd = np.zeros(len(raw), dtype=bool)
        np.logical_or.at(odd, np.repeat(np.arange(len(raw)), n)[flat == 0], True)
        for i in np.flatnonzero(odd | (n > self.LONGEST)).tolist():
            self.known[words[i]] = np.array(self.model._latin_word(words[i]), "<u2").tobytes()
        rest = np.flatnonzero(~odd & (n <= self.LONGEST))
        if not len(rest):
            return
        rest = rest[np.argsort(-n[rest], kind="stable")]
        first, n = first[rest], n[rest]
        ends = 1 if self.model.suffix else 0
        width = int(n[0]) + ends
        token_at = np.full((len(rest), width), -1, dtype=np.int32)
        state = np.zeros(len(rest), dtype=np.int32)
        for i in range(width):
            live = int(np.searchsorted(-(n + ends), -(i + 1), side="right"))  # the longest words stand first
            c = np.where(n[:live] > i, flat[np.minimum(first[:live] + i, len(flat) - 1)], self.column[256])
            state[:live] = self.table[state[:live], c]
            token = self.token_of[state[:live]]
            todo = np.flatnonzero(token >= 0)
            while len(todo):
                t = token[todo]
                start = i + 1 - self.size[t]
                before = token_at[todo, np.maximum(start - 1, 0)]
                done = start == 0
                test = np.flatnonzero(~done & (before >= 0))
                done[test] = self.compatible(before[test].astype(np.int64) << 16 | t[test])
                token_at[todo[done], i] = t[done]
                todo = todo[~done]
                token[todo] = self.shorter[token[todo]]
                todo = todo[token[todo] >= 0]
        at, rows, steps = n + ends - 1, np.arange(len(rest)), []
        while len(rows):
            t = token_at[rows, at[rows]]
            if (t < 0).any():
                raise ValueError(f"no encoding for {words[rest[rows[t < 0][0]]]!r}")
            steps.append((rows, t))
            at[rows] -= self.size[t]
            rows = rows[at[rows] >= 0]
        count = np.zeros(len(rest), dtype=np.int64)
        for rows, _ in steps:
            count[rows] += 1
        offset = np.cumsum(count)
        ids = np.zeros(int(offset[-1]), dtype="<u2")
        for k, (rows, t) in enumerate(steps):
            ids[offset[rows] - 1 - k] = t
        blob, end = ids.tobytes(), (2 * offset).tolist()
        self.known.update(zip((words[i] for i in rest.tolist()), (blob[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = LATIN_WORD.findall((BREAK.join(texts) + BREAK).lower())
        if len(self.known) > self.MOST:
            self.known.clear()
        self.known[BREAK] = b"\xff\xff"
        missing = set(words).difference(self.known)
        if missing:
            self.learn(list(missing))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u2")
        ends = np.flatnonzero(ids == 0xFFFF).tolist()
        return [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]


#: Stands between texts that are worked on together; Latin texts hold no control characters.
BREAK = "\x01"
#: Characters that normalisation leaves as they are but for lower case: visible ASCII, Latin-1 and Latin Extended-A letters.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
LATIN_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|\x01|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^\x01a-z0-9\t-\r \u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
#: The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(VISIBLE))}

#: str.split() also splits at these, which the tokenizer's pattern may not take as white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
PLAIN_SPACE = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def split_space(text: str) -> list[str]:
    return PLAIN_SPACE.findall(text) if ODD_SPACE.search(text) else text.split()


def ids_bytes(ids) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()
