"""Words of texts as several operators take them."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from sitelens.llm.common import mix64

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
#: Values of the bytes at the first places of a word, of their lower case; those of later places are computed when met.
_NEAR = 64


def _value(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A pseudo-random value for each byte (in lower case) at its place in a word."""
    return mix64(mix64(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + byte.astype(np.uint64))


_TABLE = _value(np.tile(_LOWER, _NEAR), np.repeat(np.arange(_NEAR), 256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; bytes.lower() leaves other letters alone."""
    return WORD.findall(text.encode().lower()) if text else []


def hashed_words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """A 64-bit hash of each of the words of all texts, in order, the number of words of each text, and a 128-bit digest of its
    words in order (null without words). A word's hash is the sum of a pseudo-random value for each byte at its place, mixed."""
    raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    inside = _IN_WORD[buf]
    begins, after = inside.copy(), ~inside
    begins[1:] &= ~inside[:-1]
    after[1:] &= inside[:-1]
    after[0] = False
    ends = np.cumsum(size)
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    if not len(at):
        return np.zeros(0, np.uint64), counts, [None] * len(raw)
    kept = buf[inside]
    first = np.flatnonzero(begins[inside])
    length = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, length)
    if length.max() <= _NEAR:
        value = _TABLE[place * 256 + kept]
    else:
        value = _TABLE[np.minimum(place, _NEAR - 1) * 256 + kept]
        far = np.flatnonzero(place >= _NEAR)
        value[far] = _value(_LOWER[kept[far]], place[far])
    # words in lower case, each with one blank after it
    used = inside | after
    plain = np.where(inside, _LOWER[buf], np.uint8(32))[used].tobytes()
    cut = np.concatenate([[0], np.cumsum(used)[ends - 1]]).tolist()
    digests = [hashlib.blake2b(plain[x:y], digest_size=16).digest() if y > x else None for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64)), counts, digests
