"""Inputs that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label long, id long, score double, bucket int, rank int"


def rows(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, None, None, None, "k", 1, 2, 0.5, 3, 4) for i, t in zip(ids, texts, strict=True)]


def frame(spark, texts, ids=None):
    return spark.createDataFrame(rows(texts, ids), SCHEMA)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(words))


LONG = prose(1, 60_000)
ODD = [None, "", " ", "\n\n", "a", "é", "日本語 テキスト", "<|endoftext|>", "a<|startoftext|>b  c", "\x01\x00\x02", "don't WON'T", "x" * 5000, "a b " * 3000, LONG, "word " * 40 + "\n" + "word " * 40, "ΣΑΣ İ ﬁ ½ Ⅷ ²", "🙂🙃" * 20, "\x85\x1c\xa0 z"]
