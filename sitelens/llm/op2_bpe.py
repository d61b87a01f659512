"""Operator 2: BPE encoding and decoding of whole texts (see bpe.py for the method).

Null and empty texts give no ids and an empty decoded text. Every row gives one row, repeated rows and null doc_ids
included; columns other than doc_id and text are not read. One pass over the input, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.bpe import BpeModel
from sitelens.llm.common import id_text, map_batches, read_table, worker_cache

TOKENIZER = "word_bpe_49k.json"


def model(path: str) -> BpeModel:
    return worker_cache(f"bpe:{path}", lambda: BpeModel(path))


def slices(texts: pa.Array, rows: int = 500) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids ARRAY<INT>: the exact ids of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        ids = [x.tolist() for part in slices(batch.column(1)) for x in m.encode_batch(part)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(id_text(docs), run, "doc_id long, ids array<int>", "bpe:")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; a null list of ids gives an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        texts = [m.decode(x or ()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string", "bpe:")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode the ids, and keep counts and digests of both; the ids themselves don't leave the worker."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        n, ids_sha, text_sha = [], [], []
        for part in slices(batch.column(1)):
            for ids in m.encode_batch(part):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(m.decode(ids.tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe:")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
