"""Operator 10, token counts by the whole-token shortcut."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_text, ship
from .tokens import encoder, prove_whole, slices, vocabulary_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per input row.

    Vocabulary strings proven offline to encode alone as one token are counted directly; other
    pre-tokens are merged. Null or empty text: 0 bytes, 0 tokens. Null doc_id: kept. Repeated rows:
    one result each. Empty table: no rows. Other columns are dropped. The whole text counts.
    """
    ship(docs.sparkSession)
    text = vocabulary_text(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((zlib.crc32(text.encode()), text, prove_whole(text)))

    def count(batches):
        enc = None
        for batch in batches:
            enc = enc or encoder(*shared.value)
            texts = batch.column("text").to_pylist()
            tokens: list[int] = []
            for lo, hi in slices(texts):
                tokens += [len(b) // 4 for b in enc.encode(texts[lo:hi])]
            sizes = pa.compute.binary_length(batch.column("text").cast(pa.binary())).cast(pa.int64())
            counted = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, counted, pa.compute.greater(counted, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401  so that pa.compute is there on the workers' copy of this module

    return keyed_text(docs).mapInArrow(count, SCHEMA)
