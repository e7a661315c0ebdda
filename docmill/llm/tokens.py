"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of a byte-level BPE stands, as ranks; a parameter of everything that sizes texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of a text that belongs to this vocabulary; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(vocabulary: str, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, once per process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("docmill", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sizes(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [None if t is None else len(encode(t)) for t in batch.column("text").to_pylist()]
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int32())], names=[c for c in batch.schema.names if c != "text"] + ["tokens"])

    return run


def token_sizes(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with ``text`` replaced by ``tokens``, its whole length in tokens; null for null."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.withColumn("text", F.col("text").cast("string")).mapInArrow(_sizes(vocabulary), ", ".join([*fields, "tokens int"]))
