"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie on every machine, if the session's `repeatloom.tokenizers` names no other folder,
#: and the one used by default.
VOCABULARIES, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer splits a text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "tokens"])

    return count


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` and `tokens`, the number of tokens of the whole text (0 for a null or empty text). No shuffle."""
    vocabulary = vocabulary or f"{df.sparkSession.conf.get('repeatloom.tokenizers', VOCABULARIES)}/{VOCABULARY}"
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint"
    return df.select(*keep, text).mapInArrow(_counter(vocabulary), schema)
