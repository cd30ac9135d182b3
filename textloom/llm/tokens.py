"""Byte-level BPE token ids as Spark columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import bytes_of, slices

BYTE_BPE = "byte_bpe_50k.json"


def byte_symbols() -> dict[str, int]:
    """Printable symbol of every byte, as byte-level vocabularies write it.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file, for the faster of the installed libraries.

    Ids are those of the file; strings of its special tokens become their ids.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    for name in special:
        ranks.pop(name.encode(), None)
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: Column, path: str | None = None, end_id: int | None = None) -> Column:
    """Ids of the whole text as array<int>, with ``end_id`` appended; null counts as empty."""
    path = path or public_tokenizers.path(BYTE_BPE)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = byte_bpe(path)
        tail = np.array([] if end_id is None else [end_id], np.int32)
        for batch in slices(batches):
            ids = []
            for text in batch:
                ids += [bpe.encode_to_numpy(text.as_py().decode("utf-8", "replace"), allowed_special="all"), tail]
            sizes = [len(ids[i]) + len(tail) for i in range(0, len(ids), 2)]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return encode.asNondeterministic()(bytes_of(text))
