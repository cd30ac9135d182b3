"""Vector bin packing of training examples: limits on tokens, segments and loss-bearing tokens at once.

An example is a prompt, whose tokens bear no loss, and a response, whose tokens do. Every task packs
the examples of its partition in constant memory: a bounded pool holds examples, and one sequence at
a time is filled from it by the dot-product heuristic, which takes the example whose demands, as
shares of the limits, have the largest product with what the sequence has left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm.word_tokens import word_bpe

WORD_BPE = "word_bpe_49k.json"
POOL_EXAMPLES = 1024
POOL_TOKENS = 1 << 19
# Sequence ids: task in the upper bits, the number of the sequence in its task in the lower ones.
_TASK_BITS = 36
_OWN = ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids")


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


class VectorPacker:
    """Fills sequences from a pool; ``placed`` gets (example, start, length, sequence, offset).

    With ``cut``, a sequence that no whole example fits into is filled by the beginning of one, the
    rest of which stays in the pool; and a sequence that still ends short becomes several, of the
    powers of two that its length is the sum of, so that none needs padding. Without ``cut`` only an
    example that no empty sequence could hold is cut.
    """

    def __init__(self, limits: Limits, placed: Callable[[object, int, int, int, int], None], *, cut: bool = True):
        self.limits, self.placed, self.cut = limits, placed, cut
        self.tokens, self.loss = np.zeros(POOL_EXAMPLES, np.int64), np.zeros(POOL_EXAMPLES, np.int64)
        self.what: list = [None] * POOL_EXAMPLES  # (example, tokens placed so far, first token with loss)
        self.free = list(range(POOL_EXAMPLES))[::-1]
        self.held = self.n_sequences = 0

    def add(self, example: object, length: int, loss_from: int = 0) -> None:
        """An example of ``length`` tokens, the loss-bearing ones from ``loss_from`` on."""
        if length < 1:
            return
        slot = self.free.pop()
        self.what[slot] = (example, 0, loss_from)
        self._measure(slot, 0, length, loss_from)
        self.held += length
        while not self.free or self.held > POOL_TOKENS:
            self._fill()

    def finish(self) -> None:
        while self.held:
            self._fill()

    def _measure(self, slot: int, start: int, end: int, loss_from: int) -> None:
        self.tokens[slot] = end - start
        self.loss[slot] = max(0, end - max(start, loss_from))

    def _take(self, slot: int, length: int) -> tuple[object, int, int]:
        example, start, loss_from = self.what[slot]
        end = start + int(self.tokens[slot])
        self.held -= length
        if start + length == end:
            self.what[slot], self.tokens[slot], self.loss[slot] = None, 0, 0
            self.free.append(slot)
        else:
            self.what[slot] = (example, start + length, loss_from)
            self._measure(slot, start + length, end, loss_from)
        return example, start, length

    def _beginnings(self, tokens: int, loss: int) -> np.ndarray:
        """For every slot the most of its next tokens that room for ``tokens`` and ``loss`` takes."""
        return np.minimum(np.minimum(self.tokens, tokens), self.tokens - self.loss + loss)

    def _fill(self) -> None:
        limits, parts = self.limits, []
        tokens, loss = limits.tokens, limits.loss
        while tokens and len(parts) < limits.segments:
            fits = (self.tokens <= tokens) & (self.loss <= loss) & (self.tokens > 0)
            # Every example is one segment: that share is the same for all and decides nothing.
            score = self.tokens * (tokens / limits.tokens**2) + self.loss * (loss / limits.loss**2)
            score = np.where(fits, score, -1.0)
            slot = int(score.argmax())
            last = len(parts) + 1 == limits.segments
            if score[slot] >= 0 and not (last and self.cut and self.tokens[slot] < tokens):
                length = int(self.tokens[slot])
            elif self.cut or not parts:
                most = self._beginnings(tokens, loss)
                slot = int(most.argmax())
                length = int(most[slot])
            else:
                break
            if length < 1:
                break
            before = self.loss[slot]
            parts.append(self._take(slot, length))
            tokens -= length
            loss -= int(before - self.loss[slot])
        self._close(parts, limits.tokens - tokens)

    def _close(self, parts: list[tuple[object, int, int]], filled: int) -> None:
        whole = filled == self.limits.tokens or not self.cut
        room = filled if whole else 1 << (filled.bit_length() - 1)
        at, left = 0, filled
        for example, start, length in parts:
            while length:
                step = min(length, room - at)
                self.placed(example, start, step, self.n_sequences, at)
                start, length, at, left = start + step, length - step, at + step, left - step
                if at == room:
                    self.n_sequences, at = self.n_sequences + 1, 0
                    room = 1 << (left.bit_length() - 1) if left else 1


def _encoded(batch: pa.RecordBatch, encode: Callable, end_id: int | None) -> Iterator[tuple[np.ndarray, int]]:
    """(ids, first id with loss) of every row."""
    tail = np.array([] if end_id is None else [end_id], np.int32)
    for prompt, text in zip(batch.column("__prompt"), batch.column("__text"), strict=True):
        parts = [encode(x.as_py() or "") for x in (prompt, text)]
        yield np.concatenate([*parts, tail]).astype(np.int32, copy=False), len(parts[0])


def _rows(
    batches: Iterable[pa.RecordBatch], *, vocabulary: str | None, end_id: int | None, limits: Limits, cut: bool,
    with_ids: bool, schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    encode = word_bpe(vocabulary or public_tokenizers.path(WORD_BPE)).encode
    base = TaskContext.get().partitionId() << _TASK_BITS
    kept = [n for n in schema.names if n not in _OWN]
    out: list[tuple] = []

    def placed(example: tuple, start: int, length: int, sequence: int, offset: int) -> None:
        values, ids, loss_from = example
        part = ids[start : start + length]
        loss = max(0, start + length - max(start, loss_from))
        own = (start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), loss, base + sequence, offset)
        out.append((*values, *own, part) if with_ids else (*values, *own))

    packer = VectorPacker(limits, placed, cut=cut)

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for batch in batches:
        values = zip(*(batch.column(n).to_pylist() for n in kept), strict=True) if kept else iter([()] * len(batch))
        for row, (ids, loss_from) in zip(values, _encoded(batch, encode, end_id), strict=True):
            packer.add((row, ids, loss_from), len(ids), loss_from)
        yield flush()
    packer.finish()
    yield flush()


def pack_examples(
    examples: DataFrame, *, text_col: str = "text", prompt_col: str | None = None, vocabulary: str | None = None,
    end_id: int | None = None, limits: Limits | None = None, cut: bool = True, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of every example, with its place in a packed sequence.

    The ids of an example are those of its prompt and its text by the tokeniser file ``vocabulary``,
    then ``end_id``; those of the prompt bear no loss. Columns: the other ones of ``examples``, then
    ``start`` (ids of the example before the piece), ``length``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens`` (ids of the whole example),
    ``loss_tokens``, ``sequence_id``, ``offset`` (long) and, if asked for, ``ids``; columns of these
    names are replaced. Every id lies in exactly one piece; the pieces of a sequence lie side by side
    from offset 0 and keep all ``limits``; see ``VectorPacker`` for ``cut``.

    No row leaves its task. A null prompt or text counts as empty; an example without any id has no
    piece; a very long text fills as many sequences as it needs; repeated rows are packed each on
    their own; an empty table stays empty.
    """
    limits = limits or Limits()
    gone = {*_OWN, text_col, prompt_col}
    kept = [c for c in examples.columns if c not in gone]
    prompt = F.coalesce(F.col(prompt_col), F.lit("")) if prompt_col else F.lit("")
    rows = examples.select(*kept, prompt.alias("__prompt"), F.coalesce(text_col, F.lit("")).alias("__text"))
    own = [T.StructField(n, T.ArrayType(T.IntegerType()) if n == "ids" else T.LongType()) for n in _OWN]
    schema = T.StructType([rows.schema[c] for c in kept] + (own if with_ids else own[:-1]))
    run = partial(
        _rows, vocabulary=vocabulary, end_id=end_id, limits=limits, cut=cut, with_ids=with_ids,
        schema=to_arrow_schema(schema),
    )
    return rows.mapInArrow(run, schema)


def padding(pieces: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row: sequences, tokens and padding (long), when sequences are padded to the limit, but for
    those whose length is a power of two. No pieces: zeros."""
    limit = (limits or Limits()).tokens
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return lengths.agg(
        F.count("*").alias("n_sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(exact, 0).otherwise(limit - F.col("n"))), F.lit(0)).alias("n_padding"),
    )
