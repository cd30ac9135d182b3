"""BPE as a deterministic automaton over tokens.

The automaton starts with one arc per base symbol. The gadget of a merge ``a b -> c``, applied in
order of rank, changes it in three ways: the state behind ``a`` loses its ``b`` arc; every state
that still has an ``a`` arc gains a ``c`` arc; and ``c`` leads to a copy of the state behind ``b``.
What remains accepts exactly the token sequences that BPE produces. The state behind a token depends
on that token alone, so states are named by tokens.

The arcs of all states together would fill some billion cells for a common vocabulary. An arc is
therefore compiled when it is first asked for, by replaying the gadgets that touch it from the last
one back, and kept in the transition table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import slices
from textloom.llm.tokens import byte_symbols

# White_Space code points; str.split() and \s also take the separators U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNKS = regex.compile(f"[^{_SPACE}]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
CACHED_WORDS = 100_000
CACHED_ARCS = 500_000
# Stands for the end-of-word suffix within words.
END = "\0"


class MergeAutomaton:
    """Token automaton of an ordered list of merges over a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_of_word: str = ""):
        self.end = END if end_of_word else ""
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: (rank of its merge, left, right)
        for rank, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merge_rank.setdefault((a, b), rank)
            self.parts.setdefault(c, (rank, a, b))
        self.arcs: dict[int, bool] = {}
        # Finds every token that occurs in a word, by end.
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = [0] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            whole = token.removesuffix(end_of_word) + self.end if end_of_word and token.endswith(end_of_word) else token
            self.matches.add_word(whole, i)
            self.length[i] = len(whole)
        if vocab:
            self.matches.make_automaton()

    def _compile_arc(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` ends up with an arc for ``token``."""
        return self.meet(state, token, len(self.merge_rank))

    def meet(self, state: int, token: int, before: int) -> bool:
        """Whether ``token`` can follow ``state`` once the gadgets of a rank below ``before`` are applied."""
        base = (-1, 0, 0)
        while True:
            removed = self.merge_rank.get((state, token), before)
            if removed < before:
                return False
            of_state, of_token = self.parts.get(state, base), self.parts.get(token, base)
            if of_state[0] < 0 and of_token[0] < 0:
                return True
            if of_state[0] > of_token[0]:
                # The state was copied from the one behind its right part, as it was then.
                before, state = of_state[0], of_state[2]
            else:
                # The arc came with the one for its left part, if that outlived the same gadget.
                before, token = of_token[0] + 1, of_token[1]

    def arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._compile_arc(state, token)
        return found

    def encode(self, word: str) -> list[int]:
        """Labels of the one path through the automaton that spells ``word``.

        Every beginning of the word has one path at most, so the state behind each is found from left
        to right, by the transition table. Symbols outside of the vocabulary are left out, as if they
        were not there.
        """
        if not word:
            return []
        text = word + self.end
        size, length, arcs = len(text), self.length, self.arcs
        state = [-1] * (size + 1)
        for last, token in self.matches.iter(text):
            end = last + 1
            if state[end] >= 0:
                continue
            if start := end - length[token]:
                here = state[start]
                if here < 0:
                    continue
                allowed = arcs.get(here << 32 | token)
                if not (self.arc(here, token) if allowed is None else allowed):
                    continue
            state[end] = token
        if state[size] < 0:
            known = [c for c in word[:-1] if c in self.matches]
            known += [c for c in word[-1:] if c + self.end in self.matches]
            return self.encode("".join(known)) if len(known) < len(word) else []
        path = []
        while size:
            path.append(state[size])
            size -= length[path[-1]]
        return path[::-1]


class WordTokenizer:
    """Encoder of a tokenizers JSON file with this normal form: NFC, white space runs to a
    space, lower case; words by a pattern; byte symbols; BPE; no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"].get("pretokenizers", [{}])[0]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or "pattern" not in split:
            raise ValueError(f"{path} is not a lower-casing word BPE")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.special = {x["content"]: np.int32(x["id"]).tobytes() for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbol = {b: c for c, b in byte_symbols().items()}
        # Ids by word and by chunk between spaces. A full cache becomes the old one, from which what
        # is still in use comes back.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHED_WORDS:
                self.words, self.old_words = {}, self.words
            found = self.old_words.get(word)
            if found is None:
                ids = self.automaton.encode("".join(map(self.symbol.__getitem__, word.encode())))
                found = pack(f"{len(ids)}i", *ids)
            self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if len(self.chunks) >= CACHED_WORDS:
            self.chunks, self.old_chunks = {}, self.chunks
        found = self.old_chunks.get(chunk)
        if found is None:
            if chunk.isascii():
                lower = chunk.lower()
            else:  # lower case goes by code point: no final sigma
                lower = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            found = b"".join(map(self._word, self.pattern.findall(lower)))
        self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        segments = self.specials.split(text) if self.specials and "<" in text else [text]
        for i, segment in enumerate(segments):
            if i % 2:
                parts.append(self.special[segment])
                continue
            chunks = segment.split() if not _SEPARATORS.search(segment) else _CHUNKS.findall(segment)
            for chunk in chunks:
                ids = self.chunks.get(chunk)
                parts.append(self._chunk(chunk) if ids is None else ids)
        return np.frombuffer(b"".join(parts), np.int32)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def labels(path: str) -> pa.Array:
    """Arc label of every id of a tokenizers JSON file; null where there is none."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())


def emit(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """Labels of every list of ids, joined by a space; unknown ids emit nothing."""
    values, ends = ids.values[ids.offsets[0].as_py() : ids.offsets[-1].as_py()], ids.offsets.to_numpy()
    numbers = pc.fill_null(values, -1).to_numpy(zero_copy_only=False)
    known = (numbers >= 0) & (numbers < len(names))
    known[known] = names.is_valid().to_numpy(zero_copy_only=False)[numbers[known]]
    ends = np.concatenate([[0], np.cumsum(known)])[ends - ends[0]]
    words = names.take(pa.array(numbers[known]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words), " ")


def encode(text: Column, path: str) -> Column:
    """Ids of the whole text, array<int>; a null or empty text has none. Strings of the file's added
    tokens are these tokens; nothing is added, cut or padded."""

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = tokenizer(path)
        for batch in slices(batches):
            ids = [machine.encode(x.as_py()) for x in batch]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))

    return compute.asNondeterministic()(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Text of an id array: the arc labels joined by a space, as a file without decoder has it.
    A null or empty array gives the empty text; ids outside of the vocabulary are skipped."""

    @arrow_udf(T.StringType())
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = labels(path)
        for batch in slices(batches):
            yield emit(batch, names)

    return compute.asNondeterministic()(F.coalesce(ids, F.array().cast("array<int>")))
