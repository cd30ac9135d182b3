"""Ids of a lower-casing word BPE, fast: a byte-pair encoder over words that carry an end mark."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import tiktoken

from textloom.llm.bpe_automaton import MergeAutomaton, tokenizer
from textloom.llm.tokens import byte_symbols

# White_Space within ASCII; the separators U+001C to U+001F are not part of it.
_ASCII_WORDS = r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
# Ends every word, in place of the end-of-word suffix: white space never is part of a word.
_MARK = "\n"


def ranks_suffice(automaton: MergeAutomaton) -> bool:
    """Whether joining neighbours by the rank of the joined token gives the result of the merges.

    That holds if no two tokens whose join is a token ever meet, by the time of its merge, but for
    the two that the merge names.
    """
    by_id = [automaton.parts[token][0] for token in sorted(automaton.parts)]
    if by_id != sorted(by_id):
        return False  # ids are not in the order of the merges
    spelled = {}
    stack = list(automaton.parts)
    # Spelling of every token by its parts, the parts before the whole.
    while stack:
        token = stack[-1]
        parts = automaton.parts.get(token)
        if parts is None:
            spelled[token] = (token,)
        elif parts[1] in spelled and parts[2] in spelled:
            spelled[token] = spelled[parts[1]] + spelled[parts[2]]
        else:
            stack += [x for x in parts[1:] if x not in spelled]
            continue
        stack.pop()
    by_spelling = {v: k for k, v in spelled.items()}
    for token, (rank, left, right) in automaton.parts.items():
        symbols = spelled[token]
        for cut in range(1, len(symbols)):
            a, b = by_spelling.get(symbols[:cut]), by_spelling.get(symbols[cut:])
            if a is None or b is None or (a, b) == (left, right):
                continue
            early = max(automaton.parts.get(x, (-1,))[0] for x in (a, b)) < rank
            if early and automaton.meet(a, b, rank):
                return False
    return True


class WordBpe:
    """Encoder of a tokenizers JSON file as ``bpe_automaton.WordTokenizer`` takes it; the same ids."""

    def __init__(self, path: str):
        self.machine = tokenizer(path)  # refuses files of another kind
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"]["end_of_word_suffix"] or ""
        symbols, special = byte_symbols(), {x["content"] for x in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix(suffix) if suffix and len(token) > len(suffix) else token
                ranks[bytes(symbols[c] for c in body) + (b"" if body == token else _MARK.encode())] = i
        marked = {bytes([b, 10]) for b in range(256)}
        self.plain = (
            bool(suffix)
            and max(ranks.get(x, len(ranks)) for x in marked) < 512
            and all(bytes([b]) in ranks for b in range(256))
            and ranks_suffice(self.machine.automaton)
        )
        if self.plain:
            self.bpe = tiktoken.Encoding(path, pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        # The pattern's own contractions come first, as in the file.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        generic = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.ascii_words = re.compile(pattern.replace(generic, "|" + _ASCII_WORDS)) if pattern.endswith(generic) else None
        self.words = self.machine.pattern

    def _segment(self, text: str) -> np.ndarray:
        if text.isascii() and self.ascii_words:
            words = self.ascii_words.findall(text.lower())
        else:  # lower case goes by code point: no final sigma
            words = self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if not words:
            return np.zeros(0, np.int32)
        words.append("")
        return self.bpe.encode_to_numpy(_MARK.join(words)).view(np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, int32."""
        if not self.plain:
            return self.machine.encode(text)
        specials = self.machine.specials
        if specials is None or "<" not in text:
            return self._segment(text)
        parts = []
        for i, segment in enumerate(specials.split(text)):
            parts.append(np.frombuffer(self.machine.special[segment], np.int32) if i % 2 else self._segment(segment))
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
