"""Byte-level BPE on workers: token ids by ranks, token counts by a two-tier table of pre-tokens.

Byte-level BPE never merges across pre-tokens, so the tokens of a text are those of its pre-tokens
in order. Where splitting could differ from the tokenizer's own library - special strings inside a
text, characters that the two sort differently - that library takes the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Pre-tokens of byte-level vocabularies: words, contractions, numbers, other signs, spaces. Python's classes differ
# from the library's in some characters; these are found by comparison, and a text with any takes the plain path.
PRE_TOKEN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ASCII_PRE_TOKEN = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

RANKED_PRE_TOKEN = r" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"

#: Blocks whose characters are compared one by one; all others take the plain path.
COMPARED = (range(0, 0xD800), range(0xE000, 0x10000), range(0x1F000, 0x1FB00))


@dataclass(frozen=True)
class Frequent:
    """What is sent to the workers: the tokenizer's file, the frequent table and character checks."""

    vocabulary: str  # the tokenizer as JSON
    lengths: dict[str, int]  # token counts of the frequent pre-tokens, at most as many as the vocabulary has entries
    added: tuple[str, ...]  # special strings, each one id
    plain: str  # class of characters on which pattern and library agree; empty: never split


def _bytes_of() -> dict[str, bytes]:
    """The byte of each character in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): bytes([b]) for b in kept} | {chr(256 + n): bytes([b]) for n, b in enumerate(rest)}


def ranked(model: dict) -> tiktoken.Encoding | None:
    """The same vocabulary as ranks, if its ids follow the order of its merges; else None."""
    vocabulary, byte_of = model["vocab"], _bytes_of()
    ids = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:])) or any(c not in byte_of for word in vocabulary for c in word):
        return None
    ranks = {b"".join(map(byte_of.get, word)): n for word, n in vocabulary.items()}
    return tiktoken.Encoding("ranks", pat_str=RANKED_PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def _agreed(tokenizer: Tokenizer, ranks: tiktoken.Encoding) -> str:
    """Regex class of the characters that the library, the pattern and the ranks sort alike."""
    split, runs = tokenizer.pre_tokenizer.pre_tokenize_str, []
    for block in COMPARED:
        for code in block:
            probe = f"a{chr(code)}1 {chr(code)}{chr(code)}!"
            parts = [probe[a:b] for _, (a, b) in split(probe)]
            if parts == PRE_TOKEN.findall(probe) and ranks.encode_ordinary(probe) == tokenizer.encode(probe, add_special_tokens=False).ids:
                if runs and runs[-1][1] == code - 1:
                    runs[-1][1] = code
                else:
                    runs.append([code, code])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=4)
def frequent(path: str) -> Frequent:
    """The tables for a tokenizer file.

    Merge ranks order a vocabulary by frequency, so its whole-word entries are the frequent
    pre-tokens; their number is at most that of the vocabulary, whatever the corpus. Files that
    aren't plain byte-level BPE get an empty table and are encoded text by text.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = file.read()
    parts = json.loads(vocabulary)
    tokenizer = Tokenizer.from_str(vocabulary)
    added = tuple(x["content"] for x in parts["added_tokens"])
    before = parts["pre_tokenizer"] or {}
    simple = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in parts["added_tokens"])
    if parts["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not simple:
        return Frequent(vocabulary, {}, added, "")
    ranks = ranked(parts["model"])
    if ranks is None:
        return Frequent(vocabulary, {}, added, "")
    byte_of, words, plain = _bytes_of(), [], _agreed(tokenizer, ranks)
    strange = re.compile(f"[^{plain}]")
    for entry in parts["model"]["vocab"]:
        try:
            word = b"".join(map(byte_of.get, entry)).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not strange.search(word) and PRE_TOKEN.fullmatch(word):
            words.append(word)
    coded = tokenizer.encode_batch(words, add_special_tokens=False)
    return Frequent(vocabulary, {word: len(x.ids) for word, x in zip(words, coded)}, added, plain)


_WORKER: dict[type, tuple] = {}


class Worker:
    """The tokenizer of a worker process."""

    def __init__(self, tables: Frequent):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        self.tokenizer = Tokenizer.from_str(tables.vocabulary)
        self.added = re.compile("|".join(map(re.escape, sorted(tables.added, key=len, reverse=True)))) if tables.added else None
        self.strange = re.compile(f"[^{tables.plain}]") if tables.plain else None

    @classmethod
    def of(cls, tables: Frequent) -> Worker:
        """The process's own, with which the next tasks go on."""
        if _WORKER.get(cls, (None,))[0] != tables.vocabulary:
            _WORKER[cls] = (tables.vocabulary, cls(tables))
        return _WORKER[cls][1]

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def splits(self, text: str) -> bool:
        """Whether a text can be split without the library."""
        return self.strange is not None and not (self.added and self.added.search(text)) and (text.isascii() or not self.strange.search(text))


class Encoder(Worker):
    """Token ids: by ranks, or by the library where splitting could differ."""

    def __init__(self, tables: Frequent):
        super().__init__(tables)
        self.ranks = ranked(json.loads(tables.vocabulary)["model"]) if self.strange else None

    def ids(self, text: str) -> np.ndarray:
        found = None
        if self.splits(text):
            try:
                found = self.ranks.encode_ordinary(text)
            except BaseException as failed:  # very long runs of spaces exhaust the pattern's stack
                if type(failed).__name__ != "PanicException":
                    raise
        return np.array(array("I", self.library(text) if found is None else found), "<u4")


class Counter(Worker):
    """Token counts by two tiers in one table: the frequent pre-tokens, and what this worker has met beyond them.

    When the second tier holds over `held` characters, it starts anew.
    """

    def __init__(self, tables: Frequent, held: int = 5_000_000):
        super().__init__(tables)
        self.frequent, self.held = tables.lengths, held
        self._forget()

    def _forget(self) -> None:
        self.table, self.size = dict(self.frequent), 0

    def _learn(self, words: set[str]) -> None:
        """Encodes new pre-tokens. Those of a space and letters go in one string, which falls apart again."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        joined = "".join(plain)
        if plain and PRE_TOKEN.findall(joined) == plain:
            counts = np.bincount(self.tokenizer.encode(joined, add_special_tokens=False).word_ids)
            if len(counts) == len(plain):
                self.table.update(zip(plain, counts.tolist()))
                words = words.difference(plain)
        rest = list(words)
        self.table.update((w, len(x.ids)) for w, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))

    def count(self, text: str) -> int:
        if not self.splits(text):
            return len(self.library(text))
        words = (ASCII_PRE_TOKEN if text.isascii() else PRE_TOKEN).findall(text)
        lengths = list(map(self.table.get, words))
        if None in lengths:
            unknown = {w for w, n in zip(words, lengths) if n is None}
            self.size += sum(map(len, unknown))
            if self.size > self.held:
                self._forget()
                unknown = set(words).difference(self.table)
            self._learn(unknown)
            lengths = map(self.table.__getitem__, words)
        return sum(lengths)
