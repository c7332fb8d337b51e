"""Exact byte-level BPE over whole batches: split with numpy, merge each distinct word once.

A byte-level tokenizer first splits text into words and then merges inside each word, so the
ids of a text are those of its words on end. Words repeat: a table keeps each distinct word's
result, and the tokenizer's own model is asked only for words not seen before. Character
classes come from the tokenizer's own splitter, so both agree on every code point."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.common import RangeHash

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class Splitter:
    """The word split of the byte-level pre-tokenizer, for a batch of texts at once."""

    def __init__(self, tokenizer: Tokenizer):
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._class = np.zeros(0x110000, np.uint8)

    def _learn(self, codes: np.ndarray) -> None:
        for c in np.unique(codes).tolist():
            joins = (k for k, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self._split(lead + chr(c))) == 1)
            self._class[c] = next(joins, SPACE)

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start. codes: code points of all texts on end; first: where texts start."""
        n = len(codes)
        kind = self._class[codes]
        if not kind.all():
            self._learn(codes[kind == 0])
            kind = self._class[codes]
        begin = np.zeros(n + 1, bool)
        begin[first] = True  # texts of no characters share the place of the next one
        edge = begin.copy()
        begin[0] = begin[n] = edge[n] = True
        begin[1:n] |= kind[1:] != kind[:-1]
        # the last white space before a word: alone, or joined to the word if it is a plain space
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
        begin[last] = True
        begin[last[codes[last] == 32] + 1] = False
        # contractions
        at = np.flatnonzero((codes[:-1] == 39) & begin[: n - 1] & (kind[1:] == LETTER) & ~edge[1:n])
        if len(at):
            one = codes[at + 1]
            two = np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], codes[np.minimum(at + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            begin[at[short | long] + 1] = False
            begin[at[short] + 2] = True
            begin[at[long] + 3] = True
            begin[at[long] + 2] = False
        return np.flatnonzero(begin[:n])


class WordTable:
    """An open-addressing table from word hashes to arrays, in numpy, with batched look-ups.

    value: gives the array of a word not yet known. Beyond ``room`` words the table starts
    anew, so its memory is bounded; results don't depend on what it holds."""

    def __init__(self, value: Callable[[str], np.ndarray], dtype, bits: int = 20, room: float = 0.6):
        self.value, self.dtype, self.bits, self.most = value, dtype, bits, int(room * (1 << bits))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot_lo, self.slot_n = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 16, self.dtype), 0, 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's slot, or the free slot where it would go; and whether it is there."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (hashes & mask).astype(np.int64)
        kept = self.keys[slot]
        there = kept == hashes
        open_ = np.flatnonzero(~there & (kept != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            kept = self.keys[slot[open_]]
            there[open_] = kept == hashes[open_]
            open_ = open_[(kept != hashes[open_]) & (kept != 0)]
        return slot, there

    def slots(self, hashes: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """The slots of all hashes; word(i) is the text of the i-th."""
        slot, there = self._find(hashes)
        if there.all():
            return slot
        new, where = np.unique(hashes[~there], return_index=True)
        where = np.flatnonzero(~there)[where]
        if self.count + len(new) > self.most:
            self.clear()
            new, where = np.unique(hashes, return_index=True)
            while len(new) > self.most:
                self.bits += 1
                self.most *= 2
                self.clear()
        keys, mask = self.keys, (1 << self.bits) - 1
        for h, i in zip(new.tolist(), where.tolist(), strict=True):
            s = h & mask
            while keys[s]:
                s = (s + 1) & mask
            got = self.value(word(i))
            if self.used + len(got) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(got)), self.dtype)])
            self.pool[self.used : self.used + len(got)] = got
            keys[s], self.slot_lo[s], self.slot_n[s] = h, self.used, len(got)
            self.used += len(got)
        self.count += len(new)
        return self._find(hashes)[0]

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the slots on end, and the n + 1 bounds."""
        n = self.slot_n[slot].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.slot_lo[slot] - ends[:-1], n) + np.arange(ends[-1])
        return self.pool[at], ends


def _printable_bytes() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTE_CHARS = _printable_bytes()
_TRANSLATE = str.maketrans({chr(b): c for b, c in enumerate(BYTE_CHARS)})


def byte_form(word: str) -> str:
    return word.encode().decode("latin-1").translate(_TRANSLATE)


class BatchEncoder:
    """Token ids of a batch of texts, as the tokenizer gives them without added special tokens."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.splitter = Splitter(self.tokenizer)
        self.table = WordTable(self.word_ids, np.uint32)
        #: strings that the library takes out of the text before it splits words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def word_ids(self, word: str) -> np.ndarray:
        return np.array([t.id for t in self.tokenizer.model.tokenize(byte_form(word))], np.uint32)

    def words(self, data: np.ndarray, bounds: np.ndarray):
        """text, code point bounds of the words, index of each text's first word."""
        text = data.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(codes) == len(data):
            first = bounds
        else:
            first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        if not len(codes):
            return text, codes, np.zeros(1, np.int64), np.zeros(len(bounds), np.int64)
        at = np.concatenate([self.splitter.starts(codes, first[:-1]), [len(codes)]])
        return text, codes, at, np.searchsorted(at, first)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts on end, and the n + 1 bounds. data, bounds: UTF-8 bytes as from ``utf8``."""
        text, codes, at, word = self.words(data, bounds)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        slot = self.table.slots(RangeHash(codes).of(at[:-1], at[1:]), lambda i: text[at[i] : at[i + 1]])
        ids, ends = self.table.gather(slot)
        ends = ends[word]
        odd = [i for i in range(len(bounds) - 1) if any(s in text[at[word[i]] : at[word[i + 1]]] for s in self.special)] if any(s in text for s in self.special) else []
        if odd:  # texts that hold a special string: the library itself
            parts = [ids[ends[i] : ends[i + 1]] for i in range(len(bounds) - 1)]
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(text[at[word[i]] : at[word[i + 1]]], add_special_tokens=False).ids, np.uint32)
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends


@functools.cache
def encoder(path: str) -> BatchEncoder:
    """One per worker process: its table serves all tasks that the worker runs."""
    return BatchEncoder(path)
