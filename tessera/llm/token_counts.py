"""Token counts: prefix dynamic programming over a byte-level BPE.

For every prefix of a word the table keeps the token count and the last token. The last token
of a prefix ending at byte j is the one token t = word[i:j] that may follow the last token of
the prefix ending at i: merging the two tokens' bytes from scratch gives the same two tokens.
So count[j] = count[i] + 1 is exact, and each prefix is answered without encoding it. A text's
counts are those of its words, each on top of all words before it; distinct words are worked
out once per worker."""

from __future__ import annotations

import functools
import re
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.bpe import SPACE, BatchEncoder, WordTable, byte_form, tokenizer_path
from tessera.llm.common import RangeHash, arrow_limits, slices, utf8


class PrefixCounter(BatchEncoder):
    """Exact token counts at every byte of texts (at bytes inside a character: of the bytes so far)."""

    def __init__(self, path: str):
        super().__init__(path)
        self.vocab = self.tokenizer.get_vocab()
        #: the longest token that ends in three given bytes
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            self.longest[t[-3:]] = max(self.longest.get(t[-3:], 2), len(t))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.begun: dict[str, tuple[list[int], list[str]]] = {}
        self.table = WordTable(lambda w: np.array(self.word_counts(w), np.uint32), np.uint32)

    def may_follow(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= 1 << 20:
                self.pairs.clear()
            ok = self.pairs[a, b] = [t.value for t in self.tokenizer.model.tokenize(a + b)] == [a, b]
        return ok

    def word_counts(self, word: str) -> list[int]:
        """count after 1, 2, ... bytes of one word."""
        return list(self.prefixes(byte_form(word))[0][1:])

    def prefixes(self, w: str) -> tuple[list[int], list[str]]:
        """count and last token of every prefix of w; short beginnings that words share are kept."""
        step = (min(len(w), 10) - 1) // 3 * 3
        if step <= 0:
            count, last = [0], [""]
        elif (known := self.begun.get(w[:step])) is None:
            if len(self.begun) >= 200_000:
                self.begun.clear()
            known = self.begun[w[:step]] = self.prefixes(w[:step])
            count, last = known[0][:], known[1][:]
        else:
            count, last = known[0][:], known[1][:]
        vocab, pairs, longest = self.vocab, self.pairs, self.longest.get
        for j in range(len(count), len(w) + 1):
            for i in range(max(0, j - longest(w[max(0, j - 3) : j], 2)), j):
                t = w[i:j]
                if t in vocab:
                    if not i:
                        ok = self.is_token(t)
                    elif (ok := pairs.get((last[i], t))) is None:
                        ok = self.may_follow(last[i], t)
                    if ok:
                        count.append(count[i] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError(f"no token ends {w[:j]!r}")
        return count, last

    @functools.cache  # noqa: B019  at most one entry per vocabulary entry
    def is_token(self, t: str) -> bool:
        return len(self.tokenizer.model.tokenize(t)) == 1

    def plain(self, data: np.ndarray, bounds: np.ndarray, full: bool):
        """Counts of texts taken as without special strings: all prefixes' (full) or whole texts'."""
        text, codes, at, word = self.words(data, bounds)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        slot = self.table.slots(RangeHash(codes).of(at[:-1], at[1:]), lambda i: text[at[i] : at[i + 1]])
        whole = self.table.pool[self.table.slot_lo[slot] + self.table.slot_n[slot] - 1].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(whole)])
        totals = np.diff(before[word])
        if not full:
            return None, totals
        inner, ends = self.table.gather(slot)
        first = np.repeat(before[word[:-1]], np.diff(word))  # tokens of earlier texts
        counts = np.repeat(before[:-1] - first, np.diff(ends)) + inner
        # a cut right after white space that is followed by a word: the run counts as one piece
        kind = self.splitter._class[codes]
        here = np.flatnonzero(kind[at[:-1]] == SPACE)
        begins = set(word.tolist())
        for k in here.tolist():
            e = int(at[k + 1])
            if k + 1 in begins or e >= len(codes) or kind[e] != SPACE or codes[e] == 32 and e + 1 >= len(codes):
                continue
            run = text[at[k] : e + 1]  # all of the run, its last character starts or is the next piece
            if kind[e] == SPACE and (e + 1 == len(codes) or kind[e + 1] != SPACE):
                one = self.word_counts(run)
                width = len(text[e].encode())
                base = before[k] - before[word[np.searchsorted(word, k, "right") - 1]]
                counts[ends[k + 1] : ends[k + 1] + width] = base + np.array(one[-width:])
        return counts, totals

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text's first 0, 1, ... bytes, special strings counting as the library takes them."""
        # leftmost first, of several at one place the longest
        cut = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        out, base = [np.zeros(1, np.int64)], 0
        parts = re.split(f"({cut})", text) if cut else [text]
        for part, special in itertools.zip_longest(parts[::2], parts[1::2], fillvalue=""):
            more = bool(special)
            raw = np.frombuffer((part + special[:-1]).encode(), np.uint8)
            got, _ = self.plain(raw, np.array([0, len(raw)]), True)
            out.append(base + got)
            if more:
                n = len(part.encode())
                base += (int(got[n - 1]) if n else 0) + 1
                out.append(np.array([base]))
        return np.concatenate(out)


@functools.cache
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack_counts(counts: np.ndarray) -> bytes:
    """counts at every prefix as compressed differences."""
    return zlib.compress(np.diff(counts).astype("<i2").tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(blob), "<i2").astype(np.int64))])


def cut_to_budget(text: str, counts: np.ndarray, budget: int) -> str:
    """The longest prefix of whole characters with at most ``budget`` tokens; from stored counts alone."""
    raw = text.encode()
    ends = np.flatnonzero(np.concatenate([(np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, [True]]))
    fit = ends[counts[ends] <= budget]
    return raw[: int(fit[-1])].decode()


def token_counts(docs: DataFrame, tokenizer: str | None = None, budget: int = 1024, table: bool = False) -> DataFrame:
    """Exact token counts of whole texts, and with ``table`` those of every prefix.

    Returns a row per row of ``docs`` (doc_id, text; other columns are left out): doc_id,
    n_bytes, n_tokens, over_limit (n_tokens > ``budget``) and with ``table`` prefix_counts
    (see ``unpack_counts``, ``cut_to_budget``). Special strings inside texts count as the
    library takes them by default. A null or empty text has 0 of either; repeated rows
    repeat; an empty table gives no row."""
    path = tokenizer or tokenizer_path()
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            totals, tables = [], []
            for lo, hi in slices(batch, bounds, 1 << 19):
                part, at = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                whole = part.tobytes()
                odd = any(s.encode() in whole for s in counter.special)
                n = None if odd or table else counter.plain(part, at, False)[1]
                if n is None:
                    each = [counter.counts(whole[a:b].decode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    n = np.array([c[-1] for c in each])
                    tables += [pack_counts(c) for c in each] if table else []
                totals.append(n)
            n = np.concatenate(totals) if totals else np.zeros(0, np.int64)
            out = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64()), pa.array(n > budget)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if table:
                out, names = [*out, pa.array(tables, pa.binary())], [*names, "prefix_counts"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_counts binary" * table
    return docs.select("doc_id", "text").mapInArrow(run, schema)

