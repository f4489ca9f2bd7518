"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array: symbol ids end to end plus
the sequence each belongs to.  In every round each sequence finds its
lowest-ranked adjacent pair and merges all its occurrences, left to right; all
sequences take their round at once.  A sequence without a known pair is done
and its surviving symbols are its token count.

Every merge of the vocabulary makes a token of its own, so a merge can only
enable pairs of a higher rank, and merging all occurrences of the lowest pair
at once gives the same tokens as merging one pair at a time.

Pre-tokens never cross white space, so counts are kept per white-space chunk.
The memo is bounded in entries and characters (``MEMO``, ``MEMO_CHARS``); it only saves work and never changes a count.

Results for odd input: null and empty texts have 0 bytes and 0 tokens; a null
``doc_id`` is kept; repeated rows are counted one by one; other columns are not
read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.text import small_batches

#: Chunks, and pre-tokens, whose counts a worker remembers, and their characters; beyond either the memo starts anew.
MEMO, MEMO_CHARS = 250_000, 8 << 20
#: Longer chunks and pre-tokens are counted anew each time: a memo of them would not be bounded.
MEMO_LONGEST = 256
#: Symbols that are merged in one array at most (one longer pre-token is an array of its own).
ROUND_SYMBOLS = 1 << 20
#: Characters of texts that are split and merged together (one longer text is a piece of its own).
PIECE_CHARS = 1 << 20

#: White space to ``str.split`` that is not white space to the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_symbols() -> dict[int, str]:
    """Byte -> printable character of the byte-level alphabet: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Counts BPE tokens from a tokenizer file in the ``tokenizers`` JSON format
    (byte-level alphabet, a word-end suffix, no unknown token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        symbol = _byte_symbols()
        self.inner = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbol[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(set(self.made.tolist())) != len(self.made):
            raise ValueError("two merges make the same token: rounds would not be exact")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.marks = tuple({t[:2] for t in added})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # fixed values: the file's own split pattern, with \s as the Unicode property
        self.pretoken = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.memo: dict[str, int] = {}  # of white-space chunks
        self.words: dict[str, int] = {}  # of pre-tokens
        self.held = self.words_held = 0  # characters of both

    def merged(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left in each sequence; ``flat`` holds all sequences end to end."""
        left_over = lengths.copy()
        seq = np.repeat(np.arange(len(lengths)), lengths)
        worst = len(self.rank)
        while len(flat) > 1:
            key = flat[:-1] * self.base + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank = np.append(np.where(known, self.rank[at], worst), worst)
            first = np.flatnonzero(np.diff(seq, prepend=-1))  # where each sequence begins
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(seq))))
            hit = (rank == best) & (rank < worst)
            place = np.flatnonzero(hit)
            if not len(place):
                break
            # a pair of two equal symbols can overlap itself: in a run of hits take every second
            start = np.diff(place, prepend=-2) > 1
            place = place[(place - place[start][np.cumsum(start) - 1]) % 2 == 0]
            flat[place] = self.made[rank[place]]
            left_over -= np.bincount(seq[place], minlength=len(lengths))
            stay = best < worst  # sequences without a known pair are done
            stay[place + 1] = False
            flat, seq = flat[stay], seq[stay]
        return left_over

    def count_pretokens(self, pretokens: list[bytes]) -> np.ndarray:
        out, i = np.zeros(len(pretokens), np.int64), 0
        while i < len(pretokens):
            j, size = i, 0
            while j < len(pretokens) and (j == i or size + len(pretokens[j]) <= ROUND_SYMBOLS):
                size += len(pretokens[j])
                j += 1
            lengths = np.fromiter(map(len, pretokens[i:j]), np.int64, j - i)
            raw = np.frombuffer(b"".join(pretokens[i:j]), np.uint8)
            flat = self.inner[raw]
            ends = np.cumsum(lengths) - 1
            flat[ends] = self.last[raw[ends]]
            out[i:j] = self.merged(flat, lengths)
            i = j
        return out

    def learn(self, chunks: Iterable[str]) -> dict[str, int]:
        """Counts of new chunks; only pre-tokens not met before are merged, short ones are remembered."""
        chunks = list(chunks)
        found = [self.pretoken.findall(c) for c in chunks]
        if len(self.words) > MEMO or self.words_held > MEMO_CHARS:
            self.words.clear()
            self.words_held = 0
        new = list({p for ps in found for p in ps}.difference(self.words))
        known = dict(zip(new, self.count_pretokens([p.encode("utf-8", "surrogatepass") for p in new]).tolist(), strict=True))
        short = {p: n for p, n in known.items() if len(p) <= MEMO_LONGEST}
        self.words.update(short)
        self.words_held += sum(map(len, short))
        words = self.words if len(short) == len(known) else ChainMap(known, self.words)
        return {c: words[ps[0]] if len(ps) == 1 else sum([words[p] for p in ps]) for c, ps in zip(chunks, found, strict=True)}

    def chunks(self, part: str) -> list[str]:
        if not part.isascii():
            # one character at a time: capital sigma has no final form here
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        if _ODD_SPACE.search(part):
            return [c for c in regex.split(r"\p{White_Space}+", part) if c]
        return part.split()

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of ``texts``; their new chunks are merged together."""
        counts, chunks = [], []
        for text in texts:
            parts = [text]
            if self.special and any(m in text for m in self.marks):
                parts = self.special.split(text)
            counts.append(len(parts) - 1)
            chunks.append([c for part in parts for c in self.chunks(part)])
        if len(self.memo) > MEMO or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        long: dict[str, int] = {}
        new = set().union(*chunks).difference(self.memo)
        if new:
            learned = self.learn(new)
            long = {c: n for c, n in learned.items() if len(c) > MEMO_LONGEST}
            short = {c: n for c, n in learned.items() if c not in long} if long else learned
            self.memo.update(short)
            self.held += sum(map(len, short))
        known = ChainMap(self.memo, long) if long else self.memo
        return [n + sum(map(known.__getitem__, cs)) for n, cs in zip(counts, chunks, strict=True)]

    def count_batch(self, texts: Iterable[str]) -> list[int]:
        """``count_all`` over pieces of a batch with about ``PIECE_CHARS`` characters each."""
        out, piece, size = [], [], 0
        for text in texts:
            piece.append(text or "")
            size += len(piece[-1])
            if size > PIECE_CHARS:
                out += self.count_all(piece)
                piece, size = [], 0
        return out + self.count_all(piece)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger = Merger(tokenizer_path)
        for batch in texts:
            yield pd.Series(merger.count_batch(batch), dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", text.alias("text"))
            .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
