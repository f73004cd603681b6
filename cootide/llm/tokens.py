"""Lengths of texts in tokens of a public byte-level BPE tokenizer.

The tokenizer splits a text into pieces by a pattern and encodes each piece by itself. Counting needs only the pieces'
lengths: the split is done on whole batches as arrays of code points, a piece is looked up by a 64-bit hash of its
characters, and only a piece not met before in this worker is encoded. The counts equal the tokenizer's.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The pattern of this vocabulary family, and the contractions it names.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

BLOCK_CHARS = 1 << 20
MOST_PIECES = 1 << 21
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], np.uint8)
    out[SPACES] = _SPACE
    return out


def piece_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Mask of positions at which the tokenizer's pattern begins a piece; a new document begins at ``doc_starts``."""
    kind = _classes()[codes]
    start = np.empty(len(codes), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(len(codes) + 1, bool)
    first[doc_starts] = True
    first[-1] = True
    start |= first[:-1]
    # A word after white space: a plain space before it belongs to it, other white space is a piece of its own.
    words = np.flatnonzero(start & (kind != _SPACE) & ~first[:-1])
    words = words[words > 0]
    words = words[kind[words - 1] == _SPACE]
    start[words - 1] = True
    start[words[codes[words - 1] == 0x20]] = False
    # Contractions: an apostrophe that begins a piece takes the letters named by the pattern with it.
    quotes = np.flatnonzero(start & (codes == 0x27))
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    for suffix in CONTRACTIONS:
        at = quotes
        for i, c in enumerate(suffix, 1):
            at = at[(padded[at + i] == ord(c)) & ~first[np.minimum(at + i, len(codes))]]
        start[at + 1] = False
        after = at + 1 + len(suffix)
        start[after[after < len(codes)]] = True
    return start


class TokenCounter:
    """Counts tokens of texts; keeps at most MOST_PIECES piece lengths."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.factors = np.random.default_rng(20240101).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.hashes, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _hash(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        factor = self.factors[place & 4095]
        if lengths.max() > 4096:
            factor = factor + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * factor, starts)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def _learn(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        new, at = np.unique(hashes, return_index=True)
        counts = [len(self.encoding.encode_ordinary(codes[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-32-le"))) for i in at]
        if len(self.hashes) + len(new) > MOST_PIECES:
            self.hashes, self.lengths = new, np.array(counts, np.int64)
            return
        all_hashes = np.concatenate([self.hashes, new])
        order = np.argsort(all_hashes)
        self.hashes, self.lengths = all_hashes[order], np.concatenate([self.lengths, counts])[order].astype(np.int64)

    def _look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.lengths[at], self.hashes[at] == hashes

    def count_block(self, text: str, doc_starts: np.ndarray) -> np.ndarray:
        """Tokens of each document in a non-empty concatenation of non-empty documents."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(piece_starts(codes, doc_starts))
        lengths = np.diff(starts, append=len(codes))
        hashes = self._hash(codes, starts, lengths)
        tokens, known = self._look_up(hashes)
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(codes, starts[new], lengths[new], hashes[new])
            found, again = self._look_up(hashes[new])
            assert again.all()
            tokens[new] = found
        return np.add.reduceat(tokens, np.searchsorted(starts, doc_starts))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; 0 for null and empty ones. Long texts are cut where a piece is sure to begin."""
        out = np.zeros(len(texts), np.int64)
        block: list[str] = []
        owners: list[int] = []
        size = 0

        def flush():
            nonlocal size
            if block:
                starts = np.cumsum([0, *map(len, block[:-1])])
                np.add.at(out, owners, self.count_block("".join(block), starts))
            block.clear(), owners.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in cut(text or ""):
                if size + len(part) > BLOCK_CHARS:
                    flush()
                block.append(part), owners.append(i)
                size += len(part)
        flush()
        return out


def cut(text: str, limit: int = BLOCK_CHARS):
    """Parts of at least ``limit`` characters (the last may be shorter), each beginning with white space after a word.

    There the pattern always begins a piece, whatever stands before, so lengths of parts add up.
    """
    start = 0
    while len(text) - start > limit:
        at = start + limit
        while at < len(text) and not (text[at].isspace() and ord(text[at]) in _SPACE_SET and ord(text[at - 1]) not in _SPACE_SET):
            at += 1
        if at >= len(text):
            break
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


_SPACE_SET = frozenset(SPACES)


@lru_cache(maxsize=4)
def counter(vocabulary: str, pattern: str) -> TokenCounter:
    return TokenCounter(vocabulary, pattern)


def token_count(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens of a text column, as an Arrow-batched function; 0 for null and empty texts."""

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counter(vocabulary, pattern).count(texts.to_pylist()))

    return n_tokens(text)
