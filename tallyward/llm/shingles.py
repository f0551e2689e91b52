"""Word shingles of whole texts as 64-bit tokens, by numpy on Arrow's buffers."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time; one longer text is handled alone.
CHUNK = 1 << 19
MASK = (1 << 64) - 1
#: Multipliers of the sums over a shingle's words, both odd.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Words of more bytes are hashed one by one, by a cryptographic hash.
BLOCK_BYTES = 64
#: Bytes of a block that are a word's, for each number of them.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: A-Z in lower case, and whether a byte is white space.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of h spread over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(STEP)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(BASE)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in data, lower-cased, and where each text's words begin; texts begin at starts (ascending, first 0)."""
    n = len(data)
    black = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = black[:-1]
    first = np.flatnonzero(black & (~before | edge[:n]))
    # the words, end to end, read in blocks of eight bytes. Each step maps hashes and blocks one to one, so that words of
    # one length of up to eight bytes never collide, and longer ones no more than chance has it
    letters = np.concatenate([LOWER[data[black]], np.zeros(8, np.uint8)])
    offsets = np.append(np.concatenate([[0], np.cumsum(black)])[first], len(letters) - 8)
    size = np.diff(offsets)
    blocks = np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,))
    hashes, own = mixed(size.astype(np.uint64) + np.uint64(1)), np.arange(len(size))
    for at in range(0, BLOCK_BYTES, 8):
        own = own[size[own] > at]
        if not len(own):
            break
        hashes[own] = mixed(hashes[own] ^ (blocks[offsets[own] + at] & MASKS[np.minimum(size[own] - at, 8)]))
    for k in np.flatnonzero(size > BLOCK_BYTES).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(letters[offsets[k] : offsets[k + 1]].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(first, starts)


def token_sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle tokens of each text (null: empty), in order.

    A text with fewer words than `words` has its whole word sequence as one shingle; without words it has none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        data = raw[offsets[at] : offsets[end]]
        if len(data):
            hashes, begin = word_hashes(data, np.minimum(offsets[at:end] - offsets[at], len(data)))
        else:
            hashes, begin = np.zeros(0, np.uint64), np.zeros(end - at, np.int64)
        begin = np.append(begin, len(hashes))
        rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
        for k in range(1, words):
            rolled = rolled * np.uint64(STEP) + hashes[k : k + len(rolled)]
        rolled = mixed(rolled)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= words:
                yield distinct(rolled[a : b - words + 1])
            elif b > a:
                h = b - a
                for x in hashes[a:b].tolist():
                    h = (h * BASE + x) & MASK
                yield mixed(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = end


def distinct(tokens: np.ndarray) -> np.ndarray:
    out = np.sort(tokens)
    new = np.empty(len(out), bool)
    new[:1] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def digest(tokens: np.ndarray, text: str | None = None, words: int = 5) -> bytes | None:
    """Address of a set of tokens; None for the empty set. A set of one token is addressed by the words of its text."""
    if not len(tokens):
        return None
    if len(tokens) == 1:
        own = itertools.islice(re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass").translate(bytes(LOWER))), words)
        return hashlib.blake2b(b" ".join(m[0] for m in own), digest_size=16, person=b"one").digest()
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
