"""The least MD5 of many texts, for arrays in a task."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PAIRS = 16_384  # texts that are hashed together: their words stay in the cache

_K = [int(abs(np.sin(float(i + 1))) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def _leading(words: dict[int, np.ndarray | int], n: int) -> np.ndarray:
    """The first four bytes of the MD5 of n texts of one block, as numbers in the order of the
    digests. words: those of the padded texts that are not all 0."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t = np.empty(n, np.uint32)
    for i in range(61):  # the last three rounds do not touch these bytes
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=t)
            t |= b
            t ^= c
        t += a
        word = words.get(g, 0)
        if isinstance(word, int):
            t += (_K[i] + word) & 0xFFFFFFFF
        else:
            t += word
            t += _K[i]
        np.left_shift(t, _TURN[i], out=a)
        t >>= 32 - _TURN[i]
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where the texts begin, their lengths, and all their bytes."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at[:-1], np.diff(at), texts.buffers()[2] or b""


def _words(begin: np.ndarray, size: np.ndarray, data: bytes, end: int) -> np.ndarray:
    """(word, text): the texts with 0 behind them, or with the byte `end` and then 0."""
    wide = int(size.max(initial=0)) // 4 + 1
    out = np.zeros((len(size), 4 * wide), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, column] = np.frombuffer(data, np.uint8)[np.repeat(begin, size) + column]
    out[np.arange(len(size)), size] = end
    return np.ascontiguousarray(out.view("<u4").T)


def _shifted(words: np.ndarray, by: int) -> list[np.ndarray]:
    """The words of the texts when `by` bytes stand before them."""
    if not by:
        return list(words)
    up, down = np.uint32(8 * by), np.uint32(32 - 8 * by)
    over = [np.zeros_like(words[0]), *(w >> down for w in words)]
    return [(w << up) | o for w, o in zip(words, over)] + [over[-1]]


def least_md5(prefixes: pa.Array, first: np.ndarray, last: np.ndarray, names: pa.Array) -> tuple[list[str], np.ndarray]:
    """For each prefix, the least hex MD5 of the prefix with one of names[first:last] behind it (one
    at least), and which name that is."""
    begin, size, data = _bytes(prefixes)
    name_at, name_size, name_data = _bytes(names)
    tails = _words(name_at, name_size, name_data, 0x80)
    longest = int(name_size.max(initial=0))
    best: list[str | None] = [None] * len(size)
    chosen = np.zeros(len(size), np.int64)
    text, name_text = memoryview(data), memoryview(name_data)

    def offer(walks: np.ndarray, places: np.ndarray) -> None:
        for w, j in zip(walks.tolist(), places.tolist(), strict=True):
            digest = hashlib.md5(bytes(text[begin[w] : begin[w] + size[w]]) + bytes(name_text[name_at[j] : name_at[j] + name_size[j]]), usedforsecurity=False).hexdigest()
            if best[w] is None or digest < best[w]:
                best[w], chosen[w] = digest, j

    shifted: dict[int, list[np.ndarray]] = {}
    for length in np.unique(size).tolist():
        group = np.flatnonzero(size == length)
        heads = _words(begin[group], size[group], data, 0)
        if length + longest <= 55 and length % 4 not in shifted:
            shifted[length % 4] = _shifted(tails, length % 4)
        ends = np.cumsum(last[group] - first[group])
        starts = ends - (last[group] - first[group])
        for a in range(0, int(ends[-1]), PAIRS):
            b = min(a + PAIRS, int(ends[-1]))
            i, k = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            low = np.maximum(starts[i:k] - a, 0)
            count = np.diff(low, append=b - a)
            walk = np.repeat(np.arange(i, k), count)
            if k - i == 1:
                place = slice(int(first[group[i]] + a - starts[i]), int(first[group[i]] + b - starts[i]))
            else:
                place = np.arange(a, b) - starts[walk] + first[group[walk]]
            number = np.arange(place.start, place.stop) if k - i == 1 else place
            if length + longest > 55:  # not of one block: each as it is
                offer(group[walk], number)
                continue
            head = (lambda q: int(heads[q][i])) if k - i == 1 else (lambda q: heads[q][walk])  # noqa: B023
            words = {q: head(q) for q in range(length // 4)}
            for q, tail in enumerate(shifted[length % 4][: 14 - length // 4], length // 4):
                words[q] = tail[place]
            if length % 4:
                words[length // 4] = words[length // 4] | np.uint32(head(length // 4)) if k - i == 1 else words[length // 4] | head(length // 4)
            words[14] = ((name_size[place] + length) * 8).astype(np.uint32)
            digest = _leading(words, b - a)
            hit = np.flatnonzero(digest == np.repeat(np.minimum.reduceat(digest, low), count))
            offer(group[walk[hit]], number[hit])
    return best, chosen
