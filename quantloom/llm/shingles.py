"""Sets of word shingles as sorted 64-bit hashes, computed over UTF-8 bytes in bounded memory."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype="u8")
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at a time.
CHUNK = 1 << 18


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    return tuple(np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(n - 1, x, "u8"))]) for x in (_BASE, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of ``data``, which is cut at white space only."""
    b = np.frombuffer(data, "u1")
    n = 1 << max(16, int(len(b)).bit_length())
    power, inverse = _powers(n)
    word = ~_BLANK[b]
    edge = np.diff(word.view("i1"), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTE[b] * power[: len(b)], dtype="u8")])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype("u8")), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the first word of each text plus a last bound."""
    hashes, bounds, group, size = [], [0], [], 0

    def flush() -> None:
        nonlocal size
        if group:
            own, start = _chunk(b"\n".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            bounds.extend((bounds[-1] + np.searchsorted(start, ends)).tolist())
            hashes.append(own)
            group.clear()
            size = 0

    for text in texts:
        if len(text) <= CHUNK:
            if size + len(text) > CHUNK:
                flush()
            group.append(text)
            size += len(text) + 1
            continue
        flush()
        at, words = 0, 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):  # on to the next white space
                piece = text[end : end + CHUNK]
                while piece and not _BLANK[np.frombuffer(piece, "u1")].any():
                    end += len(piece)
                    piece = text[end : end + CHUNK]
                end += int(np.argmax(_BLANK[np.frombuffer(piece, "u1")])) if piece else 0
            own, _ = _chunk(text[at:end])
            hashes.append(own)
            words += len(own)
            at = end
        bounds.append(bounds[-1] + words)
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, "u8"), np.array(bounds)


def shingle_sets(texts: list[bytes], n: int):
    """For each text its sorted distinct shingle hashes: ``n`` words in lower case (A-Z),
    or all words if there are fewer; empty without words."""
    words, bounds = word_hashes(texts)
    odd = mix(np.arange(1, n + 1, dtype="u8")) | np.uint64(1)
    full = np.zeros(max(0, len(words) - n + 1), "u8")
    for k in range(n):
        full += words[k : k + len(full)] * odd[k]
    full = mix(full)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b > a:
            yield mix((words[a:b] * odd[: b - a]).sum(dtype="u8", keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, "u8")
