"""Words of UTF-8 texts as arrays: places and 64-bit hashes of all words of a block of documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Upper to lower case for A-Z; ASCII other than letters and digits becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def normal(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and a space for every other ASCII character that is no letter or digit."""
    return (text or "").encode("utf-8", "replace").translate(TABLE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def hash_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words between spaces. A word's hash doesn't depend on where it stands."""
    codes = np.frombuffer(buffer, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], codes == 32, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_word(word: bytes) -> int:
    return int(hash_words(word)[2][0])


def hashed(rows: Iterator[tuple], text: int = -1) -> Iterator[tuple[tuple, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its normal text and the starts, ends and hashes of its words; documents are hashed in blocks of about a quarter of a megabyte."""
    block: list[tuple] = []
    size = 0
    for row in rows:
        block.append((row, normal(row[text])))
        size += len(block[-1][1])
        if size >= BLOCK:
            yield from _hashed_block(block)
            block, size = [], 0
    yield from _hashed_block(block)


def _hashed_block(block: list[tuple]) -> Iterator[tuple]:
    if not block:
        return
    starts, ends, hashes = hash_words(b" ".join(b for _, b in block))
    offsets = np.concatenate(([0], np.cumsum([len(b) + 1 for _, b in block])))
    cuts = np.searchsorted(starts, offsets)
    for (row, buffer), offset, low, high in zip(block, offsets.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=False):
        yield row, buffer, starts[low:high] - offset, ends[low:high] - offset, hashes[low:high]
