"""Word hashing of many texts at once, on NumPy arrays.

Words are runs of letters, digits and underscores after lower-casing; a Han or Kana character
is a word of its own. A word longer than ``PIECE`` characters is cut at that length. Hashes
depend on the text alone, so they agree between workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters that are hashed in one go; this bounds the working memory, not the texts.
PIECE = 1 << 18
#: Text after which a batch of documents is worked off.
BATCH_CHARS = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix one) of an array of unsigned words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(PIECE + 1, _BASE), np.full(PIECE + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 0 no word character, 1 word character, 2 a word of its own."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[i for i in range(0x110000) if chr(i).isalnum()]] = 1
    kinds[ord("_")] = 1
    for first, last in ((0x3041, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF)):
        kinds[first : last + 1] *= 2
    return kinds


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span; at most ``PIECE`` points."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((mix(points.astype(np.uint64) + np.uint64(1))) * _powers()[0][: len(points)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _powers()[1][starts])


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    kind = _kinds()[points]
    inside = kind > 0
    before = np.zeros(len(kind), np.uint8)
    before[1:] = kind[:-1]
    starts = np.flatnonzero(inside & ((before == 0) | (kind == 2) | (before == 2)))
    after = np.zeros(len(kind), np.uint8)
    after[:-1] = kind[1:]
    ends = np.flatnonzero(inside & ((after == 0) | (kind == 2) | (after == 2))) + 1
    return starts, ends


def pieces(text: str) -> Iterator[str]:
    """The lower-cased text in parts of at most ``PIECE`` characters, cut at white space if there is any."""
    text = text.lower()
    at = 0
    while len(text) - at > PIECE - 1:
        upto = at + PIECE - 1
        space = max(text.rfind(" ", at, upto), text.rfind("\n", at, upto))
        upto = space if space > at else upto
        yield text[at:upto]
        at = upto
    yield text[at:]


def packs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Parts of the texts joined by line feeds to about ``BATCH_CHARS``: the text number and the length of each part, and the parts joined."""
    owners, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            if parts and held + len(part) > BATCH_CHARS:
                yield np.array(owners), np.array([len(p) for p in parts]), "\n".join(parts)
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(part)
            held += len(part) + 1
    if parts:
        yield np.array(owners), np.array([len(p) for p in parts]), "\n".join(parts)


def packed_words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pack: prefix sums, word starts, word ends, and the text number of each word."""
    for owners, lengths, joined in packs(texts):
        points = code_points(joined)
        starts, ends = word_spans(points)
        part = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
        yield prefix_sums(points), starts, ends, owners[part]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, in order, and where each text's words begin (and the last ends)."""
    hashes, owners = [], []
    for sums, starts, ends, owner in packed_words(texts):
        hashes.append(span_hashes(sums, starts, ends))
        owners.append(owner)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=offsets[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), offsets


def runs(hashes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words and their offsets by text; a shorter text with words is one run."""
    counts = np.diff(offsets)
    n = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    text = np.repeat(np.arange(len(n)), n)
    at = offsets[:-1][text] + np.arange(out[-1]) - out[:-1][text]
    room = np.minimum(counts[text], length)
    mixed = np.zeros(len(at), np.uint64)
    for i in range(length):
        word = np.where(i < room, hashes[np.minimum(at + i, max(len(hashes) - 1, 0))], np.uint64(0)) if len(hashes) else mixed
        mixed = mixed * _BASE + word
    return mix(mixed), out


def unique_by_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text sorted and without repeats, and the new offsets."""
    found = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=out[1:])
    return np.concatenate(found) if found else values[:0], out
