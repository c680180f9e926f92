"""Word shingles of a batch of texts as 64-bit hashes, computed on whole byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text hashed at once, unless a single text is longer.
CHUNK = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash's base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _P), ("down", _P_INV)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that lie end to end in ``raw`` (uint8),
    and the number of the text it is in. A word is a run of bytes other than
    ASCII white space; A-Z count as a-z. ``starts`` are the texts' offsets.
    """
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    stop = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[stop] - sums[begin]) * down[begin]), np.searchsorted(starts, begin, "right") - 1


def shingle_sets(texts: pa.Array, powers: Powers | None = None, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (uint64).

    A text of fewer words than a shingle has one, its whole sequence; a null
    text or one without words has none.
    """
    powers = powers or Powers()
    raw = [t or b"" for t in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
                size += len(raw[end])
                end += 1
            lengths = np.fromiter((len(t) for t in raw[at:end]), np.int64, end - at)
            # an empty text starts where the next one does; searching from the right gives words to the latter
            starts = np.concatenate(([0], np.cumsum(lengths)))
            h, doc = word_hashes(np.frombuffer(b"".join(raw[at:end]), np.uint8), starts, powers)
            first = np.searchsorted(doc, np.arange(end - at + 1))
            rolled = h[: max(0, len(h) - words + 1)].copy()
            for k in range(1, words):
                rolled = rolled * _M + h[k : len(h) - words + 1 + k]
            rolled = mix(rolled)
            for i in range(end - at):
                a, b = first[i], first[i + 1]
                if b - a >= words:
                    yield np.unique(rolled[a : b - words + 1])
                elif b > a:
                    whole = np.uint64(b - a)
                    for x in h[a:b]:
                        whole = whole * _M + x
                    yield mix(np.array([whole], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
            at = end


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        h = np.bitwise_xor.reduce(mix(tokens + _P)) if len(tokens) else np.uint64(0)
        return int(mix(np.array([h ^ np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])
