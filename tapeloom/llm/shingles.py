"""Word shingles of whole text columns, as arrays: no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(BASE), -1, 1 << 64))

#: Byte to its lower-case form if it is part of a word (ASCII letters and digits, any byte beyond ASCII), else 0.
LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        LOWER[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct shingles of texts with their counts.

    A word's hash is the difference of two prefix sums of its bytes, so all words of a chunk are
    hashed at once; a shingle mixes the hashes of its words. Texts of fewer than WIDTH words have one
    shingle of all their words; texts without a word have none.
    """

    def __init__(self) -> None:
        self.up, self.down = _powers(BASE, 2), _powers(INVERSE, 2)
        self.coef = mixed_bits(np.arange(1, WIDTH + 1, dtype=U64)) | U64(1)

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts: first, end, and their shingles: doc (within the run), id (48 bits), count; by doc and id."""
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, min(at + 60_000, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1))
            yield (at, end, *self._run(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]))
            at = end

    def _run(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        n = len(raw)
        if not n:
            return none
        if len(self.up) <= n:
            self.up, self.down = _powers(BASE, n + 1), _powers(INVERSE, n + 1)
        low = LOWER[raw]
        inside = low != 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        if not len(first):
            return none
        sums = np.zeros(n + 1, U64)
        np.cumsum(low.astype(U64) * self.up[:n], out=sums[1:])
        words = mixed_bits((sums[last + 1] - sums[first]) * self.down[first])
        doc = np.searchsorted(offsets, first, side="right") - 1
        count = np.bincount(doc, minlength=len(offsets) - 1)
        parts, owners = [], []
        m = len(words) - WIDTH + 1
        if m > 0:
            full = doc[:m] == doc[WIDTH - 1 :]
            s = words[:m] * self.coef[0]
            for k in range(1, WIDTH):
                s += words[k : m + k] * self.coef[k]
            parts.append(s[full])
            owners.append(doc[:m][full])
        short = (count > 0) & (count < WIDTH)
        if short.any():
            begin = np.cumsum(count) - count
            for d in np.flatnonzero(short):
                w = words[begin[d] : begin[d] + count[d]]
                parts.append(np.array([(w * self.coef[: len(w)]).sum() + U64(len(w))], U64))
                owners.append(np.array([d]))
        keys = (np.concatenate(owners).astype(U64) << U64(48)) | (mixed_bits(np.concatenate(parts)) >> U64(16))
        keys.sort()
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        return (keys >> U64(48)).astype(np.int64), keys & U64((1 << 48) - 1), times
