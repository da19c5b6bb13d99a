"""Hashes of words and of five-word shingles for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

WIDTH = 5
SLICE_BYTES = 4 << 20
SEED = 77_003


def mix(x):
    """A bijective finalizer of 64-bit integers."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables(size: int):
    """A random number for each byte, and the powers of an odd base and of its inverse."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    values = rng.integers(0, 1 << 63, 256, np.uint64)
    base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 5
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(size + 1, base, np.uint64), np.full(size + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(batch, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Row ranges of about `limit` bytes of text."""
    import numpy as np

    texts = batch.column(batch.schema.get_field_index(column))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def word_hashes(texts) -> tuple:
    """texts: an Arrow string array without nulls. Returns the hashes of all words, split at ASCII white
    space, and each text's number of words."""
    import numpy as np

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    size = SLICE_BYTES
    while size < len(raw):
        size *= 2
    values, up, down = _tables(size)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts_word = ~space
    starts_word[1:] &= space[:-1] | edge[1:-1]
    ends_word = ~space
    ends_word[:-1] &= space[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts_word), np.flatnonzero(ends_word) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
        words = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return words, np.diff(np.searchsorted(a, offsets))


def shingle_hashes(words, counts) -> tuple:
    """Hashes of the five-word shingles of each text, in order, and how many each has. A text of one to
    four words has one shingle, all its words; a text without words has none."""
    import numpy as np

    weights = np.random.default_rng(SEED + 1).integers(0, 1 << 62, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
        full = sum(padded[j: j + len(words)] * weights[j] for j in range(WIDTH))
        short = np.flatnonzero((counts > 0) & (counts < WIDTH))
        for j in range(1, WIDTH):  # what lies beyond a short text isn't part of it
            beyond = short[counts[short] <= j]
            full[first[beyond]] -= padded[first[beyond] + j] * weights[j]
        hashes = mix(full + np.uint64(0x9E3779B97F4A7C15))
    each = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    keep = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return hashes[keep], each
