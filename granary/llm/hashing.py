"""Words of whole Arrow batches as 64-bit hashes, in numpy; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18  # bytes hashed at once; bounds the memory that one long text needs

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shifts, multiplications)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _STEP, dtype=np.uint64)
    base[0] = 1
    inverse = np.full(n, pow(int(_STEP), -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _values() -> np.ndarray:
    return mix((np.arange(257, dtype=np.uint64) + np.uint64(1)) * _STEP)


def table(is_word, lower: bool = True) -> np.ndarray:
    """Byte to code: 0 for a separator, else one more than the byte, A-Z in lower case."""
    out = np.arange(1, 257, dtype=np.uint16)
    if lower:
        out[65:91] += 32
    for b in range(256):
        if not is_word(b):
            out[b] = 0
    return out


#: Words are runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
SPACED = table(lambda b: b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
#: Words are runs of ASCII letters and digits and of all non-ASCII bytes.
LETTERS = table(lambda b: b >= 128 or chr(b).isalnum())


def _long_word(buf: np.ndarray, at: int, text_end: int, codes: np.ndarray, values: np.ndarray, prefixes: tuple[int, ...]) -> tuple:
    """End and hashes of the word at ``at``, longer than a segment: segment by segment, so memory stays bounded."""
    power = _powers(SEGMENT)[0]
    raw, shift, k, ended = 0, 1, at, False
    first = values[codes[buf[at : at + max(prefixes, default=0)]]]
    while k < text_end and not ended:
        b = codes[buf[k : min(text_end, k + SEGMENT)]]
        back = np.flatnonzero(b == 0)
        if len(back):
            b, ended = b[: back[0]], True
        raw += shift * int((values[b] * power[: len(b)]).sum())
        shift = shift * pow(int(_STEP), len(b), 1 << 64) & _ALL
        k += len(b)
    sums = [(raw, k - at), *((int((first[:p] * power[:p]).sum()), p) for p in prefixes)]
    return k, *(mix(np.array([(total + n * int(_STEP)) & _ALL], dtype=np.uint64)) for total, n in sums)


def words(buf: np.ndarray, bounds: np.ndarray, codes: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, text number, start position) of every word; bounds are text offsets, one more than the texts.

    For each length in ``prefixes`` follows the hash of the word's first so many bytes.

    Equal words have equal hashes wherever they stand: a prefix sum of scrambled byte values
    times powers of an odd number is differenced and shifted back by the inverse power.
    """
    n = int(bounds[-1] - bounds[0])
    buf = buf[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    values = _values()
    found = []
    at = 0
    while at < n:
        stop = min(n, at + SEGMENT)
        if stop < n:  # end the segment at a separator or where a text begins
            back = np.flatnonzero(codes[buf[at:stop]] == 0)
            next_text = bounds[np.searchsorted(bounds, at, side="right") : np.searchsorted(bounds, stop, side="right")]
            cuts = [int(at + back[-1] + 1)] if len(back) else []
            cuts += [int(next_text[-1])] if len(next_text) else []
            if cuts:
                stop = max(cuts)
            else:
                stop, *hashes = _long_word(buf, at, int(bounds[np.searchsorted(bounds, stop)]), codes, values, prefixes)
                found.append((np.array([at]), *hashes))
                at = stop
                continue
        b = codes[buf[at:stop]]
        word = b != 0
        first = np.zeros(stop - at + 1, dtype=bool)
        inside = bounds[(bounds >= at) & (bounds <= stop)] - at
        first[inside] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends[:-1] &= ~word[1:] | first[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _powers(SEGMENT)
        run = np.zeros(stop - at + 1, dtype=np.uint64)
        np.cumsum(values[b] * power[: stop - at], out=run[1:])
        ends_at = [e, *(np.minimum(e, s + p) for p in prefixes)]
        found.append((s + at, *(mix((run[x] - run[s]) * inverse[s] + (x - s).astype(np.uint64) * _STEP) for x in ends_at)))
        at = stop
    if not found:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes))
    s, h, *more = (np.concatenate(x) for x in zip(*found, strict=True))
    return (h, np.searchsorted(bounds, s, side="right") - 1, s, *more)


def text_slices(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of row ranges of about ``limit`` bytes; null is empty."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, buf, bounds[row : end + 1]
        row = end


def shingle_sets(h: np.ndarray, text_of: np.ndarray, n_texts: int, size: int = 5) -> list[np.ndarray]:
    """Per text: sorted distinct hashes of its ``size``-word shingles; with fewer words, of all of them."""
    per = np.bincount(text_of, minlength=n_texts)
    at = np.concatenate([[0], np.cumsum(per)])
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    if len(h) >= size:
        m = len(h) - size + 1
        whole = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            whole += h[k : k + m] * factors[k]
        whole = mix(whole)
    out = []
    for k in range(n_texts):
        if per[k] >= size:
            x = np.sort(whole[at[k] : at[k + 1] - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif per[k]:
            few = h[at[k] : at[k + 1]]
            salted = np.append(few * factors[: len(few)], np.array([len(few)], dtype=np.uint64) * _STEP)
            out.append(mix(salted.sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
