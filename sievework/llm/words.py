"""Words of a column of texts and names of their windows, as arrays.

Words are runs without blanks and the control characters \\x09 to \\x0D, as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """edges (where each text's words begin and end), codes (of all words) and the dictionary that codes point into."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    edges = parts.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # white space around a text
        keep = codes != blank
        edges = np.concatenate([[0], np.cumsum(keep)])[edges]
        codes = codes[keep]
    return edges, codes, coded.dictionary


def joined(edges: np.ndarray, codes: np.ndarray, dictionary: pa.Array) -> pa.Array:
    """Texts of words with one blank between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), dictionary.take(pa.array(codes))), " ")


def names(dictionary: pa.Array) -> np.ndarray:
    """Two 64-bit names for each word, from its digest: (words, 2)."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, dictionary.cast(pa.binary()).to_pylist())), dtype=np.uint64).reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def doubled(window: np.ndarray, have: int, want: int) -> np.ndarray:
    """Names of windows of `want` words from those of `have` words: two of them, laid so that they cover the window."""
    step = want - have
    if len(window) <= step:
        return window[:0]
    return mix(window[: len(window) - step] * np.uint64(3) + mix(window[step:]) + np.uint64(want))


#: Bytes of a plain word by kind: letters of ASCII, bytes of letters from U+00C0 to U+017F, marks that may follow.
LETTER, WIDE, TRAIL, MARK = 1, 2, 3, 4
MARKS = b".,;:!?#$%&*|)"
KIND = np.zeros(256, dtype=np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[0xC3:0xC6] = WIDE
KIND[0x80:0xC0] = TRAIL
KIND[list(MARKS)] = MARK


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in one array, and where each begins and ends."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[edges[0] : edges[-1]], edges - edges[0]


def plain(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are letters with marks after them, perhaps, and where the letters of each word end. Letters are those
    of ASCII and, of two bytes, from U+00C0 to U+017F but for the signs of times and division and the dotted I, whose
    lower case is longer."""
    kind = KIND[flat]
    bad = kind == 0
    bad[:-1] |= (kind[:-1] == WIDE) & (((flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))) | ((flat[:-1] == 0xC4) & (flat[1:] == 0xB0)))
    # A trailing byte is a letter's only after one of the leads above; after any other lead its word is bad anyway.
    mark = kind == MARK
    ends = edges[1:].copy()
    ok, at = edges[1:] > edges[:-1], edges[:-1]
    last = np.maximum.reduceat(np.where(mark, -1, np.arange(len(flat))), at[ok]) if ok.any() else np.zeros(0, np.int64)
    ends[ok] = np.maximum(last + 1, at[ok])
    wrong = np.concatenate([[0], np.cumsum(bad)])
    marks = np.concatenate([[0], np.cumsum(mark)])
    return (ends > at) & (wrong[edges[1:]] == wrong[at]) & (marks[ends] == marks[at]), ends


def gather(values: np.ndarray, edges: np.ndarray, codes: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code, one after the other, and their edges; values[edges[i]:edges[i + 1]] belong to code i."""
    size = np.diff(edges)
    out_edges = np.concatenate([[0], np.cumsum(size[codes])])
    out = np.empty(out_edges[-1], dtype=values.dtype)
    for a in range(0, len(codes), step):
        some = codes[a : a + step]
        lo, hi = out_edges[a], out_edges[min(a + step, len(codes))]
        shift = np.repeat(edges[some] - (out_edges[a : a + len(some)] - lo), size[some])
        out[lo:hi] = values[shift + np.arange(hi - lo)]
    return out, out_edges


def half_of(length: int) -> int:
    return -(-length // 2)


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of `length` words, by doubling from single words."""
    if length == 1:
        return words
    return doubled(windows(words, half_of(length)), half_of(length), length)
