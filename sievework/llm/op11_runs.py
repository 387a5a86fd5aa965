"""Runs of repeated words in each text, by the runs theorem.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. The theorem: under the
order of words or under its inverse, a run holds a longest Lyndon word whose length is q. So the texts of a slice get one
inverse suffix array; the next smaller value of a position in it ends the longest Lyndon word there, the next greater
value the longest one under the inverse order. Each such word is taken for a root and extended to both sides as far as
the words repeat with its length, by least LCP values between two suffixes (a sparse table over blocks), of the text for
the right side and of the text read backwards for the left.

Only runs of at least `least` words and `times` periods count. Any window of a few words in such a run comes again in it
(`repeated`), so that stretches without windows that repeat in their document get no suffix array; no run is lost by it.

Cases: a null or empty text has no words and no runs. Rows are independent: rows with a null or a repeated doc_id, and
repeated rows, are each answered. Texts of any length are read whole: arrays and tables are in proportion to the text of
a slice of a few megabytes, or to one longer text. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import read, slices, small_batches
from sievework.llm.words import joined, mix, split

#: Words and periods of a run at least.
LEAST, TIMES = 6, 4
#: Bytes of text whose runs are sought together.
SLICE = 4 << 20
#: Values of a block of the sparse table.
BLOCK = 16


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The inverse suffix array of text, whose last value is unlike all others. Prefix doubling: only suffixes that are
    equal so far are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    key, depth, base = text[order], 1, np.arange(n)
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(order)))
        rank[order] = np.repeat(base[starts], sizes)
        tied = np.repeat(sizes > 1, sizes)
        order, base = order[tied], base[tied]
        if not len(order):
            return rank
        # Suffixes of one group stand together; base are their places in the whole order.
        key = rank[order] * n + rank[order + depth]
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        depth *= 2


def common_prefixes(text: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place in the order of suffixes, how much that suffix has in common with the one before it."""
    n = len(text)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    values, out, h = text.tolist(), [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        while values[i + h] == values[j + h]:  # the last value, unlike all others, ends this
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.array(out, dtype=np.int32)[order]


class Minima:
    """Least values of ranges: a sparse table over blocks, prefix and suffix minima within them."""

    def __init__(self, values: np.ndarray):
        self.values = np.append(values, np.full(-len(values) % BLOCK, np.iinfo(np.int32).max, dtype=np.int32))
        rows = self.values.reshape(-1, BLOCK)
        self.head = np.minimum.accumulate(rows, axis=1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while len(self.table[-1]) > (half := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """low <= high, both within the range."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.tail[low], self.head[high])
        between = b - a - 1
        level = np.frexp(np.maximum(between, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[between > 0]).tolist():
            at = np.flatnonzero((between > 0) & (level == k))
            out[at] = np.minimum(out[at], np.minimum(self.table[k][a[at] + 1], self.table[k][b[at] - (1 << k)]))
        at = np.flatnonzero(a == b)
        out[at] = self.values[low[at]]
        for step in range(1, BLOCK):
            at = at[low[at] + step <= high[at]]
            out[at] = np.minimum(out[at], self.values[low[at] + step])
        return out


class Extension:
    """How far the suffixes at two places of a text agree."""

    def __init__(self, text: np.ndarray, rank: np.ndarray):
        self.rank, self.minima = rank, Minima(common_prefixes(text, rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        return self.minima.least(low + 1, high).astype(np.int64)


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value, or the end."""
    n = len(values)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        v, j = values[i], i + 1
        while j < n and values[j] > v:
            j = out[j]
        out[i] = j
    return np.array(out, dtype=np.int64)


def runs_of(text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of each run. text: stretches, each with a separator of its own after it, all separators
    less than all words; begin, end: for each place where its stretch begins and its separator stands."""
    n = len(text)
    rank = suffix_ranks(text)
    place, smaller, greater = np.arange(n), next_smaller(rank.tolist()), next_smaller((-rank).tolist())
    i, j = np.concatenate([place, place]), np.concatenate([smaller, greater])
    # A separator is no root, and a word of the inverse order that reaches its separator does not repeat.
    ok = (i < end[i]) & (j <= end[i]) & (times * (j - i) <= end[i] - begin[i])
    i, j = i[ok], j[ok]
    right = Extension(text, rank)(i, j)
    back = text[::-1]
    # Backwards the first separator comes last.
    back = np.append(back, -1)
    left = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = Extension(back, suffix_ranks(back))(n - i[inner], n - j[inner])
    period = j - i
    start, length = i - left, left + period + right
    ok = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([start[ok], period[ok], length[ok]], axis=1), axis=0) if ok.any() else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 2], found[:, 1]


def window_of(least: int, times: int) -> int:
    """Words of a window that any run that counts holds twice, wherever in the run it starts: a run of n words has
    n - window + 1 starts, and with two periods of them each start has another a period away."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 2)))


def repeated(codes: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """Which words are in a window that comes again in its document, by a hash: a collision only adds some."""
    n = len(codes)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    if n < window:
        return np.zeros(n, dtype=bool)
    name = mix(doc[: n - window + 1].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        name = mix(name * np.uint64(3) + codes[k : n - window + 1 + k].astype(np.uint64))
    inside = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    name = name[inside]
    every = np.sort(name)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return np.zeros(n, dtype=bool)
    at = inside[twice[np.minimum(np.searchsorted(twice, name), len(twice) - 1)] == name]
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    return np.cumsum(cover)[:-1] > 0


def all_runs(codes: np.ndarray, edges: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (among all words), length and period of each run of texts, whose words are codes[edges[i]:edges[i + 1]]."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    at = np.flatnonzero(repeated(codes, edges, window_of(least, times)))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    doc = np.searchsorted(edges, at, side="right")
    first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc) > 0)])
    stretch = np.cumsum(first) - 1
    count = int(stretch[-1]) + 1
    place = np.arange(len(at)) + stretch
    text = np.empty(len(at) + count, dtype=np.int64)
    ends = np.append(place[np.flatnonzero(first)[1:]] - 1, len(text) - 1)
    # Of two separators the later is the smaller, so that the last value of the text is the least.
    text[ends] = count - 1 - np.arange(count)
    text[place] = codes[at] + count
    word = np.zeros(len(text), dtype=np.int64)
    word[place] = at
    sizes = np.diff(np.append(-1, ends))
    start, length, period = runs_of(text, np.repeat(ends - sizes + 1, sizes), np.repeat(ends, sizes), least, times)
    return word[start], length, period


def planted(codes: np.ndarray, edges: np.ndarray, hashes: list[int | None]) -> np.ndarray:
    """A tenth of the texts repeat a part of themselves to their end, by their hash."""
    codes = codes.copy()
    for i, h in enumerate(hashes):
        n = int(edges[i + 1] - edges[i])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        codes[edges[i] + a : edges[i + 1]] = codes[edges[i] + a + np.arange(n - a) % p]
    return codes


RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, key: str = "doc_id", text: str = "text", plant: str | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; start is a word's number) and kept, the text without the words that a
    run holds after its first period. With plant, the texts that this hash column names are made to repeat before."""
    rows = small_batches(docs).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(plant).cast("long") if plant else F.lit(None).cast("long")).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                edges, codes, dictionary = split(part.column("text"))
                if plant:
                    codes = planted(codes, edges, part.column("hash").to_pylist())
                start, length, period = all_runs(codes, edges, least, times)
                gone = np.zeros(len(codes) + 1, dtype=np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                stays = np.cumsum(gone)[:-1] == 0
                kept = joined(np.concatenate([[0], np.cumsum(stays)])[edges], codes[stays], dictionary)
                order = np.lexsort((period, start))
                start, length, period = start[order], length[order], period[order]
                of = np.searchsorted(start, edges)
                fields = [pa.array(x) for x in (start - np.repeat(edges[:-1], np.diff(of)), length, period)]
                listed = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edges)), listed, kept], ["doc_id", "n_words", "runs", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, {RUNS}, kept string")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, its longest one, and digests of all of them and of what is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("hash"))
    found = runs(docs, plant="hash")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words"
    )
