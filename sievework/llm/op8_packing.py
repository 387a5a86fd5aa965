"""Best-fit packing of documents into token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the driver plans on counts by length (at most `capacity` numbers,
whatever the input). Large lengths are split into groups of equal cardinality and rounded up to the longest of their
group. A linear programme over patterns of these few sizes, solved by column generation, says how often to use each
pattern. Its places are then filled with actual lengths, longest first, and what is left, large or small, goes by best
fit, longest first, into the fullest open sequence that can hold it. The plan is a list of runs: of one length, so
many pieces from a rank on go into consecutive sequences at one offset. Its size depends on the capacity alone, so it
is sent to every task, where a piece finds its place by its length and rank.

Cases: a null or empty text is one piece of the end token. Only texts longer than the capacity are cut. Repeated rows
are packed one by one; their pieces are ordered by id, number and checksum, so that a task that runs again gives the
same places. An empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import byte_chars, materialize, read, slices, texts, worker_store
from sievework.llm.words import MARKS, bytes_of, gather, plain, split

CAPACITY = 2048
END = 0
#: Settings that the plan is tried with; the one with the fewest sequences is taken. Groups of large lengths; smallest
#: large length; share of the capacity that patterns leave free, so that the room beside large pieces is one that small
#: ones can fill: it pays where there are many small pieces.
SETTINGS = ((32, 0.4, 1 / 8), (32, 0.4, 1 / 4), (96, 0.4, 0.0))
#: Bytes of text whose words are encoded together.
SLICE = 4 << 20
#: Pieces that get their ranks in one bucket, roughly.
BUCKET = 100_000


# ---- pieces -------------------------------------------------------------------------------------------------------


class Merges:
    """The merges of a tokenizer file, applied to many words at once, round by round: in each, every word merges the pair
    of its least rank wherever it stands."""

    def __init__(self, spec: dict):
        vocab, rules = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        parts = [tuple(r) if isinstance(r, list) else tuple(r.split(" ")) for r in rules]
        left, right, new = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in parts)))
        self.width = max(vocab.values()) + 1
        self.keys, self.new, self.none = left * self.width + right, new.astype(np.int32), len(rules)
        # A hash table of ranks: a pair stands in its slot or in the next free one.
        self.bits = max(4, len(rules).bit_length() + 3)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        slot, rest = self.slot(self.keys), np.arange(len(rules))
        while len(rest):
            free = rest[self.table[slot[rest]] < 0]
            self.table[slot[free]] = free  # the last one of a slot gets it
            rest = rest[self.table[slot[rest]] != rest]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        #: Whether rounds are right: a merge may only make pairs of later ranks.
        made = np.full(self.width, -1)
        np.maximum.at(made, new, np.arange(len(new)))
        self.sound = bool((np.maximum(made[left], made[right]) < np.arange(len(new))).all())
        self.of_byte, self.of_last = (np.array([vocab.get(c + end, -1) for c in byte_chars()], dtype=np.int32) for end in ("", suffix))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or `none`."""
        key = left.astype(np.int64) * self.width + right
        slot = self.slot(key)
        found = self.table[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.table[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != key[wrong])]
        return np.where(found >= 0, found, np.int32(self.none))

    def apply(self, symbols: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none of them empty), and their edges."""
        n = len(edges) - 1
        word = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges))
        rank = np.full(len(symbols), self.none, dtype=np.int32)
        rank[:-1] = np.where(word[1:] == word[:-1], self.rank(symbols[:-1], symbols[1:]), self.none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            ready = least == self.none
            if ready.any():
                done.append((word[ready], symbols[ready]))
                word, symbols, rank, least = (x[~ready] for x in (word, symbols, rank, least))
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            # Of overlapping pairs, which are of one symbol, every other one counts.
            first = np.concatenate([[True], np.diff(at) != 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.new[rank[at]]
            stay = np.ones(len(word), dtype=bool)
            stay[at + 1] = False
            place = (np.cumsum(stay) - 1)[at]
            word, symbols, rank = word[stay], symbols[stay], rank[stay]
            for left in (place, place[place > 0] - 1):
                right = np.minimum(left + 1, len(word) - 1)
                rank[left] = np.where((word[left] == word[right]) & (right > left), self.rank(symbols[left], symbols[right]), self.none)
        word, ids = (np.concatenate(x) for x in zip((np.zeros(0, np.int32),) * 2, *done))
        return ids[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


class WordIds:
    """Ids of texts by a tokenizer that drops white space: each distinct word of a slice of texts is encoded once.

    Plain words (letters, perhaps with marks after them) need no rules for parting: they are lower-cased and merged, all
    at once, and the marks are a piece of their own. Other words go through the tokenizers library. So do whole texts
    when the file's rules are not those that this relies on."""

    #: The rules of the tokenizer that words are read by.
    RULES = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(spec)
        model = rules["model"]
        known = all(rules.get(k) == v for k, v in self.RULES.items()) and model["type"] == "BPE"
        known = known and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        # No added token may be part of a plain word.
        known = known and all(not t["content"].isalpha() and not set(t["content"]) <= set(MARKS.decode()) for t in rules["added_tokens"])
        self.merges = Merges(rules) if known else None
        if self.merges is not None and (not self.merges.sound or min(self.merges.of_byte.min(), self.merges.of_last.min()) < 0):
            self.merges = None

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library, and their edges."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end token after each, and the edges of texts."""
        if self.merges is None:
            found = [self.whole([t]) for t in column.to_pylist()]
            ids = [x for i, _ in found for x in (i, [END])]
            return np.concatenate([np.zeros(0, np.int64), *ids]).astype("<u4"), np.concatenate([[0], np.cumsum([len(i) + 1 for i, _ in found])])
        edges, codes, dictionary = split(column)
        ids, at = self.of_words(dictionary)
        ids, at = np.append(ids, END), np.append(at, at[-1] + 1)  # the end token is one more word
        codes = np.insert(codes, edges[1:], len(dictionary))
        out, ends = gather(ids.astype("<u4"), at, codes)
        return out, ends[edges + np.arange(len(edges))]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, and their edges."""
        flat, edges = bytes_of(words)
        easy, core = plain(flat, edges)
        at = np.flatnonzero(easy)
        lower, low = bytes_of(pc.utf8_lower(words.take(pa.array(at))))  # as long as it was
        size = core[at] - edges[at]
        cut = np.concatenate([[0], np.cumsum(size)])
        inside = np.repeat(low[:-1] - cut[:-1], size) + np.arange(cut[-1])
        symbols = self.merges.of_byte[lower[inside]]
        symbols[cut[1:] - 1] = self.merges.of_last[lower[inside][cut[1:] - 1]]
        ids, parts = self.merges.apply(symbols, cut)
        # Marks and other words through the library; word -> pieces -> ids.
        data = flat.tobytes()
        tails = [data[a:b] for a, b in zip(core[at].tolist(), edges[at + 1].tolist())]
        other = words.filter(pa.array(~easy)).to_pylist()
        ends = sorted(set(tails))
        more, more_edges = self.whole([*other, *(t.decode() for t in ends)])
        ids, parts = np.concatenate([ids, more]), np.concatenate([parts, parts[-1] + more_edges[1:]])
        end_of = {t: len(at) + len(other) + i for i, t in enumerate(ends)}
        pieces = np.empty(len(words) + len(at), dtype=np.int64)
        word_edges = np.concatenate([[0], np.cumsum(1 + easy)])
        pieces[word_edges[:-1][easy]] = np.arange(len(at))
        pieces[word_edges[:-1][easy] + 1] = [end_of[t] for t in tails]
        pieces[word_edges[:-1][~easy]] = len(at) + np.arange(len(other))
        values, piece_edges = gather(ids, parts, pieces)
        return values, piece_edges[word_edges]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, and ids (little-endian, 32 bits each) if asked for."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = worker_store("packing", block=1 << 20)
        if store.get("word_spec") != spec.value:
            store.update(word_spec=spec.value, word_ids=WordIds(spec.value))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, edges = store["word_ids"].encode(part.column("text"))
                pieces = -(-np.diff(edges) // capacity)
                row = np.repeat(np.arange(len(pieces)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                size = np.minimum(np.diff(edges)[row] - start, capacity)
                begin = edges[row] + start
                data = memoryview(ids.tobytes())
                cuts = [data[a:b] for a, b in zip((4 * begin).tolist(), (4 * (begin + size)).tolist())]
                out = [part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(list(map(zlib.crc32, cuts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(cuts, pa.binary())] * with_ids], names)

    rows = texts(docs, key, text)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---- the plan -----------------------------------------------------------------------------------------------------


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The linear programme of cutting stock by column generation: patterns (one in a column) and how often to use each."""
    m = len(sizes)
    columns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(40 * m):
        price = inverse.sum(axis=0)
        value = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        order = np.argsort(sizes, kind="stable")
        small = sizes[order]
        for c in range(int(small[0]), capacity + 1):
            n = np.searchsorted(small, c, side="right")
            gain = value[c - small[:n]] + price[order[:n]]
            best = int(np.argmax(gain))
            if gain[best] > value[c - 1]:
                value[c], took[c] = gain[best], order[best]
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-6:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
                continue
            column[took[c]] += 1
            c -= int(sizes[took[c]])
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        x = x - step * d
        x[leave] = step
        x = np.maximum(x, 0)
        columns[:, leave] = column
        pivot = inverse[leave] / d[leave]
        inverse = inverse - np.outer(d, pivot)
        inverse[leave] = pivot
    return columns, x


def plan(counts: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[int, float, float], ...] = SETTINGS) -> tuple[np.ndarray, int]:
    """The plan of the best setting."""
    return min((grouped(counts, capacity, *x) for x in settings), key=lambda found: found[1])


def grouped(counts: dict[int, int], capacity: int, groups: int, large: float, spare: float) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece, and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    rest = {n: c for n, c in counts.items() if c > 0}
    bins = rest.pop(capacity, 0)
    if bins:
        runs.append((capacity, 0, bins, 0, 0))
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences

    most = int(capacity * (1 - spare))
    lengths = sorted((n for n in rest if capacity * large < n <= most), reverse=True)  # longer ones stand alone
    if lengths:
        # Groups of equal cardinality along the ranks; the sizes are the longest length of each.
        total = sum(rest[n] for n in lengths)
        share = max(1, -(-total // groups))
        members: list[list[list[int]]] = [[]]
        room = share
        for n in lengths:
            left = rest[n]
            while left:
                if not room:
                    members.append([])
                    room = share
                take = min(left, room)
                members[-1].append([n, take])
                left -= take
                room -= take
        sizes = np.array([g[0][0] for g in members])
        demand = np.array([sum(c for _, c in g) for g in members], dtype=float)
        # Groups may share their size: they are one for the programme.
        unique, where = np.unique(sizes, return_inverse=True)
        together = np.bincount(where, weights=demand)
        queues: dict[int, list[list[int]]] = {i: [] for i in range(len(unique))}
        for g, i in enumerate(where):
            queues[int(i)] += members[g]
        columns, times = patterns(unique, together, most)
        for j in np.argsort(-times):
            n_bins = int(times[j] + 1e-9)
            slots = [int(i) for i in range(len(unique)) for _ in range(int(columns[i, j]))][::-1]
            for i in set(slots):
                n_bins = min(n_bins, sum(c for _, c in queues[i]) // slots.count(i))
            if n_bins <= 0 or not slots:
                continue
            state = [(bins, n_bins, capacity)]
            bins += n_bins
            for i in slots:
                new = []
                for first, n, left in state:
                    while n:
                        head = queues[i][0]
                        take = min(n, head[1])
                        runs.append((head[0], used[head[0]], take, first, capacity - left))
                        used[head[0]] += take
                        rest[head[0]] -= take
                        new.append((first, take, left - head[0]))
                        first, n = first + take, n - take
                        head[1] -= take
                        if not head[1]:
                            queues[i].pop(0)
                state = new
            for first, n, left in state:
                open_[left].append((first, n))

    # Best fit, longest first, on runs of sequences with the same room.
    rooms = sorted(open_)
    for n in sorted((k for k, c in rest.items() if c), reverse=True):
        left = rest[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                first, have, room = bins, max(1, -(-left // (capacity // n))), capacity
                bins += have
            else:
                room = rooms[at]
                first, have = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            take = min(left, have)
            runs.append((n, used[n], take, first, capacity - room))
            used[n] += take
            left -= take
            for r, a, c in ((room, first + take, have - take), (room - n, first, take)):
                if c:
                    if r not in open_:
                        bisect.insort(rooms, r)
                    open_[r].append((a, c))
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece and length (from 1 to the capacity)."""
    total = pieces.count()
    buckets = max(64, total // BUCKET)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    by_length = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(by_length, capacity)
    sent = pieces.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", *(c for c in ("ids_crc32", "start") if c in pieces.columns))
    ranked = dealt.withColumn("_at", F.row_number().over(within)).join(firsts, ["_bucket", "length"]).withColumn("_rank", F.col("_first") + F.col("_at") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(table[run, 3] + rank - table[run, 1]), pa.array(table[run, 4])], [*keep, "sequence_id", "offset"])

    columns = [f for f in pieces.schema if f.name not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, offset long"
    return ranked.select(*(f.name for f in columns), "_rank").mapInArrow(place, schema)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place and the checksum of its ids; tokenize() gives the ids to a writer."""
    return pack(materialize(tokenize(docs, path, capacity, with_ids=False)), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return sequences(read(spark, sf_dir, "documents"))
