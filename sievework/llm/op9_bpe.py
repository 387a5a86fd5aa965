"""Byte-level BPE encoding and decoding by a pair occurrence index.

A task takes a slice of its partition (some megabytes of text), lays the symbols of its distinct pieces out in one array
and maps each pair that has a rank to all its positions there. A heap holds the active ranks, which are applied in
ascending order: each one merges all its positions and files the pairs that this makes under their own ranks. A merge can
only make pairs of later ranks, so a rank is visited once; a file for which that does not hold is refused. Texts are put
together, and decoded, by gathering from flat arrays.

Cases: a null or empty text has no ids and decodes to ''. Special tokens written in a text become their own ids, as in
the tokenizers library with its defaults. Rows are independent, so repeated rows give repeated results; other columns
of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import byte_chars, read, slices, texts, worker_store
from sievework.llm.words import bytes_of, gather, plain

#: Positions from which a rank is applied to all of them at once.
MANY = 48
#: White space, and the pattern of pieces that the vocabulary was made with.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: White space at an end of a text or beside other white space (in the notation of Arrow's expressions).
BLANK = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
UNEVEN = rf"\A[{BLANK}]|[{BLANK}][{BLANK}]|[{BLANK}]\z"


class PairIndex:
    """The merges of a tokenizer file, applied to all pieces of a slice of texts at once."""

    def __init__(self, tokenizer_json: str):
        import regex

        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        self.of_byte = np.array([vocab[c] for c in chars], dtype=np.int32)
        #: By rank: its left and right symbol and the symbol that replaces them.
        self.rules: list[tuple[int, int, int]] = []
        #: By symbol: the rank of the pair with the symbol after it, and with the one before it.
        self.followed: dict[int, dict[int, int]] = defaultdict(dict)
        self.preceded: dict[int, dict[int, int]] = defaultdict(dict)
        made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            x, y, new = vocab[left], vocab[right], vocab[left + right]
            made[new] = rank
            self.rules.append((x, y, new))
            self.followed[x][y] = rank
            self.preceded[y][x] = rank
        if any(max(made.get(x, -1), made.get(y, -1)) >= r for r, (x, y, _) in enumerate(self.rules)):
            raise ValueError("a merge of this file makes pairs of earlier ranks: ranks can't be applied in ascending order")
        self.of_pair = np.array([[self.followed.get(x, {}).get(y, -1) for y in self.of_byte.tolist()] for x in self.of_byte.tolist()], dtype=np.int32)
        self.arrays: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = regex.compile(PIECE).findall
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        byte = {c: b for b, c in enumerate(chars)}
        tokens = {i: bytes(byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        #: The bytes of all tokens in one array, and the edges of each.
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(listed), dtype=np.uint8)
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t in listed])])

    def beside(self, after: bool, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that make a pair with this one, ascending, and the ranks of these pairs."""
        if (key := (after, symbol)) not in self.arrays:
            pairs = sorted((self.followed if after else self.preceded).get(symbol, {}).items())
            self.arrays[key] = tuple(np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        return self.arrays[key]

    def merge(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (none of them empty) and their edges. They lie in one array of symbols with a gap after each;
        a rank with many positions is applied to all of them at once, one with few one by one."""
        n = len(edges) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        piece = np.repeat(np.arange(n), np.diff(edges))
        place = np.arange(len(raw)) + piece
        gaps = edges[1:] + np.arange(n)
        symbols = np.full(len(raw) + n, -1, dtype=np.int32)
        symbols[place] = self.of_byte[raw]
        rank = np.full(len(raw), -1, dtype=np.int64)
        rank[:-1] = np.where(piece[1:] == piece[:-1], self.of_pair[raw[:-1], raw[1:]], -1)
        where = np.flatnonzero(rank >= 0)
        where = where[np.argsort(rank[where], kind="stable")]
        found, first = np.unique(rank[where], return_index=True)
        at: dict[int, list[int]] = {r: p.tolist() for r, p in zip(found.tolist(), np.split(place[where], first[1:]))}  # rank -> positions of the left symbol
        active = list(at)  # a heap; it is sorted
        # The same memory as machine integers and as arrays.
        sym, after, before = array("i", symbols.tobytes()), array("i", np.arange(1, len(symbols) + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, len(symbols) - 1, dtype=np.int32).tobytes())
        sym_, after_, before_ = (np.frombuffer(x, dtype=np.int32) for x in (sym, after, before))
        none: dict[int, int] = {}

        def file(s: int, positions: list[int]) -> None:
            if s in at:
                at[s] += positions
            else:
                at[s] = positions
                heapq.heappush(active, s)

        while active:
            r = heapq.heappop(active)
            positions = at.pop(r)
            x, y, new = self.rules[r]
            if len(positions) < MANY or x == y:
                followed, preceded = self.followed.get(new, none), self.preceded.get(new, none)
                positions.sort()
                for i in positions:
                    if sym[i] == x and sym[j := after[i]] == y:  # else another merge took one of the two
                        sym[i], sym[j] = new, -1
                        after[i] = k = after[j]
                        before[k] = i
                        if (s := followed.get(sym[k])) is not None:
                            if s in at:
                                at[s].append(i)
                            else:
                                file(s, [i])
                        if (s := preceded.get(sym[h := before[i]])) is not None:
                            if s in at:
                                at[s].append(h)
                            else:
                                file(s, [h])
                continue
            i = np.sort(np.array(positions, dtype=np.int64))
            i = i[(np.diff(i, prepend=-1) > 0) & (sym_[i] == x)]
            j = after_[i]
            ok = sym_[j] == y
            i, j = i[ok], j[ok]
            k = after_[j]
            sym_[i], sym_[j] = new, -1
            after_[i], before_[k] = k, i
            for follows, neighbour, left in ((True, k, i), (False, before_[i], None)):
                keys, ranks = self.beside(follows, new)
                if not len(keys):
                    continue
                said = sym_[neighbour]
                slot = np.minimum(np.searchsorted(keys, said), len(keys) - 1)
                hit = np.flatnonzero(keys[slot] == said)
                made = ranks[slot[hit]]
                hit = hit[np.argsort(made, kind="stable")]
                made.sort()
                cut = np.flatnonzero(np.diff(made)) + 1
                for a, b in zip([0, *cut.tolist()] if len(made) else [], [*cut.tolist(), len(made)]):
                    file(int(made[a]), (neighbour if left is None else left)[hit[a:b]].tolist())
        keep = sym_ >= 0
        return sym_[keep], np.concatenate([[0], np.cumsum(keep)[gaps]])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the edges of texts.

        A text in which every white-space character stands alone between others is cut at its spaces into runs; each
        distinct run of the slice is cut into pieces once. A run that begins with neither NUL, which is left out, nor a
        line end has a space before it. Other texts are one run, which is cut by the pattern."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, UNEVEN)
        for t in ["\0", *self.special]:
            odd = pc.or_(odd, pc.match_substring(column, t))
        odd = odd.to_numpy(zero_copy_only=False)
        rest = column.filter(pa.array(~odd))
        marked = pc.replace_substring(pc.binary_join_element_wise("\0", rest, ""), "\n", " \n")
        parts = pc.split_pattern(marked, " ")
        runs = parts.flatten().dictionary_encode()
        many = np.zeros(len(column), dtype=np.int64)
        many[~odd] = np.diff(parts.offsets.to_numpy())
        many[odd] = 1
        edges = np.concatenate([[0], np.cumsum(many)])
        codes = np.empty(edges[-1], dtype=np.int64)
        alone = np.zeros(len(codes), dtype=bool)
        alone[edges[:-1][odd]] = True
        codes[~alone] = runs.indices.to_numpy()
        codes[alone] = len(runs.dictionary) + np.arange(int(odd.sum()))
        ids, ends = self.of_runs(runs.dictionary, column.filter(pa.array(odd)).to_pylist())
        out, at = gather(ids, ends, codes)
        return out, at[edges]

    def of_runs(self, runs: pa.Array, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each run and of each whole text, and their edges."""
        flat, edges = bytes_of(runs)
        easy, core = plain(flat, edges)
        at = np.flatnonzero(easy)
        # Plain runs are a space with letters and, perhaps, a piece of marks.
        size = core[at] - edges[at]
        cut = np.concatenate([[0], np.cumsum(size + 1)])
        spaced = np.full(cut[-1], 32, dtype=np.uint8)
        inside = np.ones(len(spaced), dtype=bool)
        inside[cut[:-1]] = False
        spaced[inside] = flat[np.repeat(edges[at] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(at) else at, size) + np.arange(int(size.sum()))]
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(spaced)]).dictionary_encode()
        data = flat.tobytes()
        tails = [data[a:b] for a, b in zip(core[at].tolist(), edges[at + 1].tolist())]
        # Pieces of all others by the pattern; special tokens stand for themselves.
        number: dict[bytes, int] = {}
        first = len(words.dictionary)
        ends = [number.setdefault(t, first + len(number)) if t else -1 for t in tails]
        others: list[list[int]] = []
        for run in runs.filter(pa.array(~easy)).to_pylist():
            found = self.pieces(run[1:] if run[:1] == "\0" else run if run[:1] == "\n" else " " + run)
            others.append([number.setdefault(p.encode(), first + len(number)) for p in found])
        for text in whole:
            found = [p if p in self.special else q.encode() for p in self.parted(text) for q in ([p] if p in self.special else self.pieces(p))]
            others.append([number.setdefault(p, first + len(number)) for p in found])
        listed = [p for p in number]
        signs = {number[p]: self.special[p] for p in listed if isinstance(p, str)}
        more = [p.encode() if isinstance(p, str) else p for p in listed]
        a, b = bytes_of(words.dictionary)
        raw = np.concatenate([a, np.frombuffer(b"".join(more), dtype=np.uint8)])
        ids, parts = self.merge(raw, np.concatenate([b, b[-1] + np.cumsum([len(p) for p in more], dtype=np.int64)]))
        if signs:  # whatever their text was merged to
            sizes = np.diff(parts)
            where = np.array(sorted(signs))
            keep = ~np.repeat(np.isin(np.arange(len(sizes)), where), sizes)
            keep[parts[where]] = True
            ids[parts[where]] = [signs[i] for i in where.tolist()]
            ids, sizes[where] = ids[keep], 1
            parts = np.concatenate([[0], np.cumsum(sizes)])
        # Runs -> pieces -> ids.
        tail = np.array(ends, dtype=np.int64)
        count = np.ones(len(runs) + len(whole), dtype=np.int64)
        count[at] += tail >= 0
        count[np.concatenate([np.flatnonzero(~easy), len(runs) + np.arange(len(whole))])] = [len(o) for o in others]
        run_edges = np.concatenate([[0], np.cumsum(count)])
        pieces = np.empty(run_edges[-1], dtype=np.int64)
        mine = np.zeros(len(pieces), dtype=bool)
        mine[run_edges[at]] = True
        pieces[run_edges[at]] = words.indices.to_numpy()
        mine[run_edges[at][tail >= 0] + 1] = True
        pieces[run_edges[at][tail >= 0] + 1] = tail[tail >= 0]
        pieces[~mine] = [i for o in others for i in o]
        values, piece_edges = gather(ids, parts, pieces)
        return values, piece_edges[run_edges]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 become replacement characters."""
        data, at = gather(self.bytes, self.edges, ids)
        kind = pa.large_string()
        out = pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(at[edges].astype(np.int64)), pa.py_buffer(data)])
        try:
            out.validate(full=True)
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            whole, cut = data.tobytes(), at[edges].tolist()
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])], pa.string())


def listed(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids, pa.int32()))


def _index(spec: str) -> PairIndex:
    kept = worker_store("bpe", arrays=False)
    if spec not in kept:
        kept.clear()
        kept[spec] = PairIndex(spec)
    return kept[spec]


def _spec(spark: SparkSession, path: str | None):
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its ids as array<int>."""
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(spec.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed(*index.encode(part.column("text")))], ["doc_id", "ids"])

    rows = texts(docs, key, text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of encode() and the decoded text."""
    spec = _spec(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(spec.value)
        for batch in batches:
            ids = batch.column("ids")
            step = max(1, batch.num_rows * 2_000_000 // max(1, len(ids.values)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids, edges = part.column("ids"), part.column("ids").offsets.to_numpy()
                out = index.decode(ids.values.to_numpy()[edges[0] : edges[-1]], edges - edges[0])
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: the ids do not leave the worker in between."""
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(spec.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, edges = index.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed(ids, edges), index.decode(ids, edges)], ["doc_id", "ids", "decoded"])

    rows = texts(docs, key, text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents there and back, with digests of ids and text."""
    both = round_trip(read(spark, sf_dir, "documents"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
