"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are turned into log likelihoods of each language and added: the text (character trigrams of its
words), the language that the markup or metadata declares, the code in its address (a language segment in the path, or
else the two-letter ending of the host), and a prior of its host. What a declared value, a segment or an ending says about
a language is learned from the corpus by grouped sums of the text's posteriors, and so are the priors: host over site over
address ending over the whole corpus, each level smoothed towards the one above it.

The text model is fitted on a bounded sample: up to SAMPLE documents, in hash order, of every language that the labels
name, fewer of each where many languages would make it more than ROWS in all. Trigrams are counted where the texts are;
only their counts come to the driver. Sums of the corpus cover every row, and every trigram of a whole text counts.

Beside the languages stands an unknown one, whose trigrams are each as likely as the middle (of logarithms) between a
typical trigram of the text's best language and one that no sample has; the latter is charged alike in all languages.
It takes its share of every posterior, so that texts in languages that the labels do not name, and gibberish, neither
count as evidence nor reach CERTAIN.

A document is rejected if no language reaches CERTAIN or if its text has no letters. lang is the likeliest of the
languages even then; text_lang is null if the text alone is likelier unknown. Cases: a null or empty text has
no text evidence, is decided by the rest, and is rejected for want of letters; a null declared language, url or host
is no evidence. Without labels no language is known and everything is rejected. Repeated rows are decided alike. Other
columns are kept, but for those named as results (lang, score, text_lang, accepted), which the results replace.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read, slices, small_batches, worker_store
from sievework.llm.op10_html import main_text
from sievework.llm.words import split

#: Labelled documents of each language at most, and of all, but at least one of each.
SAMPLE, ROWS = 300, 19_200
#: Weight of trigrams, which are not independent.
TEMPER = 0.3
#: Smoothing of counts, strength of a prior's parent, and least posterior of an accepted language.
ALPHA, STRENGTH, CERTAIN = 0.5, 5.0, 0.6
#: Prior of the unknown language.
STRANGE = 0.01
#: Numbers that a worker keeps about words, and that it adds up at a time.
CACHE, CELLS = 1_500_000, 8_000_000
#: Columns that identify() adds.
RESULTS = ("lang", "score", "text_lang", "accepted")
LETTERS = re.compile(r"[^\W\d_]+")


class Trigrams:
    """Log likelihood of a word's trigrams in each language."""

    def __init__(self, counted: dict[str, dict[str, int]]):
        """counted: how often each trigram occurs in the sample of each language."""
        self.name = uuid.uuid4().hex
        self.languages = sorted(counted)
        counts = [counted[x] for x in self.languages]
        grams = sorted(set().union(*counts)) if counts else []
        self.at = {g: i for i, g in enumerate(grams)}
        n = len(grams) + 1
        totals = [sum(c.values()) + ALPHA * n for c in counts]
        self.floor = math.log(ALPHA / max(totals, default=1.0))
        self.unknown = np.full(len(self.languages), self.floor)  # of a trigram, by the text's best language
        # Only trigrams that a language has: for each trigram, its languages and how far they are above the floor.
        of, language, above = [], [], []
        for j, (c, total) in enumerate(zip(counts, totals)):
            values = np.array([math.log((k + ALPHA) / total) for k in c.values()])
            of.append(np.array([self.at[g] for g in c], dtype=np.int64))
            language.append(np.full(len(c), j))
            above.append(values - self.floor)
            if c:
                self.unknown[j] = (np.average(values, weights=list(c.values())) + self.floor) / 2
        of = np.concatenate([np.zeros(0, np.int64), *of])
        order = np.argsort(of, kind="stable")
        self.start = np.searchsorted(of[order], np.arange(n + 1))
        self.language = np.concatenate([np.zeros(0, np.int64), *language])[order]
        self.above = np.concatenate([np.zeros(0), *above])[order]

    def sums(self, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, languages) of the log likelihoods of each word's trigrams; the last number stands for unseen ones."""
        n, sizes = len(self.languages), np.diff(ends, prepend=0)
        many = self.start[grams + 1] - self.start[grams]
        word = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many)
        at = np.repeat(self.start[grams] - np.cumsum(many) + many, many) + np.arange(len(word))
        above = np.bincount(word * n + self.language[at], weights=self.above[at], minlength=len(sizes) * n)
        return above.reshape(len(sizes), n) + sizes[:, None] * self.floor

    @staticmethod
    def of(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) of tempered log likelihoods, the same of the unknown language, and letters of each text."""
        edges, codes, dictionary = split(column)
        words = dictionary.to_pylist()
        n = len(self.languages)
        store = worker_store("language")
        if store.get("of") != self.name or len(store["at"]) + len(words) > len(store["facts"]):
            store.update(of=self.name, at={}, facts=np.zeros((max(CACHE // (n + 2), len(words)), n + 2)))
        at, facts = store["at"], store["facts"]
        missing = [w for w in words if w not in at]
        if missing:
            parts = [LETTERS.findall(w.lower()) for w in missing]
            get = self.at.get
            grams = [[get(g, len(self.at)) for p in ps for g in self.of(p)] for ps in parts]
            ends = np.cumsum([len(g) for g in grams])
            new = slice(len(at), len(at) + len(missing))
            facts[new, :n] = self.sums(np.array([g for gs in grams for g in gs], dtype=np.int64), ends)
            facts[new, n] = [len(g) for g in grams]
            facts[new, n + 1] = [sum(map(len, ps)) for ps in parts]
            at.update(zip(missing, range(new.start, new.stop)))
        place = np.fromiter((at[w] for w in words), dtype=np.int64, count=len(words))
        total, step = np.zeros((len(edges) - 1, n + 2)), max(1, CELLS // (n + 2))
        for a in range(0, len(codes), step):
            whole = np.concatenate([np.zeros((1, n + 2)), np.cumsum(facts[place[codes[a : a + step]]], axis=0)])
            cut = np.clip(edges - a, 0, len(whole) - 1)
            total += whole[cut[1:]] - whole[cut[:-1]]
        known = total[:, :n] * TEMPER
        unknown = self.unknown[known.argmax(axis=1)] * total[:, n] * TEMPER
        return known, unknown, np.rint(total[:, n + 1]).astype(np.int64)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Trigrams:
    """The text model from documents whose language a column names."""
    rows = docs.select(F.col(key).alias("id"), primary(F.col(label)).alias("y")).where("y IS NOT NULL AND id IS NOT NULL")
    each = min(SAMPLE, max(1, ROWS // max(1, rows.select("y").distinct().count())))
    first = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    chosen = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).drop("n")
    some = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")  # at most ROWS rows, or one of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for y, said in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(LETTERS.findall(said.lower())).items():
                    for gram in Trigrams.of(word):
                        counts[y][gram] += n
            rows = [(y, g, n) for y, c in counts.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.string(), pa.int64()))], ["y", "gram", "n"])

    found = small_batches(some).mapInArrow(run, "y string, gram string, n long").groupBy("y", "gram").agg(F.sum("n").alias("n"))
    per_language = found.groupBy("y").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    counted = {r["y"]: {g["gram"]: g["n"] for g in r["grams"]} for r in per_language.collect()}  # distinct trigrams of the sample
    for r in chosen.select("y").distinct().collect():  # languages whose sample has no letters
        counted.setdefault(r["y"], {})
    return Trigrams(counted)


def primary(code: Column) -> Column:
    """The primary part of a language code: en of en-GB; null if it is none."""
    found = F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def address(url: Column) -> tuple[Column, Column]:
    """The host and the code of an address: a language as a segment of the path, or the two-letter ending of the host
    with its dot."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    segment = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1)
    ending = F.regexp_extract(host, r"(\.[a-z]{2})$", 1)
    return F.when(host != "", host), F.coalesce(F.when(segment != "", segment), F.when(ending != "", ending))


def rows_of(values: np.ndarray) -> pa.Array:
    """A list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def identify(rows: DataFrame, model: Trigrams) -> DataFrame:
    """rows: text, markup (whether the text is a page whose main text counts), declared, host, code and any others,
    which are kept. Adds lang, score, text_lang, accepted."""
    spark = small_batches(rows).sparkSession
    languages = model.languages
    sent = spark.sparkContext.broadcast(model)  # bounded by SAMPLE and ROWS
    others = [c for c in rows.columns if c not in ("text", "markup", *RESULTS)]
    rows = rows.select("text", "markup", "declared", "host", "code", F.struct(*others).alias("rest"))
    kept = [f for f in rows.schema if f.name not in ("text", "markup")]
    room = max(1 << 16, (6 << 21) // (len(languages) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", room):
                said = part.column("text")
                if (pages := part.column("markup").to_pylist()).count(True):
                    said = pa.array([main_text(t) if page else t for t, page in zip(said.to_pylist(), pages)], pa.string())
                found, unknown, letters = sent.value.likelihoods(said)
                # What each row's text says alone, as shares of the languages and the unknown one; texts without letters say nothing.
                top = np.maximum(found.max(axis=1), unknown)[:, None]
                share = np.exp(found - top)
                share = share / (share.sum(axis=1, keepdims=True) + np.exp(unknown[:, None] - top)) * (letters > 0)[:, None]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), rows_of(found), rows_of(share), pa.array(unknown), pa.array(letters)], [*(f.name for f in kept), "likelihood", "share", "unknown", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", likelihood array<double>, share array<double>, unknown double, letters long"
    read_ = rows.select(*(f.name for f in kept), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("markup", F.lit(False)).alias("markup"))
    if not languages:
        return read_.select("rest.*", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("accepted"))
    told = materialize(read_.mapInArrow(run, schema))

    peak = F.array_max("likelihood")
    sums = [F.sum(F.get("share", F.lit(i))).alias(f"n{i}") for i in range(len(languages))]
    site = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    placed = told.withColumn("site", F.when(site != "", site).otherwise(F.col("host"))).withColumn("ending", F.regexp_extract("site", r"([^.]*)$", 1))
    by_host = materialize(placed.groupBy("host", "site", "ending").agg(*sums))
    n = [f"n{i}" for i in range(len(languages))]

    def up(df: DataFrame, *key: str) -> DataFrame:
        return df.groupBy(*key).agg(*(F.sum(c).alias(c) for c in n))

    total = by_host.agg(*(F.sum(c).alias(c) for c in n)).first()  # one row
    counts = [float(total[c] or 0) for c in n]
    whole = [(c + 1) / (sum(counts) + len(counts)) for c in counts]

    def smooth(parents: list[Column]) -> list[Column]:
        size = F.aggregate(F.array(*n), F.lit(0.0), lambda a, x: a + x)
        return [(F.col(c) + STRENGTH * p) / (size + STRENGTH) for c, p in zip(n, parents)]

    p = [f"p{i}" for i in range(len(languages))]
    known = by_host.where("host IS NOT NULL")
    endings = up(known, "ending").select("ending", *(x.alias(c) for x, c in zip(smooth([F.lit(w) for w in whole]), p)))
    sites = up(known, "ending", "site").join(endings, "ending").select("site", *(x.alias(c) for x, c in zip(smooth([F.col(c) for c in p]), p)))
    hosts = known.drop("ending").join(sites, "site").select("host", F.array(*smooth([F.col(c) for c in p])).alias("prior"))

    # What declared values and address codes say: a row for each of the known languages, for each two-letter segment or
    # ending, and one for any other value.
    short = F.col("code").rlike(r"^\.?[a-z]{2}$")
    said = {
        "declared": F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other")),
        "code": F.when(F.col("code").isin(languages) | short, F.col("code")).when(F.col("code").isNotNull(), F.lit("other")),
    }

    def reliability(column: str) -> DataFrame:
        seen = told.where(F.col(column).isNotNull()).groupBy(said[column].alias(column)).agg(*sums)
        rows_ = {r[column]: [float(r[c]) for c in n] for r in seen.collect()}  # two alphabets' pairs of letters, or languages, at most
        table, values = [], sorted({*languages, "other", *rows_})
        sizes = [sum(r[i] for r in rows_.values()) for i in range(len(n))]
        for v in values:
            logs = [math.log((rows_.get(v, [0.0] * len(n))[i] + ALPHA + (4.0 if v == x else 0.0)) / (sizes[i] + ALPHA * len(values) + 4.0)) for i, x in enumerate(languages)]
            table.append((v, logs))
        return F.broadcast(spark.createDataFrame(table, f"_{column} string, {column}_log array<double>"))

    joined = told.join(hosts, "host", "left")
    for column in ("declared", "code"):
        joined = joined.join(reliability(column), said[column] == F.col(f"_{column}"), "left").drop(f"_{column}")
    zero = F.array(*(F.lit(0.0) for _ in languages))
    prior = F.coalesce("prior", F.array(*(F.lit(w) for w in whole)))
    logs = F.zip_with(F.zip_with("likelihood", F.transform(prior, lambda x: F.log(x)), lambda a, b: a + b), F.zip_with(F.coalesce("declared_log", zero), F.coalesce("code_log", zero), lambda a, b: a + b), lambda a, b: a + b)
    fused = joined.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    best = F.call_function("array_position", F.col("_logs"), F.col("_top")).cast("int") - 1
    names = F.array(*(F.lit(x) for x in languages))
    # The unknown language has a fixed prior and declares anything alike.
    anything = math.log(1 / (len(languages) + 1))
    told_any = sum((F.when(F.col(c).isNotNull(), anything).otherwise(0.0) for c in ("declared", "code")), F.lit(math.log(STRANGE)))
    strange = F.when(F.col("letters") > 0, F.exp(F.col("unknown") + told_any - F.col("_top"))).otherwise(0.0)
    score = 1 / (F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))) + strange)
    text_lang = F.when((F.col("letters") > 0) & (F.col("unknown") < peak), F.get(names, F.call_function("array_position", F.col("likelihood"), peak).cast("int") - 1))
    out = fused.select("rest", F.get(names, best).alias("lang"), score.alias("score"), text_lang.alias("text_lang"), "letters")
    return out.select("rest.*", "lang", "score", "text_lang", ((F.col("score") >= CERTAIN) & (F.col("letters") > 0)).alias("accepted"))


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """Documents: the language column is what is declared, the source stands for the host, there is no address."""
    return docs.select(F.col("doc_id"), "text", F.lit(False).alias("markup"), primary(F.col("lang")).alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("code"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Pages: main text, declared language of the markup, host and code of the address."""
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z_-]+)", 1)
    host, code = address(F.col("url"))
    return pages.select("page_id", F.col("html").alias("text"), F.lit(True).alias("markup"), primary(declared).alias("declared"), host.alias("host"), code.alias("code"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and of every document, with all evidence that each has."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs)
    pages = evidence_of_pages(read(spark, sf_dir, "pages"))
    both = evidence_of_documents(docs).unionByName(pages, allowMissingColumns=True)
    return identify(both, model).select("doc_id", "page_id", "host", "declared", "code", "text_lang", "lang", F.round("score", 6).alias("score"), "accepted")
