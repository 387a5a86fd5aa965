"""Quality rules: a decision list learned from labelled statistics, in DataFrame operations only.

Each text is described by counts (words, symbols, repeated lines, words in repeated windows, capitals, digits), and these
by features (`features`). Sequential covering learns rules for bad documents, one after the other, from the labelled
documents that pass the base rules and that no earlier rule takes. A rule grows on two thirds of them (by a hash of the
id): the threshold condition with the greatest information gain is added until no good document is left, none helps, or
it has CONDITIONS conditions. Each step counts bad and good documents by feature and bin, a small table. The rule is
then pruned on the last third: of all its beginnings, the one with the greatest precision (by Laplace, the shortest one
at ties) stays. It is taken if it holds COVER bad labelled documents at least and its precision on all reaches PRECISION;
else the list ends. Thresholds are quantiles of the bad and of the good documents. The list becomes one Spark expression,
`when(rule 1, false).when(rule 2, false)...otherwise(true)`.

Cases: a null text is empty; texts without words have zeros throughout and fail the base rules. Rows are independent:
rows with a null or a repeated doc_id, and repeated rows, are each answered. Labels without a doc_id or a quality of 0 or
1 do not count; of several labels of one doc_id the least one does. Without labels of both kinds the list is empty and
keeps what passes the base rules. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import materialize, read

BLANK = " \t\n\x0b\x0c\r"
#: Words of a window, and the base rules: least words, and most percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Quantiles that give thresholds, conditions of a rule and rules at most, bad documents of a rule at least, its precision.
QUANTILES, CONDITIONS, RULES, COVER, PRECISION = 32, 4, 16, 3, 0.9


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules ask about, from the columns of statistics()."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "capitals": _share("n_capitals", "word_chars"),
        "digits": _share("n_digits", "word_chars"),
    }


def _reached(x: Column, cuts: list[float]) -> Column:
    """How many of the thresholds x reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= x))


def _left(text: Column, pattern: str) -> Column:
    """Characters left when pattern is taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of its whole text, a row for each row of docs; no row is moved."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.btrim("text", F.lit(BLANK))
    rows = rows.select("*", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[ \t-\r]+")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    rows = rows.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.when(F.contains("text", F.lit("\n")), lines).otherwise(F.slice("w", 1, 1)).alias("l"))
    names = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW))))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _left(F.col("text"), "[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        _left(F.col("text"), r"\P{Lu}+").alias("n_capitals"),
        _left(F.col("text"), "[^0-9]+").alias("n_digits"),
        F.when(F.size("h") >= WINDOW, names).alias("names"),
    )
    # Most texts repeat no window; only those that do are sorted. Names that stand beside an equal one are repeated.
    again = F.size(F.array_distinct("names")) < F.size("names")
    rows = rows.withColumn("names", F.when(again, F.array_sort(F.transform("names", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = lambda x, k: (x["h"] == F.get("names", k - 1)["h"]) | (x["h"] == F.get("names", k + 1)["h"])
    starts = F.sort_array(F.transform(F.filter("names", beside), lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, none, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("names")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature >= value or, if below, feature < value."""

    feature: str
    below: bool
    value: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x < F.lit(self.value) if self.below else x >= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'<' if self.below else '>='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    """Conditions that all hold for bad documents; bad and good are the labelled documents that it took."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return _all(self.conditions)

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.conditions))}: bad ({self.bad} bad, {self.good} good)"


def _all(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """For each feature the quantiles of the bad and of the good documents, ascending."""
    at = F.array(*(F.lit(k / QUANTILES) for k in range(QUANTILES + 1)))
    row = labelled.agg(*(F.percentile_approx(F.when(F.col("bad") == b, x), at, 10_000).alias(f"{name}_{b}") for name, x in features().items() for b in (0, 1))).first()
    return {name: sorted({*(row[f"{name}_0"] or []), *(row[f"{name}_1"] or [])}) for name in features()}


def best_condition(counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]], bad: int, good: int) -> tuple[float, Condition | None]:
    """The greatest gain and its condition, of all thresholds, for counts of bad and good documents by feature and bin
    (the number of its thresholds that a value reaches). At ties the first feature, >= before <, the least threshold."""
    before = math.log2(bad / (bad + good))
    gain, best = 0.0, None
    for name, values in cuts.items():
        rows = [counts.get((name, b), (0, 0)) for b in range(len(values) + 1)]
        under = [(0, 0)]
        for p, n in rows:
            under.append((under[-1][0] + p, under[-1][1] + n))
        for below in (False, True):
            for j, value in enumerate(values):
                p, n = under[j + 1]
                if not below:
                    p, n = bad - p, good - n
                if p and (g := p * (math.log2(p / (p + n)) - before)) > gain + 1e-9:
                    gain, best = g, Condition(name, below, value)
    return gain, best


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list of statistics() and labels (doc_id, quality). Statistics should be written before (materialize):
    Spark moves filters on them into their expressions, which then are computed again and again."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = stats.where(~base_failed()).join(marks, "doc_id")
    growing = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 2
    rows = materialize(joined.select(*stats.columns, (1 - F.col("quality")).cast("int").alias("bad"), growing.alias("grow")))
    cuts = thresholds(rows)
    bins = [F.struct(F.lit(name).alias("feature"), _reached(x, cuts[name]).alias("bin")) for name, x in features().items() if cuts[name]]
    if not bins:
        return []
    left = binned = materialize(rows.withColumn("bins", F.array(*bins)))
    found: list[Rule] = []
    while len(found) < RULES:
        conditions: tuple[Condition, ...] = ()
        while len(conditions) < CONDITIONS:
            inside = left.where("grow").where(_all(conditions))
            counts = {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in inside.select("bad", F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("p"), F.count_if(F.col("bad") == 0).alias("n")).collect()}
            first = next(iter(features()))
            bad, good = (sum(v[i] for k, v in counts.items() if k[0] == first) for i in (0, 1))
            if not bad or not good:
                break
            gain, best = best_condition(counts, cuts, bad, good)
            if best is None:
                break
            conditions += (best,)
        if not conditions:
            break
        ends = range(1, len(conditions) + 1)
        sums = [F.count_if(_all(conditions[:e]) & held & (F.col("bad") == b)).alias(f"{name}{e}_{b}") for e in ends for b in (0, 1) for name, held in (("held", ~F.col("grow")), ("all", F.lit(True)))]
        row = left.agg(*sums).first()
        end = max(ends, key=lambda e: ((row[f"held{e}_1"] + 1) / (row[f"held{e}_1"] + row[f"held{e}_0"] + 2), -e))
        rule = Rule(conditions[:end], row[f"all{end}_1"], row[f"all{end}_0"])
        if rule.bad < COVER or rule.bad < PRECISION * (rule.bad + rule.good):
            break
        found.append(rule)
        left = binned.where(~_any(found))
    return found


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false where a rule holds, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def which(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1."""
    out = F.when(F.lit(False), F.lit(0))
    for i, r in enumerate(rules):
        out = out.when(r.column(), F.lit(i + 1))
    return out


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, kept and rule (the rule that took a document, null if none did)."""
    return stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules), "rule": F.when(~base_failed(), which(rules))})


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and the verdict of the list that labels teach."""
    stats = materialize(statistics(read(spark, sf_dir, "documents")))
    found = judged(stats, learn(stats, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
