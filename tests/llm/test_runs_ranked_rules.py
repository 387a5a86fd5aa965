"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR, rows_of
from pyspark.sql import functions as F

from sievework.llm import op11_runs, op12_ranked, op13_rules
from sievework.llm.common import materialize
from sievework.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def texts():
    """With copies, runs, odd white space, nulls, an empty and a very long text, a null and a repeated id."""
    rng = random.Random(11)
    some = lambda n, of=40: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    rows = [some(rng.randrange(60), rng.choice([1, 2, 3, 40])) for _ in range(60)]
    rows += [f"{some(9)} {' '.join([some(k)] * 6)} {some(5)}" for k in (1, 2, 3, 7, 20)]
    rows += [rows[3], rows[3], None, "", " \t\x0b\n", "\ta\x0bb c\n\nd  e ", "Été ÉTÉ x-Y_z 12#$|<", some(20_000), "x y", "a a a a a a", "same line\nsame line \nsame line\n\n \nother"]
    return [*enumerate(rows), (None, rows[4]), (5, "again under an id"), (7, rows[7])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    clash = ("hash", "runs", "kept", "term", "df", "score", "w", "h", "names", "bad", "rule", "n_words", "shard")
    return spark.createDataFrame(texts, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in clash)).repartition(3)


# ---- 11 -----------------------------------------------------------------------------------------------------------


def runs_in(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if (n := j - i + q) >= max(least, times * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_of(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_all_runs_of_small_alphabets():
    rng = random.Random(2)
    for _ in range(400):
        least, times = rng.choice([(6, 4), (6, 4), (4, 2), (2, 2), (5, 3)])
        texts = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.choice([0, 1, 3, 8, 20, 60]))] for _ in range(rng.randrange(1, 5))]
        edges = np.cumsum([0, *map(len, texts)])
        got = sorted(zip(*(x.tolist() for x in op11_runs.all_runs(np.array(sum(texts, []), dtype=np.int64), edges, least, times))))
        assert got == sorted((int(e) + s, n, q) for e, t in zip(edges, texts) for s, n, q in runs_in(t, least, times))


def test_least_of_ranges_and_common_prefixes():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 50, 700).astype(np.int32)
    table = op11_runs.Minima(x)
    low, high = np.sort(rng.integers(0, 700, (2, 3000)), axis=0)
    assert table.least(low, high).tolist() == [x[a : b + 1].min() for a, b in zip(low, high)]
    text = np.append(rng.integers(1, 3, 300), 0)
    rank = op11_runs.suffix_ranks(text)
    assert np.argsort(rank).tolist() == sorted(range(301), key=lambda i: text[i:].tolist())


def test_runs_of_texts(docs, texts):
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"]) for r in op11_runs.runs(docs).collect()]
    want = [(i, len(w), rs, kept_of(w, rs)) for i, t in texts for w in [WORD.findall(t or "")] if len(w) < 5000 for rs in [runs_in(w)]]
    assert sorted(map(repr, (g for g in got if g[1] < 5000))) == sorted(map(repr, want)) and len(got) == len(texts)
    assert any(len(w[2]) > 0 for w in want)
    assert op11_runs.runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        op11_runs.all_runs(np.arange(3), np.array([0, 3]), times=1)


def test_one_long_text_of_one_word():
    codes = np.zeros(200_000, dtype=np.int64)
    assert [x.tolist() for x in op11_runs.all_runs(codes, np.array([0, len(codes)]))] == [[0], [len(codes)], [1]]


def test_op11_query(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op11_runs"](spark, SF_DIR).collect()}
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    seen = 0
    for i, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w[a:] = [w[a + (k - a) % p] for k in range(a, len(w))]
        if len(w) > 3000:
            continue
        rs = runs_in(w)
        seen += len(rs)
        best = max(rs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(rs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in rs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept_of(w, rs).encode()).hexdigest()
    assert seen > 10


# ---- 12 -----------------------------------------------------------------------------------------------------------


def ranked(docs, items, k):
    lowered = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, Counter(lowered(t))) for i, t in docs if i is not None]
    rows = [(i, c, sum(c.values())) for i, c in rows]
    n, total = sum(x[2] > 0 for x in rows), sum(x[2] for x in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(lowered(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c, size in rows:
            m = 50 + 50 * size * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,shard,block", [(50, 12 << 20, 500_000), (3, 400, 500_000), (1, 5000, 7), (1000, 2000, 60)])
def test_search_equals_brute_force(spark, docs, texts, k, shard, block):
    rng = random.Random(k)
    items = [(i, " ".join(f"W{rng.randrange(45)}" for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    items += [(30, "été x y_z absent"), (31, None), (32, "??"), (None, "w1"), (3, "w2 w2 W3"), (33, "absent")]
    asked = op12_ranked.asked_terms(spark.createDataFrame(items, "item_id int, text string"))
    got = op12_ranked.search(op12_ranked.build(docs, shard=shard), asked, k, block)
    assert got.schema["item_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == ranked(texts, items, k)


def test_search_of_nothing(spark, docs):
    asked = op12_ranked.asked_terms(spark.createDataFrame([(1, "w1")], "item_id int, text string"))
    assert op12_ranked.search(op12_ranked.build(docs.where("false")), asked).count() == 0
    assert op12_ranked.search(op12_ranked.build(docs), asked.where("false")).count() == 0
    assert op12_ranked.search(op12_ranked.build(docs.where("length(trim(text)) = 0")), asked).count() == 0


def test_numbers_as_bytes():
    x = np.concatenate([np.arange(300), 2 ** np.arange(50), np.random.default_rng(1).integers(0, 1 << 40, 500)])
    raw, size = op12_ranked.packed(x)
    assert op12_ranked.unpacked(raw).tolist() == x.tolist() and size.sum() == len(raw)


def test_op12_query(spark, duck):
    assert rows_of(QUERIES["op12_ranked"](spark, SF_DIR).toPandas()) == rows_of(duck.execute(ORACLES["op12_ranked"]).df())


# ---- 13 -----------------------------------------------------------------------------------------------------------


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_equal_brute_force(docs, texts):
    got = [(r["doc_id"], *(r[c] for c in BASE)) for r in op13_rules.statistics(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *counted(t))) for i, t in texts)
    assert op13_rules.statistics(docs.where("false")).count() == 0


def covering(rows):
    """The same list from plain rows: (features, bad, grow)."""
    names = list(rows[0][0])
    quantile = lambda v, k: v[max(0, math.ceil(k / 32 * len(v)) - 1)]
    cuts = {}
    for name in names:
        cuts[name] = sorted({quantile(v, k) for b in (0, 1) for v in [sorted(f[name] for f, bad, _ in rows if bad == b)] if v for k in range(33)})
    holds = lambda c, f: all(f[n] < v if below else f[n] >= v for n, below, v in c)
    count = lambda c, rs: tuple(sum(1 for f, bad, _ in rs if bad == b and holds(c, f)) for b in (1, 0))
    out, left = [], rows
    while True:
        grow, rule = [r for r in left if r[2]], []
        while len(rule) < 4:
            p0, n0 = count(rule, grow)
            if not p0 or not n0:
                break
            gain, best = 0.0, None
            for name in names:
                for below in (False, True):
                    for v in cuts[name]:
                        p, n = count([*rule, (name, below, v)], grow)
                        if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                            gain, best = g, (name, below, v)
            if best is None:
                break
            rule.append(best)
        if not rule:
            return out
        held = [r for r in left if not r[2]]
        end = max(range(1, len(rule) + 1), key=lambda e: ((count(rule[:e], held)[0] + 1) / (sum(count(rule[:e], held)) + 2), -e))
        p, n = count(rule[:end], left)
        if p < 3 or p < 0.9 * (p + n):
            return out
        out.append((tuple(rule[:end]), p, n))
        left = [r for r in left if not holds(rule[:end], r[0])]


def test_learned_list_equals_plain_covering(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(260):
        bad = rng.random() < 0.3
        kind = rng.randrange(3) if bad else 3
        n = rng.randrange(20, 60)
        w = [f"{rng.choice('abcdefgh')}{rng.choice(['o', 'ee', 'ui'])}{rng.randrange(50)}" for _ in range(n)]
        size = rng.randrange(1, 4)
        w = [x * size for x in w]
        if kind == 0:
            w = [x + "##" for x in w]
        elif kind == 1:
            w = [x.upper() for x in w]
        elif kind == 2:
            w = [x * 5 for x in w]
        if rng.random() < 0.1:
            w = [x.upper() if rng.random() < 0.5 else x + "#" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 0), (0, None), (1, 7), (900, 0), (2, 1)]
    stats = op13_rules.statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = op13_rules.learn(stats, marks)
    quality = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            quality[i] = min(q, quality.get(i, 1))
    plain = []
    for i, t in rows:
        n, chars, symbols, dup, repeat = counted(t)
        if n >= 10 and 100 * repeat <= 20 * n:
            f = {"words": n, "word_length": chars / n, "symbols": symbols / n, "repeated_lines": dup / 1, "repeated_words": repeat / n, "capitals": sum(c.isupper() for c in t) / chars, "digits": sum(c.isdigit() for c in t) / chars}
            plain.append((f, 1 - quality[i], zlib.crc32(str(i).encode()) % 3 != 2))
    want = covering(plain)
    assert [(tuple((c.feature, c.below, c.value) for c in r.conditions), r.bad, r.good) for r in rules] == want and len(want) >= 2
    judged = {r["doc_id"]: r for r in op13_rules.judged(stats, rules).collect()}
    wrong = sum(r["kept"] != bool(quality[i]) for i, r in judged.items())
    assert wrong <= 0.1 * len(rows)
    assert "CASE WHEN" in op13_rules.verdict(rules)._jc.toString() and str(rules[0]).endswith("good)")


def test_no_labels_keep_what_passes(spark, docs):
    stats = materialize(op13_rules.statistics(docs))
    none = spark.createDataFrame([], "doc_id long, quality int")
    for marks in (none, stats.select("doc_id", F.lit(1).alias("quality")), stats.select("doc_id", F.lit(0).alias("quality"))):
        assert op13_rules.learn(stats, marks) == []
    assert op13_rules.judged(stats, []).where("kept = base_failed OR rule IS NOT NULL").count() == 0


def test_op13_query(spark, duck):
    found = QUERIES["op13_rules"](spark, SF_DIR)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    got = {r["doc_id"]: r for r in found.collect()}
    rows = duck.execute("SELECT doc_id, text, quality FROM documents LEFT JOIN labels USING (doc_id)").fetchall()
    assert len(got) == len(rows)
    for i, text, quality in rows:
        c = counted(text)
        assert tuple(got[i][k] for k in BASE) == c
        assert got[i]["base_failed"] == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
        if quality == 1 and not got[i]["base_failed"]:
            assert got[i]["kept"]


# ---- earlier operators --------------------------------------------------------------------------------------------


def test_every_word_gives_its_term_whatever_its_length():
    import pyarrow as pa

    from sievework.llm import op3_quality as m

    for n in (3, m.LONG, m.LONG + 1, 3 * m.LONG):
        word = ("ab" * n)[:n]
        a, b = m.terms_of(word)
        x = m.weights(pa.array([f"{word} {word}"]))[0] ** 2
        assert x[a] > 1.99 and x[b] > 1.99
        if n > m.LONG:
            terms, times = m.terms_of_run(word)
            want = np.zeros(m.DIM)
            np.add.at(want, terms, 2 * times)
            want[a] += 2
            want[b] += 2
            assert np.allclose(x[: m.DIM - 2], want[: m.DIM - 2])


def test_neighbours_are_exact_where_no_setting_has_the_recall(spark, monkeypatch):
    from sievework.llm import op2_ann as m

    monkeypatch.setattr(m, "RECALL", 1.5)
    x = np.random.default_rng(9).normal(size=(300, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 12)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in m.neighbours(rows, F.col("id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert found[q] == np.argsort(-s, kind="stable")[:7].tolist()
    assert len(found) == 15


def test_scores_equal_all_cosines_by_hand():
    """The votes of op3, from its own projection, with every cosine computed and sorted."""
    import pyarrow as pa

    from sievework.llm import op3_quality as m

    rng = random.Random(4)
    make = lambda bad: " ".join(rng.choice(["of", "the", "and"]) + ("###" if bad and rng.random() < 0.4 else "") + str(rng.randrange(30) if bad else "") for _ in range(30))
    y = np.array([i % 2 for i in range(120)])
    sample = [make(not b) for b in y]
    space = m.Space(m.weights(pa.array(sample)), y, 0.7)
    texts = [make(i % 3 == 0) for i in range(60)] + [sample[0], sample[0], "", None, "zzz"]
    got = space.score(pa.array(texts, pa.string()))
    fold = lambda t: space_of(m, space, t)
    known = fold(sample)
    for i, v in enumerate(fold(texts)):
        cos = known @ v
        near = np.argsort(-cos, kind="stable")[: m.NEIGHBOURS]
        vote = np.maximum(cos[near], 0) ** m.SHARPNESS * space.vote[near]
        want = (vote * y[near]).sum() / vote.sum() if vote.sum() > 0 else space.share
        assert abs(got[i] - want) < 2e-3, i
    assert got[60] == got[61] and got[62] == got[63] == pytest.approx(0.7)


def space_of(m, space, texts):
    import pyarrow as pa

    x = m.weights(pa.array(texts, pa.string())) * space.idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    z = x @ space.axes
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
