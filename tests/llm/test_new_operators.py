"""op11 to op13 against plain versions: usual rows, odd rows, empty tables, clashing columns."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from mnemo.llm import decision_list as D
from mnemo.llm import hard_negatives as H
from mnemo.llm import spelling_variants as S

VECTORS = "vec_id long, embedding array<float>, label int, _row string, id string, x string, anchor string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS).repartition(3)


def mined(spark, rows, **options):
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = H.mine(vectors(spark, rows), F.col("id") % 50 == 0, label, **options).drop("positive_rank")
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(400):  # close labels, so that windows hold negatives; a hot label; ties by equal vectors
        label = int(rng.choice([0, 0, 0, 1, 2, 3]))
        v = centres[0] + 0.3 * centres[label] + 0.3 * rng.normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in v], label))
    rows += [(1000 + i, rows[3][1], 5 if i % 2 else 0) for i in range(30)]
    rows += [(2000, None, 1), (2050, [1.0] * 8, None), (2100, [1.0, None] * 4, 1), (2150, [float("nan")] * 8, 1),
             (2200, [float("inf")] * 8, 1), (2250, [], 1), (2300, [0.0] * 8, 2), (2350, [1e20] * 8, 2), (2400, [1.0, 2.0], 2),
             (2401, [2.0, 1.0], 2), (2403, [1.0, 1.0], 3), (2450, [-x for x in rows[0][1]], 9)]
    return rows


def test_hard_negatives(spark, vector_rows):
    want = brute.hard_negatives(vector_rows)
    assert len(want) > 50
    assert len({w[:2] for w in want}) > 20
    for block in (4096, 16):
        assert mined(spark, vector_rows, block=block) == want


def test_hard_negatives_odd_tables(spark, vector_rows):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    double = vector_rows[:60] + vector_rows[:60]  # equal ids are different rows
    found = mined(spark, double)
    assert found and all(f[2] <= 3 for f in found)
    assert mined(spark, vector_rows[:60] + [(None, [0.5] * 8, 1)])  # a null id is a row like others, after equal scores


def test_large_products_stay_exact():
    rng = np.random.default_rng(0)
    a = rng.integers(-(1 << 26), 1 << 26, (5, 64))
    assert (H.products(a, a[::-1]) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in a[::-1]] for p in a])).all()


def test_slots_decide(spark, vector_rows, monkeypatch):
    """Without the merge of lower slots, windows lose negatives."""
    want = brute.hard_negatives(vector_rows)
    uppers = {}
    for a, p, _, _, s, _ in want:
        uppers.setdefault(a, set()).add(math.floor(95 * s / 100))
    assert max(map(len, uppers.values())) > 1


TEXTS = ["", None, " \t\n\x0b\x0c\r ", "one two three " * 20, "a b c d a b c", "a a a a a", "x\ny\nx\n\n \n \nx\r\nx", "é# *$%&|<>! 漢字 ￿",
         "A\x1cB \x85\xa0 C", "one two three\nfour\ntwo three four one two three", "a b a b a b c a b"]


def test_statistics(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(30)]
    texts += ["\n".join(rng.choice(["x y", "z", ""]) for _ in range(20)), "w " * 30000, " ".join(map(str, range(30000))) + " 1 2 3 4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = D.statistics(rows, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == [(i, *brute.rules_counts(t)) for i, t in enumerate(texts)]


def corpus(rng, n):
    """Plain, symbol-ridden and toxic texts with their labels; a few labels are wrong."""
    docs, labels, bad = [], [], set()
    for i in range(n):
        w = [rng.choice(["la", "de", "ti", "on", "er"]) * rng.randrange(1, 4) + rng.choice("aeiou") for _ in range(rng.randrange(60, 120))]
        kind = rng.choice(["plain"] * 6 + ["symbols", "toxic"])
        if kind == "symbols":
            w = [x + "###" for x in w]
        if kind == "toxic":
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "nastyq", "foulz"])
        if kind != "plain":
            bad.add(i)
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if kind == "symbols" else 1, 1 if kind == "toxic" else 0))
    return docs, labels, bad


def judged(spark, docs, labels, **options):
    d = spark.createDataFrame([(*r, "a", "b", 1) for r in docs], "doc_id long, text string, n_words string, kept string, bad int")
    lab = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, prune string")
    return D.quality_rules(d.repartition(3), lab, **options)


def test_decision_list_learns(spark):
    docs, labels, bad = corpus(random.Random(8), 1500)
    known = [x for x in labels if x[0] < 900]
    rows = judged(spark, docs, known).collect()
    unseen = [r for r in rows if r["doc_id"] >= 900]
    caught = sum(not r["kept"] for r in unseen if r["doc_id"] in bad) / sum(r["doc_id"] in bad for r in unseen)
    left = sum(r["kept"] for r in unseen if r["doc_id"] not in bad) / sum(r["doc_id"] not in bad for r in unseen)
    assert caught > 0.95 and left > 0.98
    used = {r["rule"] for r in rows} - {None}
    assert len(used) >= 2 and any("marked" in u for u in used)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in rows)
    # switched off, the method rejects nothing here
    assert all(r["kept"] for r in judged(spark, docs[:50], []).collect())


def test_covering_prefers_gain_and_prunes(spark):
    """A condition that only the growing fold supports is cut away."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        bad, fold = i % 3 == 0, i % 5 > 2
        a = rng.uniform(0.7, 1) if bad else rng.uniform(0, 0.72)
        rows.append((fold, bad, a, rng.random()))
    learner = D.Learner(spark.createDataFrame(rows, "prune boolean, bad boolean, a double, b double"), ["a", "b"])
    rules = learner.learn()
    assert rules and all(rules[0][0] == c for c in rules[0][:1]) and rules[0][0].statistic == "a" and rules[0][0].least
    got = [r for r in rows if any(all((r[2 if c.statistic == "a" else 3] >= c.cut) == c.least for c in rule) for rule in rules)]
    assert sum(r[1] for r in got) > 0.9 * sum(r[1] for r in rows) and sum(not r[1] for r in got) < 0.1 * len(got)


def test_decision_list_odd_rows(spark):
    docs = [(1, None), (1, "a b"), (None, "w " * 60), (2, " ".join(f"w{i}" for i in range(80)))]
    labels = [(1, 0, 1), (1, None, None), (None, 0, 0), (2, None, 1), (2, 1, None), (3, 1, 0)]
    rows = judged(spark, docs, labels).collect()
    assert len(rows) == 4 and sorted(r["kept"] for r in rows) == [False, False, False, True]
    assert judged(spark, [], labels).count() == 0
    assert judged(spark, docs, []).count() == 4


def test_rules_are_native(spark):
    docs, labels, _ = corpus(random.Random(1), 300)
    plan = judged(spark, docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def variants(spark, rows, **options):
    d = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, word string, n string").repartition(3)
    return sorted(map(tuple, S.spelling_variants(d, **options).collect()))


def test_spelling_variants(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "abababab", "ÀÿÀÿÀ×÷"]
    rows = []
    for i in range(700):
        w = []
        for _ in range(rng.randrange(12)):
            x = list(rng.choice(base[:rng.randrange(1, len(base) + 1)]))
            if rng.random() < 0.15:
                at = rng.randrange(len(x))
                x[at:at + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
            w.append("".join(x).upper() if rng.random() < 0.1 else "".join(x))
        rows.append((i, rng.choice([" ", "-", "9", "Ā"]).join(w)))
    rows += [(None, " ".join(base)), (None, None), (7, ""), (8, "aaaaaaa " * 300), (9, "q" * 3000 + " ", ), (10, "q" * 3000), (11, "q" * 3000)]
    rows += [(20, "chains " * 3 + "chainsx " * 6 + "chainsxy " * 30)]
    want = brute.spelling(rows)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] != w[1] and w[1] for w in want)
    for size, block in ((5000, 5000), (7, 3)):
        assert variants(spark, rows, list_words=size, block=block) == want
    assert variants(spark, []) == []
    assert variants(spark, [(1, "ab cd")]) == []


def test_search_schemes_find_every_error():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(120)})
    index = S.Bidirectional(words)
    for forward in (True, False):
        q, w = index.near(words, forward)
        got = set(zip(q.tolist(), w.tolist()))
        want = set()
        for i, a in enumerate(words):
            h = len(a) // 2
            for j, b in enumerate(words):
                if brute.one_error(a, b):
                    fixed, rest = (a[:h], a[h:]) if forward else (a[h:], a[:h])
                    if (b.startswith(fixed) and brute.one_error(rest, b[len(fixed):])) if forward else \
                            (b.endswith(fixed) and brute.one_error(rest, b[:len(b) - len(fixed)])):
                        want.add((i, j))
        assert got == want
    assert set(zip(*map(np.ndarray.tolist, index.near(["zz", "zab"], True)))) >= set()


def test_vocabulary_counts_deleted_letters(spark):
    rows = [(i, "Planet planetes") for i in range(2000)]
    got = {w: n for w, n in S.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    for i, _ in rows:
        for run in ("planet", "planetes"):
            h = zlib.crc32(f"{i}:{run}".encode())
            w = run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]
            want[w] = want.get(w, 0) + 1
    assert got == {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
