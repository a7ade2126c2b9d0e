import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from velloom.llm import toxicity

DDL = "doc_id long, text string, lang string, source string, score string, y string"


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["ba", "re", "to", "mi", "sul", "ken", "dor", "ti", "an"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        y = int(rng.random() < 0.2)
        for _ in range(len(w) // 25 + 1 if y else 0):
            w[rng.randrange(len(w))] = rng.choice(["grulf", "zwick", "vex"]) + rng.choice(parts)
        rows.append((i, " ".join(w), "en", "s", "x", "z"))
        labels.append((i, y, y))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, table):
    rows, labels = corpus(1500, 1)
    odd = [(9000, None), (9001, ""), (9002, "\n\t"), (9003, "ba re " * 40_000), (9004, "q" * 30_000), (None, "ba re to")]
    table([*labels, (1, None, None), (2, 5, 7), (99_999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int", "labels")
    d = table([*rows, *[(*o, "", "", "", "") for o in odd], (*odd[3], "", "", "", "")], DDL)
    got = toxicity.op5_toxicity(spark, d).collect()
    assert len(got) == len(rows) + len(odd) + 1
    y = dict((i, t) for i, _, t in labels)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    a, b = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([p > q for p in a for q in b]) > 0.95
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.93
    assert [r.predicted for r in got if r.doc_id in (9000, 9001, 9002, 9003)] == [0] * 5


def test_empty(spark, table):
    table([], "doc_id long, quality int, toxic int", "labels")
    assert toxicity.op5_toxicity(spark, table([], DDL)).collect() == []
    rows, _ = corpus(5, 2)
    assert {r.score for r in toxicity.op5_toxicity(spark, table(rows, DDL)).collect()} == {0.5}


def normal(text):
    return " " * 4 + " ".join(w[i : i + 40] for w in re.findall(r"\w+", text.lower()) for i in range(0, len(w), 40)) + " "


def fives(text):
    return [text[i : i + 5] for i in range(len(text) - 4)]


def kneser_ney(texts, toxic, ordinary):
    """Probability of a character after a context by class, straight from the definition."""
    longer = {g for t in texts for g in fives(normal(t))}
    counts = {}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in longer)
        longer = set(counts[k])

    def discounted(c, gram, prior, below):
        inside = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        total = sum(inside.values())
        taken = sum(min(n, 0.75) for n in inside.values())
        return (max(c.get(gram, 0) - 0.75, 0) + (taken + prior) * below) / (total + prior)

    def share(gram):
        if not gram:
            return 1 / len(counts[1])
        return discounted(counts[len(gram)], gram, 1e-3, share(gram[1:]))

    own = [Counter(g for t in some for g in fives(normal(t))) for some in (ordinary, toxic)]
    least = min(sum(c.values()) for c in own)
    own = [{g: n * (least / sum(c.values())) for g, n in c.items()} for c in own]
    return lambda y, gram: discounted(own[y], gram, 1.0, share(gram[1:]))


def counted(spark, toxic, ordinary):
    own = [Counter(g for t in some for g in fives(normal(t))) for some in (ordinary, toxic)]
    least = min(sum(c.values()) for c in own)
    return spark.createDataFrame([(y, g, n * (least / sum(c.values()))) for y, c in enumerate(own) for g, n in c.items()], "y int, gram string, n double")


def test_ratios_against_kneser_ney_by_definition(spark):
    toxic, ordinary = ["you vex me", "a vexing grulf", "ab ab"], ["a bee met me", "you met a bee", "mé ab 水"]
    texts = [*toxic, *ordinary, "bees and vexed grulfs", "水 水火 ab"]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "text string")
    p = kneser_ney(texts, toxic, ordinary)
    table = toxicity.Table(*toxicity.class_ratios(counted(spark, toxic, ordinary), toxicity.corpus_grams(docs)))
    for text in [*texts, "a text of none", "q", "you vex a bee met grulfs 火", "x" * 95]:
        rows = [math.log(p(1, g) / p(0, g)) for g in fives(normal(text))]
        words, now = [], 0.0
        for r, c in zip(rows, normal(text)[4:]):
            now += r
            if c == " ":
                words.append(now)
                now = 0.0
        top = max(1, len(words) // 30)
        want = [sum(rows) / len(rows), sum(sorted(words)[-top:]) / top, math.log(len(words) + 1)]
        assert np.allclose(toxicity.measures([text.encode()], table, table.rank())[0], want, atol=1e-12), text
    # every class's probabilities after a context are those of one choice
    letters = sorted({c for t in texts for c in normal(t)})
    for context in ("    ", " vex", "u me", "bee ", "zzzz"):
        assert all(abs(sum(p(y, context + c) for c in letters) - 1) < 1e-9 for y in (0, 1)), context


def test_long_texts_in_parts(monkeypatch, spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeéß水") for _ in range(rng.randint(1, 90))) for _ in range(400)) + ", end."
    table = toxicity.Table({g: rng.random() for g in set(fives(normal(text))) if rng.random() < 0.6}, {g[:4]: rng.random() for g in fives(normal(text)) if rng.random() < 0.8})
    whole, rank = toxicity.measures([text.encode(), b"", b"...", b"ab"], table, table.rank()), table.rank()
    grams = Counter(fives(normal(text)))
    monkeypatch.setattr(toxicity, "PIECE", 500)
    parts = list(toxicity.parts(text.encode()))
    assert len(parts) > 10 and parts[0] + "".join(p[4:] for p in parts[1:]) == normal(text)
    assert np.allclose(toxicity.measures([text.encode(), b"", b"...", b"ab"], table, rank), whole, atol=1e-12)
    got = Counter()
    for piece in toxicity.pieces(iter(parts)):
        got.update(dict(zip(*map(list, toxicity.tally(piece)))))
    assert got == grams


def test_large_alphabets():
    rng = random.Random(4)
    texts = ["    " + "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(9000)) + " " for _ in range(2)]
    grams = Counter(g for t in texts for g in fives(t))
    assert dict(zip(*map(list, toxicity.tally(texts)))) == grams and len(set("".join(texts))) > 7131
    table = toxicity.Table({g: float(i + 1) for i, g in enumerate(grams)}, {})
    points = toxicity.code_points(texts)
    want = {g: float(i + 1) for i, g in enumerate(grams)}
    assert table.ratios(points, table.rank())[4:9000].tolist() == [want[g] for g in fives(texts[0])][: 9000 - 4]


def test_extra_columns_pass_through(spark):
    rows, labels = corpus(300, 5)
    docs = spark.createDataFrame([(i, t, {"a b": i}, [1.0]) for i, t, *_ in rows], "doc_id long, text string, f0 struct<`a b`:long>, c1 array<double>")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model, keep=["f0", "text", "c1"])
    assert got.columns == ["doc_id", "score", "predicted", "f0", "text", "c1"] and got.count() == 300
    assert {(r.doc_id, r.text, r.f0["a b"]) for r in got.collect()} == {(i, t, i) for i, t, *_ in rows}


def test_a_higher_ratio_never_lowers_a_score():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    x = np.column_stack([rng.normal(size=600) - y, rng.normal(size=600) + 2 * y, rng.normal(size=600)])
    w = toxicity.rising(x, y, np.array([1.0, 1.0]))
    plain = toxicity.logistic(x[:, 1:], y, np.array([1.0, 1.0]))
    assert w[7] == 0 and w[8] > 0 and np.allclose(toxicity.probability(x, w), toxicity.probability(x[:, 1:], plain))
