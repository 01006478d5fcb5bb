"""Toxicity, language model scores and quality rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import cladeflow.llm.lm_scoring as lm
from cladeflow.llm.quality_rules import estimate, judge_quality
from cladeflow.llm.toxicity import present, score_toxicity, train, without_toxic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, rng):
    return [rng.choice(["The", "of", "and", *("".join(rng.choice("abdelnorst") for _ in range(6)) for _ in range(6))]) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w, toxic = words(rng.choice([5, 40, 400]), rng), rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "FOUL,", "rotten!"]))
        rows.append((i, " ".join(w), toxic))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.0), (700, "", 0.0), (3, rows[3][1], 0.0)], "doc_id long, text string, score double")
    return rows, docs, spark.createDataFrame([*labels, (None, 1), (5, None), (7, labels[7][1])], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    rows, docs, labels = labelled
    model = train(docs, labels.filter("doc_id % 4 <> 0"))
    got = {r.doc_id: r for r in score_toxicity(docs, model).filter("doc_id is not null").collect()}
    held = [(got[i].predicted, int(t)) for i, _, t in rows if i % 4 == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert score_toxicity(docs, model).count() == docs.count()
    clean = without_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in score_toxicity(docs, model).collect())
    again = train(docs.repartition(9), labels.filter("doc_id % 4 <> 0"))
    assert again.bias == pytest.approx(model.bias) and np.allclose(again.weights, model.weights)


def test_toxicity_without_labels_or_rows(labelled):
    _, docs, labels = labelled
    for model in (train(docs, labels.limit(0)), train(docs.limit(0), labels), train(docs, labels.filter("toxic = 0"))):
        assert {r.predicted for r in score_toxicity(docs, model).collect()} <= {0, 1}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_grams_of_long_texts_do_not_depend_on_parts(monkeypatch):
    import cladeflow.llm.toxicity as module

    text = " ".join(words(300, random.Random(1))) + " é\U0001f600"
    whole = present(text)
    monkeypatch.setattr(module, "CHUNK", 37)
    assert (present(text) == whole).all()
    assert len(present("")) == len(present("ab")) == 0


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_WORDS", 40)
    monkeypatch.setattr(lm, "CLASSES", 20)
    rng = random.Random(8)
    follows = {w: rng.sample("alpha beta gamma delta epsilon zeta eta theta".split(), 2) for w in "alpha beta gamma delta epsilon zeta eta theta".split()}
    rows = []
    for i in range(500):
        w = ["alpha"]
        for _ in range(rng.randrange(40)):
            w.append(rng.choice(follows[w[-1]]) if rng.random() < 0.95 else f"Rare{rng.randrange(60)}") if w[-1] in follows else w.append("alpha")
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "ÀÉ é \x1f" + "y" * 200), (503, "z" * 100), (503, "z" * 100), (None, "alpha")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")
    held = lambda i: i is not None and i % 5 == 2
    got = lm.score_documents(df, F.col("doc_id") % 5 == 2).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*WORD.findall(low(t)), None]
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) + 0.1 * sum(r.n_tokens for r in test)
    assert lm.score_documents(df.limit(0), F.lit(False)).count() == 0
    none = lm.score_documents(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    shares = np.array([4, 3, 2, 1, 1]) / 11
    p = lm.Parameters.start(shares)
    codes = rng.integers(0, 125, 4000)
    lm.improve(p, *np.unique(codes, return_counts=True), shares, rng, [])
    near, far, norm = p.tables()
    for u in range(5):
        for v in range(5):
            assert np.exp(near[v] + far[u] - norm[u, v]).sum() == pytest.approx(1, abs=1e-4)
    assert lm.trigrams([[1, 4], [2, 0, 4]], 4, 5).tolist() == [(4 * 5 + 4) * 5 + 1, (4 * 5 + 1) * 5 + 4, (4 * 5 + 4) * 5 + 2, (4 * 5 + 2) * 5 + 0, (2 * 5 + 0) * 5 + 4]


def measured(text):
    text = text or ""
    w, lines = WORD.findall(text), [s for s in text.split("\n") if WORD.search(s)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        w, kind = words(rng.choice([12, 60, 300]), rng), rng.choice(["good"] * 12 + ["symbols", "repeats", "capitals", "few"])
        if kind == "symbols":
            w = [x + rng.choice(["***", "###", "%%%"]) for x in w]
        if kind == "repeats":
            w = [x for x in w[:len(w) // 8 + 1] for _ in range(8)]
        if kind == "capitals":
            w = [x.upper() + "!!" for x in w]
        if kind == "few":
            w = w[:4]
        text = " ".join(w)
        if rng.random() < 0.3:
            text += "\n" + "\n".join([" ".join(w[:7])] * 2) + "\n \n\n"
        rows.append((i, text, kind))
    odd = [(None, None, "few"), (900, "", "few"), (901, " \t\n", "few"), (902, "é ü " * 40 + "<|>", None), (903, "a " * 5000, None), (903, "a b c d e f a b c d e", None), (903, "b a b a b a b a", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, kept string, n_words int")
    got = judge_quality(df).collect()
    want = sorted((str(i), *measured(t)) for i, t, _ in rows + odd)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    kind = {i: k for i, _, k in rows}
    verdict = [(kind[r.doc_id], r.kept, r.base_failed) for r in got if r.doc_id in kind]
    assert not [x for x in verdict if x[0] != "good" and x[1]]
    assert all(kept for k, kept, failed in verdict if k == "good" and not failed)
    assert judge_quality(df.limit(0)).count() == 0


def test_estimate_finds_accuracies():
    rng = random.Random(1)
    counts, truth = Counter(), {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple((1 if rng.random() < (0.8 if good else 0.2) else 0) if j < 3 else (-1 if rng.random() < (0.01 if good else 0.5) else 0) for j in range(6))
        counts[votes] += 1
        truth[votes] = truth.get(votes, 0) + good
    patterns = sorted(counts.items())
    base, odds = estimate(patterns)
    right = sum(truth[v] if base + sum(o[x] for o, x in zip(odds, v, strict=True)) > 0 else n - truth[v] for v, n in patterns)
    assert right > 0.93 * 20_000


@pytest.mark.parametrize("wrong", [4, 5, 6])
def test_estimate_outvotes_a_rule_that_is_wrong_on_a_hot_source(wrong):
    clean, junk, loud = (1,) * 9, (1, 1, -1, 1, 1, 1, 1, -1, -1), (1, 1, 1, 1, 0, -1, -1, -1, 1)
    hot = tuple(-1 if j == wrong else x for j, x in enumerate(clean))
    base, odds = estimate([(clean, 5600), (hot, 3000), (junk, 700), (loud, 400)])
    kept = {v: base + sum(o[x] for o, x in zip(odds, v, strict=True)) >= 0 for v in (clean, hot, junk, loud)}
    assert kept == {clean: True, hot: True, junk: False, loud: False}


def test_quality_keeps_a_hot_source_with_one_bad_vote(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(words(20, rng)) for _ in range(4))) for i in range(200)]
    rows += [(i, "\n".join(" ".join(words(20, rng)) + "!!!" * 3 for _ in range(4))) for i in range(200, 300)]
    rows += [(i, "\n".join(" ".join(x + "***" for x in words(20, rng)) for _ in range(4))) for i in range(300, 330)]
    got = judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(300))
