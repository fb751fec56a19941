import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import quality_gam, toxicity
from gridlark.llm.tables import least_hashed

DOCS = "doc_id long, text string, score double, x int"
LABELS = "doc_id long, quality int, toxic int, text string"


def held(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def corpus(n, seed=1):
    """Good prose and shouting; one text in five has some of the bad words, also inflected."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    bad = ["grumpf", "blargh", "zwickel"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(8, 90))]
        good, toxic = r.random() < 0.7, r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "ed"]))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, 0.5, 1))
        if i % 2:
            labels.append((i, int(good), int(toxic), "label"))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(3000)
    docs += [(5001, None, 0.1, 1), (5002, "", 0.1, 1), (5003, docs[3][1], 0.1, 1), (3, docs[3][1], 0.5, 1), (None, "no id", 0.0, 0), (5004, "word " * 200_000, 0.0, 0)]
    return docs, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {r[0]: r for r in labels}


@pytest.mark.parametrize(("op", "column", "modulus", "remainder", "threshold"), [(quality_gam.op1, 1, 5, 0, 0.3), (toxicity.op10, 2, 3, 1, 0.7)])
def test_held_out_accuracy(tables, op, column, modulus, remainder, threshold):
    docs, df, labels, known = tables
    got = op(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    assert all(r.held_out == (held(r.doc_id, modulus) == remainder) for r in got if r.doc_id is not None)
    right = [r.predicted == known[r.doc_id][column] for r in got if r.doc_id in known and r.held_out]
    assert np.mean(right) > 0.97
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[3] == by[5003] and len(by[3]) == 1 and by[5001] == by[5002]


def test_held_out_labels_are_not_learned(spark, tables):
    docs, df, labels, known = tables
    flipped = spark.createDataFrame([(i, 1 - q if held(i, 5) == 0 else q, 1 - t if held(i, 3) == 1 else t, x) for i, q, t, x in known.values()], LABELS)
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    for op in (quality_gam.op1, toxicity.op10):
        assert sorted(op(df, labels).collect(), key=key) == sorted(op(df, flipped).collect(), key=key)


def test_filters_keep_columns(tables):
    docs, df, labels, known = tables
    assert quality_gam.accepted(df, labels).columns == toxicity.accepted(df, labels).columns == df.columns
    kept = {r.doc_id for r in toxicity.accepted(df, labels).collect()}
    assert np.mean([(i in kept) == (not r[2]) for i, r in known.items()]) > 0.97


def test_empty_tables(spark, tables):
    _, df, labels, _ = tables
    none, unlabelled = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    for op in (quality_gam.op1, toxicity.op10):
        assert op(none, labels).collect() == [] and op(none, unlabelled).collect() == []
    assert {r.score for r in quality_gam.op1(df, unlabelled).collect()} == {0.5}
    assert {r.predicted for r in toxicity.op10(df, unlabelled).collect()} == {0}


def test_pair_tables_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=20, pair_rounds=60)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.93


def test_non_negative_risk():
    """With toxic texts among the unknown ones, they still come out apart from the clean ones."""
    rows = [np.array([0])] * 50 + [np.array([0])] * 20 + [np.array([1])] * 180
    toxic = np.array([True] * 50 + [False] * 200)
    weights, offset = toxicity.fit(rows, toxic, 0.1, 2)
    assert weights[0] + offset > 1 and weights[1] + offset < -1


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_quality_scores_by_hand(tables):
    """Every score is the start value and one entry of each table, looked up bin by bin in plain Python."""
    docs, df, labels, _ = tables
    model = quality_gam.learn(df, labels)
    assert model.pairs and any(np.any(t) for t in model.tables)
    got = {r.doc_id: r.score for r in quality_gam.scored(df, labels).collect()}
    for i, text, _, _ in docs[:40] + docs[3000:3002] + docs[-1:]:
        x = quality_gam.features(text)
        total = model.start + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(x, model.edges, model.tables, strict=True))
        total += sum(t[sum(x[a] >= e for e in model.coarse[a])][sum(x[b] >= e for e in model.coarse[b])] for (a, b), t in model.pairs.items())
        assert abs(got[i] - sigmoid(total)) < 1e-9


def test_quality_features_by_hand():
    f = dict(zip(quality_gam.NAMES, quality_gam.features("The cat saw THE cat!\nA1 : the end$\nA1 : the end$"), strict=True))
    n = 13
    assert f["words"] == pytest.approx(math.log1p(n)) and f["capitals"] == pytest.approx(3 / n)  # THE, A1 and A1
    assert f["marked_ends"] == pytest.approx(3 / n) and f["distinct"] == pytest.approx(9 / n) and f["top_word"] == pytest.approx(2 / n)
    assert f["repeated_lines"] == pytest.approx(1 / 3) and f["lines"] == pytest.approx(math.log1p(3)) and f["line_words"] == pytest.approx(n / 3)
    assert f["bare_marks"] == pytest.approx(2 / n) and f["beyond_ascii"] == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-3, 3), st.floats(0.1, 2)), min_size=1, max_size=9))
def test_trees_against_all_cuts(bins):
    g, h = (np.array(v) for v in zip(*bins, strict=True))
    ridge = 2.0
    score = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    gains = [score(0, c) + score(c, len(g)) - score(0, len(g)) for c in range(1, len(g))]
    won, at = quality_gam.best_cut(g, h, ridge)
    assert won == pytest.approx(max(gains, default=0.0)) and (not gains or gains[at - 1] == pytest.approx(won))
    stump = quality_gam.tree(g, h, 1, ridge)
    cuts = [0, at, len(g)] if won > 1e-9 else [0, len(g)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        assert np.allclose(stump[a:b], -g[a:b].sum() / (h[a:b].sum() + ridge))


def test_one_boosting_step_by_hand():
    """One round over one feature: a stump of two leaves, each the Newton step of its rows, times the rate."""
    x, y = np.array([[0.0], [0.0], [1.0], [1.0], [1.0]]), np.array([0.0, 0.0, 1.0, 1.0, 0.0])
    model = quality_gam.fit(x, y, rounds=1, pair_rounds=0)
    start = math.log(2.5 / 3.5)
    p = sigmoid(start)
    leaf = lambda labels: -sum(p - v for v in labels) / (len(labels) * p * (1 - p) + 2.0)
    found = model.score(np.array([[0.0], [1.0]]))
    assert np.allclose(found, [sigmoid(start + 0.15 * leaf(y[:2])), sigmoid(start + 0.15 * leaf(y[2:]))])


def test_toxicity_scores_by_hand(tables):
    docs, df, labels, _ = tables
    model = toxicity.learn(df, labels)
    assert model.known and min(model.weights) >= 0
    got = {r.doc_id: r.score for r in toxicity.scored(df, labels).collect()}
    for i, text, _, _ in docs[:40] + docs[3000:3002] + docs[-1:]:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        names = {f"={w}" for w in words} | {w[:k] for w in words for k in (4, 5) if len(w) >= k}
        total = model.offset + sum(model.weights[model.known[x]] for x in names if x in model.known)
        assert abs(got[i] - sigmoid(max(-30, min(30, total)))) < 1e-9


def test_toxicity_step_by_hand():
    """The first step of the fit goes against the slope of the risk, which is measured here by small differences."""
    rows, toxic, prior = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], int), np.array([2])], np.array([True, True, False, False, False]), 0.2

    def risk(w, b):
        f = np.array([b + sum(w[i] for i in r) for r in rows])
        return prior * np.log1p(np.exp(-f[toxic])).mean() + np.log1p(np.exp(f[~toxic])).mean() - prior * np.log1p(np.exp(f[toxic])).mean()

    start = math.log(prior / (1 - prior))
    slopes = [(risk(np.eye(3)[k] * 1e-6, start) - risk(np.zeros(3), start)) / 1e-6 for k in range(3)]
    weights, offset = toxicity.fit(rows, toxic, prior, 3, steps=1, rate=0.05)
    assert slopes[0] < 0 < slopes[2] and weights[0] == pytest.approx(0.05, rel=1e-3) and weights[2] == 0  # held at zero
    assert weights[1] == pytest.approx(0.05 if slopes[1] < 0 else 0, rel=1e-3) and abs(offset - start) <= 0.0501


def test_columns_of_the_same_names_and_repeated_ids(spark, tables):
    """Columns with the new names give way, others stay; a labelled id with very many texts counts once."""
    docs, df, labels, _ = tables
    many = df.unionByName(df.filter("doc_id = 1").crossJoin(spark.range(200)).drop("id"))
    assert quality_gam.labelled(many, labels, "quality", 5, 0, 20_000).count() == quality_gam.labelled(df, labels, "quality", 5, 0, 20_000).count()
    assert toxicity.sample(many, labels, 5_000, 15_000).count() == toxicity.sample(df, labels, 5_000, 15_000).count()
    for module in (quality_gam, toxicity):
        out = module.scored(df.limit(5), labels)
        assert sorted(out.columns) == ["doc_id", "held_out", "predicted", "score", "text", "x"]
    few = spark.createDataFrame([(i,) for i in range(160) for _ in range(10)], "doc_id long").distinct()
    assert least_hashed(few, 40, 1, "doc_id").count() == 40
