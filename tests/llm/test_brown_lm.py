import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridlark.llm import brown_lm
from gridlark.llm.tables import fold, written

DOCS = "doc_id long, text string, n long, word string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def information(bigrams, of, classes):
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    c = member.T @ bigrams @ member
    left, right = c.sum(1, keepdims=True), c.sum(0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(np.where(c > 0, c * np.log(c * c.sum() / (left * right)), 0))


def test_exchange_gains_information_and_finds_classes():
    r = np.random.default_rng(1)
    true = np.arange(30) % 3
    bigrams = np.zeros((30, 30))
    at = 0
    for _ in range(6000):  # classes follow each other in turn
        to = r.choice(np.flatnonzero(true == (true[at] + 1) % 3))
        bigrams[at, to] += 1
        at = to
    scattered = r.permutation(30)
    got = brown_lm.exchange(bigrams[np.ix_(scattered, scattered)], 3)
    assert len(set(zip(got.tolist(), true[scattered].tolist(), strict=True))) == 3
    noise = r.poisson(2.0, (40, 40)).astype(float)
    start = np.arange(40) % 6
    of = brown_lm.exchange(noise, 6)
    best = information(noise, of, 6)
    assert best >= information(noise, start, 6)
    for u in range(40):  # a last sweep may leave a few moves, none of them large
        for c in range(6):
            other = of.copy()
            other[u] = c
            assert information(noise, other, 6) <= best + 12


def corpus():
    r = random.Random(3)
    nouns, verbs = [f"noun{i}s" for i in range(40)], [f"verb{i}ed" for i in range(40)]
    out = [(i, " ".join(f"The {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} ." for _ in range(r.randrange(1, 12))), 0, "") for i in range(400)]
    out += [(500 + i, f"only{i} seen once{i}", 0, "") for i in range(20)]
    return [*out, (600, None, 0, ""), (601, "", 0, ""), (602, " \n ", 0, ""), (3, out[3][1], 0, ""), (None, "the noun1s", 0, ""), (603, "the noun1s " * 60_000, 0, "")]


@pytest.fixture(scope="module")
def scored(spark):
    data = corpus()
    return data, brown_lm.op9(spark.createDataFrame(data, DOCS)).collect()


def test_counts_and_base_score(scored):
    data, got = scored
    seen = Counter()
    for i, t, *_ in data:
        if i is None or not held(i):
            words = fold(t)
            seen.update(words)
            seen["end"] += 1
    n, v = sum(seen.values()), len(seen)
    assert len(got) == len(data)
    want = []
    for i, t, *_ in data:
        tokens = [*fold(t), "end"]
        base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((i, None if i is None else held(i), len(tokens), sum(w in seen for w in tokens), n, base))
    for a, b in zip(sorted(got, key=lambda r: repr(r[:5])), sorted(want, key=lambda r: repr(r[:5])), strict=True):
        assert tuple(a)[:5] == b[:5] and math.isclose(a.base_score, b[5], rel_tol=1e-9)


def test_classes_beat_the_base(scored):
    data, got = scored
    of = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(of) > 50 and sum(r.score for r in of) > 0.8 * sum(r.base_score for r in of)
    assert all(r.score <= 1e-9 for r in got)


def test_rare_words_come_from_the_table(spark):
    """Scores don't depend on how many words are sent to the tasks."""
    df = spark.createDataFrame(corpus(), DOCS).filter("doc_id is not null").dropDuplicates(["doc_id"])
    few, many = ({r.doc_id: r for r in brown_lm.scored(df, df, common=k).collect()} for k in (5, 10_000))
    for i, r in few.items():
        assert (r.n_tokens, r.n_known) == (many[i].n_tokens, many[i].n_known)
        assert math.isclose(r.score, many[i].score, rel_tol=1e-9) and math.isclose(r.base_score, many[i].base_score, rel_tol=1e-9)


def test_probabilities_add_up(spark):
    """Over all known words, one unknown and the end, those after any class make 1."""
    df = spark.createDataFrame([("a b c a b",), ("b a",), ("c c a",)], "text string")
    counts = brown_lm.word_counts(df)
    model = brown_lm.learn(df, counts)
    n = {bytes(r.word): r.n for r in counts.collect()}
    for before in {model.class_of(b"a"), model.end}:
        total = 10 ** model.step[before, model.end]
        for w, k in n.items():
            if w != brown_lm.END:
                c = model.class_of(w)
                total += 10 ** (model.step[before, c] - model.room[c]) * (k + brown_lm.PRIOR)
        room = [c for c in range(len(model.step)) if c != model.end]
        unseen = sum(10 ** (model.step[before, c] - model.room[c]) * brown_lm.PRIOR for c in room)
        assert math.isclose(total + unseen, 1, rel_tol=1e-9)


def test_empty_tables(spark):
    assert brown_lm.op9(spark.createDataFrame([], DOCS)).collect() == []
    lone = next(i for i in range(100) if held(i))
    r = brown_lm.op9(spark.createDataFrame([(lone, "some words", 0, "")], DOCS)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0


def test_words_beyond_the_commonest_go_by_their_neighbours(spark):
    """More words than the driver's exchange takes, of two kinds in turn, with nothing in their endings."""
    r = random.Random(5)
    kinds = [[f"{k}{i}xyz" for i in range(500)] for k in "pq"]
    texts = [" ".join(r.choice(kinds[i % 2]) for i in range(40)) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = brown_lm.learn(df, brown_lm.word_counts(df))
    classes = [Counter(model.classes_of([w.encode() for w in kind]).tolist()) for kind in kinds]
    both = sum(min(classes[0][c], classes[1][c]) for c in classes[0])
    assert both < 20


def test_endings_are_letters():
    assert brown_lm.ending("xéàü".encode()) == brown_lm.ending("yéàü".encode()) != brown_lm.ending("xéáü".encode())


def test_scores_by_hand(spark):
    """Classes are the model's; every count, probability and sum of a text's score is made again in plain Python."""
    r = random.Random(8)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    text = lambda: " ".join(r.choice(verbs if k % 2 else nouns) for k in range(r.randrange(1, 30)))
    train = [text() for _ in range(150)] + ["rare words", "", None]
    docs = [(i, t) for i, t in enumerate([*train[:20], text(), "never seen before", "noun1 Noun2 UNSEEN verb3", "", None])]
    frame = spark.createDataFrame([(t,) for t in train], "text string")
    model = brown_lm.learn(frame, brown_lm.word_counts(frame), 8)
    words = [fold(t) for t in train]
    times = Counter(w for x in words for w in x)
    of = {w: model.class_of(w) for w in {*times, *(w for _, t in docs for w in fold(t))}}
    end = 7
    after = Counter(pair for x in words for c in [[end, *(of[w] for w in x), end]] for pair in zip(c, c[1:], strict=False))
    tokens, types = Counter(), Counter()
    for w, n in times.items():
        tokens[of[w]] += n
        types[of[w]] += 1
    out = {c: sum(after[c, d] for d in range(8)) for c in range(8)}
    step = lambda c, d: math.log10((after[c, d] + 0.5) / (out[c] + 0.5 * 8))
    got = {x.doc_id: x.score for x in brown_lm.scored(spark.createDataFrame(docs, "doc_id long, text string"), frame, common=5, classes=8).collect()}
    for i, t in docs:
        chain, want = [end, *(of[w] for w in fold(t)), end], 0.0
        for a, b in zip(chain, chain[1:], strict=False):
            want += step(a, b)
        want += sum(math.log10((times[w] + 0.5) / (tokens[of[w]] + 0.5 * (types[of[w]] + 1))) for w in fold(t))
        assert abs(got[i] - want) < 1e-6, t


def test_a_sweep_by_hand(spark):
    """Neighbours by class, the class table and each unit's best class, made again in plain Python."""
    r, classes = random.Random(4), 6
    texts = [" ".join(f"w{int(r.random() ** 2 * 700)}" for _ in range(r.randrange(0, 60))) for _ in range(250)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    units, row = brown_lm.vocabulary(brown_lm.word_counts(df))
    end = int(units.of([brown_lm.END])[0])
    of = np.array([r.randrange(classes - 1) for _ in row], np.uint8)
    of[end] = classes - 1
    moving = row >= brown_lm.HEADS
    assert moving.sum() > 100
    pairs = written(brown_lm.unit_pairs(df, units), "pairs")
    own = Counter(p for t in texts for c in [[end, *units.of(fold(t)).tolist(), end]] for p in zip(c, c[1:], strict=False))
    between = np.zeros((classes, classes))
    for (a, b), n in own.items():
        between[of[a], of[b]] += n
    assert (brown_lm.group_bigrams(pairs, of, classes) == between).all()
    link = lambda c, d: math.log((between[c, d] + 0.5) / (sum(between[c]) + 0.5 * classes) / (sum(between[:, d]) + 0.5 * classes))
    gain = {}
    for (a, b), n in own.items():
        for c in range(classes - 1):
            if moving[a]:
                gain[a, c] = gain.get((a, c), 0.0) + n * link(c, of[b])
            if moving[b]:
                gain[b, c] = gain.get((b, c), 0.0) + n * link(of[a], c)
    found = brown_lm.best_classes(brown_lm.neighbours(pairs, of, moving, classes), between).to_pylist()
    assert {x["unit"] for x in found} == {u for u, _ in gain}
    for x in found:
        assert gain[x["unit"], x["of"]] >= max(gain[x["unit"], c] for c in range(classes - 1)) - 1e-9


def test_the_vocabulary_is_bounded(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(2000) for _ in range(3 + (i % 4) ** 3)),)], "text string")
    counts = brown_lm.word_counts(df)
    every, few = brown_lm.vocabulary(counts)[1], brown_lm.vocabulary(counts, most=600)[1]
    assert len(every) == 2000 + 1 + brown_lm.TAILS > len(few) and (few >= brown_lm.HEADS).sum() - brown_lm.TAILS <= 600
