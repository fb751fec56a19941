import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import runs

DOCS = "doc_id long, text string, runs string, n long, start long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, words=24, periods=3):
    """All stretches of equal words q apart; a stretch has its smallest q."""
    n, found = len(text), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and text[i] == text[i + q]:
                i += 1
            if i > start and i + q - start >= max(words, periods * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def suffixes(text):
    """Next smaller suffixes and shared words, by comparing all."""
    every, smaller, matched = [text[i:] for i in range(len(text) + 1)], [], []
    for i in range(len(text)):
        j = next(j for j in range(i + 1, len(text) + 1) if every[j] < every[i])
        smaller.append(j)
        matched.append(next((k for k, (a, b) in enumerate(zip(every[i], every[j], strict=False)) if a != b), len(every[j])))
    return smaller, matched


squares = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30), st.integers(1, 4), st.integers(0, 2)), max_size=8)


def grown(moves):
    """A text that repeats pieces of itself."""
    text = [0]
    for at, size, times, letter in moves:
        text += text[at % len(text) :][:size] * times + [letter]
    return text[:150]


@given(squares)
@settings(max_examples=300, deadline=None)
def test_next_smaller_suffixes(moves):
    text = grown(moves)
    assert runs.next_smaller([*text, -1]) == suffixes(text)


@given(squares)
@settings(max_examples=300, deadline=None)
def test_runs_of_repetitive_texts(moves):
    text = grown(moves)
    for words, periods in ((24, 3), (2, 2), (6, 3), (1, 4)):
        assert runs.runs(text, words, periods) == brute(text, words, periods)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(n):
    text, letter = [0], 1
    while len(text) < n:
        text, letter = text * 3 + [letter], letter + 1
    return text[:n]


@pytest.mark.parametrize("make", [fibonacci, nested, lambda n: nested(n)[::-1], lambda n: [0] * n, lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: ([0] * 99 + [1]) * (n // 100), lambda n: list(range(n))])
def test_words_are_read_in_proportion(make):
    class Read(list):
        times = 0

        def __getitem__(self, at):
            self.times += 1
            return super().__getitem__(at)

    for n in (1000, 16_000):
        text = make(n)
        for ranks in (text, [max(text) - r for r in text]):
            read = Read([*ranks, -1])
            runs.next_smaller(read)
            assert read.times <= 12 * n


@given(st.lists(st.one_of(st.none(), st.text(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 abé", max_size=30)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_ranks(texts):
    made = runs.Words(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    flat = [w for x in want for w in x]
    assert made.flat.to_pylist() == flat and np.diff(made.offsets).tolist() == list(map(len, want))
    order = sorted({w.encode() for w in flat})
    assert made.ranks().tolist() == [order.index(w.encode()) for w in flat]
    assert made.joined().to_pylist() == [" ".join(w) for w in want]


def test_texts_are_parted_at_rare_words_alone():
    """The stretches hold all runs of three periods, and those that only two texts would make together none."""
    r = random.Random(7)
    texts = []
    for _ in range(300):
        text = []
        while len(text) < 150:
            piece = [r.randrange(200) for _ in range(r.randrange(1, 12))]
            text += piece * r.choice([1, 1, 2, 3, 4, 9])
        texts.append(text)
    flat, of = np.concatenate([np.array(t) for t in texts]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.cumsum([0, *map(len, texts)])
    found = [[] for _ in texts]
    for first, last in runs.stretches(flat, of, 24, 3):
        assert of[first] == of[last - 1]
        found[of[first]] += [(int(first - starts[of[first]]) + s, n, q) for s, n, q in runs.runs(flat[first:last].tolist())]
    assert found == [brute(t) for t in texts] and sum(map(len, found)) > 300


def contract(rows):
    """The query's rows in plain Python."""
    out, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        out.append((doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def run(spark, rows):
    got = runs.op11(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_against_plain_python(spark):
    r = random.Random(5)
    word = lambda: r.choice(["the", "The", "of", "a", "été", "x" * 40, f"w{r.randrange(30)}"])
    rows = []
    for i in range(250):
        text = []
        for _ in range(r.randrange(0, 12)):
            text += [word() for _ in range(r.randrange(1, 9))] * r.choice([1, 1, 2, 3, 5, 12])
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "a b " * 30), (3, "again " * 40), (3, rows[3][1]), (rows[9][0], rows[9][1]), (1003, "\xa0 " * 30)]
    want = contract(rows)
    assert run(spark, rows) == want and sum(x[1] for x in want) > 100 and any(x[1] > 2 for x in want)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_long_text_of_few_words(spark):
    got = run(spark, [(1, "on " * 100_000 + "and off " * 50_000)])
    assert got[0][:6] == (1, 2, 0, 100_000, 1, 100_000_000)


def test_the_operator_gives_runs_and_texts(spark):
    df = spark.createDataFrame([(5, "go " + "a b c " * 8 + "end", "x", 1, 2)], DOCS)
    row = runs.found_runs(df).first()
    assert row.n_words == 26 and [tuple(x) for x in row.runs] == [(1, 24, 3)] and row.collapsed == "go a b c end"
