import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import wordpiece
from gridlark.llm.tables import local_path

DOCS = "doc_id long, text string, n_tokens string"
PATH = local_path("piece_bpe_32k.model")


def greedy(word, starts, onward):
    """Longest match first, by trying all lengths; None where no piece fits."""
    at, n = 0, 0
    while at < len(word):
        pieces = onward if at else starts
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return None
        at, n = at + size, n + 1
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=5)), st.sets(st.text("abc", min_size=1, max_size=5)), st.lists(st.text("abcd", max_size=14), max_size=20))
@settings(max_examples=300, deadline=None)
def test_automaton_is_greedy_longest_match(starts, onward, words):
    automaton = wordpiece.Automaton(sorted(starts), sorted(onward))
    for w in words:
        assert automaton.count(w) == greedy(w, starts, onward)


@pytest.fixture(scope="module")
def pieces():
    starts, onward = wordpiece.vocabulary(PATH)
    return set(starts), set(onward)


def test_counts_of_texts(spark, pieces):
    r = random.Random(4)
    words = ["unbelievable", "Hello,", "world!!", "naïve", "İstanbul", "日本語テキスト", "x" * 200, "ab🙂c", "don't", "a_b", "1234567"]
    data = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40))), "x") for i in range(60)]
    data += [(100, None, "x"), (101, "", "x"), (102, " \n\t ", "x"), (3, data[3][1], "x"), (3, data[3][1], "x"), (None, "no id", "x"), (103, "long text, " * 100_000, "x")]
    got = wordpiece.token_counts(spark.createDataFrame(data, DOCS))
    assert got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    want, known = [], {}
    for i, text, _ in data:
        found = re.findall(r"\w+|[^\w\s]", text or "")
        for w in set(found) - known.keys():
            known[w] = greedy(w, *pieces)
        counts = [known[w] for w in found]
        want.append((i, len(found), sum(1 if c is None else c for c in counts), sum(c is None for c in counts)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert wordpiece.token_counts(spark.createDataFrame([], DOCS)).collect() == []
