import hashlib
import random
import re

import pytest
from compare import duckdb_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlark.llm import decontaminate
from gridlark.llm.entry import ORACLES, QUERIES

DOCS = "doc_id long, text string, items string, n_hit long, row long"
ITEMS = "item_id long, text string, doc_id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(SMALL))


def windows(items, width=10):
    return {(i, tuple(w[k : k + min(width, len(w))])) for i, t in items if (w := split(t)) for k in range(len(w) - min(width, len(w)) + 1)}


def brute(docs, items, width=10):
    patterns, out = windows(items, width), []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for item, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    left = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS).repartition(3)
    got = decontaminate.contamination(left, spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS), **options)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, got.collect()), key=repr)


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_words(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in decontaminate.words(text)] == split(text)


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=7), max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_search_finds_all_occurrences(items, text, width):
    """Few letters: windows overlap, repeat, end alike and have short shifts."""
    search = decontaminate.Search([(str(i), True, t) for i, t in enumerate(items)], width)
    spans, found = search.search(text)
    hit, want = set(), set()
    for i, t in enumerate(items):
        size = min(width, len(t))
        for k in range(len(t) - size + 1 if size else 0):
            for at in range(len(text) - size + 1):
                if text[at : at + size] == t[k : k + size]:
                    hit |= set(range(at, at + size))
                    want.add(str(i))
    assert found == want and {k for s, e in spans for k in range(s, e)} == hit
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_unknown_blocks_are_skipped():
    matcher, read = decontaminate.Matcher(10, [tuple(b"%d" % k for k in range(10))]), []

    class Words(list):
        def __getitem__(self, at):
            read.append(at)
            return super().__getitem__(at)

    assert list(matcher.find(Words([b"x"] * 1000))) == [] and len(read) <= 1000 // 9 + 1


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "a", "être", "of", "3", "x_y", "don't", "Ünder", "w%d" % r.randrange(60)])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 4, 9, 10, 11, 30, 60])))) for k in range(30)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(0, 80))]
        if r.random() < 0.5:
            t = r.choice(items)[1].split()
            k = r.randrange(len(t))
            at = r.randrange(len(w) + 1)
            w[at:at] = t[k : k + r.randrange(1, 30)]
        docs.append((i, r.choice([" ", "\n", ", ", "\x00"]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    items += [(5, items[5][1]), (5, "another text of the same item"), (None, "w1 w2 nobody's item"), (77, None), (78, ""), (79, " ... ")]
    docs += [(200, None), (201, ""), (202, " .,; "), (None, items[9][1]), (203, "no w1 W2, nobody's ITEM"), (204, items[9][1]), (204, items[9][1]), (204, "other"), (205, (items[11][1] + " ") * 40)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    docs, items = corpus(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_shards_and_pieces_of_items(spark):
    """A benchmark beyond the bound: three or more shards, long items in pieces."""
    docs, items = corpus(3)
    r = random.Random(4)
    long = [f"v{r.randrange(40)}" for _ in range(300)]
    items.append((900, " ".join(long)))
    docs += [(900 + k, " ".join(long[k : k + 25])) for k in range(0, 290, 7)]
    assert run(spark, docs, items, shard=150) == brute(docs, items)
    assert len(list(decontaminate.searches(spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS), shard=150))) > 3


def test_empty_tables(spark):
    docs, items = [(1, "some words"), (2, None)], [(1, "some words")]
    assert run(spark, [], items) == [] and run(spark, docs, []) == brute(docs, []) and run(spark, docs, items) == brute(docs, items)


def test_long_text_of_one_word(spark):
    docs, items = [(1, "the " * 200_000), (2, "the " * 9)], [(1, "the " * 12), (2, "the " * 10), (3, "of")]
    got = run(spark, docs, items)
    assert got[0][1:4] == (200_000, 200_000, 2) and got[1][1:4] == (9, 0, 0)


def test_rows_are_those_of_the_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert spark_rows(QUERIES["op12_decontamination"](spark, sf_dir)) == duckdb_rows(ORACLES["op12_decontamination"], sf_dir)
