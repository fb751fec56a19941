import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from gridlark.llm import ngram_join
from gridlark.llm.tables import fold

DOCS = "doc_id long, text string, n string, comp long"


def brute(data, width=5):
    sets = {}
    for i, t in data:
        w = fold(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def run(spark, data):
    got = ngram_join.components(spark.createDataFrame([(i, t, "x", 1) for i, t in data], DOCS))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, groups, size, edits):
    """Groups of copies with word edits, a passage that all share, chains whose ends don't link."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(6, 120))]
        if r.random() < 0.5:
            base[3:3] = passage
        for _ in range(r.randrange(1, size)):
            copy = list(base)
            for _ in range(r.randrange(edits)):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                base = copy
            out.append(" ".join(copy).upper() if r.random() < 0.1 else " ".join(copy))
    r.shuffle(out)
    return list(enumerate(out))


def test_components_against_all_pairs(spark):
    for seed in (1, 2):
        data = corpus(seed, 40, 12, 6)
        assert run(spark, data) == brute(data)


def test_one_large_group(spark):
    data = corpus(3, 1, 2, 2) + [(1000 + i, t) for i, t in corpus(4, 2, 200, 8)]
    assert run(spark, data) == brute(data)


def test_edges(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    data = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " more"), (9, "x"), (10, "x y z v w"), (11, "x y z v w")]
    assert run(spark, data) == brute(data)
    assert run(spark, []) == []
    twice = run(spark, [(4, "a b"), (4, "a b"), (2, "a b")])
    assert twice == [(2, 1, 2), (4, 1, 2), (4, 1, 2)]
    df = spark.createDataFrame([(None, "a b", "x", 1), (3, "a b", "x", 1)], DOCS)
    assert sorted(r.component_id for r in ngram_join.components(df).collect()) == [3, 3]
    kept = ngram_join.one_of_each(spark.createDataFrame([(i, t, "n", 2) for i, t in data], DOCS))
    assert kept.columns == ["doc_id", "text", "n", "comp"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9, 10]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)), max_size=12), st.integers(1, 8))
def test_divide_skip(sets, least):
    lists = [sorted(s) for s in sets]
    counts = {}
    for s in sets:
        for i in s:
            counts[i] = counts.get(i, 0) + 1
    assert ngram_join.divide_skip(lists, least) == {i: c for i, c in counts.items() if c >= least}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1), max_size=4), st.lists(st.sets(st.integers(0, 60)), max_size=9))
def test_search(queries, members):
    array = lambda s: np.array(sorted(s), np.int64)
    index = ngram_join.Inverted([array(m) for m in members])
    for query in queries:
        want = [k for k, m in enumerate(members) if m and 100 * len(m & query) >= 80 * len(m | query)]
        assert sorted(index.search(array(query))) == want


def test_the_search_is_that_of_divide_skip(monkeypatch):
    """Its lists are the block's, short ones are merged and long ones probed, and nothing else finds a link."""
    sets = [np.arange(k, 100 + k, dtype=np.int64) for k in range(5)] + [np.arange(40, dtype=np.int64)]
    index, asked = ngram_join.Inverted(sets), []
    real = ngram_join.divide_skip
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, least, mu=0.01: asked.append((lists, least)) or real(lists, least, mu))
    assert sorted(index.search(sets[0])) == [0, 1, 2, 3, 4]
    (lists, least), = asked  # the small set is in a class of its own, which isn't looked into
    assert least == ngram_join.least_overlap(100, 100) and lists == [[k for k in range(5) if k <= i] for i in range(100)]
    monkeypatch.setattr(ngram_join, "divide_skip", lambda *_: {})
    assert index.search(sets[0]) == []


def test_homes_find_what_rounds_leave(spark, monkeypatch):
    """Without rounds of hubs, and with small blocks and parts, the links are the same."""
    for name, value in (("ROUNDS", 0), ("BLOCK", 3), ("SPREAD", 4), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    data = corpus(6, 12, 14, 6)
    assert run(spark, data) == brute(data)


def test_repeated_and_missing_ids(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(30))
    data = [(7, words("a")), (7, words("b")), (9, words("a")), (3, words("b") + " more"), (None, words("a")), (None, words("c")), (5, None), (5, ""), (None, None)]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame([(i, t, "x", 1) for i, t in data], DOCS)).collect()), key=str)
    assert found == sorted([(7, 26, 7), (7, 26, 3), (9, 26, 7), (3, 27, 3), (None, 26, 7), (None, 26, None), (5, 0, 5), (5, 0, 5), (None, 0, None)], key=str)


def mosaic(n, seed=3):
    """Documents of shared words, twenty passages in two versions each, and words of their own: few link, all share lists."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(100_000)}"
    shared = [word() for _ in range(100)]
    passages = [[[word() for _ in range(10)] for _ in range(2)] for _ in range(20)]
    return [(i, " ".join([*shared, *(w for p in passages for w in r.choice(p)), *(f"own{i}x{k}" for k in range(14))])) for i in range(n)]


def test_links_of_a_mosaic(spark):
    data = mosaic(150)
    data += [(200 + k, data[k][1].replace(f"own{k}x3", "other")) for k in range(0, 40, 3)]
    assert run(spark, data) == brute(data)


def test_homes_that_many_ask_have_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ASKERS", 10)
    homes = spark.createDataFrame([(h, 100 * h + k, 100 * h + k) for h in range(3) for k in range(5)], "home long, doc long, comp long")
    queries = spark.createDataFrame([(0, d, d) for d in range(1000, 1200)] + [(1, 7, 7)], "home long, doc long, comp long")
    where, asked = ngram_join.shared_out(homes, queries)
    per = {r.home: r["count"] for r in asked.groupBy("home").count().collect()}
    assert sum(per.values()) == 201 and max(per.values()) < 40 and len(per) > 12
    copies = {}
    for r in where.collect():
        copies.setdefault(r.home, set()).add(r.doc)
    assert set(per) <= set(copies) and sorted(map(sorted, copies.values())) == [list(range(5))] * 20 + [list(range(100, 105))]


def test_queries_grow_like_documents_that_share_lists(spark):
    """Documents that don't link, each a component of its own, in lists of half of them each."""
    asked = []
    for n in (500, 1000, 2000):
        r = random.Random(5)
        rows = [(p * 2 + r.randrange(2), i) for i in range(n) for p in range(20)]
        lists = spark.createDataFrame(rows, "shingle long, doc long").selectExpr("shingle", "doc", "doc comp", "300L n", "290L rest", f"{n // 2}L size")
        homes = ngram_join.homes_of(lists)
        assert homes.count() == n == homes.select("doc").distinct().count()
        asked.append(ngram_join.home_queries(lists, homes).count())
    assert all(b <= 2.5 * a for a, b in zip(asked, asked[1:], strict=False)) and asked[-1] < 8 * 2000


def test_clashing_names_come_out_as_they_are(spark):
    for ids in ([1, 2, 3], [None, 2, 2]):
        rows = [(i, f"some words of number {k} that nobody shares", 10 * k, -k, "c", k) for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string, _row long, _id long, __id string, component_id int")
        got = ngram_join.one_of_each(df)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
