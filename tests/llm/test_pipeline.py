import math
import random
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from gridlark.llm import mixing, ngram_join
from gridlark.llm.tables import local_path
from test_mixing import WORD, water_fill
from test_ngram_join import brute

SHIFT = 3


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose in two sources, shouting, toxic texts, near copies; half of the documents have labels."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(1500):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 90))]
        good, toxic = r.random() < 0.7, r.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["grumpf", "blargh", "zwickel"]))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", "ab"[i % 3 == 0], len(text)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    for k in range(40):
        i, text = docs[k][:2]
        docs.append((2000 + k, text + (" end" if k % 2 else ""), "en", "a", len(text)))
    docs += [(3000, None, "en", None, 0), (3001, "", "en", "a", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, {d[0]: d for d in docs}, {x[0]: x for x in labels}


def test_stages(spark, folder):
    at, known, labels = folder
    docs, left = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), stage(spark, docs, at).schema)
        if name != "packing":
            assert docs.columns == before.columns
        left[name] = docs.collect()
    kept = {name: {r.doc_id for r in rows} for name, rows in left.items()}
    good = [i for i, x in labels.items() if x[2] == 0]
    assert sum(i in kept["toxicity"] for i in good) > 0.97 * len(good)
    assert sum(i in kept["toxicity"] for i, x in labels.items() if x[2]) < 0.1 * sum(x[2] for x in labels.values())
    good = [i for i in kept["toxicity"] if i in labels and labels[i][1]]
    bad = [i for i in kept["toxicity"] if i in labels and not labels[i][1]]
    assert sum(i in kept["quality classifier"] for i in good) > 0.97 * len(good) and sum(i in kept["quality classifier"] for i in bad) < 0.1 * len(bad)
    rows = left["quality classifier"]
    assert kept["n-gram Jaccard join"] == {c for _, _, c in brute([(r.doc_id, r.text) for r in rows])}
    rows = left["n-gram Jaccard join"]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    goal, got = water_fill(sizes, (5, 2, 1)), defaultdict(int)
    for r in left["mixing sources to target weights"]:
        got[r.source] += len(WORD.findall(r.text or ""))
    longest = max(len(WORD.findall(r.text or "")) for r in rows)
    assert all(math.isclose(got[s], goal[s], abs_tol=longest) for s in sizes)
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(local_path("word_bpe_49k.json")).encode
    times, pieces = defaultdict(int), defaultdict(list)
    for r in left["mixing sources to target weights"]:
        times[r.doc_id] += 1
    for r in left["packing"]:
        pieces[r.doc_id].append(r)
    assert times.keys() == pieces.keys()
    for i, n in times.items():
        ids = [*encode(known[i][1] or "", add_special_tokens=False).ids, 2]
        assert sorted(p for r in pieces[i] for p in range(r.start, r.start + r.length)) == sorted(list(range(len(ids))) * n)
        assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])) for r in pieces[i])


def test_run_is_its_stages(spark, folder):
    at = folder[0]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
    tokens = lambda rows: sorted((r.doc_id, p) for r in rows for p in range(r.start, r.start + r.length))
    assert tokens(corpus_pipeline.run(spark, at).collect()) == tokens(corpus_pipeline.STAGES[-1][1](spark, docs, at).collect())


def test_weights_are_those_of_the_mix():
    assert mixing.mix.__defaults__[0] == (5, 2, 1)


def test_null_and_repeated_ids(spark):
    """Rows are lost only to near copies: neither for want of an id nor for sharing one."""
    text = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(6)]
    rows = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (2, text[2]), (2, text[3]), (2, text[3]), (2, text[0]), (3, text[4]), (None, text[5])]
    rows += [(4, ""), (4, None), (None, ""), (None, " ")]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string")
    got = ngram_join.one_of_each(df)
    found = sorted(((r.doc_id or 0), (r.text or "").strip()) for r in got.collect())
    assert found == sorted([(1, text[0]), (0, text[1]), (2, text[2]), (2, text[3]), (3, text[4]), (0, text[5]), (4, ""), (0, ""), (0, "")])
    twice = mixing.mixed_documents(got, weights=(1,), factor=2.0)
    assert sorted(r.text for r in twice.collect()) == sorted(text * 2)
