import zlib
from collections import defaultdict

import pytest

from gridlark.llm import packing
from gridlark.llm.tables import local_path

DOCS = "doc_id long, text string, length string"
TEXTS = [None, "", " \t\n", "Hello, World!", "it's we'll DON'T", "a b c　d", "İstanbul ΣΑΣ ǅ", "é ̈x", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト 12345", "!!! ??? ...", "x" * 3000, "\x1c\x1d a\x85b", "ﬁ ½ ①", "x²y³ ªº 1½2 _a_b__ ßÄÖ ÿ¡¿ ǅ Ǆ Ɐ don't's İx ŉ", "".join(map(chr, range(33, 700)))]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(local_path("word_bpe_49k.json"))


def test_words_encode_as_texts(tokenizer):
    encode = packing.Encoder(local_path("word_bpe_49k.json"))
    for text in TEXTS:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert encode.of(text) == b"".join(i.to_bytes(4, "little") for i in want)


def test_pieces_tile_documents_and_sequences(spark, tokenizer):
    data = [(i, " ".join(f"word{k * i % 37}" for k in range(i * 13 % 400)), "n") for i in range(300)]
    data += [(1000 + i, t, "n") for i, t in enumerate(TEXTS)] + [(5, data[5][1], "n"), (2000, "long text " * 30_000, None)]
    got = packing.pack(spark.createDataFrame(data, DOCS).repartition(5)).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in data}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and r.doc_tokens == len(ids[r.doc_id])
    assert docs.keys() == ids.keys()
    for i, rows in docs.items():
        times = 2 if i == 5 else 1
        assert sorted(p for r in rows for p in range(r.start, r.start + r.length)) == sorted(list(range(len(ids[i]))) * times)
    padding = 0
    for rows in sequences.values():
        assert sorted(p for r in rows for p in range(r.offset, r.offset + r.length)) == list(range(n := sum(r.length for r in rows)))
        assert n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding == 0


def test_empty_table_and_null_id(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
    assert [(r.doc_id, r.length) for r in packing.pack(spark.createDataFrame([(None, "", "")], DOCS)).collect()] == [(None, 1)]


def test_bounded_space_and_best_fit():
    packer = packing.Packer(size=8, windows=2)
    for k, n in enumerate([5, 6, 2]):
        packer.place(k, 0, n, bytes(4 * n))
    assert [[p[0] for p in s] for s in packer.full] == [[1, 2]]  # the fuller of two that have room
    packer.place(3, 0, 7, bytes(28))
    packer.place(4, 0, 7, bytes(28))
    assert len(packer.open) <= 2 and [sum(len(p[3]) for p in s) for s in packer.full] == [32] * len(packer.full)


def test_other_vocabularies_are_refused():
    """The encoder cuts words by one vocabulary's pattern, so another one is an error and not another result."""
    packing.Encoder(local_path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        packing.Encoder(local_path("byte_bpe_50k.json"))
