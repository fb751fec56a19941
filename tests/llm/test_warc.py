import base64
import hashlib
import random

import pytest
import zstandard
from compare import duckdb_rows, spark_rows

from gridlark.llm import entry, warc

PAGES = "page_id long, url string, html string, digest string, first string"


def rows():
    r = random.Random(2)
    out = [(i, f"https://example.org/{i}", f"<html><body>{' '.join(r.choice(['a', 'b', 'c']) for _ in range(r.randrange(30)))}</body></html>", "x", "y") for i in range(200)]
    out += [(300 + i, "https://example.org/\r\nx", "<p>copy\r\n\r\nWARC/1.1</p>", "x", "y") for i in range(50)]
    return [*out, (400, None, None, "x", "y"), (401, "", "", "x", "y"), (402, "u", "é\r\n\r\n" * 200_000, "x", "y"), (None, "u", "no id", "x", "y"), (403, "u", "no id", None, None), (7, "again", out[7][2], "x", "y")]


def want(data):
    first = {}
    for i, _, html, *_ in data:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, *_ in data:
        raw = (html or "").encode()
        revisit = first[html or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    data = rows()
    got = warc.op7(spark.createDataFrame(data, PAGES).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == want(data)


def test_least_payload(spark):
    data = [(1, "u", "short", "", ""), (2, "u", "short", "", ""), (3, "u", "long enough", "", ""), (4, "u", "long enough", "", "")]
    made = warc.archives(spark.createDataFrame(data, PAGES), least=8)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(made).collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_archives_stand_alone(spark, tmp_path):
    """Each begins with a skippable frame that holds the dictionary, then has one frame a record."""
    made = warc.archives(spark.createDataFrame(rows(), PAGES).repartition(2), limit=2000)
    warc.export(made, str(tmp_path))
    found = made.collect()
    assert len(found) > 2 and sum(r.records for r in found) == len(rows())
    for r in found:
        data = (tmp_path / r.archive).read_bytes()
        assert data == bytes(r.content) and data[:4] == warc.MAGIC
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        rest, n = data[8 + size :], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            text = one.decompress(rest)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            rest, n = one.unused_data, n + 1
        assert n == r.records == len(list(warc.records(data)))


def test_damage_is_found(spark):
    raw = warc.dictionary([])
    writer = warc.Writer(raw)
    writer.add(warc.record(1, "u", b"payload"))
    _, archive = writer.close()
    assert [warc.page(*x)[:2] for x in warc.records(archive)] == [(1, 7)]
    with pytest.raises(ValueError):
        list(warc.records(archive[8:]))
    bad = warc.record(1, "u", b"payload").replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad")
    writer.add(bad)
    with pytest.raises(ValueError):
        [warc.page(*x) for x in warc.records(writer.close()[1])]


def test_empty_table_and_sql(spark):
    assert warc.op7(spark.createDataFrame([], PAGES)).collect() == []
    sf = "/root/testdata/sf0.001"
    assert spark_rows(entry.op7_warc(spark, sf)) == duckdb_rows(entry.ORACLES["op7_warc"], sf)


def test_very_compressible_pages():
    """Archives are closed by plain bytes too, and are read a record at a time."""
    writer, done = warc.Writer(warc.dictionary([]), plain=64 << 20), []
    for i in range(200):
        if made := writer.add(warc.record(i, "u", f"page {i} ".encode() * 200_000)):
            done.append(made)
    done.append(writer.close())
    assert len(done) == -(-sum(len(f"page {i} ") * 200_000 for i in range(200)) // (66 << 20)) and sum(n for n, _ in done) == 200 and sum(len(a) for _, a in done) < 4 << 20
    data, seen = warc.Unpacked(done[0][1]), 0
    while (head := data.until(b"\r\n\r\n")) is not None:
        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        data.take(size + 4)
        seen += 1
        assert len(data.held) <= warc.STEP
    assert seen == done[0][0] == len(list(warc.records(done[0][1])))
    with pytest.raises(ValueError):
        list(warc.records(done[0][1][:-40]))


def test_files_are_whole(spark, tmp_path):
    df = spark.createDataFrame(rows(), PAGES).repartition(2)
    done = warc.export(warc.archives(df, limit=2000), f"file://{tmp_path}/out").collect()
    assert {r.archive: r.bytes for r in done} == {p.name: p.stat().st_size for p in (tmp_path / "out").iterdir()}
