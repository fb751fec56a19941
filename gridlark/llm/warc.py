"""WARC archives with a Zstandard dictionary, written from and read back into DataFrames.

A dictionary is built from a bounded sample of the records. Every archive begins with it, in a skippable frame, and then has
one compressed frame a record, so an archive can be read on its own and a record without those before it. Archives are rows
(archive, records, content): Spark writes and commits them wherever it can write, and lost tasks are written again.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.joins import looked_up
from gridlark.llm.tables import least_hashed, slices, written

#: Records that the dictionary is built from at most, bytes it sees of each, and its size.
SAMPLES, SAMPLE_BYTES, DICTIONARY = 1_000, 16_384, 65_536
#: Compressed bytes, and plain bytes, after which an archive is closed; plain bytes that a reader takes at a time.
ARCHIVE, PLAIN, STEP = 8 << 20, 256 << 20, 1 << 20
#: Fixed values of the format: the dictionary frame's magic number and the profile of a revisit.
MAGIC = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + block + _END


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; where the samples are too few for one, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join([*samples, record(0, "http://", b"")])[-size:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


class Writer:
    """Archives from records; ``take`` gives those that are complete."""

    def __init__(self, raw: bytes, level: int = 3, limit: int = ARCHIVE, plain: int = PLAIN) -> None:
        loaded = _loaded(raw)
        loaded.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=loaded, write_checksum=True).compress
        self.head = MAGIC + len(raw).to_bytes(4, "little") + raw
        self.limit, self.plain, self.frames, self.size, self.taken = limit, plain, [], 0, 0

    def add(self, data: bytes) -> tuple[int, bytes] | None:
        frame = self.compress(data)
        self.frames.append(frame)
        self.size += len(frame)
        self.taken += len(data)
        return self.close() if self.size >= self.limit or self.taken >= self.plain else None

    def close(self) -> tuple[int, bytes]:
        out = len(self.frames), self.head + b"".join(self.frames)
        self.frames, self.size, self.taken = [], 0, 0
        return out


class Unpacked:
    """The plain bytes of an archive's frames, unpacked as far as they are asked for."""

    def __init__(self, archive: bytes) -> None:
        if archive[:4] != MAGIC:
            raise ValueError("no dictionary frame at the start")
        start = 8 + int.from_bytes(archive[4:8], "little")
        self.reader = zstandard.ZstdDecompressor(dict_data=_loaded(archive[8:start])).stream_reader(io.BytesIO(memoryview(archive)[start:]), read_across_frames=True)
        self.held = bytearray()

    def more(self, most: int = STEP) -> bool:
        data = self.reader.read(most)
        self.held += data
        return bool(data)

    def until(self, sign: bytes) -> bytes | None:
        """What comes before ``sign``, which goes too; None at the end."""
        seen = 0
        while (at := self.held.find(sign, seen)) < 0:
            seen = max(0, len(self.held) - len(sign))
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
        return self.take(at + len(sign))[:-len(sign)]

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more(max(STEP, n - len(self.held))):
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, one at a time: no more than a record and a step are unpacked at once."""
    data = Unpacked(archive)
    while (head := data.until(_END)) is not None:
        first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        block = data.take(int(fields["Content-Length"]))
        if data.take(4) != _END:
            raise ValueError("a record has another length than it says")
        yield fields, block


def page(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url); a response's payload is held against its digest."""
    number = lambda x: int(y) if (y := x.strip("<>").removeprefix(_ID)) else None
    cut = block.index(_END)
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (base32_sha1(block[cut + 4 :]) != digest or len(block) - cut - 4 != int(http["Content-Length"])):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers, fields.get("WARC-Target-URI")


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: of payloads of ``least`` bytes or more that are equal, the smallest page_id, or null for it."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha1(payload)).withColumn("n_bytes", F.length(payload))
    first = rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
    first = written(first.filter("times > 1"), "warc-copies")
    own = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("n_bytes") < least)
    rows = looked_up(rows, first, "digest", "digest", "times")  # a payload that very many pages have isn't dealt out by its digest
    return rows.withColumn("refers_to", F.when(~own, F.col("first"))).drop("digest", "first", "times", "n_bytes")


def archives(pages: DataFrame, least: int = 0, level: int = 3, samples: int = SAMPLES, limit: int = ARCHIVE, seed: int = 11) -> DataFrame:
    """(archive, records, content): ``pages`` (page_id, url, html, others) as archives. An empty table gives none."""
    sample = pages.select("page_id", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"), "url")
    sample = least_hashed(sample, samples, seed, "page_id", "url")
    raw = dictionary([record(r["page_id"], r["url"], r["html"].encode()) for r in sample.toLocalIterator()])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, number = Writer(raw, level, limit), TaskContext.get().partitionId(), 0

        def out(done: tuple[int, bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{number:06d}.warc.zst"]), pa.array([done[0]], pa.int64()), pa.array([done[1]], pa.binary())], names=["archive", "records", "content"])

        for b in slices(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if done := writer.add(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, refers_to is not None)):
                    yield out(done)
                    number += 1
        if writer.frames:
            yield out(writer.close())

    return with_revisits(pages.select("page_id", "url", "html"), least).select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, records long, content binary")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record of ``archives``."""
    types = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found = list(zip(*(page(*x) for x in records(content.as_py())), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=names)

    return archives.select("content").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive to a file of its name in a folder that all machines reach, named by a URI of any file system that
    Arrow knows (``file:///``, ``hdfs://``, ``s3://``). Returns (archive, bytes) as read back from the folder.

    A file is written under another name and moved when it is whole, so that a lost task leaves no torn archive and a task
    that runs again replaces what it wrote.
    """

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                made = f"{root}/.{name}-{uuid.uuid4().hex}"
                with where.open_output_stream(made) as out:
                    out.write(content.as_buffer())
                where.move(made, f"{root}/{name}")
                sizes.append(where.get_file_info(f"{root}/{name}").size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return written(archives.select("archive", "content").mapInArrow(save, "archive string, bytes long"), "warc-files")


def op7(pages: DataFrame) -> DataFrame:
    """Write every page, then read the archives back.

    Null html is an empty payload, and equal empty payloads are revisits like others. Rows that repeat a page_id with its
    payload are responses all of them, if theirs is the smallest. A null page_id stays null; it is a revisit if a page with
    an id has its payload. An empty table gives an empty result.
    """
    return read(written(archives(pages), "warc-archives")).drop("url")


#: DuckDB SQL for ``op7`` over the table pages: base32 from the bits of the hexadecimal digest.
SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string(list_transform(string_split(hex, ''), lambda h: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][position(h IN '0123456789abcdef')]), '') AS b
  FROM hashed
), digests AS (
  SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest
  FROM bits
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests
"""
