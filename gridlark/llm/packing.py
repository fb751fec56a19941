"""Bounded-space online packing of tokenised documents into sequences.

A partition keeps a fixed number of windows open. A document goes to the window that it fills best; when none has room for
it, the fullest window is topped up with the document's head and emitted, and the rest looks for a place again. What is
left in the windows at the end of a partition, a bounded number of tokens, is merged over groups of partitions: windows are
joined and cut at the sequence length, and the last, shorter rest is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import local_path, slices, written

SIZE, WINDOWS, END = 4096, 16, 2
#: Partitions whose leftovers one task merges: at most GROUP * WINDOWS * SIZE tokens.
GROUP = 64
WIDTH = 4  # bytes of a token id
_LEFT = 1 << 62
#: Words of visible Latin letters and signs are cut here, by the vocabulary's own pattern, and their parts go to its merges;
#: other words go through the whole tokenizer.
_LATIN = re.compile("[!-~\u00a1-\u024f]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\\s\\w]|_)+")
#: Visible bytes stand for themselves, the others for the code points from 256 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_SPECIAL = b"<|"
#: Fixed values of the vocabulary in use: how it normalises, where it cuts, how it ends words.
_NORMAL, _SUFFIX = ["NFC", "Replace", "Lowercase"], "</w>"
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder(dict):
    """Ids of words as bytes. ASCII blanks end a word for the tokenizer, so words are encoded on their own and remembered."""

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.parts = Tokenizer.from_file(path), most, {}
        self.model = self.tokenizer.model
        shape = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["pattern"].get("Regex") for x in (shape["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if (normal, cuts, shape["model"].get("end_of_word_suffix")) != (_NORMAL, [_CUTS], _SUFFIX):
            raise ValueError(f"{path} normalises or cuts words in another way than this encoder")

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if _LATIN.fullmatch(text) and _SPECIAL not in word and _LATIN.fullmatch(text := text.lower()):
            out = b"".join([self.parts.get(part) or self.part(part) for part in _PARTS.findall(text)])
        else:
            out = b"".join([i.to_bytes(WIDTH, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        if len(self) < self.most and len(word) < 64:
            self[word] = out
        return out

    def part(self, part: str) -> bytes:
        """Ids of what the vocabulary's pattern cuts out of a lower-case word."""
        symbols = part if part.isascii() else "".join(map(_BYTES.__getitem__, part.encode("utf-8")))
        out = b"".join([t.id.to_bytes(WIDTH, "little") for t in self.model.tokenize(symbols)])
        if len(self.parts) < self.most and len(part) < 64:
            self.parts[part] = out
        return out

    def of(self, text: str | None, end: int = END) -> bytes:
        raw = (text or "").encode("utf-8")
        if _SPECIAL not in raw:  # the vocabulary is lower case, but for its special tokens
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split())) + end.to_bytes(WIDTH, "little")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Places pieces (doc_id, start, doc_tokens, ids) into at most ``windows`` open windows; full ones are in ``full``."""

    def __init__(self, size: int = SIZE, windows: int = WINDOWS) -> None:
        self.size, self.windows = size, windows
        self.open: list[tuple[int, list]] = []  # tokens, pieces
        self.full: list[list] = []

    def place(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> None:
        while ids:
            n = len(ids) // WIDTH
            if n >= self.size:
                at, take = None, self.size
            else:
                fitting = [k for k, (used, _) in enumerate(self.open) if used + n <= self.size]
                if fitting:
                    at, take = max(fitting, key=lambda k: self.open[k][0]), n
                elif len(self.open) < self.windows:
                    at, take = None, n
                else:
                    at = max(range(len(self.open)), key=lambda k: self.open[k][0])
                    take = self.size - self.open[at][0]
            used, pieces = (0, []) if at is None else self.open.pop(at)
            pieces.append((doc_id, start, doc_tokens, ids[: take * WIDTH]))
            if used + take == self.size:
                self.full.append(pieces)
            else:
                self.open.append((used + take, pieces))
            ids, start = ids[take * WIDTH :], start + take

    def finish(self) -> list[list]:
        """Join the open windows, fullest first: sequences of the full size, then of powers of two."""
        rest = deque(p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces)
        left, self.open = sum(used for used, _ in self.open), []
        out: list[list] = []
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left, sequence = left - room, []
            while room:
                doc_id, start, doc_tokens, ids = rest.popleft()
                n = len(ids) // WIDTH
                sequence.append((doc_id, start, doc_tokens, ids[: room * WIDTH]))
                if n > room:
                    rest.appendleft((doc_id, start + room, doc_tokens, ids[room * WIDTH :]))
                room -= min(n, room)
            out.append(sequence)
        return out


_COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def rows(sequences: list[tuple[int, list]], keep: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for sequence_id, pieces in sequences:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // WIDTH
            out.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence_id, offset, ids if keep else None))
            offset += n
    columns = zip(*out, strict=True) if out else [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True)], names=list(_COLUMNS))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, windows: int = WINDOWS, end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of ``docs`` (doc_id, text, others).

    Every token of a document and its ``end`` lies in one piece; sequences are filled without gaps. Null and empty texts
    are the end token alone. A row is a document, so repeated rows are packed as often as they come; a null id is kept. An
    empty table gives an empty result. ``path`` is the vocabulary's file; it must be at the same place on all machines.
    """
    path = path or local_path("word_bpe_49k.json")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(size, windows)
        number, base = 0, TaskContext.get().partitionId() << 32
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode.of(text, end)
                packer.place(doc_id, 0, len(ids) // WIDTH, ids)
            yield rows([(base + number + k, s) for k, s in enumerate(packer.full)], keep=False)
            number, packer.full = number + len(packer.full), []
        yield rows([(base + number + k, pieces) for k, (_, pieces) in enumerate(packer.open)], keep=True)

    def merged(key: tuple, left: pa.Table) -> pa.Table:
        packer, group = Packer(size, windows), key[0].as_py()
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for piece in zip(*(left.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            packer.place(*piece)
        sequences = packer.full + packer.finish()
        return pa.Table.from_batches([rows([(_LEFT + (group << 32) + k, s) for k, s in enumerate(sequences)], keep=False)])

    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, _SCHEMA), "packed-pieces")
    left = pieces.filter("ids is not null").withColumn("part", F.shiftright("sequence_id", 32).cast("long"))
    left = left.withColumn("group", F.floor(F.col("part") / GROUP).cast("long")).drop("part")
    # the same columns from every group, its key taken off again
    left = left.groupBy("group").applyInArrow(merged, _SCHEMA)
    return pieces.filter("ids is null").unionByName(left).drop("ids")
