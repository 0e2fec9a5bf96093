"""Token ids in files of patched frame-of-reference blocks.

Texts are dealt by ranges of their id and sorted within; each task encodes its texts and streams their ids into one file, part by part in the
order of ids. A file holds blocks of BLOCK ids: the block's smallest id is subtracted, what is left is packed at the width that PERCENTILE
per cent of it fits, and the others are written whole to an exception list. Then come the starts of the blocks and a table of documents (id,
number of ids), so that any run of ids is read with the blocks that hold it and no others.

File:    MAGIC | blocks | block starts u64 | document ids i64 | known flags u8 | document sizes u64 | trailer
Block:   base u32, count u16, exceptions u16, width u8 | packed bits | exception places u16 | exception values u32
Trailer: ids u64, blocks u64, documents u64, place of the block starts u64 | MAGIC      (all little-endian, bits from the lowest)

A file is written under a name of its own attempt and renamed when whole, and its name depends on its part alone, so a task that runs twice
leaves the same file. Only files named in the table of files are read.

Defined cases: a null text is an empty one and gets its end id only; rows of a null doc_id come first and keep it null; rows of one doc_id
are ordered by a hash of their texts, and equal rows are written as often as they come; a very long text is encoded piece by piece; an empty
table gives no files and no rows; further columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, small_batches

MAGIC = b"LXPFOR1\n"
#: Ids of a block, and the share of them (in per cent) that the packed width must hold.
BLOCK, PERCENTILE = 4096, 90
#: Pieces of text that a worker remembers the ids of; longer ones than PIECE_CHARS aren't remembered.
PIECES, PIECE_CHARS = 300_000, 64
HEAD, TRAILER = "<IHHB", "<QQQQ"
HEAD_BYTES, TRAILER_BYTES = struct.calcsize(HEAD), struct.calcsize(TRAILER)
FILES = "part long, path string, n_docs long, n_ids long"


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- blocks


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65,535 ids."""
    base = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(base)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return struct.pack(HEAD, base, len(ids), len(out), width) + packed + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    base, count, odd, width = struct.unpack_from(HEAD, data)
    size, at = -(-count * width // 8), HEAD_BYTES
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little").reshape(count, width)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :width] = bits
    rest = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()
    places = np.frombuffer(data, "<u2", odd, at + size)
    rest[places] = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
    return rest + np.uint32(base)


class Writer:
    """Streams documents' ids to one file."""

    def __init__(self, to, block: int = BLOCK, percentile: float = PERCENTILE):
        self.to, self.block, self.percentile = to, block, percentile
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.starts, self.docs, self.sizes = [], [], []
        self.at = len(MAGIC)
        to.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= 64 * self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        end = len(ids) - len(ids) % least
        for i in range(0, end, self.block):
            data = pack(ids[i : min(i + self.block, end)], self.percentile)
            self.starts.append(self.at)
            self.at += len(data)
            self.to.write(data)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(self.block)
        self._flush(1)
        known = [d is not None for d in self.docs]
        self.to.write(np.array(self.starts, "<u8").tobytes())
        self.to.write(np.array([d if k else 0 for d, k in zip(self.docs, known, strict=True)], "<i8").tobytes())
        self.to.write(np.array(known, np.uint8).tobytes())
        self.to.write(np.array(self.sizes, "<u8").tobytes())
        self.to.write(struct.pack(TRAILER, self.n_ids, len(self.starts), len(self.docs), self.at) + MAGIC)


class Reader:
    """Reads a file back: whole documents in order, or any run of ids."""

    def __init__(self, path: str):
        fs, inner = filesystem(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        tail = self._at(size - TRAILER_BYTES - len(MAGIC), TRAILER_BYTES + len(MAGIC))
        if tail[TRAILER_BYTES :] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} isn't a whole file of token ids")
        self.n_ids, blocks, docs, at = struct.unpack_from(TRAILER, tail)
        table = self._at(at, size - at)
        self.ends = np.append(np.frombuffer(table, "<u8", blocks), np.uint64(at)).astype(np.int64)
        self.docs = np.frombuffer(table, "<i8", docs, 8 * blocks)
        self.known = np.frombuffer(table, np.uint8, docs, 8 * (blocks + docs)).astype(bool)
        self.sizes = np.frombuffer(table, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)
        self.block = struct.unpack(HEAD, self._at(len(MAGIC), HEAD_BYTES))[1] if blocks else BLOCK

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self._at(int(self.ends[first]), int(self.ends[last + 1] - self.ends[first]))
        cut = self.ends[first : last + 2] - self.ends[first]
        out = np.concatenate([unpack(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return out[start - first * self.block : stop - first * self.block]

    def blocks(self, many: int = 64) -> Iterator[np.ndarray]:
        for at in range(0, self.n_ids, many * self.block):
            yield self.ids(at, min(self.n_ids, at + many * self.block))

    def digests(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(document, its first id's place in the file, number of ids, their CRC-32), document by document; blocks are read once, in order."""
        stream, have, at = self.blocks(), np.zeros(0, "<u4"), 0
        for doc, known, size in zip(self.docs.tolist(), self.known.tolist(), self.sizes.tolist(), strict=True):
            crc, left = 0, size
            while left:
                if not len(have):
                    have = next(stream)
                crc = zlib.crc32(have[:left].astype("<u4").tobytes(), crc)
                left, have = left - len(have[:left]), have[left:]
            yield doc if known else None, at, size, crc
            at += size


# --- encoding


#: How the lower-casing byte-level tokenizer prepares a text, as its file states it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Characters below this are letters, digits and marks that no normal form changes, but for the one capital that becomes two characters.
PLAIN_END, TWOFOLD = 0x250, 0x130


def _classes() -> tuple[re.Pattern, re.Pattern]:
    """Patterns: of pieces of plain characters only; of the words that SPLIT finds in such a piece once it is in lower case."""
    chars = [chr(i) for i in range(PLAIN_END) if i != TWOFOLD]
    of = lambda kind: "".join(re.escape(c) for c in sorted({x for c in chars for x in c.lower()}) if unicodedata.category(c)[0] == kind)
    letters, digits = of("L"), of("N")
    blank = "\t-\r \x85\xa0"
    plain = f"[\\x00-{chr(TWOFOLD - 1)}{chr(TWOFOLD + 1)}-{chr(PLAIN_END - 1)}]*"
    return re.compile(plain), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others, in order, from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """make(key) of keys, remembered; of about 2 * PIECES, what was not asked for in the last PIECES new entries is forgotten."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


def _of_worker(key: str, make: Callable):
    """What a worker process keeps between its tasks."""
    held = sys.modules.setdefault("_lexforge_of_worker", types.ModuleType("_lexforge_of_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a tokenizer file, without special tokens around it. If the file prepares texts as NORMALIZER and SPLIT say, no token
    spans a blank or a line end and words don't depend on each other: the text is cut there, and the library's model is asked for each new
    word of plain characters; other pieces, and those that hold a special token, go through the whole library. Ids of recent pieces and words
    are remembered. Texts of any other tokenizer go to the library whole."""
    return _of_worker(path, lambda: _encoder(path))


def _encoder(path: str) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    before = told["pre_tokenizer"] or {}
    if told["normalizer"] != NORMALIZER or [x for x in before.get("pretokenizers", []) if x["type"] != "ByteLevel"] != [SPLIT]:
        return lambda text: np.array(made.encode(text, add_special_tokens=False).ids, "<u4")
    special = re.compile("|".join(re.escape(x["content"]) for x in told["added_tokens"]) or r"(?!)")
    (plain, words), letters, model = _classes(), _byte_letters(), made.model

    def as_bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word_ids(word: str) -> bytes:
        return as_bytes([x.id for x in model.tokenize(word if word.isascii() and word.isalpha() else "".join(letters[b] for b in word.encode()))])

    known = Recent(word_ids)

    def piece_ids(piece: str) -> bytes:
        if plain.fullmatch(piece) and not special.search(piece):
            return b"".join([known[word] for word in words.findall(piece.lower())])
        return as_bytes(made.encode(piece, add_special_tokens=False).ids)

    pieces = Recent(piece_ids)
    return lambda text: np.frombuffer(b"".join(map(pieces.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


# --- files


def write(scratch: Scratch, docs: DataFrame, root: str, tokenizer: str, end: int, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs into files under root and returns the table of files (part, path, n_docs, n_ids), parts in ascending order of ids."""
    from pyspark import TaskContext

    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(files or parts(docs.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, to = encoder(tokenizer), TaskContext.get().partitionId(), None
        fs, where = filesystem(root)
        name = f"part-{part:07d}.ids"
        own = f"{where}/.{name}.{uuid.uuid4().hex}"
        try:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if to is None:
                        fs.create_dir(where, recursive=True)
                        stream = fs.open_output_stream(own)
                        to = Writer(stream)
                    to.add(doc, np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4"))
            if to is None:
                return
            to.close()
            stream.close()
            fs.move(own, f"{where}/{name}")
        except BaseException:
            if to is not None:
                stream.close()
                fs.delete_file(own)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{root}/{name}"]), pa.array([len(to.docs)]), pa.array([to.n_ids])], ["part", "path", "n_docs", "n_ids"])

    return scratch.save(rows.mapInArrow(run, FILES), "token_files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all documents before it. The window
    is over one row a file."""
    ahead = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("part", "path", F.coalesce(ahead, F.lit(0)).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for doc, at, size, crc in Reader(path).digests():
                    held.append((doc, before + at, size, crc))
                    if len(held) == 10_000:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    return placed.repartition(parts(files.sparkSession)).select("path", "ahead").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
