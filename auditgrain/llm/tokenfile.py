"""Token ids of documents in files that give any id without decoding a block.

A file holds its ids as directly addressable codes: every id is cut into chunks of bits, from the
lowest. Level 1 has the first chunk of all ids, level k + 1 the next chunk of those that go on, packed
without gaps. A bitmap for each level marks the ids that go on, and a directory counts the marks before
every 512th, so that the place of an id in the next level is one count and at most 64 bytes of bitmap.
Widths of chunks are chosen for each file, so that its size is least. Layout:

    magic | for each level: codes, bitmap, directory | documents (Arrow stream) | footer (JSON) | its length | magic

Spark deals the documents to ranges of ids; a task writes the files of its range in order, in bounded
portions, and a table with a row for each file, committed by Spark, says which files count. What a lost
or repeated attempt of a task wrote is in no row.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditgrain.llm.bpe import byte_symbols
from auditgrain.llm.common import column, pieces, texts_of
from auditgrain.session import fresh_path, materialize

MAGIC = b"DACIDS1\n"
#: Marks of a bitmap between two counts of its directory.
BLOCK = 512
#: Ids of a file (the last document may go beyond), bytes of text of a range, pieces of text a task remembers.
IDS, RANGE_BYTES, REMEMBERED = 1 << 22, 32 << 20, 300_000


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, one behind the other, from the lowest bit of each byte."""
    out = []
    for s in range(0, len(values), 1 << 18):
        part = np.ascontiguousarray(values[s : s + (1 << 18)], "<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, width: int, first: int, count: int) -> np.ndarray:
    """`count` packed values of `width` bits; the first begins at bit `first` of the data."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # eight bytes from every byte on
    at = first + np.arange(count, dtype=np.int64) * width
    return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def best_widths(ids: np.ndarray) -> list[int]:
    """Widths of the levels that make codes, bitmaps and directories smallest together."""
    longest = max(1, int(ids.max(initial=0)).bit_length())
    beyond = [len(ids), *(int(np.count_nonzero(ids >= (1 << s))) for s in range(1, longest))]  # values with bits from s on
    cost: dict[int, tuple[float, int]] = {longest: (0.0, 0)}
    for s in range(longest - 1, -1, -1):
        mark = 1 + 32 / BLOCK
        cost[s] = min((beyond[s] * (w + (mark if s + w < longest else 0)) + cost[s + w][0], w) for w in range(1, longest - s + 1))
    widths, s = [], 0
    while s < longest:
        widths.append(cost[s][1])
        s += widths[-1]
    return widths


def encode_file(ids: np.ndarray, documents: pa.Table, widths: Sequence[int] | None = None) -> bytes:
    """The bytes of a file. `widths` must reach the longest id; unless given they are the best ones."""
    parts, levels, at = [MAGIC], [], len(MAGIC)

    def put(data: bytes) -> list[int]:
        nonlocal at
        parts.append(data)
        at += len(data)
        return [at - len(data), len(data)]

    rest = np.ascontiguousarray(ids, np.uint32)
    for k, width in enumerate(chosen := list(widths or best_widths(rest))):
        level = {"count": len(rest), "width": width, "codes": put(pack(rest, width))}
        levels.append(level)
        rest = (rest.astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
        if k == len(chosen) - 1:
            if rest.any():
                raise ValueError("the widths do not reach the longest id")
            break
        more = rest > 0
        level["more"] = put(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
        level["counts"] = put((np.cumsum(counts) - counts).astype("<u4").tobytes())
        rest = rest[more]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as out:
        out.write_table(documents)
    footer = {"ids": len(ids), "levels": levels, "documents": put(sink.getvalue().to_pybytes())}
    tail = json.dumps(footer).encode()
    return b"".join([*parts, tail, struct.pack("<I", len(tail)), MAGIC])


class TokenFile:
    """One file, read piece by piece: only the bytes that an answer needs."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        length, magic = struct.unpack("<I8s", source.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError("no file of token ids")
        footer = json.loads(source.read_at(length, size - 12 - length))
        self.levels, self._documents, self.size = footer["levels"], footer["documents"], footer["ids"]

    def _read(self, section: Sequence[int], start: int, stop: int) -> bytes:
        return self.source.read_at(max(0, min(stop, section[1]) - start), section[0] + start)

    def _before(self, level: dict, k: int) -> int:
        """Marks before place k of a level: a count of its directory and the bitmap behind that."""
        block = k // BLOCK
        known = self._read(level["counts"], 4 * block, 4 * block + 4)
        if not known:  # k is the end of a level of whole blocks
            return len(np.flatnonzero(np.unpackbits(np.frombuffer(self._read(level["more"], 0, level["count"]), np.uint8))))
        bits = int.from_bytes(self._read(level["more"], block * BLOCK // 8, k // 8 + 1), "little")
        return int.from_bytes(known, "little") + (bits & ((1 << k % BLOCK) - 1)).bit_count()

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from `start` to `stop`; those outside are not decoded."""
        stop = self.size if stop is None else stop
        if not 0 <= start <= stop <= self.size:
            raise IndexError("ids beyond the file")
        out, where, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for level in self.levels:
            if not len(where):
                break
            width, stop = level["width"], start + len(where)
            data = self._read(level["codes"], start * width // 8, -(-stop * width // 8))
            out[where] |= unpack(data, width, start * width % 8, len(where)) << np.uint32(shift)
            if "more" in level:
                marks = np.frombuffer(self._read(level["more"], start // 8, -(-stop // 8)), np.uint8)
                where = where[np.unpackbits(marks, bitorder="little")[start % 8 :][: len(where)].astype(bool)]
                start = self._before(level, start)
                shift += width
        return out

    def id(self, k: int) -> int:
        return int(self.ids(k, k + 1)[0])

    def documents(self) -> pa.Table:
        """One row for each document: its key, `start` in this file and `n_tokens`."""
        return pa.ipc.open_stream(self._read(self._documents, 0, self._documents[1])).read_all()


#: How the byte-level splitter of the library cuts a text: letters, numbers, others, white space (a fixed value).
LETTER, NUMBER, OTHER = r"[^\W\d_]", r"\d", r"(?:[^\s\w]|_)"
PIECES = r"'(?:[stmd]|re|ve|ll)| ?{letter}+| ?{number}+| ?{other}+|{blank}+(?!{solid})|{blank}+"


def _below_256(pattern: str) -> str:
    """The characters below 256 of a class, listed: a look into one table, where the class asks its categories."""
    return f"[{''.join(f'\\x{k:02x}' for k in range(256) if re.fullmatch(pattern, chr(k)))}]"


#: For any text, and for one whose characters are all below 256.
EVERY = {"letter": LETTER, "number": NUMBER, "other": OTHER, "blank": r"\s", "solid": r"\S"}
NARROW = {name: _below_256(x) for name, x in EVERY.items()}


class Encoder:
    """The tokenizers library behind a memory of pieces.

    Texts are cut into pieces here and a piece that is not remembered goes to the model of the library.
    A character counts only where the library's splitter classes it alike, which is asked once for
    each; a text with another one, or with an added token, goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        splitter = spec["pre_tokenizer"] or {}
        #: whether texts may be cut here
        self.apart = (splitter.get("type"), splitter.get("use_regex"), splitter.get("add_prefix_space"), spec["normalizer"]) == ("ByteLevel", True, False, None)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.pieces, self.narrow_pieces = (re.compile(PIECES.format(**x)).findall for x in (EVERY, NARROW))
        self.classes = [re.compile(x).match for x in (LETTER, NUMBER, OTHER)]
        self.alike: set[str] = set()
        self.symbols = dict(enumerate(byte_symbols()))
        self.model = self.tokenizer.model
        self.memory: dict[str, bytes] = {}

    def _same_class(self, c: str) -> bool:
        """Letter, number, other or white space, in the library as here: what does it join?"""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return [len(cut(x + c)) == 1 for x in "a1!"] == [found(c) is not None for found in self.classes]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 40:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        seen = set(text)
        new = seen - self.alike
        if new:
            new = {c for c in new if not self._same_class(c)}
            self.alike |= seen - new
        if new or not self.apart or any(x in text for x in self.added):
            return self.whole(text)
        get, slow = self.memory.get, self._piece
        cut = self.narrow_pieces if max(seen, default="") <= "\xff" else self.pieces
        return b"".join([get(x) or slow(x) for x in cut(text)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; its memory of pieces is emptied at the end of a task."""
    return Encoder(path)


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    if re.match(r"file:/(?!//)", folder):
        folder = "file:///" + folder[5:].lstrip("/")
    if re.match(r"\w+://", folder):
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


FILE = "part int, file int, path string, documents long, tokens long, bytes long"


def write_tokens(
    df: DataFrame, tokenizer: str, end: int | None = 0, text: str = "text", key: str = "doc_id", ids_per_file: int = IDS,
    range_bytes: int = RANGE_BYTES, folder: str | None = None,
) -> DataFrame:
    """Encode every whole text, append `end` to each and write the ids in ascending order of the key.

    `tokenizer` is the path of a tokenizer file that every executor has; `folder`, a new one under the
    shared folder unless given, must be one that driver and executors share. Returns one row for each
    file: `part` and `file` (their order is that of the ids), path, documents, tokens and bytes.

    Keys may be of any type; null keys come last. Equal keys are ordered by a hash of the text, then by
    their place in the input, and a key of many rows is split among ranges. A null text is an empty
    one. Further columns are left out, so that names cannot clash. An empty table has no files.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)).first()[0] or 0
    order = [F.col("key").asc_nulls_last(), F.col("_hash"), F.col("_row")]
    placed = docs.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranges = placed.repartitionByRange(max(1, -(-total // range_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, part, files = encoder(tokenizer), TaskContext.get().partitionId(), 0
        system, at = store(folder)
        last = b"" if end is None else struct.pack("<I", end)
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, files
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            documents = pa.table({"key": pa.concat_arrays(keys), "start": np.cumsum(sizes) - sizes, "n_tokens": sizes})
            data = encode_file(np.frombuffer(b"".join(ids), "<u4"), documents)
            path = f"{at}/{part:06d}-{files:04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(path) as out:
                out.write(data)
            row = {"part": part, "file": files, "path": path, "documents": len(ids), "tokens": int(sizes.sum()), "bytes": len(data)}
            keys, ids, held, files = [], [], 0, files + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

        system.create_dir(at, recursive=True)
        for batch in pieces(batches, "text", chars=1_000_000, rows=1024):
            for k, x in enumerate(texts_of(batch)):
                keys.append(column(batch, "key").slice(k, 1))
                ids.append(one.encode(x) + last)
                held += len(ids[-1]) // 4
                if held >= ids_per_file:
                    yield flush()
        if ids:
            yield flush()
        one.memory.clear()

    return materialize(ranges.select("key", "text").mapInArrow(run, FILE), "token-files")


def read_tokens(files: DataFrame, folder: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """The documents of files that `write_tokens` wrote: the key, `start` (ids of all documents before
    it), `n_tokens` and `ids` (little-endian unsigned 32-bit integers), all from the files.

    `folder` is any path of the file system that holds them, `kind` the key's type. Only one row for
    each file is ordered as a whole.
    """
    before = F.sum("tokens").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    schema = f"`{key}` {kind}, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as source:
                    one = TokenFile(source)
                    for part in one.documents().to_batches(max_chunksize=1024):
                        starts, sizes = (column(part, n).to_numpy() for n in ("start", "n_tokens"))
                        first = int(starts[0])
                        data = one.ids(first, int(starts[-1] + sizes[-1])).astype("<u4").tobytes()
                        own = [data[4 * (s - first) : 4 * (s - first + n)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [column(part, "key"), pa.array(starts + row["base"]), column(part, "n_tokens"), pa.array(own, pa.binary())],
                            names=[key, "start", "n_tokens", "ids"],
                        )

    return placed.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def token_files(df: DataFrame, tokenizer: str, end: int | None = 0, text: str = "text", key: str = "doc_id", ids_per_file: int = IDS) -> DataFrame:
    """Write the ids of all documents and read the files back: see `write_tokens` and `read_tokens`."""
    folder = fresh_path(df.sparkSession, "tokens")
    files = write_tokens(df, tokenizer, end, text, key, ids_per_file, folder=folder)
    return read_tokens(files, folder, key, df.schema[key].dataType.simpleString())
