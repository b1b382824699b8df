"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
#: Words: everything but the six ASCII blanks.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: What `str.split` also takes for a blank, apart from the six ASCII blanks: in ASCII texts, and in others.
_ASCII_BLANKS = tuple("\x1c\x1d\x1e\x1f")
_OTHER_BLANKS = (*_ASCII_BLANKS, *"\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))

MASK64 = (1 << 64) - 1


def words(text: str) -> list[str]:
    """Words between ASCII blanks; by `str.split`, which is faster, where the text has no other blank."""
    for blank in _ASCII_BLANKS if text.isascii() else _OTHER_BLANKS:
        if blank in text:
            return WORD.findall(text)
    return text.split()


def lower_ascii(text: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def fold(part: int) -> Column:
    """The fold of a row: crc32 of doc_id as text, modulo 5, equal to `part`; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == part, F.lit(False))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 4_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with bounded text, so that Python objects of a slice stay small.

    A slice holds whole rows: at least one, however long its text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + chars, side="right"))), start + rows)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = min(stop, batch.num_rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column that has no nulls."""
    return column(batch, name).to_numpy(zero_copy_only=False)


def schema_of(df: DataFrame, names: Sequence[str]) -> str:
    """DDL of the named columns."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to `most` words and then begun anew; hashes do not depend on it."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        try:
            value = xxh3_64_intdigest(word)
        except UnicodeEncodeError:  # a lone surrogate
            value = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, items: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), dtype=np.uint64, count=len(items))


#: Odd multiplier of rolling hashes.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive word hashes, mixed so that all bits vary."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, width):
            out *= ROLL
            out += hashes[j : j + n]
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
