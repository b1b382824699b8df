"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly
the token sequences the merges produce. All arcs with one label end in one state, so a state is the
token read last. The gadget of merge (u, v) -> w takes the v arc away from the state after u, gives
the state after w a copy of the arcs that the state after v has at that moment, and adds a w arc
wherever a u arc leads on to v. Arcs are not stored one by one (there are a billion): a state keeps
the moment of each arc it lost, its copies refer to the state and moment they were copied from, and
an arc that is asked for is looked up along these references once and then kept in a table.

A word is encoded by walking the automaton: every prefix has exactly one accepted path, so the token
that ends at a position is the one token ending there whose arc leaves the state at its start.
Decoding emits the labels of the arcs, with a blank between two, as the file names no decoder.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditgrain.llm.common import column, pieces, schema_of, texts_of

NEVER = 1 << 62
#: Chunks of text whose encoding a task remembers; a full memory is begun anew.
REMEMBERED = 200_000


class MergeAutomaton:
    """Deterministic automaton of the given merges. `vocab` maps labels to token ids."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]]):
        size = max(vocab.values()) + 1
        self.label: list[str] = [""] * size
        for text, token in vocab.items():
            self.label[token] = text
        self.born, self.left, self.right = [0] * size, [0] * size, [0] * size
        self.closed: dict[tuple[int, int], int] = {}
        self.allowed: dict[int, bool] = {}
        dead: set[int] = set()
        for moment, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w]:
                raise ValueError(f"two merges make {a + b!r}")
            reachable = u not in dead and v not in dead and self.closed_at(u, v) == NEVER
            self.born[w], self.left[w], self.right[w] = moment, u, v
            if reachable:
                self.closed[u, v] = moment
            else:
                dead.add(w)
        made = {vocab[a + b] for a, b in merges} | {t for x, t in vocab.items() if len(x.removesuffix("</w>")) == 1}
        self.live = {x: t for x, t in vocab.items() if t not in dead and t in made}
        # ends of labels -> token, or -1 where only a longer label ends so; inside a word and at its end
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for text, token in self.live.items():
            table, text = (self.final, text[:-4]) if text.endswith("</w>") and len(text) > 4 else (self.inner, text)
            for k in range(1, len(text)):
                table.setdefault(text[k:], -1)
            table[text] = token

    def closed_at(self, x: int, y: int) -> int:
        """The merge at which the state after x lost its y arc, or NEVER."""
        if self.born[x] > self.born[y]:
            if self.closed_at(self.right[x], y) < self.born[x]:
                return self.born[x]
        elif self.born[y] and self.closed_at(x, self.left[y]) <= self.born[y]:
            return self.born[y]
        return self.closed.get((x, y), NEVER)

    def arc(self, x: int, y: int) -> bool:
        key = x << 32 | y
        found = self.allowed.get(key)
        if found is None:
            if len(self.allowed) > REMEMBERED:
                self.allowed.clear()
            found = self.allowed[key] = self.closed_at(x, y) == NEVER
        return found

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given as byte symbols."""
        n, allowed = len(word), self.allowed
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            ends = (self.final if end == n else self.inner).get
            for begin in range(end - 1, -1, -1):
                token = ends(word[begin:end])
                if token is None:
                    break
                if token < 0:
                    continue
                if begin:
                    before = last[begin]
                    found = allowed.get(before << 32 | token)
                    if found is None:
                        found = self.arc(before, token)
                    if not found:
                        continue
                last[end], start[end] = token, begin
                break
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Normalisation, pre-splitting and the automaton of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("byte_fallback"):
            raise ValueError("a BPE file with word ends is needed")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = self.automaton.label + [""] * (max([len(self.automaton.label) - 1, *added.values()]) + 1 - len(self.automaton.label))
        for text, token in added.items():
            self.labels[token] = text
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.blank = regex.compile(r"\p{White_Space}+").split
        symbols = byte_symbols()
        self.symbols = {b: symbols[b] for b in range(256)}
        self.assigned: set[str] = set()
        self.file = path
        self.memory: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _newer(self, text: str) -> bytes:
        """A text with code points that Python's Unicode tables lack: normalised and split by the library."""
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.file)
        split = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        ids = [token for piece, _ in split for token in self.automaton.encode_word(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        parts: list[bytes] = []
        for piece in self.split(chunk):
            known = self.words.get(piece)
            if known is None:
                ids = self.automaton.encode_word("".join(map(self.symbols.__getitem__, piece.encode("utf-8", "surrogatepass"))))
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[piece] = known = struct.pack(f"<{len(ids)}I", *ids)
            parts.append(known)
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        out = self.memory[chunk] = parts[0] if len(parts) == 1 else b"".join(parts)
        return out

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            # code points that Python's Unicode tables lack may be classed by later tables
            new = set(text) - self.assigned
            if new:
                if any(unicodedata.category(c) == "Cn" for c in new):
                    return [self._newer(text)]
                self.assigned |= new
            # lower-casing is by character: the final sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        get, slow = self.memory.get, self._chunk
        return [get(c) or slow(c) for c in (filter(None, self.blank(text)) if odd else text.split())]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for k, part in enumerate(self.special.split(text)):
            out += [struct.pack("<I", self.added[part])] if k % 2 else self._plain(part)
        return b"".join(out)

    def forget(self) -> None:
        """Workers outlive their tasks: what a task remembered must not stay in memory beside the next stage."""
        self.memory.clear()
        self.words.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode the whole text of every row.

    `tokenizer` is the path of a tokenizer file that every executor has. Returns the columns of
    `keep`, `n_tokens` and `ids` (little-endian unsigned 32-bit integers). A null text is an empty
    one and has no token; rows, repeated ones too, stay as they are; further columns are left out,
    so that names cannot clash. An empty table gives an empty one.
    """
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        for batch in pieces(batches, text, chars=2_000_000):
            ids = [one.encode(x) for x in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, n) for n in names), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[*names, "n_tokens", "ids"],
            )
        one.forget()

    used = list(dict.fromkeys([*names, text]))
    return df.select(*used).mapInArrow(run, f"{schema_of(df, names)}, n_tokens long, ids binary")


def decode(df: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Decode the column `ids`: the columns of `keep` and `decoded`; null ids decode to an empty text."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        for batch in pieces(batches, "ids", chars=4_000_000):
            texts = [one.decode(x or b"") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    used = list(dict.fromkeys([*names, "ids"]))
    return df.select(*used).mapInArrow(run, f"{schema_of(df, names)}, decoded string")
