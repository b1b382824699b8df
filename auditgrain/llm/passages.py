"""Substring dedup: recurring passages, located by sharded Aho-Corasick automata.

1. Anchors: of each window of words, the phrase with the least hash (winnowing). Equal windows have
   equal anchors, so a window can recur only if its anchor occurs in two documents. The anchors that
   do are kept as a Bloom filter of bounded size, which can only admit too much.
2. Windows whose anchor may recur are confirmed on 96 hash bits: the smallest document of each, and
   which shards of documents hold later ones. Rows are reduced to one per window and shard while they
   are made, so a passage that a third of all documents share costs a row for each shard.
3. Each shard of documents compiles the confirmed passages of its documents, words as symbols, into
   one automaton and streams its documents through it; every word under an occurrence of a passage
   that also starts in a document with a smaller id is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import WORD, WordHashes, int_column, mix, pieces, rolling, schema_of, texts_of, words
from auditgrain.session import materialize

PHRASE = 5
#: Bits of the anchor filter: 16 for each recurring anchor, at most 2^27 (16 MB).
FILTER_BITS = 27
#: Words of documents in one shard, about: the automaton of a shard stays within tens of MB.
SHARD_WORDS = 400_000


def _anchors(hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The least phrase hash inside each window of words."""
    spans = rolling(hashes, phrase)
    reach = window - phrase + 1
    if len(spans) < reach:
        return np.empty(0, np.uint64)
    out, have = spans, 1
    while have < reach:  # minimum over doubling spans
        step = min(have, reach - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _changes(x: np.ndarray) -> np.ndarray:
    """Without repeats of the value before: neighbouring windows mostly share their anchor."""
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _second(hashes: np.ndarray, window: int) -> np.ndarray:
    """A second, independent hash of every window, 32 bits."""
    return (rolling(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """`anchor` of every window that occurs in two documents or more, by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in pieces(batches, chars=8_000_000):
            ids = int_column(batch, "doc_id")
            found = [_changes(_anchors(memory.of(words(x)), window, phrase)) for x in texts_of(batch)]
            all_, owner = np.concatenate(found), np.repeat(ids, [len(x) for x in found])
            if not len(all_):
                continue
            order = np.argsort(all_)
            all_, owner = all_[order], owner[order]
            start = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]])
            low, high = np.minimum.reduceat(owner, start), np.maximum.reduceat(owner, start)
            yield pa.RecordBatch.from_arrays([pa.array(all_[start].view(np.int64)), pa.array(low), pa.array(high)], names=["anchor", "low", "high"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "anchor long, low long, high long")
    return rows.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("anchor")


def _cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(anchor)
    return (mixed & np.uint64((1 << bits) - 1)).astype(np.int64), (mixed >> np.uint64(64 - bits)).astype(np.int64)


def anchor_filter(recurring: DataFrame) -> np.ndarray:
    """Bloom filter of the recurring anchors as 64-bit words, at most 2^FILTER_BITS bits.

    Its size follows the number of anchors up to that bound; beyond it more windows are admitted to
    the confirmation, which stays exact.
    """
    count = recurring.count()
    bits = max(16, min(FILTER_BITS, int(count * 16).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _cells(int_column(batch, "anchor").view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b]))], names=["cell"])

    cell = F.col("cell")
    rows = recurring.mapInArrow(run, "cell long").groupBy(F.shiftright(cell, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("set")
    )
    found = rows.toArrow()  # at most 2^(FILTER_BITS - 6) rows of two integers
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("set").to_numpy()
    return out.view(np.uint64)


def _admitted(anchor: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = (len(table) * 64).bit_length() - 1
    a, b = _cells(anchor, bits)
    one = np.uint64(1)
    hit = lambda c: (table[c >> 6] >> (c & 63).astype(np.uint64)) & one
    return (hit(a) & hit(b)).astype(bool)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")


def confirmed(docs: DataFrame, table, window: int, phrase: int, shards: int, parts: int) -> DataFrame:
    """`shard`, `h1`, `h2`, `first`: windows that occur in a shard after their smallest document, `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, filter_ = WordHashes(), table.value
        for batch in pieces(batches, chars=8_000_000):
            ids, kept = int_column(batch, "doc_id"), []
            for doc, own, text in zip(ids.tolist(), int_column(batch, "shard").tolist(), texts_of(batch)):
                hashes = memory.of(words(text))
                at = np.flatnonzero(_admitted(_anchors(hashes, window, phrase), filter_))
                if len(at):
                    a, b = rolling(hashes, window), _second(hashes, window)
                    kept.append((a[at], b[at], np.full(len(at), doc), np.full(len(at), own)))
            if not kept:
                continue
            a, b, doc, shard = (np.concatenate(x) for x in zip(*kept))
            # equal windows of a shard sort together; a pair that is torn apart is joined in the shuffle
            order = np.argsort(a ^ mix(shard.astype(np.uint64)))
            a, b, doc, shard = a[order], b[order], doc[order], shard[order]
            start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (shard[1:] != shard[:-1])])
            low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[start].view(np.int64)), pa.array(b[start]), pa.array(shard[start].astype(np.int32)), pa.array(low), pa.array(high)],
                names=["h1", "h2", "shard", "low", "high"],
            )

    rows = docs.select("doc_id", "text", _shard(shards)).mapInArrow(run, "h1 long, h2 int, shard int, low long, high long")
    # one shuffle: both groupings live on the partitioning by hash
    dealt = rows.repartition(parts, "h1", "h2")
    # at most one entry for each shard, whatever the number of documents
    each = dealt.groupBy("h1", "h2", "shard").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    per = each.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.collect_list(F.struct("shard", "high")).alias("held"))
    later = F.filter("held", lambda x: x["high"] > F.col("first"))
    return per.select("h1", "h2", "first", F.explode(F.transform(later, lambda x: x["shard"])).alias("shard"))


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of set positions."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


class _Codes(dict):
    """Word -> running number."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _coverage(ids: np.ndarray, texts: list[list[str]], h1: np.ndarray, h2: np.ndarray, first: np.ndarray, window: int) -> list[np.ndarray]:
    """Which words of each document of one shard an automaton of its recurring passages covers."""
    import ahocorasick

    codes, memory = _Codes(), WordHashes()
    coded = [np.fromiter(map(codes.__getitem__, items), np.uint32, len(items)) for items in texts]
    value = memory.of(list(codes)) if codes else np.empty(0, np.uint64)
    order = np.lexsort((h2, h1.view(np.uint64)))
    h1, h2, first = h1[order].view(np.uint64), h2[order], first[order]
    encoded: list[str | None] = [None] * len(coded)
    automaton = ahocorasick.Automaton()
    for k, (doc, own) in enumerate(zip(ids.tolist(), coded)):
        hashes = value[own]
        a = rolling(hashes, window)
        if not len(a) or not len(h1):
            continue
        at = np.searchsorted(h1, a)
        live = np.flatnonzero(h1[np.minimum(at, len(h1) - 1)] == a)
        if not len(live):  # no window of it recurs: no passage can occur in it
            continue
        b = _second(hashes, window)
        source = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):  # h1 alone may repeat
            hit = h2[at[live]] == b[live]
            source[live[hit]] = first[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < len(h1)]
            live = live[h1[at[live]] == a[live]]
        # a character per word of the shard; surrogates are left out
        line = encoded[k] = (own + np.where(own < 0xD7FF, 1, 0x801).astype(np.uint32)).tobytes().decode("utf-32-le")
        for start, stop in _runs(source < doc):
            passage = line[start : stop + window - 1]
            sources = int(source[start:stop].max())
            known = automaton.get(passage, None)
            if known is None or sources < known[1]:
                automaton.add_word(passage, (len(passage), sources))
    out = [np.zeros(len(own), bool) for own in coded]
    if len(automaton):
        automaton.make_automaton()
        for doc, line, cover in zip(ids.tolist(), encoded, out):
            if line is None:
                continue
            reach = np.zeros(len(line) + 1, np.int64)
            for end, (length, sources) in automaton.iter(line):
                if sources < doc:
                    reach[end + 1 - length] += 1
                    reach[end + 1] -= 1
            cover[:] = np.cumsum(reach[:-1]) > 0
    return out


def locate(docs: DataFrame, window: int = 13, phrase: int = PHRASE, keep: tuple[str, ...] = (), cleaned: bool = False) -> DataFrame:
    """Remove words covered by windows that also start in a document with a smaller id.

    Returns, for every row of `docs`, `doc_id`, the columns of `keep`, `n_words`, `n_removed`,
    and `kept` (the kept words joined by one space) or, if asked for, `cleaned` instead (the text
    without the removed words and the blanks that follow them, so that kept lines stay lines). A null text has no words and gives
    empty texts; a row with a null doc_id is neither a source nor shortened; rows that share a doc_id
    are not compared with each other; a text of fewer words than a window stays. An empty table gives
    an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null and text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recurring = materialize(anchors(known, window, phrase), "anchors")
    size = known.select((F.sum(F.length("text")) / 6).cast("long").alias("n")).first()["n"] or 0
    shards = max(1, int(size) // SHARD_WORDS)
    filter_ = spark.sparkContext.broadcast(anchor_filter(recurring))
    found = confirmed(known, filter_, window, phrase, shards, max(parts, shards // 4))
    names = ["doc_id", *keep]
    source = docs.select(*names, "text", _shard(shards))
    out = ", ".join([schema_of(docs, names), f"n_words long, n_removed long, {'cleaned' if cleaned else 'kept'} string"])

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [x or "" for x in left.column("text").to_pylist()]
        items = [words(x) for x in texts]
        null = left.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids = left.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        cover = _coverage(ids, items, *(right.column(c).to_numpy() for c in ("h1", "h2", "first")), window)
        left_over, removed = [], []
        for text, own, gone, skip in zip(texts, items, cover, null):
            hit = not skip and bool(gone.any())
            removed.append(int(gone.sum()) if hit else 0)
            if not cleaned:
                left_over.append(" ".join([w for w, g in zip(own, gone.tolist()) if not g] if hit else own))
            elif hit:
                starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
                spans, at = [], 0
                for a, b in _runs(gone):
                    spans.append(text[at : starts[a]])
                    at = starts[b]
                left_over.append("".join([*spans, text[at:]]))
            else:
                left_over.append(text)
        arrays = [pa.array([len(x) for x in items], pa.int64()), pa.array(removed, pa.int64()), pa.array(left_over, pa.string())]
        return pa.table([*(left.column(n) for n in names), *arrays], names=[*names, "n_words", "n_removed", "cleaned" if cleaned else "kept"])

    return source.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, out)
