"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Items are the documents of the index and every passage of the corpus is a query. A posting's weight is
its BM25 impact as a share of the item's score for itself, so one threshold serves items of any
length. Postings are kept in blocks of items with the largest weight of each block. A passage first
adds up the block maxima of its terms; a block that cannot reach the threshold is passed over whole.
In the blocks that are left, WAND moves from pivot to pivot over the terms' posting lists and scores
only items that can still reach it. Every item at or above the threshold is retrieved, with no limit
on their number, and then verified: the word n-grams of its question and of its answer must both
occur in the passage to the asked share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import column, pieces, schema_of, texts_of

TOKEN = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
BLOCK = 4
#: Postings in one broadcast index; more items are searched in several passes over the corpus.
MOST_POSTINGS = 2_000_000


@dataclass(frozen=True)
class Index:
    terms: dict[str, int]
    items: np.ndarray  # item ids
    words: list[list[str]]  # tokens of each item
    answer: np.ndarray  # first token of the answer
    postings: list[tuple[np.ndarray, np.ndarray]]  # by term: item positions, weights
    maxima: np.ndarray  # blocks x terms: largest weight
    longest: int


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def answer_start(text: str) -> int:
    """Token at which the answer begins: the last sentence, or the last third where there is only one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if TOKEN.search(s)]
    n = len(tokens(text))
    return n - len(tokens(sentences[-1])) if len(sentences) > 1 else n - n // 3


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = MOST_POSTINGS) -> Iterator[Index]:
    """Indexes over all items, each within `most` postings; document frequencies are those of all items.

    Items without a token, with a null text or id match nothing and are left out; of rows with equal
    id and text one is kept.
    """
    known = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["item", "text", "words"])

    rows = known.mapInArrow(split, f"{schema_of(known, ['item', 'text'])}, words array<string>").filter(F.size("words") > 0)
    terms = rows.select(F.explode(F.array_distinct("words")).alias("term"))
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.size("words")).alias("postings")).first()
    if not totals["n"]:
        return
    shards = int(totals["postings"] // most) + 1
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    for shard in range(shards):
        own = rows.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        held = own.orderBy("item", "text").select("item", "text", "words").toArrow().to_pylist()  # within `most` postings
        own_terms = own.select(F.explode("words").alias("term")).distinct()
        frequency = {r["term"]: r["df"] for r in df.join(own_terms, "term", "left_semi").toArrow().to_pylist()}
        if held:
            yield _index(held, frequency, totals["n"], totals["mean"])


def _index(held: list[dict], frequency: dict[str, int], n: int, mean: float) -> Index:
    place = {t: k for k, t in enumerate(sorted(frequency))}
    idf = {t: float(np.log1p((n - f + 0.5) / (f + 0.5))) for t, f in frequency.items()}
    lists: list[list[tuple[int, float]]] = [[] for _ in place]
    for at, row in enumerate(held):
        counts: dict[str, int] = {}
        for w in row["words"]:
            counts[w] = counts.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(row["words"]) / mean)
        impact = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
        whole = sum(impact.values())
        for w, x in impact.items():
            lists[place[w]].append((at, x / whole))
    postings = [(np.array([a for a, _ in x], np.int64), np.array([w for _, w in x])) for x in lists]
    blocks = -(-len(held) // BLOCK)
    maxima = np.zeros((len(place) + 1, blocks), np.float32)
    for t, (at, weight) in enumerate(postings):
        np.maximum.at(maxima[t], at // BLOCK, weight.astype(np.float32))
    return Index(
        place, np.array([r["item"] for r in held]), [r["words"] for r in held], np.array([answer_start(r["text"]) for r in held]),
        postings, maxima, max(len(r["words"]) for r in held),
    )


def block_max_wand(index: Index, terms: np.ndarray, threshold: float, bounds: np.ndarray | None = None) -> list[tuple[int, float]]:
    """Item positions with their scores, all that reach the threshold for the distinct `terms`."""
    bounds = index.maxima[terms].sum(axis=0) if bounds is None else bounds
    found: list[tuple[int, float]] = []
    slack = 1e-4  # the maxima are single precision
    for block in np.flatnonzero(bounds >= threshold - slack).tolist():
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms.tolist():
            at, weight = index.postings[t]
            a, b = np.searchsorted(at, (low, high))
            if a < b:
                cursors.append([at[a:b].tolist(), weight[a:b].tolist(), 0, float(index.maxima[t, block])])
        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold - slack:
                    pivot = c[0][c[2]]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][2]] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[2]] != pivot:
                        break
                    score += c[1][c[2]]
                    c[2] += 1
                if score >= threshold:
                    found.append((pivot, score))
            else:
                for c in cursors:
                    if c[0][c[2]] >= pivot:
                        break
                    while c[2] < len(c[0]) and c[0][c[2]] < pivot:
                        c[2] += 1
            cursors = [c for c in cursors if c[2] < len(c[0])]
    return found


def _grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], passage: list[str], n: int) -> float:
    """Share of the distinct word n-grams of `part` that occur in the passage; an empty part is covered."""
    own = _grams(part, n)
    if not own:
        return 1.0
    return len(own & _grams(passage, min(n, len(part)))) / len(own)


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.7, question: float = 0.8, answer: float = 0.8, shingle: int = 5,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """One row for each document row and item found in it: `doc_id`, `item_id`, `passage` (its first
    token), `score` (BM25 as a share of the item's own), `question_overlap`, `answer_overlap`, each
    taken from the best passage.

    Passages are windows of twice the longest item, half a window apart, so that any item that
    occurs lies whole in one. Null and empty texts hold nothing; rows with a null doc_id are judged
    like others; repeated rows each give their matches; equal scores keep the earlier passage; empty
    tables give an empty result. Only the named columns are read.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, passage long, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in indexes(items, item_id, text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, chars=2_000_000):
                rows = _search(shared.value, texts_of(batch), threshold, question, answer, shingle)
                if rows:
                    at, item, start, score, q, a = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "doc_id").take(pa.array(at)), pa.array(shared.value.items[list(item)]), pa.array(start, pa.int64()), pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())],
                        names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"],
                    )

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def _search(index: Index, texts: list[str], threshold: float, question: float, answer: float, shingle: int) -> list[tuple]:
    window, other = 2 * index.longest, len(index.terms)
    step = index.longest
    code = index.terms.get
    out: list[tuple] = []
    for row, text in enumerate(texts):
        items = tokens(text)
        if not items:
            continue
        codes = np.fromiter((code(w, other) for w in items), np.int64, len(items))
        starts = np.arange(0, max(1, len(items) - step), step)
        # distinct known terms of each half window; a window's bound is at most the sum of its halves'
        half = np.arange(len(items)) // step
        keys = np.unique(half * (other + 1) + codes)
        keys = keys[keys % (other + 1) != other]
        if not len(keys):
            continue
        sums = np.zeros((half[-1] + 2, index.maxima.shape[1]), np.float32)
        owner = keys // (other + 1)
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sums[owner[edges]] = np.add.reduceat(index.maxima[keys % (other + 1)], edges, axis=0)
        sums[:-1] += sums[1:].copy()
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(sums[: len(starts)].max(axis=1) >= threshold - 1e-4).tolist():
            start = int(starts[k])
            terms = np.unique(codes[start : start + window])
            terms = terms[terms != other]
            bounds = index.maxima[terms].sum(axis=0)
            if bounds.max() < threshold - 1e-4:
                continue
            passage = items[start : start + window]
            for at, score in block_max_wand(index, terms, threshold, bounds):
                cut, own = int(index.answer[at]), index.words[at]
                q, a = overlap(own[:cut], passage, shingle), overlap(own[cut:], passage, shingle)
                if q >= question and a >= answer and (at not in best or score > best[at][3]):
                    best[at] = (row, at, start, score, q, a)
        out += best.values()
    return out
