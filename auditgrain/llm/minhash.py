"""Document fingerprints: MinHash signatures, bands joined in Spark, Jaccard verified.

A signature holds, for each of many universal hash permutations, the least value over the word
shingles of a text, computed for blocks of shingles at once in numpy. Band keys of the signatures are
joined in Spark; each band bucket links its members to its smallest member, and what that misses is
joined in blocks. Links are verified on the shingles and span the classes, not all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import WordHashes, column, lower_ascii, pieces, rolling, schema_of, texts_of, words
from auditgrain.llm.passages import _admitted, anchor_filter
from auditgrain.llm.simhash import components
from auditgrain.session import materialize

WIDTH = 5
PERMUTATIONS = 128
#: Of pairs at exactly SIMILAR, 5 in 100,000 share no band of five.
BANDS = 25
SIMILAR = 0.8
#: The six ASCII blanks.
BLANKS = " \t\n\v\f\r"
#: Rows of a block of a large bucket, about.
BLOCK_ROWS = 256
_BLOCK = 256


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240531)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def shingles(text: str, memory: WordHashes, width: int = WIDTH) -> np.ndarray:
    """32-bit hashes of the distinct word shingles (A-Z in lower case); fewer words: one shingle; none: none."""
    return _shingled(memory.of(words(lower_ascii(text))), width)


def _shingled(hashes: np.ndarray, width: int) -> np.ndarray:
    if not len(hashes):
        return np.empty(0, np.uint32)
    return np.unique((rolling(hashes, min(width, len(hashes))) >> np.uint64(32)).astype(np.uint32))


def edited_hashes(text: str, hashes: np.ndarray, kept: int, tail: str, memory: WordHashes) -> np.ndarray:
    """Word hashes of the first `kept` code points of a text, whose own are `hashes`, and the tail behind them.

    Words that end before the last blank of what is kept are hashed already.
    """
    whole = 1 + max(text.rfind(blank, 0, kept) for blank in BLANKS)
    return np.concatenate([hashes[: len(words(text[:whole]))], memory.of(words(lower_ascii(text[whole:kept] + tail)))])


def signature(found: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits for each permutation; a text without words has all ones."""
    a, b = permutations
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    held = np.empty((min(_BLOCK, len(found)), len(a)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), _BLOCK):
            block = found[k : k + _BLOCK, None]
            values = np.multiply(block, a[None, :], out=held[: len(block)])
            values += b
            np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint32(16)).astype(">u2")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal components: an estimate of the Jaccard similarity."""
    return float(np.mean(x == y))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets of shingles; two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _buckets(docs: DataFrame, parts: int) -> list[int]:
    """Smallest doc_id of each range of ids, in order; ids alone are read."""
    ids = docs.filter("doc_id is not null").select("doc_id").repartitionByRange(parts, "doc_id")
    rows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    return sorted(r["low"] for r in rows.collect())  # one row for each partition


def with_next(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[int]]:
    """Rows dealt to ranges of doc_id, descending inside each, with the row that follows the range.

    Ranges come from the ids alone. The largest row of a range is also sent to the range above it,
    flagged as `extra`, and the largest row of all to the lowest range, so every row meets the one
    that follows it without a window over all rows.
    """
    spark = docs.sparkSession
    lows = _buckets(docs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    highs = _tops(docs, lows)
    return _deal(docs, lows, highs, text), lows


def _tops(docs: DataFrame, lows: list[int]) -> list[int]:
    """Largest doc_id of each range."""
    rows = docs.filter("doc_id is not null").select(_range_of(lows), "doc_id").groupBy("range").agg(F.max("doc_id").alias("high"))
    found = {r["range"]: r["high"] for r in rows.collect()}  # one row for each range
    return [found[k] for k in range(len(lows))]


def _range_of(lows: list[int]) -> Column:
    """Range of each doc_id by binary search; rows without an id are in the lowest."""
    bounds = np.array(lows, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right") - 1, 0).astype(np.int32))

    low = lows[0] if lows else 0
    return place(F.coalesce("doc_id", F.lit(low))).alias("range")


def _deal(docs: DataFrame, lows: list[int], highs: list[int], text: str) -> DataFrame:
    n = max(1, len(lows))
    rows = docs.select("doc_id", F.col(text).alias("text"), _range_of(lows))
    top = F.array(*[F.lit(x) for x in highs]) if highs else F.array().cast("array<long>")
    is_top = F.coalesce(F.get(top, F.col("range")) == F.col("doc_id"), F.lit(False))
    # the range above reads the top row after its own last row; the lowest range is followed by the top of all
    target = F.when(F.col("range") + 1 < n, F.col("range") + 1).otherwise(0)
    dealt = rows.select("doc_id", "text", F.explode(F.when(is_top, F.array(
        F.struct(F.col("range").alias("to"), F.lit(False).alias("extra")), F.struct(target.alias("to"), F.lit(True).alias("extra")),
    )).otherwise(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("extra"))))).alias("x")).select("doc_id", "text", "x.to", "x.extra")
    order = [F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return dealt.repartitionById(n, F.col("to")).sortWithinPartitions(*order)


SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "jaccard_edited double, jaccard_next double, text_sha256 string"
)


def edited_pairs(docs: DataFrame, text: str = "text", width: int = WIDTH, permutations: int = PERMUTATIONS) -> DataFrame:
    """Every row with its fingerprint and that of its edited text, and their likeness to each other and to the next row.

    The edited text replaces the last third of the code points by as many from the start of the next
    row, in descending doc_id; the last row is followed by the first. `jaccard_*` verify the likeness
    on the shingles. A null text is empty; equal texts have equal fingerprints; rows that share a
    doc_id follow each other in the order of their texts; rows without a doc_id come last. A single
    row is its own next row. An empty table gives an empty one. Other columns are not read.
    """
    dealt, _ = with_next(docs, text)
    names = ["doc_id", *[c.split(" ")[0] for c in SCHEMA.split(", ")]]
    own_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, perms = WordHashes(), _permutations(permutations)

        def view(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = _shingled(hashes, width)
            return found, signature(found, perms)

        def pair(own: tuple, after: tuple) -> tuple:
            text, cut = own[1], len(own[1]) // 3
            tail = after[1][:cut]
            hashes = edited_hashes(text, own[2], len(text) - cut, tail, memory)
            return _pair(own, after, text[: len(text) - cut] + tail, *view(hashes))

        held = None  # the row before, which waits for its next
        for batch in pieces(batches, chars=2_000_000):
            out = []
            for doc, item, extra in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), column(batch, "extra").to_pylist()):
                hashes = memory.of(words(lower_ascii(item)))
                own = (doc, item, hashes, *view(hashes))
                if held is not None:
                    out.append(pair(held, own))
                held = None if extra else own
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=_arrow(own_type))
        if held is not None:  # only where no row follows at all
            yield pa.RecordBatch.from_pylist([dict(zip(names, pair(held, held)))], schema=_arrow(own_type))

    return dealt.mapInArrow(run, f"doc_id {own_type}, {SCHEMA}")


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _arrow(own_type: str) -> pa.Schema:
    fields = [("doc_id", own_type), *[tuple(c.split(" ")) for c in SCHEMA.split(", ")]]
    return pa.schema([(n, _ARROW[k]) for n, k in fields])


def _pair(own: tuple, after: tuple, edited: str, edited_found: np.ndarray, edited_sig: np.ndarray) -> tuple:
    doc, text, _, found, sig = own
    _, _, _, next_found, next_sig = after
    return (
        doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), sig.tobytes().hex(), edited_sig.tobytes().hex(),
        likeness(sig, edited_sig), likeness(sig, next_sig), jaccard(found, edited_found), jaccard(found, next_found), _body(text),
    )


def _prints(docs: DataFrame, text: str, width: int, permutations: int) -> DataFrame:
    """`doc_id`, `text_sha256` and `fingerprint` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, perms = WordHashes(), _permutations(permutations)
        for batch in pieces(batches, chars=2_000_000):
            texts = texts_of(batch)
            signs = [signature(shingles(x, memory, width), perms).tobytes().hex() for x in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([_body(x) for x in texts]), pa.array(signs, pa.string())], names=["doc_id", "text_sha256", "fingerprint"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, text_sha256 string, fingerprint string")


def _body(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, permutations: int = PERMUTATIONS, width: int = WIDTH, text: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """`a`, `b`, `jaccard`: verified links that connect whatever shares a band and is similar.

    Equal texts are one node, named by their smallest doc_id; the membership of copies is
    `copies(docs)`. A bucket's members are compared with its smallest node first. Members that are not
    similar to it meet each other and those similar to it, unless the distances to the smallest node
    rule a link out (Jaccard distance obeys the triangle inequality); large buckets are dealt as pairs
    of blocks. Two members that other links of their blocks connect get no link of their own, so the
    links span the classes of all similar pairs. `prints` holds the fingerprints where they are known.
    Rows without a doc_id are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if prints is None:
        prints = materialize(_prints(docs, text, width, permutations), "minhash", "zstd")
    nodes = prints.filter("doc_id is not null").groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"))
    wide = permutations // bands * 4  # hex digits of a band
    keys = [F.xxhash64(F.lit(k), F.substring("fingerprint", 1 + k * wide, wide)) for k in range(bands)]
    dealt = materialize(nodes.select("doc_id", "text_sha256", F.explode(F.array(*keys)).alias("band")), "minhash", "zstd")
    rows = dealt.select("doc_id", "band")
    centre = rows.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a")
    members = materialize(rows.join(centre, "band").select("band", "a", F.col("doc_id").alias("b")), "minhash", "zstd")
    wanted = materialize(members.select(F.col("b").alias("doc_id")).distinct().join(dealt.select("doc_id", "text_sha256").distinct(), "doc_id"), "minhash", "zstd")
    # texts that no bucket asks for are not shuffled; what a Bloom filter of bounded size lets through, the join tells apart
    key = F.xxhash64("doc_id", "text_sha256")
    filter_ = docs.sparkSession.sparkContext.broadcast(anchor_filter(wanted.select(key.alias("anchor"))))

    @F.pandas_udf("boolean")
    def asked_for(keys: pd.Series) -> pd.Series:
        return pd.Series(_admitted(keys.to_numpy(np.int64).view(np.uint64), filter_.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in pieces(batches, chars=2_000_000):
            found = [shingles(x, memory, width).tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    body = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    given = docs.select("doc_id", F.col(text).alias("text"), body.alias("text_sha256")).filter(asked_for(key)).join(wanted, ["doc_id", "text_sha256"], "left_semi")
    sets = given.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles binary").groupBy("doc_id").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "minhash")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[np.frombuffer(x, np.uint32) for x in column(batch, c).to_pylist()] for c in ("sa", "sb")]
            values = [jaccard(x, y) for x, y in zip(*both)]
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(values, pa.float64())], names=["a", "b", "jaccard"])

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    pairs = members.filter("b > a").select("a", "b").distinct()
    stars = materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(verify, f"a {kind}, b {kind}, jaccard double"), "minhash")
    near = stars.filter(F.col("jaccard") >= similar)
    return near.union(_beyond(members, stars, sets, similar, kind)).distinct()


def _beyond(members: DataFrame, stars: DataFrame, sets: DataFrame, similar: float, kind: str) -> DataFrame:
    """Links of members that are not similar to the smallest node of their bucket."""
    measured = members.filter("b > a").join(stars, ["a", "b"]).select("band", F.col("b").alias("doc_id"), "jaccard")
    apart = measured.filter(F.col("jaccard") < similar).groupBy("band").agg(F.max("jaccard").alias("top"))
    left = measured.join(apart, "band").filter(F.col("jaccard") <= F.col("top") + (1 - similar) + 1e-9)
    blocks = left.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int").alias("n"))
    own = left.join(blocks, "band").select(
        "band", "doc_id", (F.col("jaccard") >= similar).alias("linked"), F.pmod(F.xxhash64("doc_id", "band"), F.col("n")).cast("int").alias("own"), "n"
    )
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(sets, "doc_id").select(
        "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", "linked", "own", "shingles"
    )
    schema = pa.schema([("a", _ARROW[kind]), ("b", _ARROW[kind]), ("jaccard", pa.float64())])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        names, linked, block = (rows.column(c).to_pylist() for c in ("doc_id", "linked", "own"))
        found = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
        out = _span(names, found, linked, block if key[1].as_py() != key[2].as_py() else None, similar)
        return pa.Table.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)

    return dealt.groupBy("band", "low", "high").applyInArrow(meet, f"a {kind}, b {kind}, jaccard double")


def _span(names: list, found: list[np.ndarray], linked: list[bool], block: list[int] | None, similar: float) -> list[tuple]:
    """Links that connect all similar pairs; of two blocks, pairs across them. `linked` members are connected already.

    A pair is similar only if both hold one of the first values of the other (prefix), and at similar sizes.
    """
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    together = [k for k, x in enumerate(linked) if x]
    for k in together:
        parent[k] = together[0]
    out, holders = [], {}
    for x in sorted(range(len(names)), key=lambda k: len(found[k])):
        size = len(found[x])
        first = found[x][: size - math.ceil(similar * size - 1e-9) + 1].tolist() or [None]
        for y in sorted({y for v in first for y in holders.get(v, ())}):
            if find(x) == find(y) or len(found[y]) < similar * size - 1e-9 or block is not None and block[x] == block[y]:
                continue
            value = jaccard(found[x], found[y])
            if value >= similar:
                parent[find(x)] = find(y)
                out.append((min(names[x], names[y]), max(names[x], names[y]), value))
        for v in first:
            holders.setdefault(v, []).append(x)
    return out


def with_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`edited_pairs` with `near_class`, the smallest doc_id that verified links reach from a row's text."""
    rows = materialize(edited_pairs(docs, text), "minhash", "zstd")  # fingerprints are hex digits
    nodes = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("least"))
    roots = components(near_duplicates(docs, text=text, prints=rows))
    named = nodes.join(roots, nodes.least == roots.node, "left").select("text_sha256", F.coalesce("root", "least").alias("near_class"))
    return rows.join(named, "text_sha256").select(*rows.columns, "near_class")


def copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id` and `node`: the smallest doc_id with the same text."""
    known = docs.filter("doc_id is not null").select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("body"))
    return known.join(known.groupBy("body").agg(F.min("doc_id").alias("node")), "body").select("doc_id", "node")
