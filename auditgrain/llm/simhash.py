"""Near duplicates by SimHash and multi-index hashing.

Fingerprints within `distance` bits of each other have, cut into `distance - 1` segments, at least
one segment in which they differ by one bit at most. Each fingerprint enters one table per segment
and looks up the ball of radius one around its own segment; what it meets is verified on all 64 bits
inside the join, so only links leave it. Equal fingerprints are one node. In a bucket of many
fingerprints, stars around shared one-bit neighbours connect most of them first, and pairs already
on one star are left out, so that a dense group does not yield all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import TO_LOWER, column, pieces, schema_of, texts_of, words
from auditgrain.session import cut_lineage, materialize

#: Fingerprints of one bucket above which stars are looked for first.
CROWDED = 3


def simhash(text: str, width: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles; no word: zero."""
    from xxhash import xxh64_intdigest

    items = words(text.translate(TO_LOWER))
    if not items:
        return 0
    raw = [w.encode("utf-8", "surrogatepass") for w in items]
    n = max(1, len(raw) - width + 1)
    joined = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw]).tolist()
    starts = [0, *ends[: n - 1]]
    stops = ends[width - 1 :] if len(raw) > width else [ends[-1]]
    total = np.zeros(64, np.int64)
    hashes = [xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, stops)]
    for k in range(0, n, 8192):
        part = np.array(hashes[k : k + 8192], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """`doc_id` and `fp` (64 bits in a signed long) of every row, whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, chars=2_000_000):
            fps = np.array([simhash(x, width) for x in texts_of(batch, text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(run, f"{schema_of(docs, ['doc_id'])}, fp long")


def _segments(parts: int) -> list[tuple[int, int]]:
    """First bit and length of each segment."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _key(segment: int, start: int, bits: int, flip: int | None = None) -> Column:
    value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << bits) - 1))
    if flip is not None:
        value = value.bitwiseXOR(F.lit(1 << flip))
    return F.struct(F.lit(segment).alias("segment"), value.alias("value"))


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges `a`, `b` that connect what is linked: the distinct fingerprints `fp` at `distance` bits or fewer.

    Every edge is a link, leads over one shared neighbour at one bit from both ends, or joins two such
    stars of which members are linked; every link follows from edges.
    """
    parts = _segments(max(1, distance - 1))
    one = fps.select("fp").distinct()
    table = one.select("fp", F.explode(F.array(*[_key(k, a, n) for k, (a, n) in enumerate(parts)])).alias("key"))
    crowded = table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED)
    members = table.join(crowded, "key", "left_semi").select("fp").distinct()
    star = members.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])).alias("near"))
    centre = star.groupBy("near").agg(F.min("fp").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("near", "centre")
    label = star.join(centre, "near").groupBy("fp").agg(F.min("centre").alias("label"))
    # one-bit neighbours of one point differ by two bits at most
    labels = cut_lineage(label) if distance >= 2 else label.limit(0)
    labelled = one.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    probes = labelled.select("fp", "label", F.explode(F.array(*[
        _key(k, a, n, flip) for k, (a, n) in enumerate(parts) for flip in [None, *range(n)]
    ])).alias("key"))
    entries = labelled.select(F.col("fp").alias("other"), F.col("label").alias("other_label"), F.explode(F.array(*[
        _key(k, a, n) for k, (a, n) in enumerate(parts)
    ])).alias("key"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance) & (F.col("fp") < F.col("other")) & (F.col("label") != F.col("other_label"))
    met = probes.join(entries.withColumnRenamed("key", "entry"), (F.col("key") == F.col("entry")) & near)
    # members of one star are connected already, so links between two stars are one edge
    found = met.select(F.least("label", "other_label").alias("a"), F.greatest("label", "other_label").alias("b")).distinct()
    return found.union(labels.filter("fp != label").select(F.col("fp").alias("a"), F.col("label").alias("b")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` of every node with an edge; the root is the smallest node of its component.

    Smallest-neighbour labels with pointer jumping, one reliable checkpoint a round; the number of
    rounds grows with the logarithm of the longest chain. Labels are reduced before the shuffle, so a
    node with very many edges is no burden.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        reach = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("m"))
        step = state.join(reach, state.node == reach.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = step.select(F.col("node").alias("via"), F.col("root").alias("next"))
        new = cut_lineage(step.join(jump, step.root == jump.via).select("node", "old", F.least("root", "next").alias("root")))
        state = new.select("node", "root")
        if new.filter("old != root").isEmpty():
            return state


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, text: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id`, `fp`, `component_id`, the smallest doc_id reachable over links.

    A null text counts as empty (fingerprint zero, linked like any other); equal texts share a
    fingerprint; repeated rows give repeated rows; a null doc_id is never a component's name unless
    the component has no other. An empty table gives an empty result. Columns other than doc_id and
    text are not read.
    """
    fps = materialize(fingerprints(docs, width, text), "simhash")
    roots = components(links(fps, distance))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # component sizes vary without bound: names are reduced per root, then looked up per fingerprint
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
