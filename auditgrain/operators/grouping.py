"""Text vectors, exact similarity joins and leader grouping at scale.

Grouping reproduces a sequential rule - take texts in hash order; a text joins the most similar
earlier leader of its theme, or becomes a leader - without comparing all pairs:

* texts with equal vectors collapse to one node, so a huge group of copies is one node;
* nodes of a theme are dealt to blocks, and a task multiplies two blocks: every pair is scored, and only
  pairs at the threshold leave the task. Postings of whole documents would shuffle each pair once a token;
* nodes are taken in blocks of hash order that double in size. A block is compared within itself
  only after everything close to an earlier leader has been removed. Hash order is random, so what
  is left of a block has few neighbours: a third of all texts being near copies costs one leader in
  the first block, not all their pairs;
* a leader is compared with all later nodes once, which also yields the memberships.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from auditgrain.functions.expressions import compute_once
from auditgrain.session import cut_lineage, materialize

# --- fixed values of the lexical vectors ----------------------------------------------------------
TOKEN = r"[a-z0-9]{3,}"
ALIASES = {"entries": "records", "record": "records", "laboratories": "laboratory"}
STOP = [
    "the", "and", "were", "was", "for", "with", "that", "not", "are", "your", "specifically", "failure", "maintain",
    "documented",
]
BOOST_WORDS = ["contemporaneous", "retrospectiv", "backdat", "after testing"]
BOOST_TOKEN, BOOST_COUNT = "record_timing", 5
DEFAULT_THRESHOLD = 0.78
LSH_TABLES, LSH_BITS, LSH_SEED = 12, 12, 42
LSH_PROBES, LSH_RECALL = 24, 0.95
POSTING_BLOCK = 1024
# --- end of fixed values ------------------------------------------------------------------------
METHOD = "lexical_cosine"
SLACK = 1e-9
#: Nodes of a block at most, and numbers in its vectors, about.
BLOCK_NODES, BLOCK_NUMBERS = 8192, 2_000_000
#: A token in more than this part of a block's vectors is a column of a plain matrix, others are lists.
COMMON, MOST_COMMON = 1 / 16, 1024
#: Numbers that a task works on at once.
AT_ONCE = 1_000_000
#: A pair met in buckets costs about so many pairs of a matrix product.
BUCKET_COST = 32


def lexical_vector(
    texts: DataFrame, aliases: Mapping[str, str] = ALIASES, stop: Sequence[str] = STOP,
    boost_words: Sequence[str] = BOOST_WORDS, packed: bool = False,
) -> DataFrame:
    """Unit token vectors as rows (hash, token, weight). Input: one row per hash.

    A text's tokens are sorted and the runs of equal ones counted within its row: nothing is shuffled,
    and a task holds one text's tokens at a time. `packed` gives one row per text with its whole vector,
    tokens as codes, for those who compare texts and name no token.
    """
    if packed:
        return _packed_vector(texts, aliases, stop, boost_words)
    low = F.lower("text")
    found = F.filter(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*stop))
    renamed = found
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        renamed = F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), t))
    boosted = F.lit(False)
    for word in boost_words:
        boosted = boosted | F.contains(low, F.lit(word))
    tokens = F.when(boosted, F.concat(renamed, F.array_repeat(F.lit(BOOST_TOKEN), BOOST_COUNT))).otherwise(renamed)
    rows = compute_once(texts.select("hash", "text"), {"_t": F.array_sort(tokens)}).select("hash", "_t").filter(F.size("_t") > 0)
    token = lambda i: F.get("_t", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (token(i) != token(i - 1)))
    rows = compute_once(rows, {"_s": starts})
    runs = F.transform("_s", lambda s, k: F.struct(token(s).alias("token"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - s).cast("long").alias("c")))
    rows = compute_once(rows, {"_r": runs}).select("hash", "_r")
    norm = F.sqrt(F.aggregate("_r", F.lit(0).cast("long"), lambda n, r: n + r["c"] * r["c"]).cast("double"))
    rows = compute_once(rows, {"_n": norm})
    return rows.select("hash", "_n", F.inline("_r")).select("hash", "token", (F.col("c") / F.col("_n")).alias("weight"))


class _Codes(dict):
    """Token -> 64 bits of its digest, remembered for the tokens met last."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[token] = value = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)
        return value


def _packed_vector(texts: DataFrame, aliases: Mapping[str, str], stop: Sequence[str], boost_words: Sequence[str]) -> DataFrame:
    """The vectors of `lexical_vector` with a row per text: (hash, vec, key), `vec` being sorted codes of tokens and
    their weights, `key` the same for equal vectors alone. A text without tokens has an empty vector and no key.
    """
    renamed, left_out, boosts, token = dict(aliases), tuple(stop), tuple(boost_words), re.compile(TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found, weights, keys = [], [], []
                for low in part.column(1).to_pylist():
                    counts = Counter(token.findall(low or ""))
                    for word in left_out:
                        counts.pop(word, None)
                    for old in renamed.keys() & counts.keys():
                        counts[renamed[old]] += counts.pop(old)
                    if low and any(word in low for word in boosts):
                        counts[BOOST_TOKEN] += BOOST_COUNT
                    c = np.fromiter(map(codes.__getitem__, counts), np.int64, len(counts))
                    n = np.fromiter(counts.values(), np.int64, len(counts))
                    order = np.argsort(c)
                    c, w = c[order], n[order] / np.sqrt(float((n * n).sum() or 1))
                    found.append(c)
                    weights.append(w)
                    keys.append(hashlib.sha256(c.tobytes() + w.tobytes()).hexdigest() if len(c) else None)
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (found, weights)]
                vec = pa.StructArray.from_arrays(lists, names=["codes", "weights"])
                yield pa.RecordBatch.from_arrays([part.column(0), vec, pa.array(keys, pa.string())], names=["hash", "vec", "key"])

    rows = texts.select("hash", F.lower("text").alias("low"))
    return rows.mapInArrow(run, "hash string, vec struct<codes:array<bigint>,weights:array<double>>, key string")


def _packed_nodes(vectors: DataFrame, themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`vector_nodes` of packed vectors: nodes are told apart by their keys, and no vector is grouped."""
    stored = materialize(vectors, "vectors", "zstd")
    keyed = themes.select("hash", "theme").join(stored.select("hash", "key"), "hash", "left")
    copies = materialize(keyed.select("hash", "theme", F.sha2(F.concat_ws("|", "theme", F.coalesce("key", "hash")), 256).alias("node")), "copies", "zstd")
    ends = materialize(copies.groupBy("node", "theme").agg(F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash")), "ends", "zstd")
    vec = stored.select(F.col("hash").alias("first_hash"), "vec")
    none = F.lit(None).cast(stored.schema["vec"].dataType).alias("vec")
    names = ["node", "theme", "first_hash", "last_hash", "vec"]
    unknown = ends.join(vec, "first_hash", "left_anti").select(*names[:-1], none)
    return vec.join(ends, "first_hash").select(*names).unionByName(unknown), copies


def vector_nodes(vectors: DataFrame, themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, copies): one node per distinct vector and theme, ordered by its lowest text hash.

    `copies` maps every text hash to its node. A text without any token forms its own node per theme.
    Vectors come as rows of their tokens or packed, a row per text.
    """
    if "vec" in vectors.columns:
        return _packed_nodes(vectors, themes)
    entry = F.struct("token", "weight")
    packed = vectors.groupBy("hash").agg(F.array_sort(F.collect_list(entry)).alias("vec"))
    empty = F.array().cast("array<struct<token:string,weight:double>>")
    joined = themes.select("hash", "theme").join(packed, "hash", "left").withColumn("vec", F.coalesce("vec", empty))
    # A text without tokens is similar to nothing, not even to another such text.
    unique = F.when(F.size("vec") == 0, F.col("hash")).otherwise(F.to_json("vec"))
    keyed = joined.withColumn("node", F.sha2(F.concat_ws("|", "theme", unique), 256))
    nodes = keyed.groupBy("node", "theme").agg(
        F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash"), F.min_by("vec", "hash").alias("vec")
    )
    return nodes, keyed.select("hash", "theme", "node")


def prefix_postings(nodes: DataFrame, threshold: float) -> DataFrame:
    """(theme, token, node, first_hash, last_hash, weight, dropped) for the rare-token prefix of every node.

    Tokens are put in ascending document frequency; a token is dropped only when it and all more
    frequent ones together have a norm below the threshold (`dropped` is that norm). Two vectors that
    share no kept token therefore have a cosine below the threshold.
    """
    entries = nodes.select("node", "theme", "first_hash", "last_hash", F.explode("vec").alias("e")).select(
        "node", "theme", "first_hash", "last_hash", "e.token", "e.weight"
    )
    frequency = entries.groupBy("token").agg(F.count("*").alias("_df"))
    order = Window.partitionBy("node").orderBy(F.col("_df").desc(), F.col("token").desc())
    rest = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    measured = entries.join(frequency, "token").withColumn("_norm", F.sqrt(rest))
    low = F.when(F.col("_norm") < threshold - SLACK, F.col("_norm"))
    measured = measured.withColumn("dropped", F.coalesce(F.max(low).over(Window.partitionBy("node")), F.lit(0.0)))
    return measured.filter(F.col("_norm") >= threshold - SLACK).select(
        "theme", "token", "node", "first_hash", "last_hash", "weight", "dropped"
    )


@F.pandas_udf(DoubleType())
def dots(left: pd.Series, left_weights: pd.Series, right: pd.Series, right_weights: pd.Series) -> pd.Series:
    """Dot products of pairs of sparse vectors, each as sorted numbers of tokens and their weights."""
    return pd.Series(_dots(left, left_weights, right, right_weights))


def _dots(left, left_weights, right, right_weights) -> np.ndarray:
    out = np.zeros(len(left))
    for k, (a, x, b, y) in enumerate(zip(left, left_weights, right, right_weights)):
        if len(a):
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            same = a[at] == b
            out[k] = x[at[same]] @ y[same]
    return out


def _coded(nodes: DataFrame) -> DataFrame:
    """Nodes with their vector as two arrays; tokens are 64-bit hashes, told apart within a pair only."""
    rest = [c for c in nodes.columns if c != "vec"]
    entries = F.col("vec")
    if nodes.schema["vec"].dataType.simpleString().startswith("array"):
        hashed = F.array_sort(F.transform("vec", lambda e: F.struct(F.xxhash64(e["token"]).alias("codes"), e["weight"].alias("weights"))))
        nodes, entries = compute_once(nodes, {"_e": hashed}), F.col("_e")
    return nodes.select(*rest, entries["codes"].alias("codes"), entries["weights"].alias("weights"))


def _sparse(nodes: DataFrame, side: str) -> DataFrame:
    """`<side>_node` with its vector as two arrays."""
    return _coded(nodes.select(F.col("node").alias(f"{side}_node"), "vec")).withColumnsRenamed({"codes": f"_{side}_codes", "weights": f"_{side}_weights"})


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, numbers) of a column of lists; row k has the numbers from ends[k] to ends[k + 1]."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _near_sparse(table: pa.Table, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, ...]:
    """(i, j, similarity) of rows of the table with a cosine at the threshold, i of `left` and j of `right`.

    Without `right`, j comes before i in `left`. Common tokens are multiplied as a matrix; of the others each entry
    of a left row walks through the right rows of its token.
    """
    (ends, codes), (_, weights) = _flat(table.column("codes")), _flat(table.column("weights"))
    owner = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(ends))

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.full(table.num_rows, -1, np.int32)
        place[rows] = np.arange(len(rows))
        own = place[owner]
        at = np.flatnonzero(own >= 0)
        at = at[np.argsort(own[at], kind="stable")]
        return own[at], codes[at], weights[at]

    row, code, weight = part(left)
    other, code_y, weight_y = (row, code, weight) if right is None else part(right)
    height, width = len(left), len(left if right is None else right)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(code) or not len(code_y):
        return none
    known, token_y = np.unique(code_y, return_inverse=True)
    token_y = token_y.astype(np.int32)
    spread = np.bincount(token_y, minlength=len(known))
    common = np.argsort(-spread, kind="stable")[:MOST_COMMON]
    common = common[spread[common] > max(8, COMMON * width)]
    slot = np.full(len(known), -1)
    slot[common] = np.arange(len(common))

    def plain(rows, tokens, values, n):
        out, at = np.zeros((n, len(common))), slot[tokens] >= 0
        out[rows[at], slot[tokens[at]]] = values[at]
        return out, ~at

    matrix_y, rare = plain(other, token_y, weight_y, width)
    listed = np.flatnonzero(rare)
    listed = listed[np.argsort(token_y[listed], kind="stable")]  # rows ascend within a token
    count = np.bincount(token_y[listed], minlength=len(known))
    start = np.cumsum(count) - count
    list_row, list_weight = other[listed], weight_y[listed]
    if right is None:
        token, matrix, keep = token_y, matrix_y, rare
        length = np.zeros(len(token), np.int64)
        length[listed] = np.arange(len(listed)) - start[token_y[listed]]  # entries before its own
    else:
        token = np.minimum(np.searchsorted(known, code), len(known) - 1).astype(np.int32)
        met = known[token] == code
        row, token, weight = row[met], token[met], weight[met]
        matrix, keep = plain(row, token, weight, height)
        length = count[token]
    row, token, weight, length = row[keep], token[keep], weight[keep], length[keep]
    work = np.concatenate([[0], np.cumsum(np.bincount(row, weights=length, minlength=height))])
    edge = np.searchsorted(row, np.arange(height + 1))
    out, first = [], 0
    while first < height:
        last = min(max(first + 1, int(np.searchsorted(work, work[first] + AT_ONCE, side="right")) - 1), first + max(1, AT_ONCE // width), height)
        wide = last if right is None else width
        e = slice(edge[first], edge[last])
        n = length[e]
        at = np.repeat(start[token[e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat((row[e] - first).astype(np.int64) * wide, n) + list_row[at]
        products = np.bincount(cell, weights=np.repeat(weight[e], n) * list_weight[at], minlength=(last - first) * wide).reshape(last - first, wide)
        products = products + matrix[first:last] @ matrix_y[:wide].T
        i, j = np.nonzero(products >= threshold - SLACK)
        similarity = products[i, j]
        i = i + first
        if right is None:
            before = j < i
            i, j, similarity = i[before], j[before], similarity[before]
        out.append((left[i], (left if right is None else right)[j], similarity))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out))


def _near_dense(table: pa.Table, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, ...]:
    """As `_near_sparse`, of plain vectors of one length."""
    ends, numbers = _flat(table.column("vec"))
    vectors = numbers.reshape(table.num_rows, -1)
    x = vectors[left]
    y = x if right is None else vectors[right]
    out, step = [], max(1, AT_ONCE // max(1, len(y)))
    for first in range(0, len(x), step):
        products = x[first : first + step] @ y[: first + step if right is None else len(y)].T
        i, j = np.nonzero(products >= threshold - SLACK)
        similarity = products[i, j]
        i = i + first
        if right is None:
            before = j < i
            i, j, similarity = i[before], j[before], similarity[before]
        out.append((left[i], (left if right is None else right)[j], similarity))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _multiplied(left: DataFrame, right: DataFrame, threshold: float, near: Callable, values: Sequence[str], block: int = BLOCK_NODES, counted: bool = False) -> DataFrame:
    """(left_node, right_node, precedes, similarity) of all pairs of a theme with a product at the threshold.

    `counted` gives, of one set, (node, n) instead: pairs are counted on both sides within each task.

    Nodes are (node, theme, first_hash, last_hash, *values), the hashes being numbers. A theme is dealt to blocks of
    at most `block` nodes, about; each pair of blocks is a task's, and a node is sent once for each block it meets.
    The right node starts before the last copy of the left one, so that some copy may join it; `precedes` tells
    whether it starts before the first copy too.
    """
    alone = left is right
    names = ["node", "first_hash", "last_hash", *values]
    cut = lambda side: side.filter(F.col("theme").isNotNull()).select("theme", *names)
    room = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("_numbers") / F.lit(BLOCK_NUMBERS)), F.lit(1)).cast("int")

    def size(side: DataFrame, name: str) -> DataFrame:
        numbers = F.size(values[0]).alias("_numbers")
        return side.filter(F.col("theme").isNotNull()).select("theme", numbers).groupBy("theme").agg(room.alias(name))

    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if alone:
        blocks = materialize(size(left, "_n"), "blocks")
        dealt = cut(left).join(F.broadcast(blocks), "theme").select("theme", *names, own("_n").alias("_own"), every("_n").alias("_other"))
        dealt = dealt.select("theme", *names, F.greatest("_own", "_other").alias("_row"), F.least("_own", "_other").alias("_column"), "_own")
        cells = F.sum(F.expr("_n * (_n + 1) / 2"))
    else:
        blocks = materialize(size(left, "_rows").join(size(right, "_columns"), "theme"), "blocks")
        known = F.broadcast(blocks)
        a = cut(left).join(known, "theme").select("theme", *names, own("_rows").alias("_row"), every("_columns").alias("_column"), F.lit(0).alias("_own"))
        b = cut(right).join(known, "theme").select("theme", *names, every("_rows").alias("_row"), own("_columns").alias("_column"), F.lit(1).alias("_own"))
        dealt = a.unionByName(b)
        cells = F.sum(F.expr("_rows * _columns"))
    kind = left.schema["node"].dataType.simpleString()

    def multiply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, at = table.column("_own").to_numpy(), np.arange(table.num_rows)
        if alone:
            rows, columns = (at, None) if key[1].as_py() == key[2].as_py() else (at[part == key[1].as_py()], at[part == key[2].as_py()])
        else:
            rows, columns = at[part == 0], at[part == 1]
        i, j, similarity = near(table, rows, columns, threshold)
        if counted:
            n = np.bincount(np.concatenate([i, j]), minlength=table.num_rows)
            return pa.table([table.column("node"), pa.array(n.astype(np.int64))], names=["node", "n"])
        if alone:  # either may be the later one
            i, j, similarity = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(similarity, 2)
        first, last = (table.column(c).to_numpy() for c in ("first_hash", "last_hash"))
        node = table.column("node").combine_chunks()
        a, b = node.take(pa.array(i)), node.take(pa.array(j))
        kept = (first[j] < last[i]) & (i != j)
        if not alone:
            kept &= np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
        found = pa.table([a, b, pa.array(first[j] < first[i]), pa.array(similarity)], names=["left_node", "right_node", "precedes", "similarity"])
        return found.filter(pa.array(kept))

    n = blocks.agg(cells.cast("long")).first()[0] or 1
    keys = ["theme", "_row", "_column"]
    # a number of partitions of our own: small as they are, pairs of blocks are worth a task each
    schema = f"node {kind}, n long" if counted else f"left_node {kind}, right_node {kind}, precedes boolean, similarity double"
    return dealt.repartition(int(min(4 * n, 4000)), *keys).groupBy(*keys).applyInArrow(multiply, schema)


def _in_grid(left: DataFrame, right: DataFrame, on: Sequence[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_row` and `_column`: a bucket beyond `block` rows a side is dealt to a grid of tasks.

    A left row has its own row of the grid and is copied to all columns, a right row the other way
    round, so each pair still meets once. Only buckets that need a grid are counted on.
    """
    size = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name)).filter(F.col(name) > 1)
    large = size(left, "_rows").join(size(right, "_columns"), list(on), "full_outer").fillna(1, ["_rows", "_columns"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.coalesce(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = left.join(large, list(on), "left").select(*left.columns, own("_rows").alias("_row"), every("_columns").alias("_column"))
    b = right.join(large, list(on), "left").select(*right.columns, own("_columns").alias("_column"), every("_rows").alias("_row"))
    return a, b


def _shared(left: DataFrame, right: DataFrame, on: Sequence[str], block: int = POSTING_BLOCK) -> DataFrame:
    """(left_node, right_node, precedes) per shared bucket, crowded buckets dealt in a grid.

    The right node starts before the last copy of the left one, so that some copy may join it;
    `precedes` tells whether it starts before the first copy too.
    """
    extra = [c for c in ("weight", "dropped") if c in left.columns]
    left, right = _in_grid(left, right, on, block)
    on = [*on, "_row", "_column"]
    a = left.select(*on, F.col("node").alias("left_node"), F.col("first_hash").alias("_f"), F.col("last_hash").alias("_l"), *[F.col(c).alias(f"left_{c}") for c in extra])
    b = right.select(*on, F.col("node").alias("right_node"), F.col("first_hash").alias("_r"), *[F.col(c).alias(f"right_{c}") for c in extra])
    before = (F.col("_r") < F.col("_l")) & (F.col("left_node") != F.col("right_node"))
    return a.join(b, on).filter(before).withColumn("precedes", F.col("_r") < F.col("_f")).drop("_f", "_l", "_r", *on)


def similar_pairs(
    left: DataFrame, right: DataFrame, left_postings: DataFrame, right_postings: DataFrame, threshold: float
) -> DataFrame:
    """(left_node, right_node, precedes, similarity) with a cosine >= threshold.

    All common tokens outside the shared prefixes lie in the dropped part of one of the two vectors,
    so the cosine is at most the dot product over the prefixes plus the larger dropped norm. Pairs
    that cannot reach the threshold go before any vector is fetched.
    """
    return _scored(_shared(left_postings, right_postings, ["theme", "token"]), left, right, threshold)


def _scored(shared: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Shared prefix tokens of pairs, bounded, then scored on the vectors."""
    pairs = shared.groupBy("left_node", "right_node", "precedes").agg(
        F.sum(F.col("left_weight") * F.col("right_weight")).alias("_dot"),
        F.max(F.greatest("left_dropped", "right_dropped")).alias("_rest"),
    ).filter(F.col("_dot") + F.col("_rest") >= threshold - 2 * SLACK).select("left_node", "right_node", "precedes")
    both = pairs.join(_sparse(left, "left"), "left_node").join(_sparse(right, "right"), "right_node")
    similarity = dots("_left_codes", "_left_weights", "_right_codes", "_right_weights")
    return both.select("left_node", "right_node", "precedes", similarity.alias("similarity")).filter(F.col("similarity") >= threshold - SLACK)


def text_similarity_join(nodes: DataFrame, representatives: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Every node against the representatives of its theme that come earlier: pairs at or above the threshold.

    Postings of both sides are cut with the same token order, taken from all nodes.
    """
    postings = prefix_postings(nodes, threshold)
    chosen = postings.join(representatives.select("node"), "node", "left_semi")
    return similar_pairs(nodes, representatives, postings, chosen, threshold).filter("precedes").drop("precedes")


def _placed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, places): nodes with tokens under their place in the order of first hashes; `places` tells it (node, place)."""
    packed = nodes.schema["vec"].dataType.simpleString().startswith("struct")
    filled = nodes.filter(F.size("vec.codes" if packed else "vec") > 0)
    names = filled.select("node", "first_hash").orderBy("first_hash")
    places = materialize(names.withColumn("place", F.monotonically_increasing_id()).drop("first_hash"), "places", "zstd")
    ends = [F.col("place").alias(c) for c in ("node", "first_hash", "last_hash")]
    return _coded(filled.select("node", "theme", "vec")).join(places, "node").select("theme", *ends, "codes", "weights"), places


def similarity_links(nodes: DataFrame, threshold: float = DEFAULT_THRESHOLD, block: int = BLOCK_NODES) -> DataFrame:
    """(left_node, right_node, similarity): all pairs of nodes of a theme with a cosine >= threshold.

    The right node is the one that starts earlier. A theme of more than `block` nodes is dealt to blocks, and
    each pair of blocks is multiplied in one task.
    """
    # pairs carry places and are named again at the end
    placed, places = _placed(nodes)
    found = _multiplied(placed, placed, threshold, _near_sparse, ["codes", "weights"], block)
    name = lambda side: places.select(F.col("place").alias(f"{side}_node"), F.col("node").alias(f"_{side}"))
    named = found.join(name("left"), "left_node").join(name("right"), "right_node")
    return named.select(F.col("_left").alias("left_node"), F.col("_right").alias("right_node"), "similarity")


def similarity_classes(nodes: DataFrame, copies: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(hash, theme, class_hash, n_links) of every text: the first text with its vector, and how many other classes are similar.

    This is the similarity join of all texts of a theme without its pairs: copies count once, and
    links are counted on both sides in the task that finds them.
    """
    placed, places = _placed(nodes)
    counts = _multiplied(placed, placed, threshold, _near_sparse, ["codes", "weights"], counted=True)
    links = materialize(counts.groupBy("node").agg(F.sum("n").alias("n_links")), "links", "zstd")
    named = links.withColumnRenamed("node", "place").join(places, "place").select("node", "n_links")
    classes = nodes.select("node", "first_hash").join(named, "node", "left")
    return copies.join(classes, "node").select(
        "hash", "theme", F.col("first_hash").alias("class_hash"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def _first_leaders(block: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders of a block: the greedy choice in hash order, found in rounds.

    `edges` are (left_node later, right_node earlier), one table for all rounds. A round covers the
    undecided nodes with an earlier leader and makes leaders of those whose earlier neighbours are all
    covered; only the state of the nodes is written again.
    """
    state = cut_lineage(block.select("node", F.lit(None).cast("boolean").alias("leads")))
    edges = cut_lineage(edges.select("left_node", "right_node").distinct())
    of = lambda side: state.withColumnsRenamed({"node": f"{side}_node", "leads": f"_{side}"})
    while not state.filter(F.col("leads").isNull()).isEmpty():
        # what earlier neighbours of undecided nodes are by now; the edges themselves are written once
        seen = edges.join(of("left").filter(F.col("_left").isNull()), "left_node").join(of("right"), "right_node").groupBy("left_node").agg(
            F.coalesce(F.bool_or("_right"), F.lit(False)).alias("_covered"), F.bool_or(F.col("_right").isNull()).alias("_waits")
        )
        known = state.join(seen, F.col("node") == F.col("left_node"), "left")
        fresh = F.when(F.coalesce("_covered", F.lit(False)), F.lit(False)).when(~F.coalesce("_waits", F.lit(False)), F.lit(True))
        state = cut_lineage(known.select("node", F.coalesce("leads", fresh).alias("leads")))
    return state.filter("leads").select("node")


def _boundaries(n: int, first_block: int) -> list[str | None]:
    """Upper hash bounds of blocks that hold about first_block, 2*first_block, … nodes; None is the end."""
    bounds: list[str | None] = []
    share = first_block / max(n, 1)
    while share < 1:
        bounds.append(format(int(share * 16**12), "012x"))
        share *= 2
    return [*bounds, None]


def leader_pairs(nodes: DataFrame, pairs_of, first_block: int) -> tuple[DataFrame, DataFrame]:
    """(leaders, pairs): run the blocks. `pairs_of(left, right)` gives similar pairs as `similar_pairs` does."""
    n = nodes.count()
    undecided = nodes
    leaders = all_pairs = None
    low = ""
    for high in _boundaries(n, first_block):
        later = nodes.filter(F.col("last_hash") >= low)
        block = undecided if high is None else undecided.filter(F.col("first_hash") < high)
        block = cut_lineage(block)
        if not block.isEmpty():
            inside = cut_lineage(pairs_of(block, block))
            chosen = _first_leaders(block, inside.filter("precedes"))
            fresh = cut_lineage(block.join(chosen, "node", "left_semi"))
            kept = inside.join(fresh.select(F.col("node").alias("right_node")), "right_node", "left_semi")
            beyond = later.join(block.select("node"), "node", "left_anti")
            pairs = cut_lineage(kept.unionByName(pairs_of(beyond, fresh)).drop("precedes"))
            leaders = fresh if leaders is None else leaders.unionByName(fresh)
            all_pairs = pairs if all_pairs is None else all_pairs.unionByName(pairs)
            if high is not None:
                covered = pairs.select(F.col("left_node").alias("node")).distinct()
                undecided = cut_lineage(
                    undecided.filter(F.col("first_hash") >= high).join(covered, "node", "left_anti")
                )
        if high is not None:
            low = high
    return leaders, all_pairs


def _assign(copies: DataFrame, leaders: DataFrame, pairs: DataFrame, group_id: Column, method: str) -> DataFrame:
    """Each text joins its most similar earlier leader, ties to the lowest group id; leaders lead themselves."""
    ids = leaders.select(F.col("node").alias("right_node"), F.col("first_hash").alias("_leader"), group_id.alias("group_id"))
    # A later text with exactly the leader's vector is a member with similarity 1.
    own = ids.select(F.col("right_node").alias("left_node"), "right_node", F.lit(1.0).alias("similarity"))
    options = pairs.unionByName(own).join(ids, "right_node").withColumnRenamed("left_node", "node")
    joined = copies.join(options.drop("right_node"), "node").filter(F.col("_leader") <= F.col("hash"))
    choice = F.struct(-F.col("similarity"), F.col("group_id"))
    best = joined.groupBy("hash", "theme").agg(F.min_by(F.struct("group_id", "similarity", "_leader"), choice).alias("_b"))
    return best.select(
        "hash", "theme", "_b.group_id", F.least(F.lit(1.0), F.col("_b.similarity")).alias("similarity"),
        (F.col("_b._leader") == F.col("hash")).alias("is_leader"), F.lit(method).alias("method"),
    )


def _numbered(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, digests): nodes under a number instead of their digest, `first` and `last` being the places of
    their hashes in the order of all; `digests` tells the numbers (node, number).

    Postings, buckets and pairs are many more than nodes, so they carry numbers: a node's three digests have 192 letters.
    """
    known = materialize(nodes.drop("vec").withColumn("number", F.monotonically_increasing_id()), "names", "zstd")
    ends = known.select(F.explode(F.array("first_hash", "last_hash")).alias("hash")).distinct().orderBy("hash")
    places = materialize(ends.withColumn("place", F.monotonically_increasing_id()), "places", "zstd")
    of = lambda end: places.select(F.col("hash").alias(f"{end}_hash"), F.col("place").alias(end))
    placed = materialize(known.join(of("first"), "first_hash", "left").join(of("last"), "last_hash", "left"), "placed", "zstd")
    numbered = nodes.select("node", "vec").join(placed, "node").drop("node").withColumnRenamed("number", "node")
    return materialize(numbered, "nodes", "zstd"), known.select("node", "number")


def _ends(nodes: DataFrame) -> DataFrame:
    """Numbered nodes with the places of their hashes for the hashes."""
    return nodes.drop("first_hash", "last_hash").withColumnsRenamed({"first": "first_hash", "last": "last_hash"})


def _renamed(copies: DataFrame, digests: DataFrame) -> DataFrame:
    """Copies with the number of their node."""
    return copies.join(digests, "node").drop("node").withColumnRenamed("number", "node")


def group_texts(
    vectors: DataFrame, themes: DataFrame, threshold: float = DEFAULT_THRESHOLD, first_block: int = 4096,
    model: str = "local-lexical", version: str = "3",
) -> DataFrame:
    """Assign every text to a group: (hash, theme, group_id, similarity, is_leader, method)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    nodes, copies = vector_nodes(vectors, themes)
    nodes, digests = _numbered(nodes)
    vectors = _coded(nodes.select("node", "vec"))

    def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
        a = _ends(left).join(vectors, "node")
        b = a if left is right else _ends(right).join(vectors, "node")
        return _multiplied(a, b, threshold, _near_sparse, ["codes", "weights"])

    # the vectors stay in one table; what the blocks write again and again is narrow
    leaders, pairs = leader_pairs(nodes.drop("vec"), pairs_of, first_block)
    label = F.concat_ws("|", F.lit(model), F.lit(version), F.lit(str(threshold)), F.col("theme"), F.col("first_hash"))
    group_id = F.concat(F.lit("GRP-"), F.substring(F.sha2(label, 256), 1, 20))
    return _assign(_renamed(copies, digests), leaders, pairs, group_id, METHOD)


def hyperplanes(dimensions: int, tables: int = LSH_TABLES, bits: int = LSH_BITS, seed: int = LSH_SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, bits, dimensions))


def _flips(bits: int) -> np.ndarray:
    """All choices of at most two bits, as rows of booleans; the first chooses none."""
    one = np.eye(bits, dtype=bool)
    return np.concatenate([np.zeros((1, bits), bool), one, *[one[i] | one[i + 1 :] for i in range(bits - 1)]])


def hit_rate(threshold: float, bits: int = LSH_BITS, probes: int = LSH_PROBES, pairs: int = 20_000, seed: int = LSH_SEED) -> float:
    """How often the probes of one table reach a vector whose cosine is the threshold, from simulated projections."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(pairs, bits))
    y = threshold * x + np.sqrt(1 - threshold * threshold) * rng.normal(size=(pairs, bits))
    differ, flips = (x >= 0) != (y >= 0), _flips(bits)
    costs = np.partition((x * x) @ flips.T, min(probes, len(flips)) - 1, axis=1)[:, min(probes, len(flips)) - 1]
    return float(((differ.sum(axis=1) <= 2) & ((x * x * differ).sum(axis=1) <= costs + 1e-12)).mean())


def tables_for(threshold: float, recall: float, bits: int = LSH_BITS, probes: int = LSH_PROBES) -> int:
    """Tables that find a pair at the threshold with the wanted probability; pairs above it are found more often."""
    if not 0 < recall < 1:
        raise ValueError("recall must lie in (0, 1)")
    missed = 1 - hit_rate(threshold, bits, probes)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(missed)))) if missed > 0 else 1


def _hashed(df: DataFrame, dimensions: int, key: str, vector: str, tables: int, bits: int, seed: int, probes: int) -> DataFrame:
    """(key, table, signature): the bucket of a vector in each table, first, and its nearest others, `probes` in all.

    One matrix product per Arrow batch; the planes follow from the seed and are never shipped as data.
    The buckets probed are those whose change of sides costs least: the sum of the squared distances to
    the planes that are crossed, two at most.
    """
    powers, flips = 1 << np.arange(bits), _flips(bits)
    changes = flips @ powers

    @F.pandas_udf("array<long>")
    def signs(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        planes = hyperplanes(dimensions, tables, bits, seed).reshape(tables * bits, dimensions)
        matrix = np.stack(batch.to_numpy()).astype(float)
        away = (matrix @ planes.T).reshape(len(batch) * tables, bits)
        own = ((away >= 0) * powers).sum(axis=1)[:, None]
        if probes > 1:
            near = np.argpartition((away * away) @ flips.T, min(probes, len(flips)) - 1, axis=1)[:, :probes]
            own = own ^ changes[near]
        return pd.Series(list(own.reshape(len(batch), -1)))

    rows = df.select(key, F.posexplode(signs(vector)).alias("table", "signature"))
    return rows.withColumn("table", F.floor(F.col("table") / min(probes, len(flips))).cast("int"))


def lsh_signatures(
    df: DataFrame, dimensions: int, key: str = "vec_id", vector: str = "embedding", tables: int = LSH_TABLES,
    bits: int = LSH_BITS, seed: int = LSH_SEED,
) -> DataFrame:
    """(key, table, signature): which side of each random hyperplane a vector lies on, as bits."""
    return _hashed(df, dimensions, key, vector, tables, bits, seed, 1)


def probe_signatures(signatures: DataFrame, bits: int = LSH_BITS) -> DataFrame:
    """Each signature and its neighbours at one flipped bit, for signatures without their vectors."""
    flips = F.array(F.col("signature"), *[F.col("signature").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    return signatures.withColumn("signature", F.explode(flips))


def lsh_probes(
    df: DataFrame, dimensions: int, key: str = "vec_id", vector: str = "embedding", tables: int = LSH_TABLES,
    bits: int = LSH_BITS, seed: int = LSH_SEED, probes: int = LSH_PROBES,
) -> DataFrame:
    """(key, table, signature): the buckets in which to look for a vector's neighbours, nearest ones first to be kept."""
    return _hashed(df, dimensions, key, vector, tables, bits, seed, probes)


def unit_vector(vector: str = "embedding") -> Column:
    """The vector at length one; a zero vector stays as it is and is similar to none."""
    x = F.transform(vector, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(length, F.size(vector)).alias("n")), lambda e: F.when(e["n"] > 0, e["v"] / e["n"]).otherwise(e["v"]))


def dense_pairs(nodes: DataFrame, dimensions: int, threshold: float, recall: float = LSH_RECALL, bits: int = LSH_BITS, probes: int = LSH_PROBES):
    """A function of two sets of nodes that gives their pairs with a cosine at or above the threshold.

    Nodes are (node, theme, first_hash, last_hash, vec), the sets parts of them with these columns. Where the tables
    that the recall asks for would meet a good part of all pairs, all are multiplied block by block and none is lost.
    Else buckets, the own one of each node and the probed ones that others are looked for in, follow from the vector and
    are neither stored nor looked up. A pair at the threshold is found with the wanted recall.
    """
    tables = tables_for(threshold, recall, bits, probes)
    numbered = "first" in nodes.columns
    if tables * probes * BUCKET_COST >= 1 << bits:  # buckets would meet too many pairs to be worth their rows
        if not numbered:
            hashes = nodes.select(F.explode(F.array("first_hash", "last_hash")).alias("hash")).distinct().orderBy("hash")
            places = materialize(hashes.withColumn("place", F.monotonically_increasing_id()), "places", "zstd")

        def placed(side: DataFrame) -> DataFrame:
            if numbered:
                return _ends(side)
            of = lambda end: places.select(F.col("hash").alias(f"{end}_hash"), F.col("place").alias(f"_{end}"))
            ends = side.join(of("first"), "first_hash").join(of("last"), "last_hash").drop("first_hash", "last_hash")
            return ends.withColumnsRenamed({"_first": "first_hash", "_last": "last_hash"})

        def products(left: DataFrame, right: DataFrame) -> DataFrame:
            a = placed(left)
            return _multiplied(a, a if left is right else placed(right), threshold, _near_dense, ["vec"])

        return products

    def buckets(side: DataFrame, count: int) -> DataFrame:
        known = (_ends(side) if numbered else side).select(F.struct("node", "theme", "first_hash", "last_hash").alias("_n"), "vec")
        return _hashed(known, dimensions, "_n", "vec", tables, bits, LSH_SEED, count).select("_n.*", "table", "signature")

    def pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
        met = _shared(buckets(left, probes), buckets(right, 1), ["theme", "table", "signature"])
        vec = lambda d, s: d.select(F.col("node").alias(f"{s}_node"), F.col("vec").alias(f"_{s}"))
        both = met.distinct().join(vec(left, "left"), "left_node").join(vec(right, "right"), "right_node")
        dot = F.aggregate(F.zip_with("_left", "_right", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        return both.select("left_node", "right_node", "precedes", dot.alias("similarity")).filter(F.col("similarity") >= threshold - SLACK)

    return pairs_of


def group_dense(
    df: DataFrame, dimensions: int, threshold: float = DEFAULT_THRESHOLD, first_block: int = 4096,
    model: str = "dense", version: str = "3", recall: float = LSH_RECALL,
) -> DataFrame:
    """Leader grouping of dense vectors (hash, theme, embedding), candidates by hyperplane hashing.

    Each pair at the threshold is found with probability `recall`, pairs above it more often: the number
    of tables follows from both.
    """
    scaled = df.select("hash", "theme", unit_vector().alias("vec"))
    keyed = scaled.withColumn("node", F.sha2(F.concat_ws("|", "theme", F.to_json("vec")), 256))
    nodes, digests = _numbered(keyed.groupBy("node", "theme").agg(
        F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash"), F.min_by("vec", "hash").alias("vec")
    ))
    pairs_of = dense_pairs(nodes, dimensions, threshold, recall)
    leaders, pairs = leader_pairs(nodes, pairs_of, first_block)
    label = F.concat_ws("|", F.lit(model), F.lit(version), F.lit(str(threshold)), F.col("theme"), F.col("first_hash"))
    group_id = F.concat(F.lit("GRP-"), F.substring(F.sha2(label, 256), 1, 20))
    return _assign(_renamed(keyed.select("hash", "theme", "node"), digests), leaders, pairs, group_id, "hyperplane_cosine")
