"""Chunking, vector, keyword and full-text retrieval, fusion and index upkeep, all in batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrain.functions.expressions import compute_once, strip
from auditgrain.operators.folds import ordered_fold
from auditgrain.operators.fulltext import Stemmer, fulltext_search
from auditgrain.operators.ranking import top_k
from auditgrain.session import materialize

# --- fixed values -------------------------------------------------------------------------------
KEYWORD_STOP = (
    "what which where when does this that with from have your about explain please give tell more the and for how "
    "are can you why was our model data"
).split()
FUSION_CONSTANT = 60
STRONG_HIT, WEAK_HIT, MISS = "STRONG_HIT", "WEAK_HIT", "MISS"
QUERY_BYTES, CHUNK_BYTES, LEAST_CHUNK_BLOCKS = 8 << 20, 64 << 20, 16
SCORES_AT_ONCE = 1 << 22
FIRST_POSTINGS = 1_000
MOST_RESULTS = 100
MAX_CHUNKS = 25_000
# --- end of fixed values ------------------------------------------------------------------------


def chunk_documents(
    docs: DataFrame, size: int = 220, overlap: int = 30, max_chars: int = 200_000, doc_id: str = "doc_id", version: str = "1"
) -> tuple[DataFrame, DataFrame]:
    """(chunks, oversize): overlapping windows of tokens inside blank-line paragraphs.

    The text between tokens stays as it was; the index runs on across paragraphs. Every document is
    chunked; the second frame reports those longer than `max_chars`.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    clean = compute_once(docs, {"_t": strip(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")))})
    oversize = clean.filter(F.length("_t") > max_chars).drop("_t")
    step = size - overlap

    def windows(tokens: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.size(tokens) - overlap) / F.lit(step)).cast("int"))
        each = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                strip(F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), "")).alias("chunk_text"),
                F.least(F.lit(size), F.size(tokens) - i * step).alias("token_count"),
            ),
        )
        return F.filter(each, lambda w: w["token_count"] > 0)

    # Tokens of every paragraph are found once; the windows then only slice them.
    tokenised = F.transform(
        F.split("_t", r"\n\s*\n"), lambda p: F.regexp_extract_all(p, F.lit(r"(?U)(\S+\s*)"), F.lit(1))
    )
    fitting = compute_once(clean.select(doc_id, "_t"), {"_tokens": tokenised})
    pieces = fitting.select(
        doc_id, F.posexplode(F.flatten(F.transform("_tokens", windows))).alias("chunk_index", "w")
    ).select(doc_id, "chunk_index", "w.chunk_text", "w.token_count")
    identity = F.concat_ws("\0", F.col(doc_id).cast("string"), F.col("chunk_index").cast("string"), "chunk_text", F.lit(version))
    chunk_id = F.concat(F.lit("CHK-"), F.substring(F.sha2(identity, 256), 1, 32))
    return pieces.withColumn("chunk_id", chunk_id), oversize


def metadata_filter(chunks: DataFrame, filters: Mapping[str, str] | None) -> DataFrame:
    """Keep chunks whose metadata map contains every given pair."""
    for key, value in (filters or {}).items():
        chunks = chunks.filter(F.try_element_at("metadata", F.lit(key)) == F.lit(value))
    return chunks


def _unit(table: pa.Table, name: str) -> np.ndarray:
    """Vectors of length one; a zero vector has no direction and becomes NaN."""
    vectors = np.array(table.column(name).to_pylist(), dtype=float).reshape(table.num_rows, -1)
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(norms == 0, np.nan, norms)[:, None]


def blocks_for(df: DataFrame, most: int, least: int, vector: str = "embedding") -> int:
    """Blocks of about `most` bytes of vectors, 8 bytes a component, `least` at least; one row comes to the driver."""
    total = df.agg(F.sum(F.greatest(F.size(vector), F.lit(0)).cast("long") * 8)).first()[0] or 0
    return max(least, -(-total // most))


def vector_search(
    queries: DataFrame, chunks: DataFrame, k: int, filters: Mapping[str, str] | None = None,
    query_blocks: int | None = None, chunk_blocks: int | None = None, rows_at_once: int = 2048,
) -> DataFrame:
    """Exact cosine top-k of every query: (query_id, chunk_id, score, rank), ties by chunk id.

    Queries and chunks are dealt to blocks by hash. A task gets one block of either, scans the
    chunks in slices with one matrix product each and keeps k rows per query, ids compared in their
    own type; the rest is a top-k over those. No row passes through the driver. Unless given, the
    numbers of blocks follow from the bytes of the vectors, so that a block holds about QUERY_BYTES or
    CHUNK_BYTES at any input size; the result does not depend on them.
    """
    chunks = metadata_filter(chunks, filters)
    query_blocks = query_blocks or blocks_for(queries, QUERY_BYTES, 1)
    chunk_blocks = chunk_blocks or blocks_for(chunks, CHUNK_BYTES, LEAST_CHUNK_BLOCKS)
    types = dict(queries.dtypes) | {f"c_{c}": t for c, t in chunks.dtypes}
    schema = f"query_id {types['query_id']}, chunk_id {types['c_chunk_id']}, score double"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select("query_id", "embedding", deal("query_id", query_blocks).alias("q"), every(chunk_blocks).alias("c"))
    held = chunks.select("chunk_id", "embedding", deal("chunk_id", chunk_blocks).alias("c"), every(query_blocks).alias("q"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("chunk_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, right = ids[order], right.take(pa.array(order))  # equal scores then keep the smaller id
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * left.num_rows
        if left.num_rows and right.num_rows:
            matrix = _unit(left, "embedding")
            step = max(1, min(rows_at_once, SCORES_AT_ONCE // left.num_rows))
            for start in range(0, right.num_rows, step):
                scores = matrix @ _unit(right.slice(start, step), "embedding").T
                for n, row in enumerate(scores):
                    usable = np.flatnonzero(~np.isnan(row))
                    if len(usable) > k:
                        usable = usable[row[usable] >= np.partition(row[usable], -k)[-k]]
                    s, at = np.concatenate([out[n][0], row[usable]]), np.concatenate([out[n][1], usable + start])
                    best = np.lexsort((at, -s))[:k]
                    out[n] = s[best], at[best]
        query = np.repeat(np.arange(left.num_rows), [len(s) for s, _ in out])
        found = np.concatenate([at for _, at in out]) if out else np.empty(0, np.int64)
        return pa.table({
            "query_id": left.column("query_id").combine_chunks().take(pa.array(query, pa.int64())),
            "chunk_id": right.column("chunk_id").combine_chunks().take(pa.array(found, pa.int64())),
            "score": pa.array(np.concatenate([s for s, _ in out]) if out else np.empty(0), pa.float64()),
        })

    found = asked.groupBy("q", "c").cogroup(held.groupBy("q", "c")).applyInArrow(nearest, schema)
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def keyword_tokens(c: Column | str, stop: Sequence[str] = KEYWORD_STOP) -> Column:
    """Distinct lower-case words of three or more characters, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*stop)))


def keyword_candidates(queries: DataFrame, docs: DataFrame, k: int, order: str = "chunk_id", first: int = FIRST_POSTINGS) -> DataFrame:
    """(query_id, document, score): shared words of all pairs that may be among the best k of a query.

    Upper bounds keep frequent words from making pairs. A query's rarest words, as long as their
    postings together stay below `first` (the rarest in any case), give candidates and with their whole
    scores a k-th best. A document without any of the n - (k-th best) + 1 rarest words cannot reach that,
    so only words up to there make further candidates; the words beyond only complete scores, on the
    documents' own words. A query with fewer than k candidates so far takes all its words.
    """
    asked = queries.select("query_id", F.explode(keyword_tokens("text")).alias("token"))
    held = materialize(docs.select(order, keyword_tokens("text").alias("_held")), "words")
    postings = held.select(order, F.explode("_held").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    frequency = postings.groupBy("token").agg(F.count("*").alias("_df"))
    rarest = Window.partitionBy("query_id").orderBy("_df", "token")
    ranked = materialize(asked.join(frequency, "token").withColumns({
        "_place": F.row_number().over(rarest), "_n": F.count("*").over(Window.partitionBy("query_id")),
        "_sum": F.sum("_df").over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).withColumn("_early", (F.col("_place") == 1) | (F.col("_sum") <= first)), "ranked")
    words = ranked.groupBy("query_id").agg(F.collect_list("token").alias("_asked"))

    def pairs(tokens: DataFrame) -> DataFrame:
        return postings.join(tokens.select("query_id", "token"), "token").select("query_id", order).distinct()

    def scored(found: DataFrame) -> DataFrame:
        both = found.join(held, order).join(words, "query_id")
        return both.select("query_id", order, F.size(F.array_intersect("_asked", "_held")).cast("long").alias("score"))

    early = materialize(scored(pairs(ranked.filter("_early"))), "early")
    best = top_k(early, ["query_id"], [F.col("score").desc(), F.col(order)], k)
    reached = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("_kth"))
    needed = ranked.filter(~F.col("_early")).join(reached, "query_id").filter((F.col("_kth") == 0) | (F.col("_place") <= F.col("_n") - F.col("_kth") + 1))
    late = pairs(needed).join(early.select("query_id", order), ["query_id", order], "left_anti")
    return early.unionByName(scored(late))


def keyword_search(queries: DataFrame, docs: DataFrame, k: int = 3, order: str = "chunk_id") -> DataFrame:
    """Number of shared words per (query, document), best k; ties by document order; at least one word."""
    return top_k(keyword_candidates(queries, docs, k, order), ["query_id"], [F.col("score").desc(), F.col(order)], k)


def fuse(vector: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists."""
    side = lambda df, name: df.select("query_id", "chunk_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
    both = side(vector, "vector").join(side(keyword, "keyword"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (FUSION_CONSTANT + F.col(c)), F.lit(0.0))
    scored = both.withColumn("final_score", part("vector_rank") + part("keyword_rank"))
    return top_k(scored, ["query_id"], [F.col("final_score").desc(), F.col("chunk_id")], limit)


def check_request(limit: int, filters: Mapping[str, str] | None, allowed: Sequence[str] | None = None, most: int = MOST_RESULTS) -> None:
    """Refuses a limit outside 1 to `most` and filters on keys that are not allowed (any, if None)."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie in 1 to {most}")
    unknown = set(filters or {}) - set(allowed) if allowed is not None else set()
    if unknown:
        raise ValueError(f"unsupported filter: {', '.join(sorted(unknown))}")


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, limit: int, filters: Mapping[str, str] | None = None, allowed: Sequence[str] | None = None,
    stop: Sequence[str] = (), stem: Stemmer | None = None, plain: bool = False, most: int = MOST_RESULTS,
) -> DataFrame:
    """Fusion of vector and full-text candidates, each three times the limit, among chunks that pass the filters.

    A query or chunk may lack its text or its embedding; it then takes part in the other search only.
    """
    check_request(limit, filters, allowed, most)
    chunks = metadata_filter(chunks, filters)
    with_ = lambda df, c: df.filter(F.col(c).isNotNull())
    near = vector_search(with_(queries, "embedding"), with_(chunks, "embedding"), 3 * limit)
    return fuse(near, fulltext_search(with_(queries, "text"), with_(chunks, "text"), 3 * limit, stop, stem, plain), limit)


def hit_status(results: DataFrame, queries: DataFrame, strong: float = 0.65, weak: float = 0.55, mode: str = "vector") -> DataFrame:
    """STRONG, WEAK or MISS per query from its best cosine; in keyword mode any result is WEAK."""
    best = results.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("results"))
    joined = queries.select("query_id").join(best, "query_id", "left")
    if mode == "keyword":
        status = F.when(F.col("results") > 0, WEAK_HIT).otherwise(MISS)
    else:
        top = F.coalesce("best", F.lit(0.0))
        status = F.when(top >= strong, STRONG_HIT).when(top >= weak, WEAK_HIT).otherwise(MISS)
    return joined.select("query_id", status.alias("status"), "best")


def selected_hits(results: DataFrame, weak: float = 0.55, k: int = 5, mode: str = "vector") -> DataFrame:
    """The results that count as evidence: at or above `weak` (any in keyword mode), best k."""
    kept = results if mode == "keyword" else results.filter(F.col("score") >= weak)
    return top_k(kept.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def validate_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: how many vectors are empty, not finite or zero, how many dimensions occur, and the verdict."""
    v = F.transform(vector, lambda x: x.cast("double"))
    empty = F.coalesce(F.size(vector) <= 0, F.lit(True))
    infinite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~empty & F.forall(v, lambda x: x == 0)
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    checked = df.agg(
        F.count("*").alias("vectors"), flag(empty).alias("empty"), flag(infinite).alias("not_finite"), flag(zero).alias("zero"),
        F.min(F.size(vector)).alias("min_dimensions"), F.max(F.size(vector)).alias("max_dimensions"),
    )
    return checked.withColumn(
        "valid",
        (F.col("empty") + F.col("not_finite") + F.col("zero") == 0) & F.coalesce(F.col("min_dimensions") == F.col("max_dimensions"), F.lit(True)),
    )


DOCUMENT_KEY = ["space", "document_id"]


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace all chunks of every incoming document in its space. Incoming metadata gains the document fields."""
    extra = F.create_map(
        F.lit("document_id"), F.col("document_id"), F.lit("domain"), F.col("domain"), F.lit("source_type"), F.col("source_type")
    )
    # The document fields win over caller metadata of the same name.
    names = F.array(F.lit("document_id"), F.lit("domain"), F.lit("source_type"))
    kept = F.map_filter("metadata", lambda k, _: ~F.array_contains(names, k))
    merged = incoming.withColumn("metadata", F.map_concat(kept, extra))
    rest = existing.join(incoming.select(*DOCUMENT_KEY).distinct(), DOCUMENT_KEY, "left_anti")
    return rest.unionByName(merged.select(*existing.columns))


def admit_documents(existing: DataFrame, incoming: DataFrame, max_chunks: int = MAX_CHUNKS, arrival: str = "document_id") -> DataFrame:
    """One row for each incoming document, in order of arrival in its space: its chunks, those it replaces, the space's total then, and the verdict.

    A document is refused when the space, without the chunks it replaces, would hold more than
    `max_chunks`; the next one is judged by what the space holds then. The running total of a space is
    carried over documents, not chunks.
    """
    counted = incoming.groupBy(*DOCUMENT_KEY).agg(F.count("*").alias("chunks"), F.min(arrival).alias("_arrival"))
    held = existing.groupBy(*DOCUMENT_KEY).agg(F.count("*").alias("replaced"))
    total = held.groupBy("space").agg(F.sum("replaced").alias("_total"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    judged = counted.join(held, DOCUMENT_KEY, "left").join(total, "space", "left").withColumns({"replaced": none(F.col("replaced")), "_total": none(F.col("_total"))})

    def admit(now: int | None, chunks: int, replaced: int, start: int) -> tuple[int, tuple[int, str]]:
        now = start if now is None else now
        after = now - replaced + chunks
        return (after, (after, "admitted")) if after <= max_chunks else (now, (now, "refused"))

    out = ordered_fold(judged, ["space"], ["_arrival", "document_id"], ["chunks", "replaced", "_total"], {"total": "long", "verdict": "string"}, admit)
    return out.select(*DOCUMENT_KEY, "chunks", "replaced", "total", "verdict")


def upsert_within_capacity(
    existing: DataFrame, incoming: DataFrame, max_chunks: int = MAX_CHUNKS, arrival: str = "document_id"
) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents): the upsert of the documents that fit, and the verdict on every incoming one."""
    documents = materialize(admit_documents(existing, incoming, max_chunks, arrival), "admitted")
    fitting = documents.filter(F.col("verdict") == "admitted").select(*DOCUMENT_KEY)
    return upsert_chunks(existing, incoming.join(fitting, DOCUMENT_KEY, "left_semi").select(*incoming.columns)), documents


def capacity(chunks: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Chunks per space against the configured capacity."""
    return chunks.groupBy("space").agg(F.count("*").alias("chunks")).withColumn("within_capacity", F.col("chunks") <= max_chunks)
