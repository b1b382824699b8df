"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling in Spark.

Contexts are the hashed last letters of the word before; every context is a restaurant and all share
the parent restaurant of single words, whose base is uniform over the known words and one unknown.
Customers of a context are its training tokens; each of its tables is a customer of the parent.

The corpus is dealt by word, so that all customers of a word, in every context and in the parent, sit
in one task; what tasks need from each other are totals by context. Seatings start with one table
per context and word; a sweep takes all customers of a context and word away and seats them anew, one
after the other, by the Chinese restaurant weights, and then does the same in the parent. Sweeps use
totals as the task estimates them, as in other distributed samplers; predictive probabilities use the
exact totals of each sample, so they sum to one, and are averaged over samples.

Words with at least `HEAVY` of the tokens (so at most 1 / HEAVY of them) would overload a task: their
counts by context are summed before the shuffle, and they are scored where the texts are read, from a
matrix of at most 1 / HEAVY x CONTEXTS probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import WordHashes, column, lower_ascii, pieces, texts_of, words
from auditgrain.session import materialize

CONTEXT_BITS = 10
CONTEXTS = 1 << CONTEXT_BITS
SUFFIX = 3
HEAVY = 2e-4
DISCOUNT, STRENGTH = 0.75, 10.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 10.0
BURN_IN, SAMPLES = 2, 3
#: Customers are drawn one by one up to twice this number, then in stretches of this part of those seated.
STRETCH = 64
#: Light tokens of one bucket, about.
BUCKET_TOKENS = 1_000_000
#: The end of a text, a token that no word equals.
END = "\n"


class _Numbers(WordHashes):
    """Word -> 64 bits that name it: 54 of its hash, then the context that it makes for the next word."""

    def __missing__(self, word: str) -> int:
        raw, end = (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in (word, word[-SUFFIX:]))
        value = raw >> CONTEXT_BITS << CONTEXT_BITS | end >> (64 - CONTEXT_BITS)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


class _Tokens:
    """Word and context numbers of texts; the end token is last, the start of a text a context of its own."""

    def __init__(self):
        self.memory = _Numbers()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.memory.of(["", *words(lower_ascii(text)), END])
        return found[1:], (found[:-1] & np.uint64(CONTEXTS - 1)).astype(np.uint16)


def _counts(docs: DataFrame) -> DataFrame:
    """`kind`, `key`, `n`: training tokens by word (kind 0) and by context (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in pieces(batches, chars=6_000_000):
            found = [tokens.of(x) for x in texts_of(batch)]
            w, n = np.unique(np.concatenate([a for a, _ in found]), return_counts=True)
            c = np.bincount(np.concatenate([b for _, b in found]), minlength=CONTEXTS)
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.zeros(len(w), np.int8), np.ones(len(at), np.int8)]), pa.array(np.r_[w.view(np.int64), at]), pa.array(np.r_[n, c[at]])],
                names=["kind", "key", "n"],
            )

    rows = docs.select("text").mapInArrow(run, "kind byte, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class _Totals:
    tokens: int
    types: int
    contexts: np.ndarray  # training tokens of each context
    heavy: np.ndarray  # sorted hashes
    heavy_counts: np.ndarray

    @property
    def heavy_part(self) -> float:
        """Share of the tokens that are heavy words."""
        return float(self.heavy_counts.sum()) / max(1, self.tokens)


def _totals(counts: DataFrame) -> _Totals:
    sizes = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    contexts = np.zeros(CONTEXTS)
    found = counts.filter("kind = 1").toArrow()  # at most CONTEXTS rows
    contexts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    # at most 1 / HEAVY rows
    heavy = counts.filter((F.col("kind") == 0) & (F.col("n") >= max(1.0, HEAVY * sizes["n"]))).toArrow()
    keys, n = heavy.column("key").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
    order = np.argsort(keys)
    return _Totals(int(sizes["n"]), int(sizes["v"]), contexts, keys[order], n[order])


def seat_anew(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each pair after all its customers left and came back one by one.

    With n customers at t tables the next one opens a table with odds `fresh` to n - discount * t.
    Once n is large the odds hardly change from one customer to the next: those of a stretch of
    n / STRETCH customers are drawn together, at the odds of its middle.
    """
    order = np.argsort(-customers, kind="stable")
    limit, weight = customers[order], fresh[order]
    tables, below = (limit > 0).astype(np.int64), -limit
    n, active = 1, int(np.searchsorted(below, -1))
    while active:
        step = max(1, n // STRETCH)
        left = np.minimum(step, limit[:active] - n)
        f = weight[:active]
        chance = f / (n + (left - 1) / 2 - discount * tables[:active] + f)
        tables[:active] += rng.random(active) < chance if step == 1 else rng.binomial(left, chance)
        n += step
        active = int(np.searchsorted(below[:active], -n))
    out = np.empty_like(tables)
    out[order] = tables
    return out


def seat(
    word: np.ndarray, context: np.ndarray, customers: np.ndarray, totals: _Totals, seed: int,
    part: float = 1.0, others: tuple[np.ndarray, float] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of the seating of all customers of some words: tables by pair, and by word the
    customers and tables in the parent; one row for each sample. `word` numbers the words from 0.

    A sweep seats all customers of every pair anew, then all customers of the parent. Totals of other
    tasks are estimated: these words stand for `part` of all tokens, and `others` are the tables by
    context and in all of the rest, where they are known.
    """
    rng = np.random.default_rng(seed)
    n_words = int(word.max()) + 1 if len(word) else 0
    elsewhere, guests_elsewhere = others if others is not None else (np.zeros(len(totals.contexts)), 0.0)
    base = 1.0 / (totals.types + 1)
    tables = (customers > 0).astype(np.int64)
    guests = np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
    words_here = max(1, int((guests > 0).sum()))
    shared = (guests > 0).astype(np.int64)
    many = np.flatnonzero(customers > 1)  # a single customer has a single table
    many_words, many_contexts, many_customers = word[many], context[many], customers[many]
    out: tuple[list, list, list] = ([], [], [])
    for sweep in range(BURN_IN + SAMPLES):
        share = part * tables.sum() / max(1, customers.sum())
        new_word = (PARENT_STRENGTH + PARENT_DISCOUNT * shared.sum() * totals.types / words_here) * base
        chance = (guests - PARENT_DISCOUNT * shared + new_word) / (PARENT_STRENGTH + max(1.0, guests_elsewhere + share * totals.tokens))
        fresh = (STRENGTH + DISCOUNT * (elsewhere + share * totals.contexts))[many_contexts] * chance[many_words]
        tables = (customers > 0).astype(np.int64)
        tables[many] = seat_anew(many_customers, fresh, DISCOUNT, rng)
        guests = np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
        shared = seat_anew(guests, np.full(n_words, new_word), PARENT_DISCOUNT, rng)
        if sweep >= BURN_IN:
            for known, x in zip(out, (tables, guests, shared)):
                known.append(x)
    return tuple(np.array(x, np.int64).reshape(SAMPLES, -1) for x in out)


@dataclass(frozen=True)
class _Sampled:
    """Exact totals of each sample: tables by context, customers and tables of the parent."""

    tables: np.ndarray  # samples x contexts
    guests: np.ndarray
    shared: np.ndarray


def predictive(customers, tables, guests, shared, context, totals: _Totals, sampled: _Sampled) -> np.ndarray:
    """Average over the samples of the probability of each pair's word in its context."""
    out = np.zeros(len(context))
    for s in range(SAMPLES):
        parent = (guests[s] - PARENT_DISCOUNT * shared[s] + (PARENT_STRENGTH + PARENT_DISCOUNT * sampled.shared[s]) / (totals.types + 1)) / (PARENT_STRENGTH + sampled.guests[s])
        out += (customers - DISCOUNT * tables[s] + (STRENGTH + DISCOUNT * sampled.tables[s][context]) * parent) / (STRENGTH + totals.contexts[context])
    return out / SAMPLES


def _pack(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Light tokens by bucket of words and slice of rows; a row of each slice with its documents; heavy training pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, totals, part, n = _Tokens(), shared.value, TaskContext.get().partitionId(), 0
        for batch in pieces(batches, chars=4_000_000):
            slice_, n = part << 32 | n, n + 1
            found = [tokens.of(x) for x in texts_of(batch)]
            sizes = np.array([len(a) for a, _ in found])
            w, c = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            own = np.repeat(np.arange(len(found)), sizes).astype(np.uint16)
            held = column(batch, "held").to_numpy(zero_copy_only=False).astype(bool)
            at = np.minimum(np.searchsorted(totals.heavy, w), max(0, len(totals.heavy) - 1))
            heavy = totals.heavy[at] == w if len(totals.heavy) else np.zeros(len(w), bool)
            some = np.bincount(own[heavy], minlength=len(found))
            rows = [(
                -1 - int(slice_ % buckets), slice_, column(batch, "doc_id").to_pylist(), held.tobytes(),
                np.concatenate([sizes, some]).astype(np.int64).tobytes(), at[heavy].astype(np.uint16).tobytes(), c[heavy].tobytes(),
            )]
            key, times = np.unique(at[heavy & ~held[own]].astype(np.int64) << CONTEXT_BITS | c[heavy & ~held[own]], return_counts=True)
            rows.append((-1 - int(slice_ % buckets), -1, None, key.tobytes(), times.astype(np.int64).tobytes(), b"", b""))
            light = ~heavy
            w, c, own = w[light], c[light], own[light]
            bucket = ((w >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            w, c, own = w[order], c[order], own[order]
            for b in range(buckets):
                x, y = edges[b], edges[b + 1]
                if y > x:
                    rows.append((b, slice_, None, w[x:y].tobytes(), c[x:y].tobytes(), own[x:y].tobytes(), held[own[x:y]].tobytes()))
            yield _batch(rows, batch.schema.field("doc_id").type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held").mapInArrow(run, f"bucket int, slice long, ids array<{kind}>, a binary, b binary, c binary, d binary")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "slice", "ids", "a", "b", "c", "d"])


def _seat_buckets(packed: DataFrame, shared, kind: str) -> DataFrame:
    """Seats each bucket. Rows of documents and of heavy pairs (negative buckets) pass through."""
    given, kept = ["bucket", "slice", "ids", "a", "b", "c", "d"], ["bucket", "slice", "ids", *"abcdefg", "sums"]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        ids = table.schema.field("ids").type
        if bucket < 0:
            empty = pa.array([None] * table.num_rows, pa.binary())
            return pa.table([*(table.column(n) for n in given), empty, empty, empty, pa.array([None] * table.num_rows, pa.list_(pa.float64()))], names=kept)
        order = pa.array(np.argsort(table.column("slice").to_numpy(), kind="stable"))  # the same rows give the same seating
        table = table.take(order)
        read = lambda n, t: np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()])
        slices, w = table.column("slice").to_numpy(), read("a", np.uint64)
        sizes = np.array([len(x) for x in table.column("d").to_pylist()])
        _, word = np.unique(w, return_inverse=True)
        context, held = read("b", np.uint16), read("d", bool)
        pairs, token = np.unique(word.astype(np.int64) << CONTEXT_BITS | context, return_inverse=True)
        customers = np.bincount(token, weights=~held, minlength=len(pairs)).astype(np.int64)
        ends = np.cumsum(sizes)
        tokens = [np.stack([slices, ends - sizes, ends]).astype(np.int64).tobytes(), token.astype(np.uint32).tobytes(), read("c", np.uint16).tobytes()]
        row = (bucket, -2, None, *_seated(pairs, customers, shared.value, bucket, 1 - shared.value.heavy_part), *tokens)
        return _rows([(*row[:7], *tokens, row[7])], ids, kept)

    return packed.groupBy("bucket").applyInArrow(run, f"bucket int, slice long, ids array<{kind}>, {TABLES}")


TABLES = "a binary, b binary, c binary, d binary, e binary, f binary, g binary, sums array<double>"


def _rows(rows: list[tuple], ids: pa.DataType, names: list[str]) -> pa.Table:
    types = [pa.int32(), pa.int64(), ids, *[pa.binary()] * 7, pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _seated(pairs: np.ndarray, customers: np.ndarray, totals: _Totals, seed: int, part: float, others: tuple[np.ndarray, float] | None = None) -> tuple:
    """Pairs as steps, customers, tables, parents as bytes, and what other tasks need to know in sum."""
    _, word = np.unique(pairs >> CONTEXT_BITS, return_inverse=True)
    context = pairs & (CONTEXTS - 1)
    tables, guests, parents = seat(word, context, customers, totals, seed, part, others)
    sums = np.concatenate([*(np.bincount(context, weights=t, minlength=CONTEXTS) for t in tables), guests.sum(axis=1), parents.sum(axis=1)])
    steps = np.diff(pairs, prepend=0).astype(np.uint32)
    return (steps.tobytes(), customers.astype(np.uint32).tobytes(), tables.astype(np.uint32).tobytes(), np.stack([guests, parents]).astype(np.uint32).tobytes(), sums)


def _read_tables(row: dict) -> tuple[np.ndarray, ...]:
    """Word number, context, customers by pair; tables by sample and pair; guests and shared tables by sample and word."""
    pairs = np.cumsum(np.frombuffer(row["a"], np.uint32).astype(np.int64))
    customers, tables = np.frombuffer(row["b"], np.uint32).astype(np.int64), np.frombuffer(row["c"], np.uint32).reshape(SAMPLES, -1).astype(np.int64)
    parents = np.frombuffer(row["d"], np.uint32).reshape(2, SAMPLES, -1).astype(np.int64)
    _, word = np.unique(pairs >> CONTEXT_BITS, return_inverse=True)
    return word, pairs, customers, tables, parents[0], parents[1]


def _seat_heavy(stored: DataFrame, shared, light: _Sampled) -> DataFrame:
    """Seating of the heavy words from their summed counts, some words to a group, after the light ones."""
    others = (light.tables.mean(axis=0), float(light.guests.mean()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, n = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counted = stored.filter("slice = -1").select("a", "b").mapInArrow(spread, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy())
        pairs, customers = table.column("key").to_numpy()[order], table.column("n").to_numpy()[order]
        row = _seated(pairs, customers, shared.value, (1 << 40) + key[0].as_py(), shared.value.heavy_part, others)
        types = [*[pa.binary()] * 4, pa.list_(pa.float64())]
        return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=["a", "b", "c", "d", "sums"])

    groups = counted.withColumn("part", F.shiftright("key", CONTEXT_BITS + 5))
    return groups.groupBy("part").applyInArrow(run, "a binary, b binary, c binary, d binary, sums array<double>")


def _sums(rows: DataFrame) -> _Sampled:
    found = rows.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(SAMPLES * (CONTEXTS + 2))  # a row for each of these places at most
    out[found.column("at").to_numpy()] = found.column("x").to_numpy()
    at = SAMPLES * CONTEXTS
    return _Sampled(out[:at].reshape(SAMPLES, CONTEXTS), out[at : at + SAMPLES], out[at + SAMPLES :])


def _heavy_matrix(heavy: DataFrame, totals: _Totals, sampled: _Sampled) -> np.ndarray:
    """log10 probability of each heavy word in each context: at most 1 / HEAVY x CONTEXTS numbers."""
    out = np.zeros((max(1, len(totals.heavy)), CONTEXTS))
    for row in heavy.toArrow().to_pylist():
        word, pairs, customers, tables, guests, shared = _read_tables(row)
        codes = np.unique(pairs >> CONTEXT_BITS)
        context = pairs & (CONTEXTS - 1)
        for k, code in enumerate(codes):
            own = np.flatnonzero(word == k)
            full, seated = np.zeros(CONTEXTS), np.zeros((SAMPLES, CONTEXTS))
            full[context[own]] = customers[own]
            seated[:, context[own]] = tables[:, own]
            every = np.arange(CONTEXTS)
            spread = lambda x: np.repeat(x[:, [k]], CONTEXTS, axis=1)  # noqa: E731, B023
            out[code] = np.log10(predictive(full, seated, spread(guests), spread(shared), every, totals, sampled))
    return out


def score(docs: DataFrame, held: str = "held") -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every row.

    The rows for which the boolean column `held` is not true train the model. A null text is empty
    and is one token, the end; a null `held` counts as false; repeated rows are counted and scored
    one by one; a null doc_id is kept. A word without training tokens has the probability of the one
    unknown word. With no training row every text has probability one. An empty table gives an empty
    one. Only doc_id, text and `held` are read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.coalesce(F.col(held), F.lit(False)).alias("held"))
    counts = materialize(_counts(source.filter("not held")), "counts")
    totals = _totals(counts)
    size = docs.select((F.sum(F.length("text")) / 10).cast("long").alias("n")).first()["n"] or 0
    shared = spark.sparkContext.broadcast(totals)
    buckets = max(1, size // BUCKET_TOKENS)
    light = materialize(_seat_buckets(_pack(source, shared, buckets), shared, kind), "seated")
    others = _sums(light.filter("bucket >= 0"))
    heavy = materialize(_seat_heavy(light, shared, others), "heavy")
    frequent = _sums(heavy)
    sampled = _Sampled(others.tables + frequent.tables, others.guests + frequent.guests, others.shared + frequent.shared)
    matrix = _heavy_matrix(heavy, totals, sampled)
    known = spark.sparkContext.broadcast((sampled, matrix))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled, matrix = known.value
        totals = shared.value
        floor = np.log10(totals.tokens + 0.5 * (totals.types + 1))
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]  # one bucket at a time in memory
                out = []
                if row["bucket"] < 0:
                    sizes = np.frombuffer(row["b"], np.int64).reshape(2, -1)
                    word, context = np.frombuffer(row["c"], np.uint16), np.frombuffer(row["d"], np.uint16)
                    own = np.repeat(np.arange(sizes.shape[1]), sizes[1])
                    add = lambda x: np.bincount(own, weights=x, minlength=sizes.shape[1])  # noqa: E731, B023
                    base = np.log10(totals.heavy_counts + 0.5) - floor if len(totals.heavy) else np.zeros(1)
                    out.append((row["slice"], row["ids"], row["a"], sizes[0].tobytes(), np.arange(sizes.shape[1], dtype=np.uint16), sizes[1].astype(np.uint32), add(base[word]), add(matrix[word, context])))
                else:
                    word, pairs, customers, tables, guests, shared_tables = _read_tables(row)
                    by_word = np.bincount(word, weights=customers)
                    logp = np.log10(predictive(customers, tables, guests[:, word], shared_tables[:, word], pairs & (CONTEXTS - 1), totals, sampled))
                    base, seen = (np.log10(by_word + 0.5) - floor)[word], (by_word > 0)[word].astype(np.uint32)
                    token, owner = np.frombuffer(row["f"], np.uint32), np.frombuffer(row["g"], np.uint16)
                    for slice_, start, stop in np.frombuffer(row["e"], np.int64).reshape(3, -1).T.tolist():
                        at, own = token[start:stop], owner[start:stop]
                        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # tokens of a document stand together
                        out.append((slice_, None, None, None, own[first], *(np.add.reduceat(x[at], first).astype(x.dtype) for x in (seen, base, logp))))
                types = [pa.int64(), batch.schema.field("ids").type, *[pa.binary()] * 6]
                flat = [(*x[:4], *(y.tobytes() for y in x[4:])) for x in out]
                for k in range(0, len(flat), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat[k : k + 512]), types)], names=["slice", "ids", "held", "n", "at", "known", "base", "score"])

    found = light.filter("slice <> -1").drop("sums").mapInArrow(parts, f"slice long, ids array<{kind}>, held binary, n binary, at binary, known binary, base binary, score binary")
    n_train = totals.tokens

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        n = len(head["ids"])
        sums = {"known": np.zeros(n, np.int64), "base": np.zeros(n), "score": np.zeros(n)}
        # summed in a fixed order, so that a lost task gives the same digits again
        for r in sorted(rows, key=lambda r: (r["at"], r["base"], r["score"])):
            at = np.frombuffer(r["at"], np.uint16)
            for name, kind_ in (("known", np.uint32), ("base", float), ("score", float)):
                sums[name][at] += np.frombuffer(r[name], kind_)
        return pa.table({
            "doc_id": pa.array(head["ids"], table.schema.field("ids").type.value_type), "held_out": pa.array(np.frombuffer(head["held"], bool)),
            "n_tokens": pa.array(np.frombuffer(head["n"], np.int64)), "n_known": pa.array(sums["known"]),
            "train_tokens": pa.array(np.full(n, n_train, np.int64)), "base_score": pa.array(sums["base"]), "score": pa.array(sums["score"]),
        })

    return found.groupBy("slice").applyInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
