"""Full-text search: web-search syntax, a positional inverted index and cover-density ranks.

A query is alternatives of clauses: blanks between words mean all of them, `or` starts another
alternative, quotes make a phrase and a minus sign keeps chunks with that word or phrase out. A chunk
meets a query only through the rarest word of one of its alternatives, so no query is compared with
chunks that lack that word.

The rank follows the covers of a query in a chunk: stretches of words that satisfy it and hold no
shorter such stretch. A cover counts less the more words it has beyond those that were asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrain.operators.ranking import top_k
from auditgrain.session import materialize

# --- fixed values: words, pieces of a query, English stop words and what a cover counts ------------
TERM = r"[\p{L}\p{N}]+"
PIECE = r'-?"[^"]*"?|[^\s"]+'
ENGLISH_STOP = (
    "a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its me my no nor not of "
    "on or our she so some such than that the their them then there these they this those to too was we were what when where which who "
    "whom why will with you your"
).split()
#: A cover without other words counts a tenth; sums are in units of 10^-12, so that their order does not matter.
COVER, UNITS = 100_000_000_000, 1e12
# --- end of fixed values ---------------------------------------------------------------------------
#: What every chunk holds, for alternatives that only keep chunks out; its place is before the first word.
ANYTHING, NOWHERE = "", -1
_UNSEEN = -(1 << 30)

Stemmer = Callable[[Column], Column]


def light_stem(word: Column) -> Column:
    """English plurals, -ing, -ed and a final e, by their ends alone."""
    ends = lambda x, least: word.endswith(x) & (F.length(word) >= least)
    less = lambda n, more="": F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(more))
    base = (
        F.when(ends("sses", 5), less(2)).when(ends("ies", 5), less(3, "y")).when(word.endswith("ss") | word.endswith("us"), word)
        .when(ends("s", 4), less(1)).when(ends("ing", 6), less(3)).when(ends("ed", 5), less(2)).otherwise(word)
    )
    return F.regexp_replace(base, "^(.{3,})e$", "$1")


def _words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def _known(df: DataFrame, stop: Sequence[str], stem: Stemmer | None) -> DataFrame:
    """The column `word` without stop words, as `term`."""
    kept = df.filter(~F.col("word").isin(*stop)) if stop else df
    return kept.withColumn("term", stem(F.col("word")) if stem else F.col("word")).drop("word")


def parse_queries(queries: DataFrame, stop: Sequence[str] = (), stem: Stemmer | None = None, plain: bool = False) -> DataFrame:
    """One row for each word of a query: query_id, alternative, clause, negated, slot, term, need, clauses, asked, place.

    A piece of several words, in quotes or joined by punctuation, is a phrase; `slot` is a word's place
    in it, stop words counted. `need` is the number of words of a clause, `clauses` and `asked` those of
    the clauses and words that an alternative must find, `place` numbers the clauses from 0. An
    alternative that only keeps chunks out starts from all of them; one without any word is none. In
    `plain` text every word must be there and no sign has a meaning.
    """
    if plain:
        pieces = queries.select("query_id", F.posexplode(F.array_distinct(_words("text"))).alias("clause", "piece"))
        parts = pieces.select("query_id", F.lit(0).cast("long").alias("alternative"), "clause", F.lit(False).alias("negated"), "piece")
    else:
        pieces = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(PIECE), F.lit(0))).alias("clause", "piece"))
        before = Window.partitionBy("query_id").orderBy("clause")
        is_or = F.col("piece") == "or"
        parts = pieces.withColumn("alternative", F.sum(F.when(is_or, 1).otherwise(0)).over(before)).filter(~is_or).select(
            "query_id", "alternative", "clause", F.col("piece").startswith("-").alias("negated"), "piece"
        )
    words = parts.select("query_id", "alternative", "clause", "negated", F.posexplode(_words("piece")).alias("slot", "word"))
    known = _known(words, stop, stem)
    # an alternative that only refuses is counted as one clause that anything satisfies
    key = ["query_id", "alternative"]
    refusing = known.groupBy(*key).agg(F.min("negated").alias("_none")).filter("_none").select(
        *key, F.lit(-1).alias("clause"), F.lit(False).alias("negated"), F.lit(0).alias("slot"), F.lit(ANYTHING).alias("term")
    )
    every = known.unionByName(refusing)
    alternative = Window.partitionBy(*key)
    wanted = F.when(~F.col("negated"), F.col("clause"))
    return every.withColumns({
        "need": F.count("*").over(Window.partitionBy(*key, "clause")).cast("int"),
        "clauses": F.size(F.collect_set(wanted).over(alternative)),
        "asked": F.count(wanted).over(alternative).cast("int"),
        "place": F.dense_rank().over(Window.partitionBy(*key).orderBy("negated", "clause")) - 1,
    })


def positional_index(
    chunks: DataFrame, stop: Sequence[str] = (), stem: Stemmer | None = None, vocabulary: DataFrame | None = None
) -> DataFrame:
    """(chunk_id, term, positions): sorted places of each term in each chunk, counted in words from 0.

    With a `vocabulary` (column `term`) only its terms are kept; other words go before any shuffle where
    the plan can broadcast it.
    """
    words = chunks.select("chunk_id", F.posexplode(_words("text")).alias("position", "word"))
    terms = _known(words, stop, stem).unionByName(chunks.select("chunk_id", F.lit(NOWHERE).alias("position"), F.lit(ANYTHING).alias("term")))
    if vocabulary is not None:
        terms = terms.join(vocabulary.select("term"), "term", "left_semi")
    return terms.groupBy("chunk_id", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def _occurrences(parts: Column) -> Column:
    """Starts of a phrase from (slot, positions) of all its words: where every word is at its slot."""
    shifted = lambda x: F.transform(x["positions"], lambda p: p - x["slot"])
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), shifted(F.element_at(parts, 1)), lambda a, x: F.array_intersect(a, shifted(x)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cover_density(alternatives: Column) -> Column:
    """Sum over the minimal covers, from (clauses, asked, spans) of each satisfied alternative.

    Spans (end, start, place) are taken by their end. For each clause the latest start so far is kept;
    the least of these over an alternative's clauses is where its shortest stretch to here begins, and
    the greatest of those over the alternatives begins the shortest one of all. A stretch is a cover when
    it begins behind the one before; at equal ends the later beginning counts.
    """
    spans = F.array_sort(F.flatten(F.transform(
        alternatives, lambda a, i: F.transform(a["spans"], lambda s: F.struct(s["end"].alias("end"), s["start"].alias("start"), i.alias("own"), s["place"].alias("place")))
    )))
    unseen = F.lit(_UNSEEN)
    first = F.struct(
        F.transform(alternatives, lambda a: F.array_repeat(unseen, a["clauses"])).alias("latest"),
        F.lit(0).cast("long").alias("total"), unseen.alias("start"), unseen.alias("end"), F.lit(0).cast("long").alias("counts"),
    )

    def step(state: Column, span: Column) -> Column:
        latest = F.transform(state["latest"], lambda row, i: F.when(
            i == span["own"], F.transform(row, lambda v, j: F.when(j == span["place"], F.greatest(v, span["start"])).otherwise(v))
        ).otherwise(row))
        return _let(latest, lambda rows: _let(_begins(rows), lambda begins: _advance(rows, begins, state, span)))

    def _advance(rows: Column, begins: Column, state: Column, span: Column) -> Column:
        same_end = span["end"] == state["end"]
        later = begins["start"] > state["start"]
        taken = later | ((begins["start"] == state["start"]) & same_end)
        return F.struct(
            rows.alias("latest"), (state["total"] + F.when(later & ~same_end, state["counts"]).otherwise(0)).alias("total"),
            F.greatest(begins["start"], state["start"]).alias("start"), F.when(taken, span["end"]).otherwise(state["end"]).alias("end"),
            F.when(taken, _counts(begins, span["end"])).otherwise(state["counts"]).alias("counts"),
        )

    def _begins(rows: Column) -> Column:
        return F.array_max(F.zip_with(rows, alternatives, lambda row, a: F.struct(F.array_min(row).alias("start"), a["asked"].alias("asked"))))

    def _counts(begins: Column, end: Column) -> Column:
        others = F.greatest(F.lit(0), end - begins["start"] + 1 - begins["asked"])
        # before the first word stands only what anything satisfies
        return F.when(end < 0, F.lit(0)).otherwise(F.floor(F.lit(COVER) / (others + 1))).cast("long")

    return F.aggregate(spans, first, step, lambda s: (s["total"] + s["counts"]) / F.lit(UNITS))


def match_queries(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that satisfy a parsed query."""
    key = ["query_id", "alternative"]
    frequency = index.groupBy("term").agg(F.count("*").alias("_df"))
    asked = wanted.filter(~F.col("negated")).join(frequency, "term", "left")
    rarest = asked.groupBy(*key).agg(F.min_by("term", F.struct(F.coalesce("_df", F.lit(0)), "term")).alias("term"))
    candidates = rarest.join(index.select("chunk_id", "term"), "term").select(*key, "chunk_id")
    found = wanted.join(candidates, key).join(index, ["chunk_id", "term"])
    # one shuffle by query and chunk serves the three groupings below
    dealt = found.repartition("query_id", "chunk_id")
    pair = ["query_id", "chunk_id"]
    clauses = dealt.groupBy(*pair, "alternative", "clause", "negated", "need", "clauses", "asked", "place").agg(
        F.collect_list(F.struct("slot", "positions")).alias("_parts"), F.min("slot").alias("_low"), F.max("slot").alias("_high")
    ).filter(F.size("_parts") == F.col("need")).withColumn("_at", _occurrences(F.col("_parts"))).filter(F.size("_at") > 0)
    spans = F.transform("_at", lambda s: F.struct((s + F.col("_high")).alias("end"), (s + F.col("_low")).alias("start"), F.col("place").alias("place")))
    satisfied = clauses.withColumn("_spans", spans).groupBy(*pair, "alternative", "clauses", "asked").agg(
        F.max("negated").alias("_out"), F.count(F.when(~F.col("negated"), 1)).alias("_got"),
        F.flatten(F.collect_list(F.when(~F.col("negated"), F.col("_spans")))).alias("spans"),
    ).filter(~F.col("_out") & (F.col("_got") == F.col("clauses")))
    packed = satisfied.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("alternative", "clauses", "asked", "spans"))).alias("_a"))
    return packed.select(*pair, cover_density(F.col("_a")).alias("score"))


def fulltext_search(
    queries: DataFrame, chunks: DataFrame, k: int, stop: Sequence[str] = (), stem: Stemmer | None = None, plain: bool = False
) -> DataFrame:
    """Best k chunks of each query: (query_id, chunk_id, score, rank), by the unrounded score, ties by chunk id.

    Stop words are neither asked for nor found but keep their places; `stem` maps a word column to its
    stems on both sides. A query without words finds nothing.
    """
    wanted = materialize(parse_queries(queries, stop, stem, plain), "clauses")
    index = materialize(positional_index(chunks, stop, stem, wanted.select("term").distinct()), "postings")
    return top_k(match_queries(wanted, index), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
