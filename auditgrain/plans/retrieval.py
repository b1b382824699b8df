"""Chunking, retrieval and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.operators import conversations as C
from auditgrain.operators import ranking as P
from auditgrain.operators import retrieval as R
from auditgrain.operators.fulltext import ENGLISH_STOP, TERM, fulltext_search, light_stem
from auditgrain.plans.base import table, with_views
from auditgrain.plans.registry import query

CHUNKS = [
    ("clean", r"SELECT doc_id, trim(replace(text, chr(13) || chr(10), chr(10)), chr(32) || chr(10) || chr(9) || chr(13)) AS t FROM documents"),
    ("paragraphs", r"SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pn FROM (SELECT doc_id, string_split_regex(t, '\n\s*\n') AS ps FROM clean)"),
    ("tokens", r"SELECT doc_id, pn, regexp_extract_all(p, '\S+\s*') AS tk FROM paragraphs"),
    ("windows", "SELECT doc_id, pn, tk, unnest(range(0, greatest(1, CAST(ceil((len(tk) - 30) / 190.0) AS BIGINT)))) AS w FROM tokens WHERE len(tk) > 0"),
    ("chunks", r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pn, w) - 1 AS chunk_index, rtrim(array_to_string(tk[w * 190 + 1 : w * 190 + 220], ''), chr(32) || chr(10) || chr(9) || chr(13)) AS chunk_text, least(220, len(tk) - w * 190) AS token_count FROM windows"),
]


def chunks(spark, d):
    return R.chunk_documents(table(spark, d, "documents"), 220, 30, 20_000)


@query("RTR-1", "chunk_documents", with_views("", "SELECT doc_id, chunk_index, chunk_text, token_count FROM chunks", CHUNKS))
def _(spark, d):
    return chunks(spark, d)[0].select("doc_id", "chunk_index", "chunk_text", "token_count")


@query("RTR-1", "oversize_documents", with_views("", "SELECT doc_id, length(t) AS characters FROM clean WHERE length(t) > 20000", CHUNKS[:1]))
def _(spark, d):
    from auditgrain.functions.expressions import strip

    return chunks(spark, d)[1].select("doc_id", F.length(strip("text")).alias("characters"))


def centroids(spark, d):
    """One query per label: the mean vector of its members, per dimension."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def vector_chunks(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding",
        F.create_map(F.lit("half"), F.when(F.col("label") < 5, "low").otherwise("high")).alias("metadata"), "label",
    )


VECTORS = [
    ("e", "SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings"),
    ("dims", "SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e"),
    ("cent", "SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY label"),
    ("scores", "SELECT query_id, vec_id AS chunk_id, label, list_cosine_similarity(q, v) AS score FROM cent, e"),
    ("vec_hits", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 15"),
]


@query("RTR-2", "vector_search", with_views("", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vec_hits WHERE rank <= 10", VECTORS))
def _(spark, d):
    return R.vector_search(centroids(spark, d), vector_chunks(spark, d), 10).withColumn("score", F.round("score", 6))


@query("RTR-2", "vector_search_filtered", with_views("", """SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores WHERE label < 5) WHERE rank <= 10""", VECTORS[:4]))
def _(spark, d):
    return R.vector_search(centroids(spark, d), vector_chunks(spark, d), 10, {"half": "low"}).drop("score")


def passages(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


STOP = ", ".join(f"'{w}'" for w in R.KEYWORD_STOP)
KEYWORD = [
    ("qt", f"SELECT DISTINCT item_id AS query_id, t FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) WHERE length(t) > 2 AND t NOT IN ({STOP})"),
    ("dt", f"SELECT DISTINCT doc_id AS chunk_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) WHERE length(t) > 2 AND t NOT IN ({STOP})"),
    ("hits", "SELECT query_id, chunk_id, count(*) AS score FROM qt JOIN dt USING (t) GROUP BY ALL"),
]


@query("RTR-3", "keyword_search", with_views("", "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 3", KEYWORD))
def _(spark, d):
    return R.keyword_search(passages(spark, d), texts(spark, d), 3)


def stem_sql(t: str) -> str:
    ends = lambda x, n: f"{t} LIKE '%{x}' AND length({t}) >= {n}"
    less = lambda n: f"left({t}, length({t}) - {n})"
    base = f"""CASE WHEN {ends('sses', 5)} THEN {less(2)} WHEN {ends('ies', 5)} THEN {less(3)} || 'y' WHEN {t} LIKE '%ss' OR {t} LIKE '%us' THEN {t}
      WHEN {ends('s', 4)} THEN {less(1)} WHEN {ends('ing', 6)} THEN {less(3)} WHEN {ends('ed', 5)} THEN {less(2)} ELSE {t} END"""
    return rf"regexp_replace({base}, '^(.{{3,}})e$', '\1')"


def fulltext_sql(raw: str, english: bool = False) -> list[tuple[str, str]]:
    """Full-text search by its definition, from the words of each query: (query_id, alternative, clause, slot, word, negated)."""
    stop = "WHERE word NOT IN (" + ", ".join(f"'{w}'" for w in ENGLISH_STOP) + ")" if english else ""
    term = stem_sql("word") if english else "word"
    return [
        ("bw", r"SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x <> 'or') AS w FROM benchmark"),
        ("raw", raw),
        ("ask", f"""SELECT *, count(*) OVER (PARTITION BY query_id, alternative, clause) AS need FROM (SELECT query_id, alternative, clause, slot, negated, {term} AS term FROM raw {stop})"""),
        ("alts", """SELECT query_id, alternative, count(DISTINCT CASE WHEN NOT negated THEN clause END) AS clauses, count(CASE WHEN NOT negated THEN 1 END) AS asked,
          count(DISTINCT CASE WHEN NOT negated THEN term END) AS terms FROM ask GROUP BY ALL"""),
        ("words", r"SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents"),
        ("pos", f"""SELECT chunk_id, p, {term} AS term FROM (SELECT chunk_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM words) {stop}"""),
        ("has", "SELECT DISTINCT chunk_id, term FROM pos WHERE term IN (SELECT term FROM ask)"),
        ("cand", """SELECT query_id, alternative, chunk_id FROM (SELECT DISTINCT query_id, alternative, term FROM ask WHERE NOT negated) JOIN has USING (term)
          JOIN alts USING (query_id, alternative) GROUP BY query_id, alternative, chunk_id, terms HAVING count(*) = terms"""),
        ("occ", """SELECT a.query_id, a.alternative, a.clause, a.negated, a.need, p.chunk_id, p.p - a.slot AS place, min(a.slot) AS lo, max(a.slot) AS hi
          FROM cand c JOIN ask a ON a.query_id = c.query_id AND a.alternative = c.alternative JOIN pos p ON p.chunk_id = c.chunk_id AND p.term = a.term
          GROUP BY a.query_id, a.alternative, a.clause, a.negated, a.need, p.chunk_id, p.p - a.slot HAVING count(*) = a.need"""),
        ("good", """SELECT query_id, alternative, chunk_id FROM occ JOIN alts USING (query_id, alternative) GROUP BY query_id, alternative, chunk_id, clauses
          HAVING count(DISTINCT CASE WHEN NOT negated THEN clause END) = clauses AND NOT bool_or(negated)"""),
        ("ev", "SELECT query_id, chunk_id, alternative, clause, place + lo AS s, place + hi AS e FROM occ JOIN good USING (query_id, alternative, chunk_id)"),
        ("latest", """SELECT x.query_id, x.chunk_id, x.e, o.alternative, o.clause, max(o.s) AS s FROM (SELECT DISTINCT query_id, chunk_id, e FROM ev) x
          JOIN ev o ON o.query_id = x.query_id AND o.chunk_id = x.chunk_id AND o.e <= x.e GROUP BY ALL"""),
        ("begins", """SELECT query_id, chunk_id, e, min(s) AS l, asked FROM latest JOIN alts USING (query_id, alternative)
          GROUP BY query_id, chunk_id, e, alternative, asked, clauses HAVING count(*) = clauses"""),
        ("ends", "SELECT * FROM begins QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id, e ORDER BY l DESC, asked DESC) = 1"),
        ("covers", "SELECT query_id, chunk_id, l, min(e) AS e, arg_min(asked, e) AS asked FROM ends GROUP BY query_id, chunk_id, l"),
        ("scored", "SELECT query_id, chunk_id, sum(100000000000 // (1 + greatest(0, e - l + 1 - asked)))::DOUBLE / 1e12 AS s FROM covers GROUP BY ALL"),
        ("text_hits", "SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 15"),
    ]


FULLTEXT_HITS = "SELECT query_id, chunk_id, round(s, 6) AS score, rank FROM text_hits WHERE rank <= 10"
PLAIN = """SELECT query_id, 0 AS alternative, row_number() OVER (PARTITION BY query_id ORDER BY word) AS clause, 0 AS slot, word, FALSE AS negated
  FROM (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM benchmark)"""


def raw_sql(*words: tuple[int, int, int, int, bool]) -> str:
    """Words of every query from (alternative, clause, slot, number of the passage's word, negated)."""
    return " UNION ALL ".join(
        f"SELECT query_id, {a} AS alternative, {c} AS clause, {s} AS slot, w[{n}] AS word, {neg} AS negated FROM bw WHERE len(w) >= {n}" for a, c, s, n, neg in words
    )


def web_queries(spark, d, form: str, words: int):
    """Queries in web-search syntax made of the first words of each passage; `{n}` in the form is the n-th."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda x: x != "or")
    text = F.lit(form)
    for n in range(1, words + 1):
        text = F.replace(text, F.lit(f"{{{n}}}"), F.get("w", F.lit(n - 1)))
    return passages(spark, d).select("query_id", w.alias("w")).filter(F.size("w") >= words).select("query_id", text.alias("text"))


def ten(hits):
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("RTR-4", "fulltext_search", with_views("", FULLTEXT_HITS, fulltext_sql(PLAIN)))
def _(spark, d):
    return ten(fulltext_search(passages(spark, d), texts(spark, d), 10, plain=True))


@query("RTR-4", "fulltext_phrase", with_views("", FULLTEXT_HITS, fulltext_sql(raw_sql((0, 0, 0, 1, False), (0, 0, 1, 2, False), (0, 1, 0, 3, False)))))
def _(spark, d):
    return ten(fulltext_search(web_queries(spark, d, '"{1} {2}" {3}', 3), texts(spark, d), 10))


@query("RTR-4", "fulltext_either", with_views("", FULLTEXT_HITS, fulltext_sql(raw_sql(
    (0, 0, 0, 1, False), (0, 1, 0, 2, False), (1, 0, 0, 3, False), (1, 0, 1, 4, False), (2, 0, 0, 5, False), (2, 1, 0, 1, False)))))
def _(spark, d):
    return ten(fulltext_search(web_queries(spark, d, '{1} {2} or "{3} {4}" OR {5} {1}', 5), texts(spark, d), 10))


@query("RTR-4", "fulltext_without", with_views("", FULLTEXT_HITS, fulltext_sql(raw_sql(
    (0, 0, 0, 2, False), (0, 1, 0, 1, True), (0, 2, 0, 3, True), (0, 2, 1, 4, True)))))
def _(spark, d):
    return ten(fulltext_search(web_queries(spark, d, '{2} -{1} -"{3} {4}"', 4), texts(spark, d), 10))


@query("RTR-4", "fulltext_stems", with_views("", FULLTEXT_HITS, fulltext_sql(raw_sql(
    (0, 0, 0, 1, False), (0, 1, 0, 2, False), (0, 1, 1, 3, False), (1, 0, 0, 4, False), (1, 1, 0, 5, False)), english=True)))
def _(spark, d):
    return ten(fulltext_search(web_queries(spark, d, '{1} {2}-{3} or {4} {5}', 5), texts(spark, d), 10, ENGLISH_STOP, light_stem))


FUSED = [
    *VECTORS[:4], ("low_hits", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores WHERE label < 5 QUALIFY rank <= 15"),
    *fulltext_sql(PLAIN)[:-1],
    ("text_hits", """SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM scored
      WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE label < 5) QUALIFY rank <= 15"""),
    ("fused", """SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
      coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS final_score FROM low_hits v FULL JOIN text_hits t ON t.query_id = v.query_id AND t.chunk_id = v.chunk_id"""),
]


def hybrid_tables(spark, d):
    """Queries are label means and benchmark passages, chunks embeddings and documents, joined by their ids."""
    means = centroids(spark, d).withColumn("query_id", F.col("query_id").cast("long"))
    return means.join(passages(spark, d), "query_id", "full"), vector_chunks(spark, d).join(texts(spark, d), "chunk_id", "full")


@query("RTR-5", "hybrid_search", with_views("", "SELECT query_id, chunk_id, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 5", FUSED))
def _(spark, d):
    hits = R.hybrid_search(*hybrid_tables(spark, d), 5, {"half": "low"}, allowed=["half"], plain=True)
    return hits.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


@query("RTR-6", "hit_status", with_views("", """SELECT query_id, round(max(score), 6) AS best, CASE WHEN max(score) >= 0.65 THEN 'STRONG_HIT' WHEN max(score) >= 0.55 THEN 'WEAK_HIT' ELSE 'MISS' END AS status,
  count(CASE WHEN score >= 0.55 AND rank <= 5 THEN 1 END) AS selected FROM vec_hits GROUP BY query_id""", VECTORS))
def _(spark, d):
    q = centroids(spark, d)
    found = R.vector_search(q, vector_chunks(spark, d), 15)
    chosen = R.selected_hits(found).groupBy("query_id").agg(F.count("*").alias("selected"))
    return R.hit_status(found, q).join(chosen, "query_id", "left").select(
        "query_id", F.round("best", 6).alias("best"), "status", F.coalesce("selected", F.lit(0)).alias("selected")
    )


@query("RTR-7", "validate_vectors", """SELECT count(*) AS vectors, sum(CASE WHEN vec_id % 50 = 1 THEN 1 ELSE 0 END)::BIGINT AS empty, 0 AS not_finite, sum(CASE WHEN vec_id % 50 = 2 THEN 1 ELSE 0 END)::BIGINT AS zero,
  0 AS min_dimensions, 64 AS max_dimensions, FALSE AS valid FROM embeddings""")
def _(spark, d):
    k = F.col("vec_id") % 50
    spoiled = F.when(k == 1, F.array().cast("array<float>")).when(k == 2, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    return R.validate_vectors(table(spark, d, "embeddings").withColumn("embedding", spoiled))


@query("RTR-8", "upsert_chunks", """SELECT 'main' AS space, source AS document_id, doc_id, lang AS domain, CASE WHEN lang = 'fr' AND source IN (SELECT source FROM documents WHERE lang = 'fr') THEN 'new' ELSE 'old' END AS version
FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'fr') OR lang = 'fr'""")
def _(spark, d):
    base = table(spark, d, "documents").select(
        F.lit("main").alias("space"), F.col("source").alias("document_id"), "doc_id", F.col("lang").alias("domain"), F.lit("prose").alias("source_type")
    )
    old = base.withColumn("metadata", F.create_map(F.lit("version"), F.lit("old")))
    new = base.filter("domain = 'fr'").withColumn("metadata", F.create_map(F.lit("version"), F.lit("new"), F.lit("domain"), F.lit("stale")))
    out = R.upsert_chunks(old, new)
    return out.select("space", "document_id", "doc_id", "domain", F.try_element_at("metadata", F.lit("version")).alias("version"))


CAPACITY = [
    ("old", "SELECT lang AS space, source || '-' || (doc_id % 7) AS document_id, count(*) AS replaced FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL"),
    ("new", "SELECT lang AS space, source || '-' || (doc_id % 11) AS document_id, count(*) AS chunks, min(doc_id) AS arrival FROM documents GROUP BY ALL"),
    ("judged", """SELECT new.*, coalesce(old.replaced, 0) AS replaced, (SELECT coalesce(sum(replaced), 0) FROM old o WHERE o.space = new.space) AS start,
      row_number() OVER (PARTITION BY new.space ORDER BY arrival, new.document_id) AS i FROM new LEFT JOIN old USING (space, document_id)"""),
    ("walk", """SELECT space, 0::BIGINT AS i, max(start)::BIGINT AS total, NULL::VARCHAR AS verdict FROM judged GROUP BY space
      UNION ALL SELECT j.space, j.i, CASE WHEN w.total - j.replaced + j.chunks <= 220 THEN w.total - j.replaced + j.chunks ELSE w.total END,
        CASE WHEN w.total - j.replaced + j.chunks <= 220 THEN 'admitted' ELSE 'refused' END FROM walk w JOIN judged j ON j.space = w.space AND j.i = w.i + 1"""),
]


def spaces(spark, d):
    """Chunks already held and chunks that arrive: documents of a language are a space, parts of a source its documents."""
    base = table(spark, d, "documents").select("doc_id", F.col("lang").alias("space"), "source", F.lit("prose").alias("source_type"), F.col("lang").alias("domain"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    named = lambda df, n: df.withColumn("document_id", F.concat_ws("-", "source", (F.col("doc_id") % n).cast("string")))
    return named(base.filter("doc_id % 3 <> 0"), 7), named(base, 11)


@query("RTR-8", "admit_documents", with_views("", """SELECT j.space, j.document_id, j.chunks, j.replaced, w.total, w.verdict FROM judged j JOIN walk w ON w.space = j.space AND w.i = j.i""", CAPACITY).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    return R.admit_documents(*spaces(spark, d), 220, "doc_id")


@query("RTR-8", "upsert_within_capacity", with_views("", """SELECT space, document_id, count(*) AS chunks FROM (
SELECT lang AS space, source || '-' || (doc_id % 7) AS document_id FROM documents WHERE doc_id % 3 <> 0 AND (lang, source || '-' || (doc_id % 7)) NOT IN (SELECT (space, document_id) FROM taken)
UNION ALL SELECT lang, source || '-' || (doc_id % 11) FROM documents WHERE (lang, source || '-' || (doc_id % 11)) IN (SELECT (space, document_id) FROM taken)) GROUP BY ALL""", [
    *CAPACITY, ("taken", "SELECT j.space, j.document_id FROM judged j JOIN walk w ON w.space = j.space AND w.i = j.i WHERE w.verdict = 'admitted'"),
]).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    chunks_, _ = R.upsert_within_capacity(*spaces(spark, d), 220, "doc_id")
    return chunks_.groupBy("space", "document_id").agg(F.count("*").alias("chunks"))


@query("SRT-4", "top_k_per_query", with_views("", "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 5", KEYWORD))
def _(spark, d):
    return P.top_k_per_query(R.keyword_candidates(passages(spark, d), texts(spark, d), 5), 5)


@query("WIN-6", "last_turns", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3""")
def _(spark, d):
    return C.last_turns(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "position")


@query("WIN-6", "transcript", "SELECT turn, role, text FROM conversations WHERE conv_id = 2 ORDER BY turn")
def _(spark, d):
    return C.transcript(table(spark, d, "conversations"), 2).select("turn", "role", "text")


@query("WIN-7", "recent_sessions", """SELECT conv_id, max(conv_id * 7919 % 1009 * 100 + turn) AS last_activity, count(*) AS messages,
  substring(arg_min(text, turn) FILTER (role = 'user'), 1, 120) AS title FROM conversations GROUP BY conv_id ORDER BY last_activity DESC, conv_id LIMIT 100""")
def _(spark, d):
    # The table has no clock; a scattered number per conversation stands in for it.
    turns = table(spark, d, "conversations").withColumn("last_activity", F.col("conv_id") * 7919 % 1009 * 100 + F.col("turn"))
    return C.recent_sessions(turns, 100)
