"""Text tagging, routing, redaction, mentions and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrain.functions.expressions import squeeze
from auditgrain.operators import grouping as S
from auditgrain.operators import mentions as E
from auditgrain.operators import routing as R
from auditgrain.operators import tagging as G
from auditgrain.operators.observations import dedupe_texts
from auditgrain.plans.base import (
    PARTS, PROSE, all_words, any_word, project_rows, quoted, sentence_tags, table, theme_list, with_views,
)
from auditgrain.plans.registry import query
from auditgrain.session import materialize

CLEAN = ("docs", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents")


@query("TAG-3", "classify_observation", with_views("", "SELECT doc_id, category, theme, severity, confidence, evidence_quote, keywords FROM classified", [CLEAN, *sentence_tags("docs", "clean", PROSE)]))
def _(spark, d):
    return G.classify_observation(table(spark, d, "documents"), PROSE).select(
        "doc_id", "category", "theme", "severity", "confidence", "evidence_quote", F.array_join("keywords", ",").alias("keywords")
    )


def _supported(theme: str, low: str) -> str:
    cases = " ".join(f"WHEN {quoted(t)} THEN {any_word(low, w)}" for t, w in PROSE.themes.items())
    return f"NOT {any_word(low, PROSE.negations)} AND CASE {theme} {cases} ELSE FALSE END"


def _severe(kind: str, low: str) -> str:
    words = list(PROSE.critical) + (list(PROSE.high) if kind == "High" else [])
    return f"NOT {any_word(low, PROSE.severity_negations)} AND {any_word(low, words)}"


@query("TAG-4", "support_checks", f"""SELECT doc_id, {_severe('Critical', 'lower(text)')} AS critical, {_severe('High', 'lower(text)')} AS high, {_supported("'Motion'", 'lower(text)')} AS motion,
  {_supported("'Secret'", 'lower(text)')} AS secret FROM documents""")
def _(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", G.severity_supported(F.lit("Critical"), text, PROSE).alias("critical"), G.severity_supported(F.lit("High"), text, PROSE).alias("high"),
        G.supported_theme(F.lit("Motion"), text, PROSE).alias("motion"), G.supported_theme(F.lit("Secret"), text, PROSE).alias("secret"),
    )


@query("TAG-5", "is_instruction", "SELECT doc_id, regexp_matches(text, 'ignore (?:all )?previous|in the|en la', 'i') AS instruction FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", G.is_instruction(F.col("text"), PROSE).alias("instruction"))


RUBRIC = [
    ("split", r"SELECT doc_id, list_distinct_ordered AS quotes FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(10) || chr(9) || chr(13))), "
     + r"lambda s: s <> '' AND NOT regexp_matches(lower(s), '(^|[^\p{L}\p{N}_])(the of|de la)($|[^\p{L}\p{N}_])') AND " + any_word("lower(s)", PROSE.words) + ") AS found FROM documents), LATERAL (SELECT list_reduce(list_prepend([]::VARCHAR[], list_transform(found, lambda s: [s])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered)"),
    ("themed", f"SELECT *, list_transform(quotes, lambda s: {theme_list('lower(s)', PROSE)}) AS per, lower(array_to_string(quotes, ' ')) AS low FROM split"),
    ("flat", "SELECT *, list_filter(" + "[" + ", ".join(quoted(t) for t in PROSE.names) + "], lambda t: len(list_filter(per, lambda p: list_contains(p, t))) > 0) AS present, flatten(per) AS all_themes FROM themed"),
    ("ordered", "SELECT *, list_sort(list_transform(present, lambda t: lpad(CAST(list_position(all_themes, t) AS VARCHAR), 9, '0') || t)) AS keyed FROM flat"),
]


@query("TAG-6", "tag_rubric", with_views("", f"""SELECT doc_id, array_to_string(list_transform(keyed, lambda k: substring(k, 10)), ',') AS themes, len(quotes) AS quotes,
  CASE substring(keyed[1], 10) WHEN 'Motion' THEN 'Dynamics' WHEN 'Origin' THEN 'Dynamics' WHEN 'Secret' THEN 'Security' ELSE 'Unclassified' END AS category,
  CASE WHEN len(keyed) = 0 THEN 'Insufficient evidence' WHEN {any_word('low', PROSE.rubric_critical)} THEN 'Critical' WHEN {any_word('low', PROSE.rubric_high)} THEN 'High'
    WHEN {all_words('low', PROSE.rubric_low_all)} THEN 'Low' WHEN {any_word('low', PROSE.rubric_medium)} THEN 'Medium' ELSE 'Insufficient evidence' END AS severity FROM ordered""", RUBRIC))
def _(spark, d):
    return G.tag_rubric(table(spark, d, "documents"), PROSE).select(
        "doc_id", F.array_join("themes", ",").alias("themes"), F.size("evidence_quotes").alias("quotes"), "category", "severity"
    )


def candidate_tags(spark, d):
    """Rule tags of every text, damaged in a known way by hash: what an unreliable provider would send."""
    # texts and tags are asked for several times: each is worked out once
    texts = materialize(dedupe_texts(table(spark, d, "documents")), "texts", "zstd")
    digit = F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") % 8
    tags = materialize(G.classify_observation(texts, PROSE).drop("text").withColumn("fault", digit), "tags", "zstd")
    fault = F.col("fault")
    damaged = tags.withColumns({
        "theme": F.when(fault == 1, "Nonsense").otherwise(F.col("theme")),
        "category": F.when(fault == 2, "Other").otherwise(F.col("category")),
        "confidence": F.when(fault == 3, 1.5).otherwise(F.col("confidence")),
        "evidence_quote": F.when(fault == 4, F.concat(F.lit("never said: "), F.col("evidence_quote"))).otherwise(F.col("evidence_quote")),
        "keywords": F.when(fault == 5, F.array(F.lit("zzzzqq"))).otherwise(F.col("keywords")),
        "rationale": F.when(fault == 6, "Raises the risk score.").otherwise(F.col("rationale")),
    })
    return texts, tags.drop("fault"), damaged


FAULTS = [
    ("uniq", "SELECT DISTINCT sha256(clean) AS hash, clean FROM docs"),
    *sentence_tags("uniq", "clean", PROSE),
    ("damaged", "SELECT *, CAST('0x' || left(hash, 2) AS INTEGER) % 8 AS fault FROM classified"),
]


@query("TAG-7", "verify_tags", with_views("", f"""SELECT hash, CASE fault WHEN 1 THEN list_contains(r, 'unknown theme') WHEN 2 THEN list_contains(r, 'unknown category') WHEN 3 THEN list_contains(r, 'confidence outside 0-1')
   WHEN 4 THEN list_contains(r, 'quote not verbatim') WHEN 5 THEN list_contains(r, 'keyword not in text') WHEN 6 THEN list_contains(r, 'prohibited conclusion') ELSE len(r) = 0 END AS as_expected FROM (
  SELECT hash, fault, CASE fault WHEN 1 THEN ['unknown theme'] WHEN 2 THEN ['unknown category'] WHEN 3 THEN ['confidence outside 0-1'] WHEN 4 THEN ['quote not verbatim']
   WHEN 5 THEN ['keyword not in text'] WHEN 6 THEN ['prohibited conclusion'] ELSE [] END AS r FROM damaged)""", [CLEAN, *FAULTS]))
def _(spark, d):
    texts, _, damaged = candidate_tags(spark, d)
    checked = G.verify_tags(damaged, texts, PROSE)
    has = lambda m: F.array_contains("reasons", m)
    fault = F.col("fault")
    expected = (
        F.when(fault == 1, has("unknown theme")).when(fault == 2, has("unknown category")).when(fault == 3, has("confidence outside 0-1"))
        .when(fault == 4, has("quote not verbatim")).when(fault == 5, has("keyword not in text")).when(fault == 6, has("prohibited conclusion"))
        .otherwise(F.col("valid"))
    )
    return checked.select("hash", expected.alias("as_expected"))


@query("TAG-8", "resolve_tags", with_views("", """SELECT hash, theme, severity, fault IN (0, 7) AND theme IS NOT NULL AS ai_generated, CASE WHEN fault = 7 THEN FALSE ELSE fault <> 0 END AS fallback,
  CASE WHEN fault IN (0, 7) THEN 'validated' WHEN fault = 2 THEN 'provider_unavailable' ELSE 'invalid_output' END AS raw_status FROM damaged""", [CLEAN, *FAULTS]))
def _(spark, d):
    texts, rules, damaged = candidate_tags(spark, d)
    checked = G.verify_tags(damaged, texts, PROSE)
    # Fault 2 stands for texts the provider never answered.
    answered = checked.filter(F.col("fault") != 2)
    return G.resolve_tags(answered, rules).select("hash", "theme", "severity", "ai_generated", "fallback", "raw_status")


@query("JOI-12", "incremental_untagged", with_views("", """SELECT DISTINCT hash FROM (SELECT sha256(clean) AS hash, clean, doc_id FROM docs)
WHERE 'rules:' || sha256(clean || 'prose-1' || '2.0' || 'deterministic') NOT IN (SELECT 'rules:' || sha256(clean || 'prose-1' || '2.0' || 'deterministic') FROM docs JOIN labels USING (doc_id))""", [CLEAN]))
def _(spark, d):
    docs = table(spark, d, "documents")
    key = lambda c: G.cache_key(c, "rules", "deterministic", "prose-1", "2.0")
    # Already tagged: the documents somebody labelled.
    cache = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(key(F.col("text")).alias("cache_key"))
    return G.incremental_untagged(dedupe_texts(docs), cache, "rules", "deterministic", "prose-1", "2.0").select("hash")


def _route_sql(table_name: str, text: str) -> str:
    hit = lambda p: f"regexp_matches(low, {quoted(p)})"
    return f"""SELECT *, {hit(R.UNSUPPORTED)} AS un, {hit(R.ANALYTIC)} AS an, {hit(R.ASSESSMENT)} AS ass, {hit(R.RECOMMEND)} AS rec, {hit(R.CRITICAL)} AS crit, {hit(R.SUMMARISE)} AS summ
  FROM (SELECT *, lower({text}) AS low FROM {table_name})"""


ROUTED = ("routed", """SELECT *, CASE WHEN un THEN 'UnsupportedDomainAgent' WHEN an THEN 'DataAnalyticsAgent' WHEN ass THEN 'InspectionAssessmentAgent' ELSE 'EvidenceAgent' END AS target,
  CASE WHEN NOT un AND an AND ass THEN 'InspectionAssessmentAgent' END AS secondary_target,
  CASE WHEN crit THEN 'CRITICAL' WHEN rec THEN 'HIGH' WHEN ass THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN rec THEN 'Recommend' WHEN contains(low, 'compare') THEN 'Compare' WHEN an OR ass THEN 'Analyse' WHEN summ THEN 'Summarise' ELSE 'Search' END AS task,
  concat_ws(',', CASE WHEN un THEN 'R1' END, CASE WHEN NOT un AND an THEN 'R2' END, CASE WHEN NOT un AND an AND ass THEN 'M1' END, CASE WHEN NOT un AND ass THEN 'R3' END,
    CASE WHEN NOT un AND NOT an AND NOT ass THEN 'R4' END, CASE WHEN crit OR rec THEN 'H1' END) AS matched_rules FROM hits""")


@query("TAG-10", "route_text", with_views("", "SELECT doc_id, target, secondary_target, risk_level, task, matched_rules FROM routed", [
    ("asked", """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'How many inspections ' WHEN 1 THEN 'Compare rates ' WHEN 2 THEN 'Should we approve ' WHEN 3 THEN 'CAPA findings ' WHEN 4 THEN 'patient dosage '
      WHEN 5 THEN 'summarise ' WHEN 6 THEN 'falsified records ' ELSE '' END || text AS text FROM documents"""), ("hits", _route_sql("asked", "text")), ROUTED]))
def _(spark, d):
    k = F.col("doc_id") % 8
    opening = (
        F.when(k == 0, "How many inspections ").when(k == 1, "Compare rates ").when(k == 2, "Should we approve ").when(k == 3, "CAPA findings ")
        .when(k == 4, "patient dosage ").when(k == 5, "summarise ").when(k == 6, "falsified records ").otherwise("")
    )
    asked = table(spark, d, "documents").withColumn("text", F.concat(opening, "text"))
    return R.route_text(asked).select("doc_id", "target", "secondary_target", "risk_level", "task", F.array_join("matched_rules", ",").alias("matched_rules"))


NAMES = (*R.NAMED_SECRETS, "token")


@query("PRJ-18", "redact_secrets", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:postgres(?:ql)?(?:\+psycopg)?://)[^\s]+', '[REDACTED DATABASE URL]', 'gi'),
  '\bsk-[A-Za-z0-9_-]{16,}', '[REDACTED]', 'g'), '(authorization|x-goog-api-key|x-api-key)([\s"'':=]+)(?:Bearer\s+)?[^\s"'',}]+', '\1\2[REDACTED]', 'gi'),
  '\b(password|access[_ -]?key|api[_ -]?key|authorization|bearer|token)([\s"'':=]+)(?:Bearer\s+)?[^\s"'',}]+', '\1\2[REDACTED]', 'gi')) AS redacted, contains(text, 'token = "') AS had_token FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(R.redact_secrets(F.col("text"), NAMES), 256).alias("redacted"), F.contains("text", F.lit('token = "')).alias("had_token")
    )


@query("PRJ-19", "redact_json_keys", """SELECT event_id, '{"user":"' || user_id || '","api_key":"[REDACTED]","n":' || event_id || ',"flag":true,"none":null,"note":"password=[REDACTED] ok","list":[{"cookie":"[REDACTED]"},5,["é"]],"a":{"b":{"c":{"d":{"Cookie":"[REDACTED]","k":"' || event_type || '"}}}}}' AS props FROM events""")
def _(spark, d):
    secret = F.concat(F.lit("c-"), F.col("event_id").cast("string"))
    body = F.concat(
        F.lit('{"user":"'), F.col("user_id").cast("string"), F.lit('","api_key":{"x":"'), secret, F.lit('"},"n":'), F.col("event_id").cast("string"),
        F.lit(', "flag":true,"none":null,"note":"password=hunter2 ok","list":[{"cookie":"'), secret, F.lit('"},5,["é"]],"a":{"b":{"c":{"d":{"Cookie":["'),
        secret, F.lit('"],"k":"'), F.col("event_type"), F.lit('"}}}}}'),
    )
    return table(spark, d, "events").select("event_id", R.redact_json_keys(body).alias("props"))


@query("JOI-10", "match_entity_mentions", with_views("", r"""SELECT text_id, name, 'full' AS match FROM kept
UNION ALL SELECT DISTINCT t.text_id, n.name, 'first_word' FROM texts t JOIN names n ON length(split_part(n.name, ' ', 1)) >= 4 AND regexp_matches(lower(t.text), '\b' || lower(split_part(n.name, ' ', 1)) || '\b')
WHERE t.text_id NOT IN (SELECT text_id FROM full_hits)""", [
    ("names", "SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part WHERE p_type = 'PROMO'"),
    ("texts", """SELECT o_orderkey AS text_id, CASE WHEN o_orderkey % 4 = 0 THEN 'only a large thing here, cold.' ELSE 'See (' || coalesce(t, '') || ') now.' END AS text
      FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT p_name || ' ' || lower(p_type), '; ' ORDER BY p_name || ' ' || lower(p_type)) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""),
    ("full_hits", r"SELECT t.text_id, n.name FROM texts t JOIN names n ON contains(lower(t.text), lower(n.name)) AND regexp_matches(lower(t.text), '\b' || lower(n.name) || '\b')"),
    ("kept", "SELECT * FROM full_hits a WHERE NOT EXISTS (SELECT 1 FROM full_hits b WHERE b.text_id = a.text_id AND length(b.name) > length(a.name) AND contains(lower(b.name), lower(a.name)))"),
]))
def _(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name")).unionByName(
        part.filter("p_type = 'PROMO'").select(F.concat_ws(" ", F.col("p_name"), F.lower("p_type")).alias("name"))
    )
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", F.col("p_name"), F.lower("p_type")))), "; ").alias("t")
    )
    k = F.col("o_orderkey")
    texts = table(spark, d, "orders").join(lines, F.col("l_orderkey") == k, "left").select(
        k.alias("text_id"),
        F.when(k % 4 == 0, "only a large thing here, cold.").otherwise(F.concat(F.lit("See ("), F.coalesce("t", F.lit("")), F.lit(") now."))).alias("text"),
    )
    return E.match_entity_mentions(texts, names)


# ---------------------------------------------------------------------------------- similarity

VECTORS = [
    CLEAN,
    ("uniq", "SELECT DISTINCT sha256(clean) AS hash, clean FROM docs"),
    ("tok", """SELECT hash, CASE t WHEN 'entries' THEN 'records' WHEN 'record' THEN 'records' WHEN 'laboratories' THEN 'laboratory' ELSE t END AS token FROM (
      SELECT hash, unnest(regexp_extract_all(lower(clean), '[a-z0-9]{3,}')) AS t FROM uniq)
      WHERE t NOT IN ('the','and','were','was','for','with','that','not','are','your','specifically','failure','maintain','documented')"""),
    ("counts", """SELECT hash, token, count(*) AS c FROM tok GROUP BY ALL UNION ALL SELECT hash, 'record_timing', 5 FROM uniq
      WHERE contains(lower(clean), 'contemporaneous') OR contains(lower(clean), 'retrospectiv') OR contains(lower(clean), 'backdat') OR contains(lower(clean), 'after testing')"""),
    ("vectors", "SELECT hash, token, c / sqrt(sum(c * c) OVER (PARTITION BY hash))::DOUBLE AS weight FROM counts"),
]


@query("TAG-11", "lexical_vector", with_views("", "SELECT hash, token, round(weight, 6) AS weight FROM vectors", VECTORS))
def _(spark, d):
    return S.lexical_vector(dedupe_texts(table(spark, d, "documents"))).select("hash", "token", F.round("weight", 6).alias("weight"))


def document_vectors(spark, d):
    docs = table(spark, d, "documents")
    texts = dedupe_texts(docs)
    # A text may occur in several languages; its theme is the first of them.
    themes = docs.select(F.sha2(squeeze("text"), 256).alias("hash"), "lang").groupBy("hash").agg(F.min("lang").alias("theme"))
    return S.lexical_vector(texts, packed=True), themes


THEME_NODES = [
    *VECTORS,
    ("themes", "SELECT sha256(clean) AS hash, min(lang) AS theme FROM docs JOIN documents USING (doc_id) GROUP BY 1"),
    ("packed", "SELECT hash, string_agg(token || ':' || CAST(weight AS VARCHAR), ',' ORDER BY token) AS v FROM vectors GROUP BY hash"),
    ("nodes", "SELECT theme, v, min(hash) AS hash FROM themes JOIN packed USING (hash) GROUP BY theme, v"),
]


@query("JOI-11", "text_similarity_join", with_views("", """SELECT t.hash, t.theme, coalesce(n.hash, t.hash) AS class_hash, coalesce(d.n_links, 0) AS n_links
FROM themes t LEFT JOIN packed p ON p.hash = t.hash LEFT JOIN nodes n ON n.theme IS NOT DISTINCT FROM t.theme AND n.v = p.v LEFT JOIN degrees d ON d.theme = n.theme AND d.hash = n.hash""", [
    *THEME_NODES,
    ("pairs", """SELECT n.theme, a.hash, b.hash AS other FROM nodes n JOIN nodes r ON r.theme = n.theme AND r.hash < n.hash JOIN vectors a ON a.hash = n.hash
      JOIN vectors b ON b.hash = r.hash AND b.token = a.token GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.78 - 1e-9"""),
    ("degrees", "SELECT theme, hash, count(*) AS n_links FROM (SELECT theme, hash FROM pairs UNION ALL SELECT theme, other FROM pairs) GROUP BY ALL"),
]))
def _(spark, d):
    """All texts of a theme against each other at 0.78: each text with its class of equal vectors and the number of similar classes."""
    nodes, copies = S.vector_nodes(*document_vectors(spark, d))
    return S.similarity_classes(nodes, copies)


@query("JOI-11", "text_similarity_links", with_views("", """SELECT a.hash AS hash, b.hash AS earlier_hash, n.theme, 'link' AS kind, round(sum(a.weight * b.weight), 6) AS similarity
FROM nodes n JOIN nodes r ON r.theme = n.theme AND r.hash < n.hash JOIN vectors a ON a.hash = n.hash JOIN vectors b ON b.hash = r.hash AND b.token = a.token
GROUP BY a.hash, b.hash, n.theme HAVING sum(a.weight * b.weight) >= 0.78 - 1e-9
UNION ALL SELECT t.hash, n.hash, n.theme, 'copy', 1.0 FROM themes t JOIN packed p ON p.hash = t.hash JOIN nodes n ON n.theme = t.theme AND n.v = p.v WHERE n.hash < t.hash""", THEME_NODES))
def _(spark, d):
    """All links of a theme between the first texts of equal vectors, and each later text with its first one."""
    nodes, copies = S.vector_nodes(*document_vectors(spark, d))
    names = materialize(nodes.select("node", "theme", "first_hash"), "names", "zstd")
    links = S.similarity_links(nodes).join(names.select(F.col("node").alias("left_node"), "theme", F.col("first_hash").alias("hash")), "left_node").join(
        names.select(F.col("node").alias("right_node"), F.col("first_hash").alias("earlier_hash")), "right_node"
    ).select("hash", "earlier_hash", "theme", F.lit("link").alias("kind"), F.round("similarity", 6).alias("similarity"))
    members = copies.join(names.drop("theme"), "node").filter("first_hash < hash").select(
        "hash", F.col("first_hash").alias("earlier_hash"), "theme", F.lit("copy").alias("kind"), F.lit(1.0).alias("similarity")
    )
    return links.unionByName(members)


def leader_sql(threshold: float, model: str, method: str, name: str) -> list[tuple[str, str]]:
    """The sequential rule over `texts` (hash, theme) and `sims` (hash, theme, earlier, similarity >= threshold)."""
    return [
        ("turn", "SELECT theme, hash, row_number() OVER (PARTITION BY theme ORDER BY hash) AS i FROM texts"),
        ("near", "SELECT t.theme, t.i, t.hash, list(s.earlier) FILTER (s.earlier IS NOT NULL) AS earlier FROM turn t LEFT JOIN sims s ON s.theme = t.theme AND s.hash = t.hash GROUP BY ALL"),
        ("walk", """SELECT theme, 0::BIGINT AS i, []::VARCHAR[] AS leaders FROM (SELECT DISTINCT theme FROM texts)
          UNION ALL SELECT w.theme, n.i, CASE WHEN list_has_any(w.leaders, coalesce(n.earlier, [])) THEN w.leaders ELSE list_append(w.leaders, n.hash) END
          FROM walk w JOIN near n ON n.theme = w.theme AND n.i = w.i + 1"""),
        ("heads", "SELECT theme, unnest(leaders) AS leader FROM (SELECT theme, arg_max(leaders, i) AS leaders FROM walk GROUP BY theme)"),
        ("choices", "SELECT s.hash, s.theme, s.earlier AS leader, s.similarity FROM sims s JOIN heads l ON l.theme = s.theme AND l.leader = s.earlier UNION ALL SELECT leader, theme, leader, 1.0 FROM heads"),
        ("named", f"SELECT *, 'GRP-' || left(sha256('{model}|3|{threshold}|' || theme || '|' || leader), 20) AS group_id FROM choices"),
        (name, f"""SELECT hash, theme, group_id, round(least(1.0, similarity), 6) AS similarity, leader = hash AS is_leader, '{method}' AS method FROM named
          QUALIFY row_number() OVER (PARTITION BY hash, theme ORDER BY (leader = hash) DESC, round(similarity, 12) DESC, group_id) = 1"""),
    ]


GROUPED = "SELECT hash, theme, group_id, similarity, is_leader, method FROM grouped"


def recursive(body: str, extra: list[tuple[str, str]], names: str = "") -> str:
    return with_views(names, body, extra).replace("WITH ", "WITH RECURSIVE ", 1)


def rounded(groups):
    return groups.withColumn("similarity", F.round("similarity", 6))


@query("TAG-12", "group_texts", recursive(GROUPED, [
    *VECTORS,
    ("texts", "SELECT sha256(clean) AS hash, min(lang) AS theme FROM docs JOIN documents USING (doc_id) GROUP BY 1"),
    ("sims", """SELECT x.hash, x.theme, y.hash AS earlier, sum(a.weight * b.weight) AS similarity FROM texts x JOIN texts y ON y.theme = x.theme AND y.hash < x.hash
      JOIN vectors a ON a.hash = x.hash JOIN vectors b ON b.hash = y.hash AND b.token = a.token GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.78 - 1e-9"""),
    *leader_sql(0.78, "local-lexical", "lexical_cosine", "grouped"),
]))
def _(spark, d):
    return rounded(S.group_texts(*document_vectors(spark, d)))


@query("TAG-12", "group_part_texts", recursive(GROUPED, [
    ("docs", r"SELECT DISTINCT sha256(c) AS doc_id, c AS clean FROM (SELECT trim(regexp_replace(long_text, '\s+', ' ', 'g')) AS c FROM project_rows)"),
    *sentence_tags("docs", "clean", PARTS),
    ("texts", "SELECT doc_id AS hash, theme FROM classified"),
    ("counts", "SELECT hash, t AS token, count(*) AS c FROM (SELECT doc_id AS hash, unnest(regexp_extract_all(lower(clean), '[a-z0-9]{3,}')) AS t FROM docs) GROUP BY ALL"),
    ("vectors", "SELECT hash, token, c / sqrt(sum(c * c) OVER (PARTITION BY hash))::DOUBLE AS weight FROM counts"),
    ("sims", """SELECT x.hash, x.theme, y.hash AS earlier, sum(a.weight * b.weight) AS similarity FROM texts x JOIN texts y ON y.theme = x.theme AND y.hash < x.hash
      JOIN vectors a ON a.hash = x.hash JOIN vectors b ON b.hash = y.hash AND b.token = a.token GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.6 - 1e-9"""),
    *leader_sql(0.6, "local-lexical", "lexical_cosine", "grouped"),
], "project_rows"))
def _(spark, d):
    rows = project_rows(spark, d).select(F.col("long_text").alias("text"))
    texts = dedupe_texts(rows)
    tagged = G.classify_observation(texts, PARTS).select("hash", "theme")
    return rounded(S.group_texts(S.lexical_vector(texts, {}, [], [], packed=True), tagged, 0.6))


def planes_sql(dimensions: int) -> str:
    """The hyperplanes of the seed as a literal table (tab, bit, plane)."""
    planes = S.hyperplanes(dimensions)
    rows = (f"({t}, {b}, [{', '.join(repr(float(x)) for x in plane)}]::DOUBLE[])" for t, table_ in enumerate(planes) for b, plane in enumerate(table_))
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(tab, bit, plane)"


@query("TAG-13", "lsh_signatures", with_views("", """SELECT vec_id, tab AS "table", sum(CASE WHEN list_inner_product(embedding::DOUBLE[], plane) >= 0 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS signature
FROM embeddings, planes GROUP BY ALL""", [("planes", planes_sql(64))]))
def _(spark, d):
    return S.lsh_signatures(table(spark, d, "embeddings"), 64)


@query("TAG-13", "group_dense", recursive(GROUPED, [
    ("texts", "SELECT sha256(vec_id::VARCHAR) AS hash, label::VARCHAR AS theme, embedding::DOUBLE[] AS v FROM embeddings"),
    ("sims", """SELECT x.hash, x.theme, y.hash AS earlier, list_cosine_similarity(x.v, y.v) AS similarity FROM texts x JOIN texts y ON y.theme = x.theme AND y.hash < x.hash
      WHERE list_cosine_similarity(x.v, y.v) >= 0.6 - 1e-9"""),
    *leader_sql(0.6, "dense", "hyperplane_cosine", "grouped"),
]))
def _(spark, d):
    dense = table(spark, d, "embeddings").select(
        F.sha2(F.col("vec_id").cast("string"), 256).alias("hash"), F.col("label").cast("string").alias("theme"), "embedding"
    )
    # at this recall no pair of the given vectors is lost, so that the rule can be checked by SQL
    return rounded(S.group_dense(dense, 64, 0.6, recall=0.999))


