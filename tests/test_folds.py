"""JSON masking, review chains, ranks over ranges and the one-pass audit against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from auditgrain.operators import reviews as V
from auditgrain.operators import rollup as U
from auditgrain.operators.normalize import recency_rank
from auditgrain.operators.ranking import range_rank
from auditgrain.operators.routing import NAMED_SECRETS, REDACTED, SENSITIVE_KEYS, redact_json_keys, redact_secrets

HIDDEN = re.compile(SENSITIVE_KEYS)


def written(rng, depth=0):
    """A random JSON text with odd spacing, escapes, numbers and keys."""
    gap = lambda: rng.choice(["", "", " ", "\n\t"])
    text = lambda: json.dumps("".join(rng.choice(['a', '"', "\\", "é", "\n", "/", " ", ":", "{", "]", ",", " "]) for _ in range(rng.randrange(6))), ensure_ascii=rng.random() < 0.5)
    key = lambda: rng.choice([text(), '"k"', '"cookie"', '"PASSWORD2"', '"api\\u005fkey"', '"k"'])
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return text()
    if kind < 4:
        return rng.choice(["0", "-1", "1.50", "12345678901234567890123", "1e400", "true", "null", '"\\ud800"', '"password=S1 x"', '"say \\"Bearer S2\\" \\n"'])
    items = [gap() + (key() + gap() + ":" + gap() if kind > 4 else "") + written(rng, depth + 1) + gap() for _ in range(rng.randrange(4))]
    body = ",".join(items) or gap()
    return "{" + body + "}" if kind > 4 else "[" + body + "]"


def masked(value, clean):
    if isinstance(value, tuple):
        kind, held = value
        return (kind, [(k, REDACTED if HIDDEN.search(k) else masked(v, clean)) for k, v in held]) if kind == "object" else value
    if isinstance(value, list):
        return [masked(v, clean) for v in value]
    return clean[value] if isinstance(value, str) else value


def read(text):
    """Objects and numbers as marked pairs, keys in order and repeated, numbers as they are written."""
    keep = lambda x: ("number", x)
    return json.loads(text, object_pairs_hook=lambda p: ("object", p), parse_int=keep, parse_float=keep, parse_constant=lambda x: 1 / 0)


def strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, tuple):
        for _, v in value[1] if value[0] == "object" else []:
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def test_json_masking_equals_walking_the_parsed_text(spark):
    rng = random.Random(3)
    texts = [written(rng) for _ in range(500)]
    for t in texts[:200]:  # broken ones
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + rng.choice(["", ",", "}", "]", '"', ":", "\x01", "x", "\\"]) + t[at + rng.randrange(2) :])
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(8)
    got = {r["k"]: (r["o"], r["c"]) for r in frame.select("k", redact_json_keys(F.col("t")).alias("o"), redact_secrets(F.col("t")).alias("c")).collect()}
    parsed = {}
    for k, t in enumerate(texts):
        try:
            parsed[k] = read(t)
        except (ValueError, ZeroDivisionError):
            assert got[k][0] == got[k][1], t
    said = sorted({s for v in parsed.values() for s in strings(v) if "\ud800" not in s})
    cleaned = spark.createDataFrame([(s,) for s in said], "s string").select("s", redact_secrets(F.col("s"), NAMED_SECRETS).alias("c")).collect()
    clean = {r["s"]: r["c"] for r in cleaned} | {"\ud800": "\ud800"}
    assert len(parsed) > 500 and sum("REDACTED" in got[k][0] for k in parsed) > 100
    for k, value in parsed.items():
        assert read(got[k][0]) == masked(value, clean), texts[k]


def test_json_masking_leaves_what_it_does_not_hide(spark):
    deep = "[" * 200_000 + '{"password":[{"x":1}],"n":1}' + "]" * 200_000
    exact = '{"a":"\\ud800","n":0.12345678901234567891,"e":1e400,"k":1,"k":2,"u":"\\u00e9\\/","cookie":{"a":[1]}}'
    rows = spark.createDataFrame([(0, deep), (1, exact), (2, "{\"a\":1,}"), (3, None), (4, "[1 2] password=x")], "k int, t string")
    got = {r["k"]: r["o"] for r in rows.select("k", redact_json_keys(F.col("t")).alias("o")).collect()}
    assert got[0] == deep.replace('[{"x":1}]', '"[REDACTED]"') and got[1] == exact.replace('{"a":[1]}', '"[REDACTED]"')
    assert got[2] == '{"a":1,}' and got[3] is None and got[4] == "[1 2] password=[REDACTED]"
    assert "Python" not in rows.select(redact_json_keys(F.col("t")))._jdf.queryExecution().toString()


def judged_by_hand(incoming, current, known):
    now, out = dict(current), {}
    for run, observation, arrival, revision, action, theme, severity in sorted(incoming, key=lambda r: (r[2], r[3])):
        key = (run, observation)
        if key not in known:
            status = "unknown"
        elif action == "Modify" and (theme is None or severity is None):
            status = "invalid"
        else:
            status = "accepted" if revision == now.get(key, 0) else "conflict"
        if status == "accepted":
            now[key] = revision + 1
        out[run, observation, arrival] = (status, revision + 1 if status == "accepted" else None)
    return out


def test_a_long_chain_of_reviews_is_one_pass(spark):
    rng = random.Random(5)
    chain = [("r", "hot", n, n // 2, "Approve", None, None) for n in range(1000)]  # 500 follow-ups, each tried twice
    others = [("r", f"o{rng.randrange(12)}", 2000 + n, rng.randrange(4), rng.choice(["Approve", "Reject", "Modify"]), None, None) for n in range(300)]
    incoming = chain + others + [("s", "nowhere", 5000, 0, "Approve", None, None)]
    current = [("r", "o3", 2), ("r", "o3", 1), ("r", "o4", 1)]
    known = {("r", "hot"), *(("r", f"o{k}") for k in range(11))}
    frame = spark.createDataFrame(incoming, "run_id string, observation_id string, arrival long, revision int, action string, theme string, severity string")
    out = V.apply_reviews(
        frame.repartition(7), spark.createDataFrame(current, "run_id string, observation_id string, revision int"),
        spark.createDataFrame(sorted(known), "run_id string, observation_id string"),
    )
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert out.schema["new_revision"].dataType.simpleString() == "int" and set(before) == set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {(r["run_id"], r["observation_id"], r["arrival"]): (r["status"], r["new_revision"]) for r in out.collect()}
    assert got == judged_by_hand(incoming, {("r", "o3"): 2, ("r", "o4"): 1}, known)
    assert sum(s == "accepted" for (_, o, _), (s, _) in got.items() if o == "hot") == 500


def test_ranks_of_a_site_without_dates_that_owns_a_third(spark):
    rng = random.Random(8)
    rows = [("hot", None, f"{k:05d}") for k in range(3000)] + [(rng.choice(["a", "b", None]), rng.choice([None, "2020-01-01", "2021-05-05"]), f"{k:05d}") for k in range(3000, 9000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "site_key string, day string, inspection_id string").withColumn("inspection_date", F.to_date("day")).repartition(6)
    want, last = {}, {}
    for site, day, key in sorted(rows, key=lambda r: (r[0] or "", r[1] is None, "".join(chr(255 - ord(c)) for c in r[1] or ""), r[2])):
        last[site] = want[site, key] = last.get(site, 0) + 1
    assert {(r["site_key"], r["inspection_id"]): r["inspection_rank"] for r in recency_rank(df).collect()} == want
    order = [F.col("inspection_date").desc_nulls_last(), F.col("inspection_id")]
    got = range_rank(df, ["site_key"], order, "n", ranges=12)
    assert {(r["site_key"], r["inspection_id"]): r["n"] for r in got.collect()} == want
    dealt = df.repartitionByRange(12, "site_key", *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 2.5 * 9000 / 12


def test_the_audit_reads_each_source_once(spark, tmp_path):
    rows = [("1", "f1", "2020-01-01", "NAI", "Yes", "P"), ("1", "f2", "2020-01-01", "OAI", "Yes", "Q"), ("2", "f1", "2021-01-01", "NAI", "No", "P"), ("2", "f1", "2021-01-01", "NAI", "No", "P"), ("3", None, None, None, "No", None)]
    spark.createDataFrame(rows, "id string, fei string, date string, classification string, posted string, project string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("1", "x", 1), ("1", "x", 2), ("2", "y", 3)], "id string, short string, source_row int").write.parquet(f"{tmp_path}/c")
    annual = spark.createDataFrame([(2020, 5), (2020, 6)], "year int, frequency long")
    got = {(r["section"], r["label"], r["measure"]): r["value"] for r in U.source_audit(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/c"), annual).collect()}
    assert got["inspections", "", "rows"] == "5" and got["inspections", "", "inspections"] == "3" and got["inspections", "", "sites"] == "2"
    assert got["inspections", "", "conflicting_ids"] == "1" and got["inspections", "", "multi_class_ids"] == "1" and got["inspections", "", "max_date"] == "2021-01-01"
    assert got["classification", "NAI", "n"] == "3" and got["posted", "No", "n"] == "3" and got["duplicate_citations", "", "extras"] == "1" and got["citations", "", "rows"] == "3"
    assert got["duplicate_examples", "1", "classifications"] == "NAI,OAI" and got["duplicate_examples", "2", "projects"] == "P" and ("duplicate_examples", "3", "n") not in got
    assert got["annual", "2020", "frequency_sum"] == "11" and got["classification", None, "n"] == "1"
    out = U.source_audit(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/c"), annual)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp_path}/p" not in out._jdf.queryExecution().executedPlan().toString() and plan.count("source_row") <= 1


def test_documents_beyond_the_capacity_are_refused_in_order(spark):
    from auditgrain.operators import retrieval as R

    rng = random.Random(4)
    chunk = lambda space, document, n: [(space, document, f"{document}-{k}", "d", "t", {"a": "b"}) for k in range(n)]
    schema = "space string, document_id string, chunk_id string, domain string, source_type string, metadata map<string,string>"
    old = [r for k in range(10) for r in chunk("hot", f"d{k:03d}", 3)]
    new = {(rng.choice(["hot", "hot", "hot", "cold"]), f"d{k:03d}"): rng.randrange(1, 9) for k in range(0, 60, 2)}
    existing, incoming = spark.createDataFrame(old, schema), spark.createDataFrame([r for (s, d), n in new.items() for r in chunk(s, d, n)], schema)
    held, total, want = {f"d{k:03d}": 3 for k in range(10)}, {"hot": 30, "cold": 0}, {}
    for (space, document), n in sorted(new.items()):
        replaced = held.get(document, 0) if space == "hot" else 0
        fits = total[space] - replaced + n <= 60
        total[space] += n - replaced if fits else 0
        want[space, document] = (n, replaced, total[space], "admitted" if fits else "refused")
    chunks, documents = R.upsert_within_capacity(existing, incoming.repartition(5), 60)
    assert {(r["space"], r["document_id"]): tuple(r)[2:] for r in documents.collect()} == want and {v[3] for v in want.values()} == {"admitted", "refused"}
    assert {r["space"]: r["count"] for r in chunks.groupBy("space").count().collect()} == {s: n for s, n in total.items() if n}


def test_a_stored_page_is_the_page(spark):
    from auditgrain.operators import browse as B

    rng = random.Random(1)
    rows = [(f"o{k:04d}", rng.choice([None, "a", "b", "c"]), rng.choice([1, 2, 3, None]), rng.choice([1999, 2000, None])) for k in range(500)]
    index = spark.createDataFrame(rows, "observation_id string, company string, severity_rank int, year int")
    orders = [("severity", "desc"), ("facility", "asc"), ("date", "desc")]
    stored = B.store_index(index, orders, ranges=6)
    for sort, direction in orders:
        for limit, offset in ((25, 0), (10, 245), (60, 470), (5, 500), (1000, 0), (30, 70)):
            want = [tuple(r) for r in B.browse(index, sort, direction, limit, offset).collect()]
            assert [tuple(r) for r in B.stored_page(stored, sort, direction, limit, offset).collect()] == want
    held, sizes = stored.pages["severity", "desc"]
    assert sum(n for _, n in sizes) == 500 and len(sizes) > 1 and stored.total == 500
    with pytest.raises(ValueError):
        B.stored_page(stored, "theme", "asc")


def test_contexts_of_every_occurrence(spark):
    from auditgrain.operators.tagging import _quote_contexts

    cases = [("One. Two x. Three x x? x", "x"), ("a.b a.b. c a.b", "a.b"), ("none", "x"), ("xx" * 5, "xx"), ("Start $1 \\E (x) end. (x)", "(x)"), ("no stop x and x and x", "x")]
    df = spark.createDataFrame(cases, "t string, q string").coalesce(1)
    got = [r[0] for r in df.select(_quote_contexts(F.col("t"), F.col("q"))).collect()]
    for (t, q), found in zip(cases, got):
        want, at = [], t.find(q)
        while at >= 0:
            want.append(re.search(r"[^.!?]*$", t[:at]).group() + q)
            at = t.find(q, at + len(q))
        assert found == want


def test_mentions_equal_trying_every_name(spark):
    from auditgrain.operators.mentions import NAME_STOPWORDS, match_entity_mentions

    rng = random.Random(12)
    words = ["the", "acme", "labs", "north", "food", "gear", "geared", "co", "x1", "river", "company"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))).title() for _ in range(120)} | {"North, River", "Acme-Labs", "R&D Acme"})
    texts = [(k, " ".join(rng.choices([*words, "Acme-Labs", "north, river", "(gear)"], k=rng.randrange(0, 14)))) for k in range(150)] + [(900, None), (901, "R&D acme!")]
    units = lambda t: re.findall(r"\w+|[^\w\s]+", t.lower())
    want = set()
    for k, t in texts:
        said = f" {' '.join(units(t or ''))} "
        full = [n for n in names if n.lower() not in NAME_STOPWORDS and len(n) > 3 and f" {' '.join(units(n))} " in said]
        kept = [n for n in full if not any(len(o) > len(n) and n.lower() in o.lower() for o in full)]
        first = [n for n in names if len(w := n.lower().split()[0]) >= 4 and w not in NAME_STOPWORDS and w in units(t or "")]
        want |= {(k, n, "full") for n in kept} if full else {(k, n, "first_word") for n in first}
    frames = spark.createDataFrame(texts, "text_id int, text string").repartition(4), spark.createDataFrame([(n,) for n in names] * 2, "name string")
    got = [tuple(r) for r in match_entity_mentions(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {m for _, _, m in want} == {"full", "first_word"}


def test_json_masking_takes_few_steps(spark):
    texts = ['{"cookie" :\n"x","a:" : [":",{"b":"cookie:"}]}', '{"a":"cookie":1}', '{"cookie"::1}', '["cookie":1]', '"cookie":', '{"cookie":{"a":[1]} }', '{"a\n" :1,"cookie":2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["o"] for r in rows.select("k", redact_json_keys(F.col("t")).alias("o")).collect()}
    assert got[0] == '{"cookie":"[REDACTED]","a:":[":",{"b":"cookie:"}]}' and got[5] == '{"cookie":"[REDACTED]"}'
    assert [got[k] for k in (1, 2, 3, 4, 6)] == [texts[k] for k in (1, 2, 3, 4, 6)]
    # what a token does is decided once, not again for every part of the state
    assert len(rows.select(redact_json_keys(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_a_stored_order_by_company_is_the_copy_by_company(spark):
    from auditgrain import session
    from auditgrain.operators import browse as B

    index = spark.createDataFrame([(f"o{k:03d}", "abc"[k % 3], k % 4, 2000) for k in range(60)], "observation_id string, company string, severity_rank int, year int")
    with session.steps_dropped(spark, 2):
        stored = B.store_index(session.materialize(index, "index"), [("severity", "desc"), ("facility", "asc")])
        made = list(session._made.get())
    assert [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in made] == ["index", "index-severity-desc", "index-facility-asc"]
    assert sorted(map(tuple, stored.rows.collect())) == sorted(map(tuple, index.collect()))  # the copies are there, the first table is not
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert [r["observation_id"] for r in B.stored_page(stored, "facility", "asc", 5).collect()] == [f"o{k:03d}" for k in range(0, 15, 3)]
