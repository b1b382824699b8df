"""Dense candidates against all pairs, crowded buckets, and leaders among many texts that share a word."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrain.operators import grouping as S

from test_observations import sequential_groups

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("threshold", [0.6, 0.78])
def test_dense_recall_reaches_what_was_asked(spark, threshold):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = threshold + 1e-6
    vectors = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z])
    rows = [(f"{k:06d}", "t", f"{k:06d}", f"{k:06d}", v.tolist()) for k, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "node string, theme string, first_hash string, last_hash string, vec array<double>")
    found = {(r["left_node"], r["right_node"]) for r in S.dense_pairs(nodes, 48, threshold, 0.95)(nodes, nodes).collect()}
    want = {(f"{j:06d}", f"{i:06d}") for i, j in zip(*np.nonzero(np.triu(vectors @ vectors.T >= threshold, 1)))}
    assert found <= want and len(want) >= 1500 and len(found) / len(want) >= 0.95
    assert S.tables_for(threshold, 0.99) > S.tables_for(threshold, 0.95) > S.tables_for(0.95, 0.95)


def test_the_own_bucket_is_probed_and_the_cheapest_others(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=6).tolist() for _ in range(20)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    planes = S.hyperplanes(6, 3, 5)
    probed = {}
    for r in S.lsh_probes(df, 6, tables=3, bits=5, probes=7).collect():
        probed.setdefault((r["vec_id"], r["table"]), set()).add(r["signature"])
    own = {(r["vec_id"], r["table"]): r["signature"] for r in S.lsh_signatures(df, 6, tables=3, bits=5).collect()}
    for (k, t), signature in own.items():
        away = planes[t] @ np.array(vectors[k])
        assert signature == sum(1 << b for b in range(5) if away[b] >= 0)
        costs = sorted((sum(away[b] ** 2 for b in flip), signature ^ sum(1 << b for b in flip)) for flip in [(), *((a,) for a in range(5)), *((a, b) for a in range(5) for b in range(a))])
        assert probed[k, t] == {s for _, s in costs[:7]}


def test_a_crowded_bucket_meets_every_pair_once(spark):
    left = spark.range(70).selectExpr("'k' AS key", "concat('l', id) AS node", "'9' AS last_hash", "'5' AS first_hash").unionByName(
        spark.createDataFrame([("few", "l0", "9", "5")], "key string, node string, last_hash string, first_hash string"))
    right = spark.range(50).selectExpr("'k' AS key", "concat('r', id) AS node", "'1' AS first_hash", "'1' AS last_hash").unionByName(
        spark.createDataFrame([("few", "r0", "1", "1"), ("none", "r1", "1", "1")], "key string, node string, first_hash string, last_hash string"))
    for block in (1000, 8):
        met = S._shared(left, right, ["key"], block).groupBy("left_node", "right_node").count().collect()
        assert len(met) == 70 * 50 and {(r["left_node"], r["right_node"]): r["count"] for r in met if r["count"] != 1} == {("l0", "r0"): 2}
    a, b = S._in_grid(left, right, ["key"], 8)
    both = a.join(b.withColumnRenamed("node", "other"), ["key", "_row", "_column"])
    assert max(r["count"] for r in both.groupBy("key", "_row", "_column").count().collect()) < 70 * 50 / 10


def test_leaders_where_one_word_is_in_a_third_of_the_texts(spark):
    rng = random.Random(2)
    texts = {" ".join(rng.choices([f"word{i}" for i in range(30)], k=5)) + (" everywhere everywhere" if k % 3 == 0 else "") for k in range(150)}
    themes = {sha(t): "x" for t in texts}
    frame = spark.createDataFrame([(sha(t), t) for t in texts], "hash string, text string")
    got = S.group_texts(S.lexical_vector(frame), spark.createDataFrame(list(themes.items()), "hash string, theme string"), 0.7, 64).collect()
    leaders, similarity = sequential_groups(texts, themes, 0.7)
    assert {r["hash"] for r in got if r["is_leader"]} == leaders
    assert {r["hash"]: r["similarity"] for r in got} == pytest.approx({h: min(1.0, s) for h, s in similarity.items()})


def test_zero_vectors_lead_themselves(spark):
    df = spark.createDataFrame([("a", "t", [0.0, 0.0]), ("b", "t", [0.0, 0.0]), ("c", "t", [1.0, 2.0]), ("d", "t", [2.0, 4.0])], "hash string, theme string, embedding array<double>")
    got = {r["hash"]: (r["is_leader"], round(r["similarity"], 6)) for r in S.group_dense(df, 2, 0.9).collect()}
    assert got["c"] == (True, 1.0) and got["d"] == (False, 1.0) and got["a"][0]
    assert df.select(S.unit_vector().alias("v")).filter(F.exists("v", lambda x: x.isNull() | F.isnan(x))).count() == 0


def test_tokens_of_a_text_are_counted_within_its_row(spark):
    texts = {"a": "Record records the laboratories, backdated RECORD", "b": "no", "c": " ".join(f"w{k % 700:03d}" for k in range(5000)), "d": None}
    frame = spark.createDataFrame(list(texts.items()), "hash string, text string")
    vectors = S.lexical_vector(frame)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    got = {(r["hash"], r["token"]): r["weight"] for r in vectors.collect()}
    a = {"records": 3, "laboratory": 1, "backdated": 1, S.BOOST_TOKEN: S.BOOST_COUNT}
    c = {f"w{k:03d}": 8 if k < 100 else 7 for k in range(700)}
    want = {(h, t): n / np.sqrt(sum(x * x for x in counts.values())) for h, counts in (("a", a), ("c", c)) for t, n in counts.items()}
    assert got == pytest.approx(want)


def test_postings_and_pairs_carry_numbers_that_keep_the_order_of_hashes(spark):
    texts = ["old red gear broke", "old red gear broke again", "new bolt came loose", "New bolt, came loose", *[f"case {k} item{k}" for k in range(20)]]
    frame = spark.createDataFrame([(sha(t), t) for t in texts], "hash string, text string")
    themes = frame.select("hash", F.when(F.col("text").startswith("case"), "a").otherwise("b").alias("theme"))
    nodes, _ = S.vector_nodes(S.lexical_vector(frame), themes)
    numbered, digests = S._numbered(nodes)
    rows = numbered.collect()
    assert len({r["node"] for r in rows}) == digests.count() == len(rows) == len(texts) - 1
    ends = sorted([(r["first_hash"], r["first"]) for r in rows] + [(r["last_hash"], r["last"]) for r in rows])
    assert [p for _, p in ends] == sorted(p for _, p in ends) and len({p for _, p in ends}) == len({h for h, _ in ends}) == len(texts)
    postings = S.prefix_postings(S._ends(numbered), 0.7)
    assert {postings.schema[c].dataType.simpleString() for c in ("node", "first_hash", "last_hash")} == {"bigint"}


def test_what_a_step_shuffles_is_deleted_once_it_is_written(spark):
    from auditgrain.session import CLEANUP, cut_lineage, materialize

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    shuffled = lambda: {x.rsplit("/", 1)[-1] for x in files().split(" ") if "/shuffle_" in x}
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.max("id").alias("m"))
    for write in (materialize, cut_lineage):
        before, written = shuffled(), write(df)
        deadline = time.time() + 10  # files go in the background
        while shuffled() - before and time.time() < deadline:
            time.sleep(0.2)
        assert not shuffled() - before and spark.conf.get(CLEANUP, None) is None
        assert written.count() == 700
    spark.conf.set(CLEANUP, "false")  # what the session says holds
    try:
        before = shuffled()
        materialize(df)
        assert shuffled() - before and spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)


def test_packed_vectors_are_those_of_the_rows_and_make_the_same_classes(spark):
    texts = {"a": "Record records the laboratories, backdated RECORD", "b": "no", "c": "red red gear gear", "d": "gear red", "e": None, "f": "cold gear"}
    frame = spark.createDataFrame(list(texts.items()), "hash string, text string")
    rows, packed = S.lexical_vector(frame), S.lexical_vector(frame, packed=True)
    weights = {h: sorted(r["weight"] for r in rows.filter(F.col("hash") == h).collect()) for h in texts}
    got = {r["hash"]: r for r in packed.collect()}
    assert {h: sorted(r["vec"]["weights"]) for h, r in got.items()} == {h: pytest.approx(w) for h, w in weights.items()}
    assert got["b"]["key"] is None and got["e"]["key"] is None and len({got[h]["key"] for h in "acf"}) == 3
    themes = frame.select("hash", F.lit("t").alias("theme"))
    sort = lambda df: sorted(map(tuple, df.collect()))
    assert sort(S.similarity_classes(*S.vector_nodes(packed, themes), 0.4)) == sort(S.similarity_classes(*S.vector_nodes(rows, themes), 0.4))


def test_links_leave_their_task_without_postings(spark):
    texts = {f"{k:03d}": " ".join(["shared", "words", "everywhere", f"only{k % 50}"]) for k in range(200)}
    frame = spark.createDataFrame(list(texts.items()), "hash string, text string")
    nodes, _ = S.vector_nodes(S.lexical_vector(frame, packed=True), frame.select("hash", F.lit("t").alias("theme")))
    for block in (8192, 7):
        links = S.similarity_links(nodes, 0.7, block)
        assert "Generate explode(vec" not in links._jdf.queryExecution().executedPlan().toString()
        assert links.count() == 50 * 49 // 2 and {round(r[0], 6) for r in links.select("similarity").distinct().collect()} == {0.75}


def test_dense_pairs_are_multiplied_where_buckets_would_meet_most_of_them(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(f"{k:02d}", "t", f"{k:02d}", f"{k:02d}", v.tolist()) for k, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "node string, theme string, first_hash string, last_hash string, vec array<double>")
    for left, right in ((nodes, nodes), (nodes.filter("node >= '30'"), nodes.filter("node < '40'"))):
        pairs = S.dense_pairs(nodes, 4, 0.6, 0.999)(left, right)
        assert "FlatMapGroupsInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
        sides = [{r["node"] for r in side.collect()} for side in (left, right)]
        want = {(i, j) for i in sides[0] for j in sides[1] if j < i and vectors[int(i)] @ vectors[int(j)] >= 0.6}
        got = [(r["left_node"], r["right_node"]) for r in pairs.filter("precedes").collect()]
        assert want and set(got) == want and len(got) == len(want)
