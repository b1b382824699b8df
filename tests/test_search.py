"""Full-text and keyword search against plain versions of themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditgrain.operators import retrieval as R
from auditgrain.operators.fulltext import ENGLISH_STOP, fulltext_search, light_stem, parse_queries, positional_index


def covers_by_hand(words, query):
    """Score by trying all stretches; `query` is a list of alternatives of (negated, phrase) with None for a gap."""
    n = len(words)
    at = lambda phrase, i: i + len(phrase) <= n and all(p is None or words[i + k] == p for k, p in enumerate(phrase))
    live = [a for a in query if not any(neg and any(at(p, i) for i in range(n)) for neg, p in a)]
    live = [[p for neg, p in a if not neg] for a in live]
    live = [a for a in live if all(any(at(p, i) for i in range(n)) for p in a)]
    if not live:
        return None
    holds = lambda a, l, e: all(any(at(p, i) and i + len(p) - 1 <= e for i in range(l, e + 1)) for p in a)
    found = [(l, e) for l in range(n) for e in range(l, n) if any(a and holds(a, l, e) for a in live)]
    minimal = [(l, e) for l, e in found if not any((x, y) != (l, e) and l <= x and y <= e for x, y in found)]
    asked = lambda a: sum(w is not None for p in a for w in p)
    return sum(10**11 // (1 + max(0, e - l + 1 - max(asked(a) for a in live if a and holds(a, l, e)))) for l, e in minimal) / 1e12


QUERIES = {
    "a b": [[(False, ["a"]), (False, ["b"])]], '"a b" c': [[(False, ["a", "b"]), (False, ["c"])]], "a or b c": [[(False, ["a"])], [(False, ["b"]), (False, ["c"])]],
    'a -"b c"': [[(False, ["a"]), (True, ["b", "c"])]], "-d": [[(True, ["d"])]], 'c b-a OR "d d"': [[(False, ["c"]), (False, ["b", "a"])], [(False, ["d", "d"])]],
    "a a b": [[(False, ["a"]), (False, ["a"]), (False, ["b"])]], '"a b a" or a -c or -a': [[(False, ["a", "b", "a"])], [(False, ["a"]), (True, ["c"])], [(True, ["a"])]],
    "zzz": [[(False, ["zzz"])]], "d or zzz a": [[(False, ["d"])], [(False, ["zzz"]), (False, ["a"])]],
}


def test_web_search_equals_trying_all_stretches(spark):
    rng = random.Random(6)
    chunks = {k: [rng.choice("abcde") for _ in range(rng.randrange(0, 22))] for k in range(60)}
    frame = spark.createDataFrame([(k, " ".join(w).replace("e", "E, -")) for k, w in chunks.items()], "chunk_id long, text string")
    words = {k: re.findall(r"[a-z]+", " ".join(w)) for k, w in chunks.items()}
    asked = spark.createDataFrame([(n, q) for n, q in enumerate(QUERIES)], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in fulltext_search(asked, frame, 1000).collect()}
    want = {(n, k): covers_by_hand(w, q) for n, q in enumerate(QUERIES.values()) for k, w in words.items()}
    assert got == {key: pytest.approx(s, abs=1e-15) for key, s in want.items() if s is not None} and len(got) > 150
    best = fulltext_search(asked, frame, 3).collect()
    for n in range(len(QUERIES)):
        ranked = sorted((-s, k) for (q, k), s in want.items() if q == n and s is not None)[:3]
        assert [(r["chunk_id"], r["rank"]) for r in sorted(best, key=lambda r: r["rank"]) if r["query_id"] == n] == [(k, i + 1) for i, (_, k) in enumerate(ranked)]


def test_stop_words_keep_their_places_and_stems_meet(spark):
    chunks = spark.createDataFrame([(1, "Heads of the states"), (2, "head state"), (3, "the head, making a state"), (4, "passes glass cities used bus"), (5, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, '"head of a state"'), (2, "make the"), (3, "pass city uses buses"), (4, "of the"), (5, None), (6, 'glass -"used bus" or heads')], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]) for r in fulltext_search(asked, chunks, 10, ENGLISH_STOP, light_stem).collect()}
    # buses keeps its ending: the stemmer goes by the ends of words alone
    assert got == {(1, 1), (1, 3), (2, 3), (6, 1), (6, 2), (6, 3)}
    stems = spark.createDataFrame([(w,) for w in "cities passes cats bus glass making make used red sing ties".split()], "w string").select(light_stem(F.col("w"))).collect()
    assert [r[0] for r in stems] == ["city", "pass", "cat", "bus", "glass", "mak", "mak", "used", "red", "sing", "tie"]


def test_parsed_queries_and_index(spark):
    asked = spark.createDataFrame([(1, 'x "y z" -w or or -v'), (2, '"open quote'), (3, "or"), (4, "- !")], "query_id long, text string")
    rows = {(r["query_id"], r["alternative"], r["term"]): r for r in parse_queries(asked).collect()}
    assert sorted(k for k in rows if k[0] == 1) == [(1, 0, "w"), (1, 0, "x"), (1, 0, "y"), (1, 0, "z"), (1, 2, ""), (1, 2, "v")]
    assert rows[1, 0, "z"]["slot"] == 1 and rows[1, 0, "z"]["need"] == 2 and rows[1, 0, "x"]["clauses"] == 2 and rows[1, 0, "x"]["asked"] == 3 and rows[1, 0, "w"]["negated"]
    assert {k[2] for k in rows if k[0] == 2} == {"open", "quote"} and not [k for k in rows if k[0] in (3, 4)]
    chunks = spark.createDataFrame([(1, "b a b"), (2, "")], "chunk_id long, text string")
    index = {(r["chunk_id"], r["term"]): r["positions"] for r in positional_index(chunks).collect()}
    assert index == {(1, "b"): [0, 2], (1, "a"): [1], (1, ""): [-1], (2, ""): [-1]}


def test_keyword_search_equals_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(40)]
    heavy = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 10, 40])]) for _ in range(n))
    docs = [(k, heavy(rng.randrange(0, 14))) for k in range(200)] + [(900, None)]
    asked = [(k, heavy(rng.randrange(0, 12))) for k in range(40)] + [(90, None), (91, "the and for"), (92, "nowhere")]
    q, c = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "chunk_id long, text string")
    for k in (1, 3, 10):
        for first in (1, 60):
            found = R.keyword_candidates(q, c, k, first=first)
            best = R.top_k(found, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
            got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in best.collect())
            want = []
            for n, text in asked:
                scores = sorted((-len(set((text or "").split()) & set((t or "").split())), i) for i, t in docs)
                kept = [(-s, i) for s, i in scores if s][:k] if text != "the and for" else []
                want += [(n, r + 1, i, s) for r, (s, i) in enumerate(kept)]
            assert got == sorted(want)


def test_a_word_of_every_document_makes_no_pairs(spark):
    docs = spark.range(3000).selectExpr("id AS chunk_id", "concat('everywhere common', ' rare', id % 300, ' other', id % 250) AS text")
    asked = spark.range(50).selectExpr("id AS query_id", "concat('everywhere common rare', id, ' other', id) AS text")
    found = R.keyword_candidates(asked, docs, 3)
    assert found.count() < 50 * 25  # against 150,000 pairs that share a word
    best = R.keyword_search(asked, docs, 3).filter("query_id = 7").orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in best] == [(7, 4), (1507, 4), (257, 3)]


def test_requests_are_refused(spark):
    R.check_request(5, {"half": "low"}, ["half"])
    for limit, filters, allowed in ((0, None, None), (101, None, None), (5, {"x": "1"}, ["half"])):
        with pytest.raises(ValueError):
            R.check_request(limit, filters, allowed)
