"""Language ID, fingerprints, near-dedup, substring dedup, decontamination: brute force and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrain.llm import decontam, language, minhash, passages, simhash
from auditgrain.llm.common import TO_LOWER, WordHashes, words
from auditgrain.llm.queries import PLANS, table

from .helpers import DOCS, WORD, frame, odd_documents, prose

ROWS = odd_documents()


def test_words_split_on_the_six_blanks_only():
    for text in (r[1] or "" for r in ROWS):
        assert words(text) == WORD.findall(text)


def test_language_held_out_accuracy_and_rejection(spark, small):
    got = PLANS["op1_language_id"](spark, small).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    assert (held["lang"] == held.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(1, "der die das und ist nicht", "de", "s", 1), (2, "the and of that was for", "en", "s", 1), (3, None, "en", "s", 0), (4, "123 !!", None, "s", 6), (5, "", "de", "s", 0), (None, "the and of", None, "s", 1), (2, "the and of that was for", "en", "s", 1)]
    docs = frame(spark, rows)
    model = language.train(docs, F.lit(True))
    got = language.predict(docs, model).collect()
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == len(rows) and {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (None, "en")} <= by
    none = language.train(docs.limit(0), F.lit(True))
    assert none.languages == [] and {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_language_pieces_of_long_texts_lose_no_ngram():
    text = prose(__import__("random").Random(1), 40_000)
    points = language._points(text)
    whole = sum(len(b) for b in language._buckets(points))
    parts = sum(len(b) for s in language._spans(points) for b in language._buckets(s))
    assert whole <= parts <= whole + 3 * (len(points) // language._PIECE + 1) * max(language.ORDERS)


def test_minhash_edits_the_next_row(spark):
    docs = frame(spark, ROWS)
    got = {r["doc_id"]: r for r in minhash.edited_pairs(docs).collect()}
    order = sorted(ROWS, key=lambda r: -r[0])
    assert len(got) == len(ROWS)
    for k, row in enumerate(order):
        own, after = row[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        r = got[row[0]]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
        assert abs(r["near_edited"] - r["jaccard_edited"]) < 0.25 and 0 <= r["near_next"] <= 1
    prints = {}
    for row in ROWS:
        assert prints.setdefault(row[1] or "", got[row[0]]["fingerprint"]) == got[row[0]]["fingerprint"]
    assert minhash.edited_pairs(docs.limit(0)).count() == 0
    assert minhash.edited_pairs(docs.limit(1)).count() == 1


def test_minhash_edited_words_are_hashed_once():
    rng = random.Random(11)
    texts = [r[1] or "" for r in ROWS] + ["".join(rng.choices("aB \t\n\x0b\x0c\r\x1c\xa0é𝒳", k=rng.randrange(40))) for _ in range(3000)]
    memory = WordHashes()
    for text, after in zip(texts, texts[1:]):
        cut = len(text) // 3
        kept, tail = len(text) - cut, after[:cut]
        edited = text[:kept] + tail
        got = minhash.edited_hashes(text, memory.of(WORD.findall(text.translate(TO_LOWER))), kept, tail, memory)
        assert (got == memory.of(WORD.findall(edited.translate(TO_LOWER)))).all()


def test_minhash_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "a b c", "x", "s", 1), (1, "a b c", "x", "s", 1), (None, "d", "x", "s", 1), (2, None, "x", "s", 1)]
    assert sorted(r["n_chars"] for r in minhash.edited_pairs(frame(spark, rows)).collect()) == [0, 1, 5, 5]


def test_minhash_links_are_verified(spark):
    got = {(r["a"], r["b"]) for r in minhash.near_duplicates(frame(spark, ROWS)).collect()}
    memory = WordHashes()
    sets = {r[0]: minhash.shingles(r[1] or "", memory) for r in ROWS}
    first = {}
    for r in sorted(ROWS):
        first.setdefault(r[1] or "", r[0])
    want = {(a, b) for a in first.values() for b in first.values() if a < b and minhash.jaccard(sets[a], sets[b]) >= 0.9}
    assert want <= got and all(minhash.jaccard(sets[a], sets[b]) >= minhash.SIMILAR for a, b in got)


@pytest.mark.parametrize("block", [256, 3])
def test_minhash_links_span_the_classes_of_all_similar_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = [(900, "", "x", "s", 0), (901, " ", "x", "s", 1)]
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(200)]
        for k in range(14):  # twins: 0.95 to each other, less than or about 0.8 to the others
            if k % 2 == 0:
                at, n = int(rng.integers(0, 150)), int(rng.integers(8, 26))
            own = list(base)
            own[at : at + n] = [f"g{group}c{k // 2}x{j}" for j in range(n)]
            own[190 + k % 2] = "twin"
            rows.append((group * 20 + k, " ".join(own), "x", "s", 1))
    docs, memory = frame(spark, rows), WordHashes()
    sets = {r[0]: minhash.shingles(r[1], memory) for r in rows}
    links = minhash.near_duplicates(docs).collect()
    assert all(minhash.jaccard(sets[r["a"]], sets[r["b"]]) == pytest.approx(r["jaccard"]) and r["jaccard"] >= 0.8 for r in links)
    want = components_of(sets, lambda a, b: minhash.jaccard(a, b) >= 0.8)
    pairs = {(r["a"], r["b"]) for r in links}
    got = components_of({k: k for k in sets}, lambda a, b: (min(a, b), max(a, b)) in pairs)
    assert got == want and len(set(want.values())) > 7
    if block == 256:
        assert {r["doc_id"]: r["near_class"] for r in minhash.with_classes(docs).collect()} == want


def brute_simhash(text):
    import xxhash

    own = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not own:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(own[k : k + 4]).encode(), 42) for k in range(max(1, len(own) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def components_of(points: dict, linked) -> dict:
    """Union-find over all pairs."""
    parent = {k: k for k in points}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    items = list(points)
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(points[a], points[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in items}


@pytest.mark.parametrize("crowded", [32, 2])
def test_simhash_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    want = {r[0]: brute_simhash(r[1]) for r in ROWS}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, ROWS)).collect()}
    assert {k: r["fp"] % (1 << 64) for k, r in got.items()} == want
    assert {k: r["component_id"] for k, r in got.items()} == components_of(want, lambda a, b: (a ^ b).bit_count() <= 4)
    # links of dense clusters and long chains
    points = [int(x) for x in rng.integers(0, 1 << 63, 6, dtype=np.uint64)]
    for base in list(points):
        for _ in range(25):
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            points.append(base)
    points = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in points})
    edges = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    own = components_of({p: p % (1 << 64) for p in points}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {p: roots.get(p, p) for p in points} == own
    assert simhash.near_duplicates(frame(spark, ROWS).limit(0)).count() == 0


def brute_kept(rows, window=13):
    split = {r[0]: WORD.findall(r[1] or "") for r in rows}
    first = {}
    for k in sorted(split):
        for i in range(len(split[k]) - window + 1):
            first.setdefault(tuple(split[k][i : i + window]), k)
    out = {}
    for k, own in split.items():
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out[k] = (len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g))
    return out


@pytest.mark.parametrize("shard_words", [300, 1 << 30])
def test_passages_match_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(passages, "SHARD_WORDS", shard_words)
    docs = frame(spark, ROWS).withColumnRenamed("kept", "kept_")
    want = brute_kept(ROWS)
    assert any(n for _, n, _ in want.values())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in passages.locate(docs).collect()} == want
    for r in passages.locate(docs, cleaned=True).collect():
        assert " ".join(WORD.findall(r["cleaned"])) == want[r["doc_id"]][2]


def test_passages_of_odd_rows(spark):
    text = prose(__import__("random").Random(3), 20)
    rows = [(1, text, "x", "s", 1), (1, text, "x", "s", 1), (None, text, "x", "s", 1), (2, text, "x", "s", 1), (3, None, "x", "s", 0)]
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in passages.locate(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20), (3, 0)]
    assert passages.locate(frame(spark, rows).limit(0)).count() == 0


def brute_leaks(docs, items, question=0.8, answer=0.8):
    out = set()
    for doc, text, *_ in docs:
        own = decontam.tokens(text or "")
        for item, body in items:
            parts = decontam.tokens(body or "")
            if item is None or not parts:
                continue
            cut = decontam.answer_start(body)
            for k in range(max(1, len(own))):
                near = own[k : k + 2 * len(parts)]
                if decontam.overlap(parts[:cut], near, 5) >= question and decontam.overlap(parts[cut:], near, 5) >= answer:
                    out.add((doc, item))
                    break
    return out


def test_decontamination_matches_brute_force(spark):
    rng = __import__("random").Random(11)
    items = [(k, f"{prose(rng, 20, 5000)}? {prose(rng, 12, 5000)}.") for k in range(30)] + [(30, None), (31, "..."), (None, "x y z"), (5, None)]
    items.append(items[4])
    docs = [(k, prose(rng, 150, 5000), "en", "s", 1) for k in range(40)] + [(40, None, "en", "s", 0), (41, "", "en", "s", 0)]
    for k in range(0, 40, 4):
        near = items[k % 30][1].split(" ")
        if k % 8:
            near[0] = "other"
        docs[k] = (k, f"{prose(rng, 200, 5000)} {' '.join(near).upper()} {prose(rng, 50, 5000)}", "en", "s", 1)
    docs.append(docs[8])
    got = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items) and len(got) == 11
    for shard in (1, 50):
        more = decontam.indexes(spark.createDataFrame(items, "item_id long, text string"), most=shard * 10)
        assert sum(len(i.items) for i in more) == 30
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(spark, docs), empty).count() == 0
    assert decontam.contaminated(frame(spark, docs).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_wand_returns_all_that_plain_scoring_returns(spark):
    rng = __import__("random").Random(2)
    items = [(k, prose(rng, rng.randrange(3, 30), 60)) for k in range(90)]
    index = next(decontam.indexes(spark.createDataFrame(items, "item_id long, text string")))
    for _ in range(100):
        terms = np.unique([index.terms[w] for w in decontam.tokens(prose(rng, 40, 60)) if w in index.terms])
        scores = {}
        for t in terms:
            for at, weight in zip(*index.postings[t]):
                scores[int(at)] = scores.get(int(at), 0.0) + weight
        for threshold in (0.3, 0.6):
            got = dict(decontam.block_max_wand(index, terms, threshold))
            assert got.keys() == {k for k, v in scores.items() if v >= threshold}
            assert all(abs(got[k] - scores[k]) < 1e-9 for k in got)


def test_documents_schema_is_as_expected(spark, small):
    assert set(table(spark, small, "documents").columns) == {c.split(" ")[0] for c in DOCS.split(", ")}


def test_texts_no_bucket_asks_for_are_left_out_before_the_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    own = [prose(rng, 60) for _ in range(40)]
    near = [f"{t} end" for t in own[:4]]
    docs = frame(spark, [(k, t, "en", "s", len(t)) for k, t in enumerate(own + near)])
    seen = []
    monkeypatch.setattr(minhash, "anchor_filter", lambda keys, f=minhash.anchor_filter: seen.append(keys.count()) or f(keys))
    links = {(r["a"], r["b"]) for r in minhash.near_duplicates(docs).collect()}
    assert links == {(k, 40 + k) for k in range(4)} and seen[0] < 20
