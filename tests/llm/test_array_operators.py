"""Whitening, periodic runs and token files against plain versions of themselves."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditgrain.llm import runs, tokenfile, whitening
from auditgrain.llm.queries import PLANS, table, tokenizer_file

from .helpers import WORD, frame, odd_documents

VECTORS = "vec_id long, embedding array<float>, label int"


def whitened_by_hand(rows, d, top=8):
    """(x, deviation, whitened up to sign, explained) in plain numpy over the usable rows."""
    kept = [v for _, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    deviation = [int((row * row).sum()) for row in away]
    centred = away.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:top]
    return n, deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(10, 10))
    rows = [(k, [float(np.float32(c)) for c in mixing @ rng.normal(size=10) * 0.2]) for k in range(300)]
    odd = [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] * 10), (904, [0.1] * 9 + [float("inf")]), (905, [0.5] * 4), (7, rows[7][1]), (None, rows[8][1])]
    every = [*rows, *odd]
    df = frame(spark, [(k, v, 0) for k, v in every], VECTORS).withColumns({"x": F.lit(1), "index": F.lit(2), "key": F.lit("k")})
    n, deviation, want, explained = whitened_by_hand(every, 10)
    for blocks in (whitening.Blocks(), whitening.Blocks(rows=32, columns=4, partial=3)):
        got = whitening.whiten(df.repartition(5), blocks=blocks).toPandas()
        assert len(got) == 8 * n == 8 * 302 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
        one = got[got["vec_id"] < 300].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
        assert one["deviation"].tolist() == [deviation[k] for k in range(300) for _ in range(8)]
        found = one["whitened"].to_numpy().reshape(300, 8)
        signs = np.sign((found * want[:300]).sum(axis=0))
        np.testing.assert_allclose(found * signs, want[:300], atol=1e-9)
        np.testing.assert_allclose(one["explained"].to_numpy()[:8], explained, rtol=1e-10)


def test_rows_of_keeps_the_matrix_until_the_call_is_over(spark, monkeypatch):
    call = whitening.callMLlibFunc

    def late(*args):
        time.sleep(3)  # what Python dropped before the call is gone from the JVM by now
        return call(*args)

    monkeypatch.setattr(whitening, "callMLlibFunc", late)
    held = whitening.local_block(spark, np.array([[1.0, 2.0], [3.0, 4.0]]), whitening.Blocks())
    assert sorted((r["index"], list(r["values"])) for r in whitening.rows_of(held).collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_whitening_without_variance_or_rows(spark):
    flat = frame(spark, [(k, [1.0, float(k % 2), 5.0], 0) for k in range(6)], VECTORS)
    got = whitening.whiten(flat).collect()
    assert len(got) == 18 and all((r["whitened"] is not None) == (r["component"] == 1) for r in got)
    assert {round(abs(r["whitened"]), 9) for r in got if r["component"] == 1} == {1.0} and all(r["identity_error"] < 1e-9 for r in got)
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whitening.whiten(frame(spark, [], VECTORS)).count() == 0 and whitening.whiten(frame(spark, [(1, None, 0)], VECTORS)).count() == 0


def test_whitening_query(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, small, "embeddings").collect()]
    n, deviation, want, explained = whitened_by_hand(rows, len(rows[0][1]))
    got = {(r["vec_id"], r["component"]): r for r in PLANS["op11_whitening"](spark, small).collect()}
    assert len(got) == 8 * n
    for c in range(8):
        mine = np.array([got[k, c + 1]["whitened"] for k, _ in rows])
        np.testing.assert_allclose(mine * np.sign(mine @ want[:, c]), want[:, c], atol=1e-8)
    assert [got[k, 1]["deviation"] for k, _ in rows] == deviation and got[rows[0][0], 2]["explained"] == pytest.approx(explained[1], rel=1e-9)


def brute_runs(x, shortest=12):
    """(start, length, period) of all runs by trying every period and stretch."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def by_hand(text, key=None):
    """The row of op12 for a text: words, planted period, runs and what is kept."""
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    rng, texts = random.Random(1), []
    for _ in range(300):
        n, letters = rng.randrange(0, 260), rng.choice([1, 2, 3, 50])
        x = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2 + 1))
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                x[rng.randrange(n)] = 77
        texts.append(np.array(x, np.int64))
    want = [brute_runs(t.tolist()) for t in texts]
    for pairs in (5, 1000, 1_000_000):
        assert [[tuple(r) for r in f.tolist()] for f in runs.find_runs(texts, pairs=pairs)] == want
    assert runs.find_runs([]) == [] and runs.find_runs([np.empty(0, np.int64)])[0].shape == (0, 3)


def test_extensions_equal_direct_comparison():
    assert {(b - a) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))
    rng = np.random.default_rng(5)
    x, starts = runs.marked([np.tile(rng.integers(0, 3, 70), 5), rng.integers(0, 2, 300), np.zeros(200, np.int64)], 3)
    tree = runs.Extensions(x)
    i, j = rng.integers(0, len(x) - 2 * runs.PERIOD, (2, 3000))
    i, j = i[i != j], j[i != j]
    ahead = tree.shift(i, j)
    direct = runs.compare(x, i, j, 500)
    far = direct >= ahead
    assert far.any() and (ahead[far] + tree.between(i[far] + ahead[far], j[far] + ahead[far]) == direct[far]).all()


def test_runs_of_odd_texts(spark):
    rows = [r for r in odd_documents() if len(r[1] or "") < 40_000]
    rows += [(5000, "a b " * 40, "en", "s", 0), (5001, "x " * 11, "en", "s", 0), (5002, "x\t" * 12, "en", "s", 0), (None, "p q r " * 9 + "tail", "en", "s", 0)]
    got = runs.periodic_runs(frame(spark, rows)).withColumn("lines", runs.run_lines(F.col("runs"))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda r: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], sha(r["lines"]), sha(r["collapsed"]))
    assert sorted(map(repr, ((r["doc_id"], row(r)) for r in got))) == sorted(map(repr, ((r[0], by_hand(r[1])) for r in rows)))
    assert runs.periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(frame(spark, rows).withColumn("start", F.lit(1)), keep=("doc_id", "start"))


def test_a_very_long_periodic_text(spark):
    text = " ".join(f"w{k % 1999}" for k in range(60_000))
    (got,) = runs.periodic_runs(frame(spark, [(1, text, "en", "s", 0)])).collect()
    assert (got["n_runs"], got["start"], got["length"], got["period"], got["exponent_milli"]) == (1, 0, 60_000, 1999, 30_015)
    assert got["collapsed"] == " ".join(f"w{k}" for k in range(1999))


def test_runs_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    for r in PLANS["op12_periodic_runs"](spark, small).collect():
        text = docs.pop(r["doc_id"])
        if len(text) < 6000:
            assert tuple(r)[1:] == by_hand(text, r["doc_id"])
    assert not docs


@pytest.mark.parametrize("widths", [None, [8, 8, 16], [1, 2, 3, 26], [32]])
def test_codes_give_every_id(widths):
    rng = np.random.default_rng(2)
    for ids in (np.array([], np.uint32), np.zeros(1, np.uint32), np.array([2**32 - 1, 0, 1], np.uint32), np.concatenate([rng.integers(0, 2**b, 700) for b in (1, 4, 9, 16, 31)]).astype(np.uint32), np.full(2048, 300, np.uint32)):
        documents = pa.table({"key": [1], "start": [0], "n_tokens": [len(ids)]})
        one = tokenfile.TokenFile(pa.BufferReader(tokenfile.encode_file(ids, documents, widths)))
        assert (one.ids() == ids).all() and one.size == len(ids) and one.documents().equals(documents)
        assert [one.id(k) for k in range(0, len(ids), 7)] == ids[::7].tolist()
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (one.ids(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            one.ids(0, len(ids) + 1)
    with pytest.raises(ValueError):
        tokenfile.encode_file(np.array([9], np.uint32), documents, [3])


def test_best_widths_are_smallest():
    ids = np.concatenate([np.arange(200), np.full(30, 70_000)]).astype(np.uint32)
    documents = pa.table({"key": [1]})
    size = lambda w: sum(x["codes"][1] + x.get("more", [0, 0])[1] for x in tokenfile.TokenFile(pa.BufferReader(tokenfile.encode_file(ids, documents, w))).levels)
    assert size(None) <= min(size(w) for w in ([17], [8, 9], [4, 4, 9], [9, 8], [8, 4, 5])) + 4


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = [
    "a  b", "a   b ", " lead", "  lead", "tail ", "tail  ", "\n a\n  b \n\n c", "a \n b\t c", "x\x1c y \x1c z", "x\x85 y \xa0 z  w   v", "<|endoftext|>",
    "foo <|endoftext|> bar\n <|endoftext|>x", "don't we'll 12 345 $%^ mixed1a", "ß 漢字 かな 𝒳 👩‍👧 é é", " ", "   ", "​ a ᠎ b", "a " * 50, "x" * 5000, "it 's　 y",
]


def test_pieces_are_encoded_as_the_library_does():
    rng = random.Random(8)
    made = ["".join(rng.choice("ab1.'\n\t  \x1c\x85\xa0 漢é") for _ in range(rng.randrange(60))) for _ in range(3000)]
    one = tokenfile.Encoder(tokenizer_file("byte_bpe_50k.json"))
    made += [chr(c) * 2 + "a " + chr(c) + "1" + chr(c) + chr(c) + "!" for c in [*range(0x3000), *range(0x1F300, 0x1F400), 0xE000, 0x10FFFF]]
    every = [*ODD, *made]
    assert one.apart and [np.frombuffer(one.encode(x), "<u4").tolist() for x in every] == library_ids(every)


def test_token_files_read_back(spark):
    rows = [*odd_documents(), *((10_000 + k, x, "en", "s", 0) for k, x in enumerate(ODD)), (None, "no key", "en", "s", 0), (None, None, "en", "s", 0), (3, "again", "en", "s", 0)]
    df = frame(spark, rows).withColumns({"key": F.lit("k"), "start": F.lit(1), "path": F.lit("p")})
    path = tokenizer_file("byte_bpe_50k.json")
    for size in (500, 1 << 22):
        got = tokenfile.token_files(df.repartition(3), path, ids_per_file=size).collect()
        got.sort(key=lambda r: r["start"])
        keys = [r["doc_id"] for r in got]
        assert keys[-2:] == [None, None] and keys[:-2] == sorted(r[0] for r in rows if r[0] is not None)
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0
        ids = {}
        for r in got:
            ids.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
        want = {}
        for r, x in zip(rows, library_ids([r[1] for r in rows])):
            want.setdefault(r[0], []).append([*x, 0])
        assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}
    texts = frame(spark, [("b", "two words"), ("a", "one")], "doc_id string, text string", clash=False)
    assert [(r["doc_id"], r["start"]) for r in sorted(tokenfile.token_files(texts, path, end=None).collect(), key=lambda r: r["start"])] == [("a", 0), ("b", 1)]
    assert tokenfile.token_files(df.limit(0), path).count() == 0


def test_files_give_single_ids(spark, tmp_path):
    docs = frame(spark, [(k, f"document number {k} " * (k + 1), "en", "s", 0) for k in range(40)])
    files = tokenfile.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), ids_per_file=900, range_bytes=4000, folder=f"file:{tmp_path}/ids").orderBy("part", "file").collect()
    assert len(files) > 3 and {f["path"] for f in files} <= {str(p) for p in (tmp_path / "ids").iterdir()}
    want = [i for x in library_ids([f"document number {k} " * (k + 1) for k in range(40)]) for i in [*x, 0]]
    at = 0
    for f in files:
        with pa.OSFile(f["path"]) as source:
            one = tokenfile.TokenFile(source)
            assert one.size == f["tokens"] and [one.id(k) for k in range(0, one.size, 11)] == want[at : at + one.size : 11]
            at += one.size
    assert at == len(want)


def test_token_query(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect())
    got = sorted(map(tuple, PLANS["op13_token_files"](spark, small).collect()))
    want, at = [], 0
    for (key, _), ids in zip(docs, library_ids([t for _, t in docs])):
        want.append((key, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        at += len(ids) + 1
    assert got == want


def test_narrow_texts_are_cut_as_any_text():
    rng = random.Random(4)
    one = tokenfile.Encoder(tokenizer_file("byte_bpe_50k.json"))
    for letters in ([chr(k) for k in range(256)], list("ab1 \t\n'_stréllve.²")):
        for _ in range(3000):
            text = "".join(rng.choices(letters, k=rng.randrange(12)))
            assert one.narrow_pieces(text) == one.pieces(text)
            assert one.encode(text) == one.whole(text)
    for ids in ([], [0], [1, 2, 255, 256, 1 << 20], [(1 << 32) - 1, 0]):
        widths = tokenfile.best_widths(np.array(ids, np.uint32))
        assert sum(widths) == max(1, max(ids, default=0).bit_length())
