"""Pages, chat windows, language model, licenses, byte-pair encoding and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrain.llm import bpe, chat, licenses, pages, pitman_yor
from auditgrain.llm.queries import PLANS, SQL, table, tokenizer_file

from .helpers import WORD, frame, odd_documents
from .test_text_operators import brute_kept, brute_leaks, brute_simhash, components_of

ROWS = odd_documents()

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="post-{n}"><h2>Head&amp;line</h2><p>First <b>bo</b>ld&nbsp;text, long enough to be the main part of it.<p>Second&#33;
 paragraph<br>broken, also with some more words in it.<ul><li>one<li>two</ul><div class="ad-slot">Buy</div><form>Name<input></form></div>
<section class="comments"><p>A reader says a lot about this, in fact more than the page itself does, and goes on and on and on for many words.</p></section>
<aside>Related</aside></div><footer>Foot</footer><!-- end --></body></html>"""


def test_pages_keep_the_article_alone(spark):
    rows = [(k, f"https://host{k % 2}.example/{k}", PAGE.replace("{n}", str(k))) for k in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "https://host0.example/cut", PAGE[:700]), (23, "no url", "just text"), (24, "https://host1.example/o", "<div><p>Only <i>this"), (0, "https://host0.example/0", PAGE.replace("{n}", "0"))]
    df = frame(spark, rows, "page_id long, url string, html string")
    got = [r for r in pages.extract(df).collect()]
    by = {r["page_id"]: r["text"] for r in got}
    want = "Head&line First bold text, long enough to be the main part of it. Second! paragraph broken, also with some more words in it. one two"
    assert len(got) == len(rows) and all(by[k] == want for k in range(8))
    assert by[20] == by[21] == "" and by[23] == "just text" and by[24] == "Only this" and by[22].startswith("Head&line First bold text")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_query_on_the_given_table(spark, small):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in PLANS["op3_html_consensus"](spark, small).collect()}
    for row in table(spark, small, "pages").collect():
        body = row["html"][row["html"].find("<article>") + 9 :].split("</article>")[0]
        body = re.sub(r"<[^>]*$", "", body)
        assert got[row["page_id"]] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", " ", body))).split())


LEAD = "This lead tells in some words what the article is about and why it matters."
LONG = "A long section text with many words that goes on for a while, so that it wins. " * 4


def main_text(page):
    return pages.main_text(pages.parse(page), None)


@pytest.mark.parametrize("page,want", [
    (f"<body><article><h1>Head</h1><p>{LEAD}</p><section><p>{LONG}</p></section><section><p>{LONG}</p></section></article><div>x</div></body>", f"Head {LEAD} {LONG}{LONG}"),
    (f"<body><div id=w><div class=intro><p>{LEAD}</p></div><div class=body><p>{LONG}</p></div></div><div>Buy this</div></body>", f"{LEAD} {LONG}"),
    (f"<body><div id=w><div class=body><p>{LONG}</p></div><div class=zone>Buy <a href=x>this</a></div></div></body>", LONG),
    (f"<body><div><p>{LEAD}</p><table><tr><td>{LONG}</td></tr></table><p>{LEAD}</p></div></body>", f"{LEAD} {LONG}{LEAD}"),
    (f"<body><article><p>{LONG}</p><div class=related-work><p>{LONG}</p></div><h2 id=social-effects>Social</h2><p>{LEAD}</p></article></body>", f"{LONG}{LONG}Social {LEAD}"),
    (f"<body><article><p>{LONG}</p><div class=comment-list><p>{LONG}</p></div><div class=share>Share this</div></article></body>", LONG),
    (f"<body><article><p>{LONG}\u0130<script>x</script>{LEAD}</p></article></body>", f"{LONG}\u0130{LEAD}"),
])
def test_pages_keep_all_parts_of_an_article(page, want):
    assert main_text(page) == " ".join(want.split())


@pytest.mark.parametrize("page,want", [
    ("<b>" * 1100 + "deep", "deep"),
    ("<div>" * 100_000 + "deep text" + "</div>" * 100_000, "deep text"),
    ("<p>x" + "<b>" * 20_000 + "</i>" * 20_000 + "y", "xy"),
    ("<div>" * 3000 + "<p>t</p>" * 3000, " ".join(["t"] * 3000)),
])
def test_pages_may_be_deep(page, want):
    assert main_text(page) == want


def test_pages_of_many_hosts_are_dealt(spark, monkeypatch):
    rows = [(k, f"https://h{k % 3}.example/{k}", PAGE.replace("{n}", str(k)) + f"<!-- {k} -->") for k in range(12)] + [(12, None, None)]
    df = frame(spark, rows, "page_id long, url string, html string")
    want = {tuple(r) for r in pages.extract(df).collect()}
    monkeypatch.setattr(pages, "BROADCAST_HOSTS", 0)
    got = pages.extract(df).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_a_page_unlike_its_host_keeps_its_own_text(spark):
    short = f"<body><div class=post><section class=s><p>{LONG}</p></section></div></body>"
    odd = f"<body><div class=post><section class=s>Short.</section></div><div class=long><p>{LONG * 5}</p></div></body>"
    df = spark.createDataFrame([(k, "https://h.example/", short) for k in range(5)] + [(9, "https://h.example/", odd)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got[0] == LONG.strip() and got[9] == " ".join((LONG * 5).split())


def digests(turns):
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget,history", [(2048, 256), (60, 30), (1, 0)])
def test_chat_reads_back(spark, budget, history):
    rng = random.Random(4)
    rows, marks = [], ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "\\", "<\\s>", " ok ", "\n", "é"]
    for conv in range(30):
        rows.append((conv, 0, "system", "be kind " * rng.randrange(0, 12)))
        rows += [(conv, t, "assistant" if t % 2 == 0 else "user", "".join(rng.choice(marks) for _ in range(rng.randrange(0, 30)))) for t in range(1, rng.randrange(2, 20))]
    rows += [(40, 0, "user", None), (40, 1, "assistant", None), (41, 0, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (42, 3, "assistant", "same"), (42, 3, "assistant", "same"), (43, None, "tool", "t"), (44, 0, "assistant", "long " * 20_000)]
    rng.shuffle(rows)
    df = frame(spark, rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df, budget, history)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == conv), key=key)]
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)
    for w in chat.format_windows(df, budget, history).collect():
        assert w["n_tokens"] <= budget or w["n_turns"] - w["n_repeated"] == 1
    assert chat.read_back(chat.format_windows(df.limit(0), budget, history)).count() == 0


def test_chat_query_has_the_extra_conversation(spark, small):
    got = {r["conv_id"]: r for r in PLANS["op4_chat_windows"](spark, small).collect()}
    said = "</s>[INST] ok [/INST]"
    r = got[-7]
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests([("user", said), ("assistant", said)])
    assert len(got) == table(spark, small, "conversations").select("conv_id").distinct().count() + 1


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 4000)
    docs = frame(spark, ROWS).withColumn("held", F.col("doc_id") % 5 == 0)
    got = {r["doc_id"]: r for r in pitman_yor.score(docs).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r[0]: [*WORD.findall((r[1] or "").translate(lower)), None] for r in ROWS}
    counts = Counter(w for k, own in tokens.items() if k % 5 for w in own)
    n, v = sum(counts.values()), len(counts)
    for k, own in tokens.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(counts[w] > 0 for w in own), n, k % 5 == 0)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6 * len(own)
        assert r["score"] < 0 and math.isfinite(r["score"])
    none = pitman_yor.score(docs.withColumn("held", F.lit(True))).collect()
    assert len(none) == len(ROWS) and all(abs(r["score"]) < 1e-9 and r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert pitman_yor.score(docs.limit(0)).count() == 0


def test_language_model_is_a_distribution_and_beats_the_base(spark, small):
    got = PLANS["op6_pitman_yor"](spark, small).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    word, context = np.repeat(np.arange(40), 6), np.tile(np.arange(6), 40)
    customers = rng.integers(0, 9, 240) * (rng.random(240) < 0.6)
    contexts = np.zeros(pitman_yor.CONTEXTS)
    contexts[:6] = np.bincount(context, weights=customers)
    known = np.bincount(word, weights=customers) > 0
    totals = pitman_yor._Totals(int(customers.sum()), int(known.sum()), contexts, np.empty(0, np.uint64), np.empty(0))
    tables, guests, shared = pitman_yor.seat(word, context, customers, totals, 1)
    assert ((tables >= (customers > 0)) & (tables <= customers)).all() and (shared <= guests).all()
    sums = pitman_yor._Sampled(np.stack([np.bincount(context, weights=t, minlength=pitman_yor.CONTEXTS) for t in tables]), guests.sum(axis=1), shared.sum(axis=1))
    p = pitman_yor.predictive(customers, tables, guests[:, word], shared[:, word], context, totals, sums)
    none = np.zeros((pitman_yor.SAMPLES, 6), np.int64)
    unknown = pitman_yor.predictive(none[0], none, none, none, np.arange(6), totals, sums)
    for c in range(6):
        assert abs(p[(context == c) & known[word]].sum() + unknown[c] - 1) < 1e-9


def plain_seating(customers, fresh, discount, rng):
    sizes = []
    for n in range(customers):
        if not sizes or rng.random() < fresh / (n - discount * len(sizes) + fresh):
            sizes.append(1)
        else:  # which of the tables has no influence on their number
            sizes[0] += 1
    return len(sizes)


@pytest.mark.parametrize("customers,runs", [(1, 3), (2, 4000), (20, 2000), (200, 400), (2000, 150), (100_000, 12)])
@pytest.mark.parametrize("fresh", [0.05, 4.0])
def test_tables_are_as_many_as_in_a_plain_sampler(customers, runs, fresh):
    rng, own = np.random.default_rng(5), random.Random(5)
    got = pitman_yor.seat_anew(np.full(20_000, customers), np.full(20_000, fresh), 0.75, rng)
    want = [plain_seating(customers, fresh, 0.75, own) for _ in range(runs)]
    assert 1 <= got.min() and got.max() <= customers
    assert abs(got.mean() - np.mean(want)) < 0.02 * got.mean() + 3 * np.std(want) / math.sqrt(runs)
    assert 0.6 * np.std(want) <= got.std() <= 1.6 * np.std(want) or runs < 100


def test_seating_of_none_and_of_mixed_pairs():
    rng = np.random.default_rng(3)
    assert pitman_yor.seat_anew(np.zeros(0, np.int64), np.zeros(0), 0.75, rng).shape == (0,)
    customers = rng.integers(0, 400, 300)
    tables = pitman_yor.seat_anew(customers, np.full(300, 0.5), 0.75, rng)
    assert ((tables > 0) == (customers > 0)).all() and (tables <= customers).all()
    assert tables[customers > 200].mean() > tables[(customers > 0) & (customers < 20)].mean()


def test_license_scan_against_sql(spark, tmp_path):
    import duckdb

    lines = ["Licensed under the Apache License, Version 2.0.", "released under the MIT license", "mit license mit license", "GENERAL PUBLIC LICENSE", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache", "über MIT  License\nLicensed under CC BY-NC 4.0", "license"]
    rng = random.Random(6)
    rows = [(k, "\n".join(rng.choice([*lines, "other words here", ""]) for _ in range(rng.randrange(0, 5))), "en", "s", 1) for k in range(60)]
    rows += [*ROWS, (900, None, "en", "s", 0), (900, None, "en", "s", 0), (None, lines[0], "en", "s", 1)]
    df = frame(spark, rows)
    got = df.sparkSession.createDataFrame(licenses.scan(df).collect(), licenses.scan(df).schema).toPandas()
    path = str(tmp_path / "documents")
    df.select("doc_id", "text").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(SQL["op9_license_scan"]).df()
    order = list(got.columns)
    as_rows = lambda x: sorted(map(repr, x[order].astype(object).where(x[order].notna(), None).astype(str).values.tolist()))
    got["doc_id"], want["doc_id"] = got["doc_id"].astype(float), want["doc_id"].astype(float)
    for c in ("first_word", "last_word"):
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert as_rows(got) == as_rows(want) and (got.labels != got.base_labels).any()
    assert licenses.scan(df.limit(0)).count() == 0


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [(x.ids, t.decode(x.ids, skip_special_tokens=False)) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library(spark):
    rng = random.Random(8)
    texts = [r[1] or "" for r in ROWS]
    texts += ["".join(rng.choice("aaabbthe nrsiou'") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x300), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(300)]
    texts += ["<|startoftext|>Hi<|endoftext|> a", "<|startoftext|", "ΑΣ ΟΔΟΣ", "é \x1c a", "İ", " 's 'S don't I'LL"]
    df = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    path = tokenizer_file()
    got = sorted(bpe.decode(bpe.encode(df, path), path).collect())
    for r, (ids, text) in zip(got, library(texts), strict=True):
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == text and r["n_tokens"] == len(ids)
    none = frame(spark, [(1, None, "en", "s", 0), (1, None, "en", "s", 0)])
    assert [r["n_tokens"] for r in bpe.encode(none, path).collect()] == [0, 0]
    assert bpe.encode(df.limit(0), path).count() == 0


def test_automaton_accepts_what_the_merges_make():
    rng = random.Random(9)
    for _ in range(40):
        symbols, merges, vocab = list("abc"), [], {}
        for s in "abc":
            vocab[s] = len(vocab)
        while len(merges) < 12:
            u, v = rng.choice(symbols), rng.choice(symbols)
            if u + v not in vocab and len(u + v) < 7:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                symbols.append(u + v)
        automaton = bpe.MergeAutomaton(vocab, merges)
        automaton.final = automaton.inner  # this vocabulary has no word ends
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = list(word)
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (u, v):
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert [automaton.label[t] for t in automaton.encode_word(word)] == parts


def test_pipeline_matches_brute_force(spark, small):
    import corpus_pipeline as P

    docs = table(spark, small, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    after = docs
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, after, small)
        after = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r["doc_id"]: r for r in after.collect()}
    ids = set(given)
    assert seen["language_id"].keys() == {k for k in ids if any(map(str.isalpha, given[k]["text"] or ""))}
    first = components_of({k: brute_simhash(given[k]["text"]) for k in seen["language_id"]}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert seen["simhash_near_dedup"].keys() == set(first.values())
    cut = brute_kept([(k, given[k]["text"]) for k in seen["simhash_near_dedup"]])
    assert {k: " ".join(WORD.findall(r["text"])) for k, r in seen["substring_dedup"].items()} == {k: x[2] for k, x in cut.items()}
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    leaks = {k for k, _ in brute_leaks([(k, r["text"]) for k, r in seen["substring_dedup"].items()], items)}
    assert seen["decontamination"].keys() == seen["substring_dedup"].keys() - leaks
    texts = {k: seen["decontamination"][k]["text"] for k in seen["decontamination"]}
    want = dict(zip(texts, library(list(texts.values()))))
    assert {k: np.frombuffer(r["ids"], "<u4").tolist() for k, r in seen["bpe"].items()} == {k: x[0] for k, x in want.items()}
    got = {r["doc_id"]: r["ids_sha256"] for r in P.run(spark, small).collect()}
    assert got == {k: r["ids_sha256"] for k, r in seen["bpe"].items()}
    for name, _ in P.STAGES[:-1]:
        assert all(set(r.asDict()) == set(docs.columns) for r in list(seen[name].values())[:1])


def test_pipeline_of_an_empty_and_an_odd_table(spark, small, tmp_path):
    import corpus_pipeline as P

    for rows in ([], ROWS + [(None, "no id the and", None, None, 1), ROWS[0]]):
        folder = tmp_path / f"t{len(rows)}"
        frame(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
        table(spark, small, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
        got = P.run(spark, str(folder)).collect()
        assert (not rows and not got) or (rows and got)


def test_pipeline_drops_leaks_of_rows_without_an_id_or_with_a_shared_one(spark, small):
    import corpus_pipeline as P

    leak = next(r["text"] for r in table(spark, small, "benchmark").collect() if r["text"] and len(r["text"].split()) > 8)
    clean = "nothing of any test is told here at all"
    rows = [(None, leak), (None, clean), (None, None), (7, clean), (7, f"Before it. {leak} After it."), (8, leak), (8, leak), (9, "")]
    docs = frame(spark, [(k, t, None, None, 0) for k, t in rows])
    got = P.decontaminate(spark, docs, small).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, clean), (7, clean), (9, "")]


def test_pipeline_keeps_different_texts_that_share_an_id(spark, small):
    import corpus_pipeline as P

    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (6, a), (7, c), (4, c), (None, a), (8, None), (8, "")]
    docs = frame(spark, [(k, t, None, None, 0) for k, t in rows])
    got = P.drop_near_duplicates(spark, docs, small).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(5, a), (5, b), (4, c), (0, a), (8, "")])
