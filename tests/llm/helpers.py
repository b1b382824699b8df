"""Fixtures in plain Python for the training-data operators."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASH = {"shard": 1, "fp": 2, "bucket": 3, "slice": 4, "ids": 5, "kept": 6, "score": 7, "body": 8, "words": 9, "node": 10, "held": None, "n_tokens": 11, "label": 12}


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents(seed: int = 7, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, null, empty and very long texts, odd blanks, ties."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(5, 120)) for _ in range(n)]
    passage = prose(rng, 40)
    for k in range(0, n, 5):
        texts[k] = f"{prose(rng, 20)} {passage}\n{prose(rng, 10)}"
    for k in range(1, n, 7):
        own = texts[k].split(" ")
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [texts[3], texts[3], None, None, "", "   \t\n", "one", "a\x1cb c\xa0d e", prose(rng, 30_000), "Ünïcode ΑΣ İx  𝒳 " * 20, "x" * 50_000]
    rows = [(k * 3, t, "en" if k % 3 else "fr", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple], schema: str = DOCS, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns}) if clash else df
