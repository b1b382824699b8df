"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are gathered from all training rows, summed in numpy inside each task
and in Spark across tasks. The matrix of log probabilities (languages x buckets) is broadcast; its
size is bounded by `MOST_LANGUAGES` and the number of buckets. A batch of texts is scored as a sparse
matrix: the rows of the matrix at the n-grams that occur are gathered and summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import column, pieces, schema_of, texts_of

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
SMOOTHING = 0.5
#: More labels than this are an error: the broadcast matrix would no longer be small.
MOST_LANGUAGES = 200
#: N-grams that count as independent evidence in a document's score.
EVIDENCE = 32.0
UNKNOWN = "und"
_PIECE = 1 << 16


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    weight: np.ndarray  # buckets x languages


def _buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order; orders have their own hash."""
    with np.errstate(over="ignore"):
        for order in ORDERS:
            if len(points) < order:
                continue
            n = len(points) - order + 1
            h = points[:n] + np.uint32(order * 0x9E37)
            for j in range(1, order):
                h = h * np.uint32(0x01000193) + points[j : j + n]
            h = h * np.uint32(0x9E3779B1)
            yield (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two blanks."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _spans(points: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that overlap enough for no n-gram to be lost; memory stays bounded.

    The shorter n-grams of the overlap count twice, once in 65,536 characters.
    """
    step = _PIECE
    for start in range(0, max(1, len(points) - max(ORDERS) + 1), step):
        yield points[start : start + step + max(ORDERS) - 1]


def train(docs: DataFrame, rows: Column, text: str = "text", label: str = "lang") -> Model:
    """Model of the rows for which `rows` holds and the label is known; every such row counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in pieces(batches, text):
            for lang, item in zip(column(batch, label).to_pylist(), texts_of(batch, text)):
                if lang not in sums and len(sums) >= MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} labels")
                total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                seen[lang] = seen.get(lang, 0) + 1
                for span in _spans(_points(item)):
                    for found in _buckets(span):
                        total += np.bincount(found, minlength=1 << BUCKET_BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[seen[lang], total[at]])], names=["lang", "bucket", "n"],
            )

    known = docs.filter(rows & F.col(label).isNotNull()).select(text, label)
    counts = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most languages x buckets rows
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    place = {x: k for k, x in enumerate(languages)}
    table = np.zeros((len(languages), (1 << BUCKET_BITS) + 1))
    table[found["lang"].map(place).to_numpy(dtype=np.int64), found["bucket"].to_numpy() + 1] = found["n"].to_numpy()
    smooth = table[:, 1:] + SMOOTHING
    prior = np.log(np.maximum(table[:, 0], 1) / max(1.0, table[:, 0].sum()))
    return Model(languages, prior, np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `lang_pred` and `score` (0 to 1) of every row, from its whole text alone.

    The score is the posterior of the best language with the evidence of long texts tempered to
    `EVIDENCE` n-grams, so that it still tells texts apart. A null text, one without a letter, and
    any text when nothing was learned are `und` with score 0. Ties go to the language that sorts
    first; repeated rows get equal results; an empty table gives an empty one.
    """
    spark, names = docs.sparkSession, list(keep)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, text, chars=1_000_000):
            langs, scores = [], []
            for item in texts_of(batch, text):
                if not m.languages or not any(map(str.isalpha, item)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total, n = np.zeros(len(m.languages)), 0
                for span in _spans(_points(item)):
                    for found in _buckets(span):
                        at, times = np.unique(found, return_counts=True) if len(found) < 512 else _sparse(found)
                        total += times @ m.weight[at]
                        n += len(found)
                total = m.prior + total
                best = int(np.argmax(total))
                odds = (total - total[best]) * min(1.0, EVIDENCE / max(n, 1))
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(odds).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"],
            )

    used = list(dict.fromkeys([*names, text]))
    return docs.select(*used).mapInArrow(run, f"{schema_of(docs, names)}, lang_pred string, score double")


def _sparse(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts, by counting instead of sorting."""
    counts = np.bincount(found, minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]
