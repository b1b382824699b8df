"""Documents to token ids, in five stages that each read what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Language rejects rows without a letter or with an unsure prediction; near-dedup keeps
the document with the smallest id of each group; substring dedup cuts recurring passages out of the
text; decontamination drops documents that hold a benchmark item; the last stage encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrain.llm import bpe, decontam, language, passages, simhash
from auditgrain.llm.common import fold
from auditgrain.llm.queries import table, tokenizer_file
from auditgrain.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior of the predicted language.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows with a predicted language; `lang` becomes the prediction. A null text or one without a letter goes.

    The model learns from the labelled rows outside fold 0; without labels nothing can be told apart,
    and rows with a letter are kept as they are.
    """
    model = language.train(docs, ~fold(0) & F.col("doc_id").isNotNull())
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.predict(docs.select(*COLUMNS), model, keep=tuple(COLUMNS))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; rows without an id are not grouped and stay.

    A document is an id with a text: different texts that share an id are different documents, of
    which a group keeps the one with the smaller hash. Repeated rows of the document that stays are
    one document: one of them stays.
    """
    named = docs.filter("doc_id is not null").select(*COLUMNS, F.xxhash64("text").alias("body"))
    groups = simhash.near_duplicates(named.select(F.struct("doc_id", "body").alias("doc_id"), "text"))
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id.doc_id", "doc_id.body").distinct()
    out = named.join(kept, ["doc_id", "body"], "left_semi").dropDuplicates(["doc_id", "body"])
    return out.select(*COLUMNS).unionAll(docs.filter("doc_id is null").select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; passages that also start in a document with a smaller id leave its text."""
    out = passages.locate(docs, keep=("lang", "source"), cleaned=True)
    text = F.col("cleaned")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found; others stay as they are.

    Only the text decides, so texts are judged and dropped by their hash: rows without an id, and rows
    that share one, are judged like any other.
    """
    body = F.sha2(F.col("text").cast("binary"), 256)
    found = decontam.contaminated(docs.select(body.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    # bounded by the contaminated documents; the plan broadcasts it where its measured size allows
    leaks = materialize(found.select(F.col("doc_id").alias("body")).distinct(), "leaks")
    return docs.withColumn("body", body).join(leaks, "body", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `lang`, `source`, `n_tokens`, `ids` (little-endian unsigned 32-bit) and digests of ids and decoded text."""
    path = tokenizer_file()
    ids = bpe.encode(docs, path, keep=("doc_id", "lang", "source"))
    out = bpe.decode(ids, path, keep=("doc_id", "lang", "source", "n_tokens", "ids"))
    return out.select(
        "doc_id", "lang", "source", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: Hash functions, automata and the classifier are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
