"""Registered queries of the training-data operators: thin, whole tables, digests derived in Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrain.llm import bpe, chat, decontam, language, licenses, minhash, pages, passages, pitman_yor, runs, simhash, tokenfile, whitening
from auditgrain.llm.common import fold

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on the machine that asks; executors hold the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = language.train(docs, ~fold(0) & F.col("doc_id").isNotNull())
    out = language.predict(docs, model)
    return out.select("doc_id", fold(0).alias("held_out"), "lang_pred", "score")


def op2_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.with_classes(table(spark, d, "documents"))


def op3_html_consensus(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract(table(spark, d, "pages"))


def op4_chat_windows(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return chat.read_back(chat.format_windows(given.unionAll(extra)))


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_pitman_yor(spark: SparkSession, d: str) -> DataFrame:
    return pitman_yor.score(table(spark, d, "documents").withColumn("held", fold(1)))


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = passages.locate(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op10_bpe_automaton(spark: SparkSession, d: str) -> DataFrame:
    path = tokenizer_file()
    out = bpe.decode(bpe.encode(table(spark, d, "documents"), path), path)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = runs.periodic_runs(docs.select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(runs.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, d: str) -> DataFrame:
    back = tokenfile.token_files(table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


PLANS: dict[str, Plan] = {
    "op1_language_id": op1_language_id,
    "op2_minhash": op2_minhash,
    "op3_html_consensus": op3_html_consensus,
    "op4_chat_windows": op4_chat_windows,
    "op5_decontamination": op5_decontamination,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_bpe_automaton": op10_bpe_automaton,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
SQL: dict[str, str] = {"op9_license_scan": licenses.oracle()}
