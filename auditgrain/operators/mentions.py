"""Names mentioned in texts, found through their rarest pairs of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.session import materialize

# --- fixed values: names that are ordinary question words are never matched -----------------------
NAME_STOPWORDS = (
    "the a an why is this company companies site sites high low risk which show compare for of and what are over "
    "last years food management first selected considered recurring deficiencies themes increased highest "
    "regulatory how has since"
).split()
# --- end of fixed values ------------------------------------------------------------------------
WORD = r"(?U)\w+|[^\w\s]+"


def _units(c: Column) -> Column:
    """Words and runs of punctuation, lower-cased: name boundaries then fall on unit boundaries."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def _named_pairs(names: DataFrame) -> DataFrame:
    """Names with `key`: a unit alone, or of two and more the neighbouring pair that the fewest names hold."""
    pair = F.transform(F.sequence(F.lit(1), F.size("_u") - 1), lambda i: F.array_join(F.slice("_u", i, F.lit(2)), " "))
    keys = names.withColumn("key", F.explode(F.when(F.size("_u") > 1, pair).otherwise(F.col("_u"))))
    held = keys.groupBy("key").agg(F.countDistinct("name").alias("_n"))
    rarest = keys.join(held, "key").groupBy("name", "gram").agg(F.min_by("key", F.struct("_n", "key")).alias("key"))
    return rarest


def match_entity_mentions(
    texts: DataFrame, names: DataFrame, text_id: str = "text_id", stopwords: Sequence[str] = NAME_STOPWORDS
) -> DataFrame:
    """(text id, name, match): `full` for a whole name, else `first_word` where a text has no full match.

    Stop words and names of three characters or fewer never match; a name contained in a longer
    matched name is dropped. A text meets a name through the one pair of neighbouring units that the
    fewest names share, so neither long names nor common first words make many pairs; that the whole
    name stands in the text is then one search in it, and names within longer ones leave inside the row.
    """
    clean = names.select(F.trim("name").alias("name")).filter(F.length("name") > 0).distinct()
    clean = clean.withColumn("_u", _units(F.col("name")))
    usable = clean.filter(~F.lower("name").isin(*stopwords) & (F.length("name") > 3) & (F.size("_u") > 0)).withColumn("gram", F.array_join("_u", " "))
    cut = texts.select(text_id, _units(F.col("text")).alias("_t"))
    pairs = F.transform(F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(1))), lambda u, i: F.concat_ws(" ", u, F.get("_t", i + 1)))
    held = materialize(cut.select(
        text_id, F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).alias("_said"), F.array_distinct("_t").alias("_words"),
        F.array_distinct(F.when(F.size("_t") > 1, F.concat("_t", pairs)).otherwise(F.col("_t"))).alias("_keys"),
    ), "units")
    met = held.select(text_id, F.explode("_keys").alias("key")).join(_named_pairs(usable), "key").groupBy(text_id).agg(
        F.collect_set(F.struct("gram", "name")).alias("_met")
    )
    found = held.select(text_id, "_said").join(met, text_id).select(
        text_id, F.filter("_met", lambda m: F.contains("_said", F.concat(F.lit(" "), m["gram"], F.lit(" ")))).alias("_full")
    ).filter(F.size("_full") > 0)
    within = lambda a, b: (F.length(b["name"]) > F.length(a["name"])) & F.contains(F.lower(b["name"]), F.lower(a["name"]))
    whole = found.select(text_id, F.explode(F.filter("_full", lambda a: ~F.exists("_full", lambda b: within(a, b)))).alias("m"))
    first = clean.withColumn("_word", F.lower(F.get(F.split("name", r"\s+"), F.lit(0)))).filter(
        (F.length("_word") >= 4) & ~F.col("_word").isin(*stopwords)
    ).select("name", "_word")
    rest = held.select(text_id, "_words").join(found.select(text_id), text_id, "left_anti")
    fallback = rest.select(text_id, F.explode("_words").alias("_word")).join(first, "_word").select(text_id, "name")
    return whole.select(text_id, "m.name", F.lit("full").alias("match")).distinct().unionByName(
        fallback.distinct().withColumn("match", F.lit("first_word"))
    )
