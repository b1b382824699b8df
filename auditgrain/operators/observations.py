"""The observation corpus: quarantine, unique texts, identities, stable ids, conflicts and quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.expressions import compute_once, count_if, squeeze
from auditgrain.session import materialize

# --- fixed values -------------------------------------------------------------------------------
EMPTY_TEXT = "Empty or nontext observation"
NO_SOURCE = "Missing source identity"
BAD_ID = "Invalid record identity"
MAX_ID_LENGTH = 512
# --- end of fixed values ------------------------------------------------------------------------
IDENTITY_FIELDS = ("fei", "date", "company")
LOAD_ORDER = ("priority", "source_row")
#: Up to so many repeated ids are sent to all tasks; beyond, all rows are shuffled by id.
FEW_KEYS = 1_000_000


def load_order(order: Sequence[str]) -> Column:
    """Sort key of the load order; row numbers compare as numbers, other row names after them as texts."""
    keys = []
    for name in order:
        if name == "source_row":
            number = F.col(name).cast("string").try_cast("bigint")
            keys += [number.isNull().alias("_named"), number.alias("_number")]
        keys.append(F.col(name))
    return F.struct(*keys)


def text_hash(text: Column) -> Column:
    return F.sha2(squeeze(text), 256)


def quarantine_reason(clean: Column | None = None) -> Column:
    """The first reason a row cannot enter the corpus; null for a good row. `clean` is the squeezed text, where it is known."""
    clean = squeeze("text") if clean is None else clean
    bad_id = lambda c: F.col(c).isNotNull() & ((F.trim(F.col(c)) == "") | (F.length(c) > MAX_ID_LENGTH))
    return F.coalesce(
        F.col("invalid_reason"),
        F.when(F.coalesce(clean, F.lit("")) == "", EMPTY_TEXT),
        F.when(F.coalesce(F.col("source_file"), F.lit("")) == "", NO_SOURCE),
        F.when(bad_id("inspection_id") | bad_id("observation_id"), BAD_ID),
    )


def quarantine_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with `reason`)."""
    marked = df.withColumn("reason", quarantine_reason())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def dedupe_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct normalised text, keyed by its sha-256.

    Equal hashes have equal texts, so whole rows are told apart: the aggregate stays hash-based, where
    the first text of a hash would sort all rows.
    """
    return df.select(squeeze(text).alias("text")).select(F.sha2("text", 256).alias("hash"), "text").distinct()


def _same_name(a: Column, b: Column) -> Column:
    return F.lower(squeeze(a)) == F.lower(squeeze(b))


def _met(df: DataFrame, key: str, values: Sequence[Column]) -> DataFrame:
    """(key, varied) of the keys under which rows meet; `varied` where any of the values (nulls aside)
    takes more than one form.

    Values are compared by 64-bit hashes: numeric minima and maxima keep the aggregate hash-based,
    where minima of strings would sort every row, and what is shuffled narrow.
    """
    names = [f"_h{i}" for i in range(len(values))]
    hashed = df.select(key, *[F.when(v.isNotNull(), F.xxhash64(v)).alias(n) for v, n in zip(values, names, strict=True)])
    ends = hashed.groupBy(key).agg(F.count("*").alias("_n"), *[f(n).alias(f"{n}_{e}") for n in names for f, e in ((F.min, "lo"), (F.max, "hi"))])
    differs = F.lit(False)
    for n in names:
        differs = differs | F.coalesce(F.col(f"{n}_lo") != F.col(f"{n}_hi"), F.lit(False))
    return ends.filter("_n > 1").select(key, differs.alias("varied"))


def _varied(df: DataFrame, key: str, values: Sequence[Column]) -> DataFrame:
    """Keys under which any of the values (nulls aside) takes more than one form, written once."""
    return materialize(_met(df, key, values).filter("varied").select(key), "varied", "zstd")


def resolve_identity(df: DataFrame, order: Sequence[str] = LOAD_ORDER) -> DataFrame:
    """First metadata per inspection wins; a later row that disagrees moves to a conflict id.

    Adds `identity_conflict` and `existing_*`, and rewrites `inspection_id` of conflicting rows.
    Only inspections whose metadata varies need a winner; it is a partially aggregated minimum joined
    back, so one inspection may own any share of the rows. These winners are written before they are
    joined: while they are few, no row of the corpus is shuffled. Metadata is looked through as it is
    written, which spares every row the normalisation; only what then meets a winner is compared by name.
    """
    named = df.filter(F.col("inspection_id").isNotNull())
    varied = _varied(named, "inspection_id", [F.nullif(F.col(c), F.lit("")) for c in IDENTITY_FIELDS])
    first = materialize(
        named.join(varied, "inspection_id", "left_semi").groupBy("inspection_id")
        .agg(F.min_by(F.struct(*IDENTITY_FIELDS), load_order(order)).alias("_first")), "first", "zstd"
    )
    joined = df.join(first, "inspection_id", "left")
    differs = F.lit(False)
    for name in IDENTITY_FIELDS:
        a, b = F.nullif(F.col(f"_first.{name}"), F.lit("")), F.nullif(F.col(name), F.lit(""))
        differs = differs | F.coalesce(~_same_name(a, b), F.lit(False))
    identity = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in IDENTITY_FIELDS])
    moved = F.concat(F.col("inspection_id"), F.lit("-CONFLICT-"), F.substring(F.sha2(identity, 256), 1, 12))
    return joined.withColumn("identity_conflict", differs).select(
        *[c for c in df.columns if c != "inspection_id"],
        F.col("inspection_id").alias("source_inspection_id"),
        F.when(F.col("identity_conflict"), moved).otherwise(F.col("inspection_id")).alias("inspection_id"),
        "identity_conflict",
        *[F.when(F.col("_first").isNotNull(), F.col(f"_first.{c}")).otherwise(F.col(c)).alias(f"existing_{c}") for c in IDENTITY_FIELDS],
    )


def observation_key() -> Column:
    """The given id, else a digest of (inspection or source, reference, text hash, grain)."""
    source = F.concat_ws("#", F.col("source_file"), F.col("source_row"))
    parts = [F.coalesce(F.col("inspection_id"), source), F.coalesce("reference", F.lit("")), F.col("hash"), F.col("grain")]
    derived = F.concat(F.lit("OBS-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))
    return F.coalesce(F.nullif(F.col("observation_id"), F.lit("")), derived)


CONTENT = ("hash", "inspection_id", "dataset")


def identify_observations(df: DataFrame, order: Sequence[str] = LOAD_ORDER) -> DataFrame:
    """Stable observation ids; the same id with other content becomes a `-VAR-` id and a conflict.

    Ids are looked through by their 64-bit hash. Two that meet in it get a winner each that they need
    not have, which changes nothing.
    """
    return _identify(df, order)[0]


def _identify(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(identified, met): `met` are the hashes of ids under which rows met before variants got ids of their own."""
    if "hash" not in df.columns:
        df = df.withColumn("hash", text_hash(F.col("text")))
    keyed = df.withColumn("observation_id", observation_key())
    marked = keyed.withColumn("_key", F.xxhash64("observation_id"))
    # A null inspection is content too, hence the placeholder.
    met = materialize(_met(marked, "_key", [F.struct(*[F.coalesce(F.col(c), F.lit("<null>")) for c in CONTENT])]), "met", "zstd")
    varied = met.filter("varied").select("_key")
    first = materialize(marked.join(varied, "_key", "left_semi").groupBy("observation_id").agg(
        F.min_by(F.struct(*CONTENT), load_order(order)).alias("_first")
    ), "first", "zstd")
    joined = keyed.join(first, "observation_id", "left")
    differs = F.lit(False)
    for name in CONTENT:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"_first.{name}"))
    differs = F.col("_first").isNotNull() & differs
    content = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in CONTENT])
    variant = F.concat(F.col("observation_id"), F.lit("-VAR-"), F.substring(F.sha2(content, 256), 1, 12))
    identified = joined.withColumn("variant_conflict", differs).select(
        *[c for c in keyed.columns if c != "observation_id"],
        F.when(F.col("variant_conflict"), variant).otherwise(F.col("observation_id")).alias("observation_id"),
        "variant_conflict", F.coalesce("_first.hash", "hash").alias("existing_hash"),
        F.coalesce("_first.dataset", "dataset").alias("existing_dataset"),
    )
    return identified, met.select("_key")


NARROW = (
    "hash", "dataset", "grain", "inspection_id", "company", "site", "year", "product", "inspection_type", "frequency",
)


def split_repeats(identified: DataFrame, few: int = FEW_KEYS, met: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows alone under their observation id, the others); None and all rows where more than `few` ids repeat.

    Ids are counted by their 64-bit hash, so that what is shuffled is narrow; ids that meet in it go to
    the others. The input is read again for either part, so it had better be stored. Where the hashes `met`
    before variants were renamed are known, only the new ids of variants are looked up and none is counted.
    """
    marked = identified.withColumn("_key", F.xxhash64("observation_id"))
    if met is None:
        several_keys = marked.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    else:
        several_keys = met.unionByName(marked.filter("variant_conflict").select("_key")).distinct()
    repeated = materialize(several_keys, "repeated", "zstd")
    if repeated.count() > few:
        return None, identified
    sent = F.broadcast(repeated)
    return marked.join(sent, "_key", "left_anti").drop("_key"), marked.join(sent, "_key", "left_semi").drop("_key")


def dedupe_observations(
    identified: DataFrame, order: Sequence[str] = LOAD_ORDER, split: tuple[DataFrame | None, DataFrame] | None = None
) -> DataFrame:
    """Repeats collapse to the first loaded row; text stays in the text table, keyed by hash.

    `split` is what `split_repeats` gives: rows alone under their id stay where they are.
    """
    alone, several = split or split_repeats(identified)
    first = several.groupBy("observation_id").agg(
        F.min_by(F.struct(*NARROW), load_order(order)).alias("_o"), F.count("*").alias("occurrences")
    ).select("observation_id", "_o.*", "occurrences")
    if alone is None:
        return first
    return alone.select("observation_id", *NARROW, F.lit(1).cast("long").alias("occurrences")).unionByName(first)


def observation_origins(identified: DataFrame, split: tuple[DataFrame | None, DataFrame] | None = None) -> DataFrame:
    """Every origin of every observation, as rows."""
    alone, several = (x and x.select("observation_id", "source_file", "source_row") for x in split or split_repeats(identified))
    return several.distinct() if alone is None else alone.unionByName(several.distinct())


def conflicts(identified: DataFrame) -> DataFrame:
    """Rows that disagreed with what was loaded first: existing against incoming."""
    join = lambda names: F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in names])
    identity = identified.filter("identity_conflict").select(
        F.lit("identity").alias("kind"), F.col("source_inspection_id").alias("identity"),
        join([f"existing_{c}" for c in IDENTITY_FIELDS]).alias("existing"), join(IDENTITY_FIELDS).alias("incoming"),
        "source_file", "source_row",
    )
    variant = identified.filter("variant_conflict").select(
        F.lit("variant").alias("kind"), F.col("observation_id").alias("identity"),
        join(["existing_hash", "existing_dataset"]).alias("existing"), join(["hash", "dataset"]).alias("incoming"),
        "source_file", "source_row",
    )
    return identity.unionByName(variant)


def build_corpus(sources: DataFrame, order: Sequence[str] = LOAD_ORDER, audited: bool = True) -> Mapping[str, DataFrame]:
    """All corpus tables from the unioned sources.

    Each source row feeds several outputs and two first-wins joins, so the checked rows and the
    identified rows are each written once; every output then reads only the columns it needs. Who asks
    for the observations and texts alone (`audited` false) has the same steps write their columns alone.
    """
    cleaned = compute_once(sources, {"clean": squeeze("text")})
    checked = compute_once(cleaned, {"hash": F.sha2("clean", 256), "reason": quarantine_reason(F.col("clean"))})
    checked = materialize(checked.drop("clean" if audited else "text"), "checked", "zstd", ("source_row",))
    accepted = checked.filter(F.col("reason").isNull()).drop("reason")
    identified, met = _identify(resolve_identity(accepted.drop("text", "clean"), order), order)
    if not audited:
        identified = identified.select("observation_id", *NARROW, *order, "variant_conflict")
    identified = materialize(identified, "identified", "zstd", ("observation_id", "source_row"))
    split = split_repeats(identified, met=met)
    observations = dedupe_observations(identified, order, split)
    if not audited:
        return {"observations": observations, "texts": accepted.select("hash", F.col("clean").alias("text")).distinct()}
    return {
        "quarantine": checked.filter(F.col("reason").isNotNull()).drop("hash"),
        "identified": identified,
        "observations": observations,
        "texts": accepted.select("hash", squeeze("text").alias("text")).distinct(),
        "origins": observation_origins(identified, split),
        "conflicts": conflicts(identified),
    }


def corpus_quality(sources: DataFrame, corpus: Mapping[str, DataFrame]) -> DataFrame:
    """Totals as rows (section, label, n): accounting, and observations by dataset and grain."""
    reason = quarantine_reason()
    totals = sources.agg(
        F.count("*").alias("total_records"), count_if(reason.isNull()).alias("valid_records"),
        count_if(reason.isNotNull()).alias("invalid_records"),
        count_if(F.coalesce(squeeze("text"), F.lit("")) == "").alias("empty_text_rows"),
    )
    found = corpus["identified"].agg(
        count_if(F.col("identity_conflict")).alias("identity_conflicts"),
        count_if(F.col("variant_conflict")).alias("variant_conflicts"),
        F.countDistinct("inspection_id").alias("total_inspections"),
    )
    unique = corpus["observations"].agg(
        F.count("*").alias("total_observations"), F.sum(F.col("occurrences") - 1).alias("duplicate_observation_rows")
    )
    texts = corpus["texts"].agg(F.count("*").alias("unique_observation_texts"))

    def rows(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("n")) for c in df.columns])
        return df.select(F.explode(pairs).alias("r")).select(F.lit("totals").alias("section"), "r.label", "r.n")

    by_dataset = corpus["observations"].groupBy("dataset", "grain").agg(F.count("*").alias("n")).select(
        F.lit("datasets").alias("section"), F.concat_ws("/", "dataset", "grain").alias("label"), "n"
    )
    return rows(totals).unionByName(rows(found)).unionByName(rows(unique)).unionByName(rows(texts)).unionByName(by_dataset)
