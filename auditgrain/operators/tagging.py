"""Rule tagging of observation text, validation of external tags, and tag runs over unique texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.functions.expressions import compute_once, contains_any, literal_pattern, reasons, squeeze, strip
from auditgrain.functions.taxonomy import (
    OBSERVATION_TAXONOMY,
    PROHIBITED_RATIONALE_PATTERN,
    RISK_TAXONOMY,
    SEVERITY_RANKS,
    Taxonomy,
    keyword_array,
    theme_array,
)

QUALITY, UNCLASSIFIED = "Quality and compliance", "Unclassified"
SEVERITIES = ("Low", "Medium", "High", "Critical", UNCLASSIFIED)
SENTENCE_END = r"(?<=[.!?])\s+"
QUOTE_LENGTH, QUOTE_LEAD, MAX_KEYWORDS = 900, 100, 20
TAG_COLUMNS = ["category", "theme", "severity", "confidence", "evidence_quote", "rationale", "keywords"]


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANKS.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def tag_themes(df: DataFrame, taxonomy: Taxonomy = RISK_TAXONOMY, text: str = "observation_text") -> DataFrame:
    return df.withColumn("themes", theme_array(F.col(text), taxonomy))


def rule_severity(text: Column, taxonomy: Taxonomy = RISK_TAXONOMY) -> Column:
    low = F.lower(text)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(contains_any(low, taxonomy.rule_critical), "Critical")
        .when(contains_any(low, taxonomy.rule_high), "High")
        .when(contains_any(low, taxonomy.words), "Medium")
        .otherwise("Low")
    )


def rule_analysis(df: DataFrame, taxonomy: Taxonomy = RISK_TAXONOMY, text: str = "observation_text") -> DataFrame:
    """First theme, category, severity and a fixed confidence from keywords alone."""
    found = F.size("themes") > 0
    return tag_themes(df, taxonomy, text).withColumns({
        "theme": F.coalesce(F.get("themes", F.lit(0)), F.lit(UNCLASSIFIED)),
        "category": F.when(found, QUALITY).otherwise(UNCLASSIFIED),
        "severity": rule_severity(F.col(text), taxonomy),
        "confidence": F.when(found, 0.65).otherwise(0.2),
    })


def is_instruction(c: Column, taxonomy: Taxonomy = OBSERVATION_TAXONOMY) -> Column:
    """Does the text try to instruct a reader rather than report something?"""
    return c.rlike(taxonomy.instruction_pattern)


def severity_supported(severity: Column, text: Column, taxonomy: Taxonomy = OBSERVATION_TAXONOMY) -> Column:
    low = F.lower(text)
    critical = contains_any(low, taxonomy.critical)
    return (
        F.when(severity.isin("Low", "Medium", UNCLASSIFIED), True)
        .when(contains_any(low, taxonomy.severity_negations), False)
        .when(severity == "Critical", critical)
        .otherwise(critical | contains_any(low, taxonomy.high))
    )


def supported_theme(theme: Column, text: Column, taxonomy: Taxonomy = OBSERVATION_TAXONOMY) -> Column:
    low = F.lower(text)
    supported = F.lit(False)
    for name, words in taxonomy.themes.items():
        supported = F.when(theme == name, contains_any(low, words)).otherwise(supported)
    return F.when(theme == UNCLASSIFIED, True).when(contains_any(low, taxonomy.negations), False).otherwise(supported)


def classify_observation(df: DataFrame, taxonomy: Taxonomy = OBSERVATION_TAXONOMY, text: str = "text") -> DataFrame:
    """Theme, severity and a verbatim quote from the first usable sentence with a keyword.

    Instruction-like and negated sentences are skipped. Texts without a usable sentence come out
    as Unclassified with their opening as the quote.
    """
    pattern = literal_pattern(taxonomy.words)

    def usable(s: Column) -> Column:
        low = F.lower(s)
        return low.rlike(pattern) & ~is_instruction(s, taxonomy) & ~contains_any(low, taxonomy.negations)

    staged = compute_once(df, {"_text": squeeze(text)})
    staged = compute_once(staged, {"_hit": F.get(F.filter(F.split("_text", SENTENCE_END), usable), F.lit(0))})
    staged = staged.withColumn("_low", F.lower("_hit"))
    ordered = [(t, w) for t, words in taxonomy.themes.items() for w in words]
    first = lambda pick: F.coalesce(*[F.when(F.contains("_low", F.lit(w)), F.lit(pick(t, w))) for t, w in ordered])
    staged = compute_once(staged, {"_theme": first(lambda t, w: t), "_word": first(lambda t, w: w)})
    start = F.greatest(F.instr("_low", F.col("_word")) - 1 - QUOTE_LEAD, F.lit(0)) + 1
    staged = compute_once(staged, {"_quote": F.substr("_hit", start, F.lit(QUOTE_LENGTH))})
    quote, hit = F.col("_quote"), F.col("_hit").isNotNull()
    minor = F.lit(bool(taxonomy.low_all))
    for word in taxonomy.low_all:
        minor = minor & F.contains("_low", F.lit(word))
    severity = (
        F.when(severity_supported(F.lit("Critical"), quote, taxonomy), "Critical")
        .when(severity_supported(F.lit("High"), quote, taxonomy), "High")
        .when(minor, "Low")
        .otherwise("Medium")
    )
    tagged = compute_once(staged, {
        "category": F.when(hit, QUALITY).otherwise(UNCLASSIFIED),
        "theme": F.coalesce("_theme", F.lit(UNCLASSIFIED)),
        "severity": F.when(hit, severity).otherwise(UNCLASSIFIED),
        "confidence": F.when(hit, 0.55).otherwise(0.1),
        "evidence_quote": F.when(hit, quote).otherwise(F.substring("_text", 1, QUOTE_LENGTH)),
        "keywords": F.when(hit, F.slice(keyword_array(F.col("_low"), taxonomy), 1, MAX_KEYWORDS)).otherwise(
            F.array().cast("array<string>")
        ),
    })
    tagged = tagged.withColumn(
        "rationale",
        F.when(hit, F.concat(F.lit("Keyword signal for "), F.col("theme"), F.lit("; priority "), F.col("severity"),
                             F.lit(" follows the words of the quote.")))
        .otherwise(F.lit("No keyword signal; needs human review.")),
    )
    return tagged.drop("_text", "_hit", "_low", "_theme", "_word", "_quote")


def tag_rubric(df: DataFrame, taxonomy: Taxonomy = RISK_TAXONOMY, text: str = "text") -> DataFrame:
    """Multi-label tags by sentence; negated sentences abstain; severity from the quoted sentences."""
    sentence = F.filter(
        F.transform(F.split(text, SENTENCE_END), strip),
        lambda s: (s != "") & ~F.lower(s).rlike(taxonomy.rubric_negation_pattern)
        & F.lower(s).rlike(literal_pattern(taxonomy.words)),
    )
    staged = compute_once(df, {"evidence_quotes": F.array_distinct(sentence)})
    staged = compute_once(staged, {"themes": F.array_distinct(F.flatten(
        F.transform("evidence_quotes", lambda s: theme_array(s, taxonomy))
    ))})
    staged = staged.withColumn("_low", F.lower(F.array_join("evidence_quotes", " ")))
    low = F.col("_low")
    minor = F.lit(bool(taxonomy.rubric_low_all))
    for word in taxonomy.rubric_low_all:
        minor = minor & F.contains(low, F.lit(word))
    none = F.lit("Insufficient evidence")
    severity = F.when(F.size("themes") == 0, none).otherwise(
        F.when(contains_any(low, taxonomy.rubric_critical), "Critical")
        .when(contains_any(low, taxonomy.rubric_high), "High")
        .when(minor, "Low")
        .when(contains_any(low, taxonomy.rubric_medium), "Medium")
        .otherwise(none)
    )
    theme = F.get("themes", F.lit(0))
    category = F.lit(UNCLASSIFIED)
    for name, label in taxonomy.category_of_theme.items():
        category = F.when(theme == name, F.lit(label)).otherwise(category)
    return staged.withColumns({
        "theme": F.coalesce(theme, F.lit(UNCLASSIFIED)), "category": category, "severity": severity,
    }).drop("_low")


def _quote_contexts(text: Column, quote: Column) -> Column:
    """For each occurrence of the quote: the text from the sentence before it to its end.

    Occurrences are located one behind the other. A sentence begins behind the last full stop since the
    occurrence before, or else where that one's began, so no part of the text is looked through twice.
    """
    size = F.length(quote)
    count = F.floor((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / size).cast("int")
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("since"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def next_one(state: Column, _: Column) -> Column:
        at = F.call_function("locate", quote, text, state["at"])
        behind = F.regexp_extract(F.substring(text, state["since"], at - state["since"]), r"[^.!?]*$", 0)
        since = at - F.length(behind)
        return F.struct(
            (at + size).alias("at"), since.alias("since"),
            F.concat(state["found"], F.array(F.struct(since.alias("start"), (at + size).alias("stop")))).alias("found"),
        )

    found = F.aggregate(F.sequence(F.lit(1), count), start, next_one, lambda state: state["found"])
    # sequence(1, 0) would count down
    return F.when(count > 0, F.transform(found, lambda f: F.substring(text, f["start"], f["stop"] - f["start"]))).otherwise(F.array().cast("array<string>"))


def verify_tags(tags: DataFrame, texts: DataFrame, taxonomy: Taxonomy = OBSERVATION_TAXONOMY) -> DataFrame:
    """Check externally produced tags against their texts: adds `reasons` and `valid`."""
    joined = tags.join(texts.select("hash", F.col("text").alias("_text")), "hash", "left")
    theme, severity, quote, text = F.col("theme"), F.col("severity"), F.col("evidence_quote"), F.col("_text")
    unclassified = theme == UNCLASSIFIED
    low = F.lower(text)
    bad_word = F.exists("keywords", lambda k: (F.trim(k) == "") | ~F.contains(low, F.lower(k)))
    verbatim = (F.trim(quote) != "") & F.contains(text, quote)
    in_context = F.exists(
        _quote_contexts(text, quote),
        lambda s: ~is_instruction(s, taxonomy) & supported_theme(theme, s, taxonomy),
    )
    length = F.length(quote)
    fails = reasons(
        (text.isNull(), "unknown text"),
        (~F.coalesce(theme.isin(*taxonomy.names, UNCLASSIFIED), F.lit(False)), "unknown theme"),
        (~F.coalesce(F.col("category").isin(QUALITY, UNCLASSIFIED), F.lit(False)), "unknown category"),
        (~F.coalesce(severity.isin(*SEVERITIES), F.lit(False)), "unknown severity"),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0-1"),
        (~F.coalesce(length.between(1, 1000), F.lit(False)), "quote length"),
        (unclassified != (F.col("category") == UNCLASSIFIED), "category and theme disagree"),
        ((severity == UNCLASSIFIED) & ~unclassified, "severity missing for a theme"),
        (~F.coalesce(verbatim, F.lit(False)), "quote not verbatim"),
        (F.size("keywords") > 30, "too many keywords"),
        (bad_word, "keyword not in text"),
        (F.coalesce(verbatim, F.lit(False)) & ~unclassified & ~F.coalesce(in_context, F.lit(False)), "context does not support theme"),
        (F.col("rationale").rlike(PROHIBITED_RATIONALE_PATTERN), "prohibited conclusion"),
        (is_instruction(quote, taxonomy) & ~unclassified, "instruction used as evidence"),
        (~supported_theme(theme, quote, taxonomy), "theme not supported"),
        (~severity_supported(severity, quote, taxonomy), "severity not supported"),
    )
    return joined.withColumn("reasons", fails).withColumn("valid", F.size("reasons") == 0).drop("_text")


def resolve_tags(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """A validated candidate where there is one, else the rule tag, marked as a fallback.

    `candidates` carries `valid`; a missing candidate means the provider was unavailable. Every text
    gets its own evidence: nothing is copied from another member of its group.
    """
    picked = candidates.select("hash", F.col("valid").alias("_valid"), F.struct(*TAG_COLUMNS).alias("_given"))
    joined = rules.select("hash", F.struct(*TAG_COLUMNS).alias("_rule")).join(picked, "hash", "left")
    use = F.coalesce("_valid", F.lit(False))
    return joined.withColumn("_tag", F.when(use, F.col("_given")).otherwise(F.col("_rule"))).select(
        "hash", "_tag.*", use.alias("ai_generated"), (~use).alias("fallback"),
        F.when(use, "validated").when(F.col("_valid").isNull(), "provider_unavailable").otherwise("invalid_output").alias("raw_status"),
    )


def cache_key(text: Column, provider: str, model: str, taxonomy_version: str, prompt_version: str) -> Column:
    versioned = F.concat(squeeze(text), F.lit(taxonomy_version), F.lit(prompt_version), F.lit(model))
    return F.concat(F.lit(provider + ":"), F.sha2(versioned, 256))


def incremental_untagged(
    texts: DataFrame, cache: DataFrame, provider: str, model: str, taxonomy_version: str, prompt_version: str
) -> DataFrame:
    """Texts without a cached tag under exactly this provider, model and pair of versions."""
    keyed = texts.withColumn("cache_key", cache_key(F.col("text"), provider, model, taxonomy_version, prompt_version))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def tag_run(
    observations: DataFrame, texts: DataFrame, run_id: str, cache: DataFrame | None = None,
    taxonomy: Taxonomy = OBSERVATION_TAXONOMY, prompt_version: str = "2.0",
) -> Mapping[str, DataFrame]:
    """Classify each unique text once, reuse cached tags, and attach the result to every occurrence.

    Returns `tags` (cache after the run), `assignments` (run, hash, cache key) and `members`
    (run, observation with its columns): a run covers all observations, so nobody has to fetch them by id.
    """
    provider, model = "rules", "deterministic"
    keyed = texts.withColumn("cache_key", cache_key(F.col("text"), provider, model, taxonomy.version, prompt_version))
    todo = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = classify_observation(todo, taxonomy).select(
        "cache_key", *TAG_COLUMNS, F.lit(False).alias("ai_generated"), F.lit(False).alias("fallback"),
        F.lit("validated").alias("raw_status"),
    )
    tags = fresh if cache is None else cache.select(*fresh.columns).unionByName(fresh)
    run = F.lit(run_id).alias("run_id")
    return {
        "tags": tags,
        "assignments": keyed.select(run, "hash", "cache_key"),
        "members": observations.select(run, "*"),
    }
