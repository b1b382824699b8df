"""Ordered decision table over text, and redaction of secrets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: routing patterns, target names and redaction patterns -------------------------
UNSUPPORTED = r"\b(patient|dosage|dose|diagnos\w*|treatment|pharmacovigilance|adverse.event)\b"
ANALYTIC = r"\b(how many|count|rate|trend|compare|highest|lowest|total|distribution)\b"
ASSESSMENT = r"\b(observations?|findings?|capa|deficien\w*|quality|compliance|inspections?)\b"
RECOMMEND = r"\b(recommend\w*|should|approve|release|compliant|certif\w*|regulatory significance|regulatory impact)\b"
CRITICAL = r"\b(patient harm|falsif\w*|contamination|critical|safety)\b"
SUMMARISE = r"summari[sz]"
TARGETS = {
    "unsupported": "UnsupportedDomainAgent", "analytic": "DataAnalyticsAgent",
    "assessment": "InspectionAssessmentAgent", "reference": "EvidenceAgent",
}
MANDATORY_REVIEW_LEVELS = ("HIGH", "CRITICAL")
REDACTED, REDACTED_URL = "[REDACTED]", "[REDACTED DATABASE URL]"
SECRET_VALUE = r"([\s\"\x27:=]+)(?:Bearer\s+)?[^\s\"\x27,}]+"
HEADER_SECRET = r"(?i)(authorization|x-goog-api-key|x-api-key)" + SECRET_VALUE
DATABASE_URL = r"(?i)(?:postgres(?:ql)?(?:\+psycopg)?://)[^\s]+"
KEY_TOKEN = r"\bsk-[A-Za-z0-9_-]{16,}"
NAMED_SECRETS = ("password", "access[_ -]?key", "api[_ -]?key", "authorization", "bearer")
SENSITIVE_KEYS = r"(?i)password|access_key|api_key|authorization|cookie|token_digest|key_digest"
# --- end of fixed values ------------------------------------------------------------------------


def route_text(df: DataFrame, text: str = "text", require_review: Column | None = None, has_observation: Column | None = None) -> DataFrame:
    """Target, optional second target, domain, task, risk level, review flag and the rules that fired."""
    low = F.lower(text)
    hit = {name: low.rlike(p) for name, p in {
        "unsupported": UNSUPPORTED, "analytic": ANALYTIC, "assessment": ASSESSMENT, "recommend": RECOMMEND,
        "critical": CRITICAL, "summarise": SUMMARISE,
    }.items()}
    if has_observation is not None:
        hit["assessment"] = hit["assessment"] | has_observation
    staged = df.withColumns({f"_{k}": F.coalesce(c, F.lit(False)) for k, c in hit.items()})
    un, an, ass = F.col("_unsupported"), F.col("_analytic"), F.col("_assessment")
    both = ~un & an & ass
    asked = require_review if require_review is not None else F.lit(False)
    risk = F.when(F.col("_critical"), "CRITICAL").when(F.col("_recommend"), "HIGH").when(ass, "MEDIUM").otherwise("LOW")
    high = F.col("risk_level").isin(*MANDATORY_REVIEW_LEVELS)
    rules = F.array_compact(F.array(
        F.when(un, "R1"), F.when(~un & an, "R2"), F.when(both, "M1"), F.when(~un & ass, "R3"),
        F.when(~un & ~an & ~ass, "R4"), F.when(high, "H1"), F.when(asked, "H2"),
    ))
    pick = lambda a, b, c, d: F.when(un, a).when(an, b).when(ass, c).otherwise(d)
    return staged.withColumn("risk_level", risk).withColumns({
        "target": pick(TARGETS["unsupported"], TARGETS["analytic"], TARGETS["assessment"], TARGETS["reference"]),
        "secondary_target": F.when(both, TARGETS["assessment"]),
        "domain": pick("General", "Analytics", "Quality", "Regulatory"),
        "task": F.when(F.col("_recommend"), "Recommend").when(F.contains(low, F.lit("compare")), "Compare")
        .when(an | ass, "Analyse").when(F.col("_summarise"), "Summarise").otherwise("Search"),
        "mandatory_review": high | asked,
        "matched_rules": rules,
    }).drop(*[f"_{k}" for k in hit])


def _named(names: Sequence[str]) -> str:
    return r"(?i)\b(" + "|".join(names) + ")" + SECRET_VALUE


def redact_secrets(c: Column, names: Sequence[str] = NAMED_SECRETS) -> Column:
    """Replace secret values, keeping the name of the key before them. Whole text."""
    out = F.regexp_replace(c, DATABASE_URL, REDACTED_URL)
    out = F.regexp_replace(out, KEY_TOKEN, REDACTED)
    out = F.regexp_replace(out, HEADER_SECRET, "$1$2" + REDACTED)
    return F.regexp_replace(out, _named(names), "$1$2" + REDACTED)


#: A JSON text holds neither of these characters; they stand for two escapes while it is cut into tokens.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_TOKENS = r'"[^"]*+"(?:[ \t\r\n]*+:)?+|[\[\]{}:,]|[^ \t\r\n"\[\]{}:,]++|"'
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_NO_STRING = r"[\x00\x03-\x1f]|\\(?![/bfnrt]|u[0-9a-fA-F]{4})"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hide(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _show(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _plain(token: Column) -> Column:
    """What a string token says; null where it cannot be read."""
    read = F.element_at(F.from_json(F.concat(F.lit("["), _show(token), F.lit("]")), "array<string>"), 1)
    return F.when(token.rlike(r"[\x01\x02\\]"), read).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def _clean_token(token: Column, names: Sequence[str]) -> Column:
    """A string token without secrets; one without any stays as it is written."""

    def written(said: Column) -> Column:
        clean = redact_secrets(said, names)
        listed = F.to_json(F.array(clean))
        return F.when(clean == said, token).otherwise(_hide(F.substring(listed, F.lit(2), F.length(listed) - 2)))

    # one look for all kinds of secrets; most texts hold none
    held = "|".join(f"(?:{p})" for p in (DATABASE_URL, KEY_TOKEN, HEADER_SECRET, _named(names)))
    return _let(_plain(token), lambda said: F.when(said.rlike(held), F.coalesce(written(said), token)).otherwise(token))


def _classed(tokens: Column, pattern: str, names: Sequence[str]) -> Column:
    """Tokens with their kind: a bracket, : or , itself, k a key, S a sensitive one, s another text, v a scalar, x no JSON.

    Keys are the texts with a colon behind them, which belongs to their token. What a text holds is looked
    at here, once, and secrets leave it.
    """

    def one(token: Column) -> Column:
        # a text ends with its quote, so what is trimmed is the colon and the blanks before it
        name = F.rtrim(token, F.lit(" \t\r\n:"))
        spoiled = lambda text: (F.length(text) == 1) | text.rlike(_NO_STRING)
        sensitive = F.coalesce(_plain(name).rlike(pattern), F.lit(False))
        as_is = lambda kind, text=token: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
        key = lambda kind: as_is(kind, F.concat(name, F.lit(":")))
        return (
            F.when(token.isin(*"[]{}:,"), F.struct(token.alias("kind"), token.alias("text")))
            .when(~token.startswith('"'), F.when(token.rlike(_SCALAR), as_is("v")).otherwise(as_is("x")))
            .when(token.endswith(":"), F.when(spoiled(name), as_is("x")).when(sensitive, key("S")).otherwise(key("k")))
            .when(spoiled(token), as_is("x"))
            .otherwise(F.struct(F.lit("s").alias("kind"), _clean_token(token, names).alias("text")))
        )

    return F.transform(tokens, one)


def _json_step(state: Column, token: Column) -> Column:
    """One token further.

    `need` is what may come next: v a value, V that or the end of a list, k a key or the end of an
    object, K a key, a comma after a value, or $ at the end; x after a mistake. It decides first, so that
    a step looks at few conditions and writes one state.

    Spark copies the state of a fold at every step, so it holds no text. Open containers are runs of one
    kind: `inner` and `depth` the innermost, `around` those about it. `hidden` counts the open
    containers of a hidden value that began at token `since`; `secret` tells that the next value is one;
    `cuts` are the tokens of hidden values.
    """
    kind, at, need = token["kind"], state["at"], state["need"]
    inside = state["hidden"] > 0
    grows = kind == state["inner"]
    shrinks = state["depth"] > 1
    outside = F.struct(state["inner"].alias("kind"), state["depth"].alias("depth"))
    empty = ~shrinks & (F.size(state["around"]) == 0)
    below = F.element_at(state["around"], -1)
    cut = lambda since: F.concat(state["cuts"], F.array(F.struct(since.alias("start"), (at + 1).alias("stop"))))
    since = F.when(inside, state["since"]).otherwise(at).alias("since")
    off, ahead = F.lit(False), (at + 1).alias("at")

    def same(need: Column, secret: Column = off, cuts: Column = state["cuts"]) -> Column:
        held = [state[n].alias(n) for n in ("inner", "depth", "around", "hidden")]
        return F.struct(need.alias("need"), *held, since, secret.alias("secret"), ahead, cuts.alias("cuts"))

    wrong = same(F.lit("x"))
    comma = same(F.when(state["inner"] == "{", "K").otherwise("v"))
    key = same(F.lit("v"), ~inside & (kind == "S"))
    value = same(F.when(state["depth"] == 0, "$").otherwise(","), off, F.when(state["secret"], cut(at)).otherwise(state["cuts"]))
    opened = F.struct(
        F.when(kind == "{", "k").otherwise("V").alias("need"), kind.alias("inner"), F.when(grows, state["depth"] + 1).otherwise(1).alias("depth"),
        F.when(grows | (state["depth"] == 0), state["around"]).otherwise(F.concat(state["around"], F.array(outside))).alias("around"),
        F.when(inside | state["secret"], state["hidden"] + 1).otherwise(0).alias("hidden"), since, off.alias("secret"), ahead, state["cuts"].alias("cuts"),
    )
    closed = F.struct(
        F.when(empty, "$").otherwise(",").alias("need"),
        F.when(shrinks, state["inner"]).when(empty, "").otherwise(below["kind"]).alias("inner"),
        F.when(shrinks, state["depth"] - 1).when(empty, 0).otherwise(below["depth"]).alias("depth"),
        F.when(shrinks | empty, state["around"]).otherwise(F.slice(state["around"], F.lit(1), F.size(state["around"]) - 1)).alias("around"),
        F.when(inside, state["hidden"] - 1).otherwise(state["hidden"]).alias("hidden"), since, off.alias("secret"), ahead,
        F.when(state["hidden"] == 1, cut(state["since"])).otherwise(state["cuts"]).alias("cuts"),
    )
    ends = (kind == "}") & (state["inner"] == "{") | (kind == "]") & (state["inner"] == "[")
    return (
        F.when(need == ",", F.when(kind == ",", comma).when(ends, closed).otherwise(wrong))
        .when((need == "v") | (need == "V"), F.when((kind == "s") | (kind == "v"), value).when((kind == "{") | (kind == "["), opened).when((kind == "]") & (need == "V"), closed).otherwise(wrong))
        .when((need == "k") | (need == "K"), F.when((kind == "k") | (kind == "S"), key).when((kind == "}") & (need == "k"), closed).otherwise(wrong))
        .otherwise(wrong)
    )


def _masked(tokens: Column, cuts: Column) -> Column:
    """The tokens as one text, every cut replaced."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["stop"]))
    stops = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(F.size(tokens)))
    between = F.zip_with(starts, stops, lambda a, b: F.array_join(F.transform(F.slice(tokens, a + 1, b - a), lambda t: t["text"]), ""))
    return F.array_join(between, f'"{REDACTED}"')


def redact_json_keys(c: Column, pattern: str = SENSITIVE_KEYS, names: Sequence[str] = NAMED_SECRETS) -> Column:
    """Mask the values of sensitive keys in a JSON text at any depth, in objects and lists, and clean other texts.

    The text is cut into tokens and a fold over them carries the open containers and whether the key in
    force is sensitive, so depth has no limit. Everything but masked values and texts that hold a secret
    stays as it is written, blanks between tokens apart: long numbers, repeated keys, unpaired escapes.
    A text that is no JSON is cleaned as a text; null stays null.
    """
    start = F.struct(
        F.lit("v").alias("need"), F.lit("").alias("inner"), F.lit(0).alias("depth"), F.array().cast("array<struct<kind:string,depth:int>>").alias("around"),
        F.lit(0).alias("hidden"), F.lit(0).alias("since"), F.lit(False).alias("secret"), F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("cuts"),
    )
    found = F.regexp_extract_all(_hide(c), F.lit(_TOKENS), F.lit(0))
    classed = _let(found, lambda tokens: _classed(tokens, pattern, names))
    whole = _let(classed, lambda tokens: F.aggregate(
        tokens, start, _json_step, lambda state: F.when(state["need"] == "$", _show(_masked(tokens, state["cuts"])))
    ))
    clean = redact_secrets(c, names)
    # without sensitive words, escapes and blanks between tokens a text stays what it is, JSON or not
    plain = ~c.rlike(pattern) & ~F.contains(c, F.lit("\\")) & ~F.regexp_replace(c, '"[^"]*+"', "").rlike(r"[ \t\r\n]") & (clean == c)
    return F.when(plain, c).when(c.rlike(r"[\x01\x02]"), clean).otherwise(F.coalesce(whole, clean))
