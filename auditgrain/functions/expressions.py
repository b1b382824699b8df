"""Column helpers shared by the operators. Everything stays inside Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points Python's str.split() treats as blank and Java's \s does not.
_BLANK = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Collapse every run of Unicode blanks to one space and strip the ends."""
    return F.trim(F.regexp_replace(col(c), _BLANK, " "))


def strip(c: Column | str) -> Column:
    """Strip Unicode blanks from both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimiser may copy an ordinary projected expression into every filter and projection above
    it; a deep formula then grows with each copy. It does not look through a generator, so these
    columns are evaluated once per row and are plain attributes from here on.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def known_ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Ratio over known rows; null, never zero, when nothing is known."""
    return F.round(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), digits)


def count_if(condition: Column) -> Column:
    """How many rows satisfy the condition; unknown counts as no."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when any of the literal words is a substring."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def matched(text: Column, words: Iterable[str]) -> Column:
    """Array of the literal words found, in the given order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def literal_pattern(words: Iterable[str]) -> str:
    """Alternation of literal words for rlike."""
    return "|".join(re.escape(w) for w in words)


def reasons(*conditions: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in conditions]))


def first_row(columns: Sequence[str], order: Sequence[Column]) -> Column:
    """Aggregate keeping, of each group, the columns of the row that sorts first.

    A partial aggregate: a group with a third of all rows is reduced map-side.
    """
    return F.min_by(F.struct(*columns), F.struct(*order))


def month_index(month: Column) -> Column:
    """`YYYY-MM` as a running month number."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def month_label(index: Column) -> Column:
    label = F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))
    return F.when(index.isNotNull(), label)
