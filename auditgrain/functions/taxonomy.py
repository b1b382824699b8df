"""Taxonomies are data: ordered themes with keywords, plus word lists for severity and negation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditgrain.functions.expressions import contains_any, matched

# --- fixed values: theme names and keywords, in matching order ---------------------------------
RISK_THEMES: dict[str, list[str]] = {
    "Data Integrity": ["data integrity", "audit trail", "records were deleted", "falsif"],
    "OOS Investigation": ["oos", "out of specification", "out-of-specification"],
    "CAPA": ["capa", "corrective action", "preventive action"],
    "Documentation": ["documentation", "batch records", "signatures"],
    "Quality Systems": ["quality system", "quality unit", "quality assurance"],
    "Laboratory Controls": ["laboratory", "qc", "calibration"],
    "Manufacturing Controls": ["manufacturing", "production control"],
    "Validation": ["validation", "validated"],
    "Deviation Management": ["deviation", "root cause"],
    "Training": ["training", "trained"],
    "Equipment": ["equipment", "instrument"],
    "Computer Systems": ["computer", "software", "access control"],
}
EXTRA_DATA_INTEGRITY = [
    "contemporaneous", "retrospectiv", "after testing", "original data", "original records",
    "backdat", "records were not retained", "unreliable original records",
]
EXTRA_THEMES: dict[str, list[str]] = {
    "Materials Management": ["raw material", "component receipt", "supplier qualification", "incoming material"],
    "Packaging and Labeling": ["labeling", "labelling", "packaging", "label control"],
    "Cleaning and Sanitation": ["sanitation", "sanitary", "cleaning", "pest", "vermin"],
    "Complaints": ["complaint"],
    "Investigations": ["investigat"],
    "Environmental Monitoring": ["environmental monitoring", "environmental sample"],
    "Sterility Assurance": ["steril", "aseptic", "microbial contamination"],
    "Production and Process Controls": ["process control", "in-process control"],
    "Equipment and Facilities": ["facility", "facilities", "building", "maintenance"],
}
CATEGORY_OF_THEME: dict[str, str] = {
    "Data Integrity": "Records and data integrity",
    "Documentation": "Records and data integrity",
    "Computer Systems": "Records and data integrity",
    "OOS Investigation": "Laboratory controls",
    "Laboratory Controls": "Laboratory controls",
    "CAPA": "Quality management",
    "Quality Systems": "Quality management",
    "Deviation Management": "Quality management",
    "Training": "Personnel and training",
    "Validation": "Production and validation",
    "Manufacturing Controls": "Production and validation",
    "Equipment": "Facilities and equipment",
}
# Severity words of the short rule analysis.
RULE_CRITICAL = ["falsif", "records were deleted", "contamination"]
RULE_HIGH = ["failed", "repeated", "disabled"]
# Severity and negation words of the observation classifier.
OBSERVATION_CRITICAL = [
    "falsif", "records were deleted", "unreliable original records", "contaminated released product",
    "serious contamination", "released contaminated",
]
OBSERVATION_HIGH = ["significant", "systemic", "repeated", "disabled", "not retained", "no investigation", "not established"]
OBSERVATION_LOW = ["isolated", "no product impact"]
SENTENCE_NEGATIONS = ["no evidence of", "no deficiencies", "did not fail", "not observed"]
SEVERITY_NEGATIONS = ["no evidence of", "no deficiencies", "not observed"]
INSTRUCTION_PATTERN = (
    r"(?i)ignore (?:all |the |any )?(?:previous|prior|system) instructions"
    r"|classify (?:this|it|everything) as|system prompt|you are (?:now |an? )|return (?:only )?json"
)
# Severity and negation words of the multi-label rubric.
RUBRIC_CRITICAL = ["falsif", "records were deleted", "contaminated released product"]
RUBRIC_HIGH = ["failed", "repeated", "disabled", "no investigation"]
RUBRIC_LOW = ["isolated administrative", "no product impact"]
RUBRIC_MEDIUM = ["incomplete", "inadequate", "lacked", "not verified", "not establish"]
RUBRIC_NEGATION_PATTERN = (
    r"\b(no evidence|no deficiencies|no failures|did not fail|not observed|without deficiencies)\b"
)
PROHIBITED_RATIONALE_PATTERN = r"(?i)(?:risk score|patient (?:harm|death)|FDA (?:determined|concluded))"
SEVERITY_RANKS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
SEVERITY_WEIGHTS = {"Low": 0.25, "Medium": 0.5, "High": 0.75, "Critical": 1.0}
# --- end of fixed values ------------------------------------------------------------------------

OBSERVATION_THEMES: dict[str, list[str]] = {
    **RISK_THEMES,
    "Data Integrity": RISK_THEMES["Data Integrity"] + EXTRA_DATA_INTEGRITY,
    **EXTRA_THEMES,
}


@dataclass(frozen=True)
class Taxonomy:
    """Everything the tagging operators need to know about a domain."""

    themes: Mapping[str, Sequence[str]] = field(default_factory=lambda: RISK_THEMES)
    rule_critical: Sequence[str] = tuple(RULE_CRITICAL)
    rule_high: Sequence[str] = tuple(RULE_HIGH)
    critical: Sequence[str] = tuple(OBSERVATION_CRITICAL)
    high: Sequence[str] = tuple(OBSERVATION_HIGH)
    low_all: Sequence[str] = tuple(OBSERVATION_LOW)
    negations: Sequence[str] = tuple(SENTENCE_NEGATIONS)
    severity_negations: Sequence[str] = tuple(SEVERITY_NEGATIONS)
    instruction_pattern: str = INSTRUCTION_PATTERN
    category_of_theme: Mapping[str, str] = field(default_factory=lambda: CATEGORY_OF_THEME)
    rubric_critical: Sequence[str] = tuple(RUBRIC_CRITICAL)
    rubric_high: Sequence[str] = tuple(RUBRIC_HIGH)
    rubric_low_all: Sequence[str] = tuple(RUBRIC_LOW)
    rubric_medium: Sequence[str] = tuple(RUBRIC_MEDIUM)
    rubric_negation_pattern: str = RUBRIC_NEGATION_PATTERN
    version: str = "1.0"

    @property
    def names(self) -> list[str]:
        return list(self.themes)

    @property
    def words(self) -> list[str]:
        """All keywords, in theme order, each once."""
        return list(dict.fromkeys(w for words in self.themes.values() for w in words))


RISK_TAXONOMY = Taxonomy()
OBSERVATION_TAXONOMY = Taxonomy(themes=OBSERVATION_THEMES, version="2.2")


def theme_flags(text: Column, taxonomy: Taxonomy) -> dict[str, Column]:
    """One boolean per theme: does any of its keywords occur in the lower-cased text?"""
    low = F.lower(text)
    return {name: F.coalesce(contains_any(low, words), F.lit(False)) for name, words in taxonomy.themes.items()}


def theme_array(text: Column, taxonomy: Taxonomy) -> Column:
    """Ordered multi-label themes of a text; empty for missing text."""
    flags = theme_flags(text, taxonomy)
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def keyword_array(low: Column, taxonomy: Taxonomy) -> Column:
    return matched(low, taxonomy.words)
