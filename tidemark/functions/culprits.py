"""What a culprit text says: feature, direction, sigma, per cent, and the family of the feature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dimensions import FAMILY_WORDS


# The grammar of a culprit's text, "name (SPIKE (+865%), σ=4.2)", in any case. What can't be read is
# 'unknown', 'UNKNOWN' or 0; a number that isn't one ("1.2.3") counts as what can't be read.
NAME = r"(?i)^([a-z_][a-z0-9_]*)"
EVENT = r"(?i)\b(SPIKE|DROP)\b"
SIGMA = r"(?i)σ\s*=\s*([\d.]+)"
PERCENT = r"(?i)(?:SPIKE|DROP)\s*\(([+-]?[\d.]+)%\)"
BLANK = r"^\s+"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)


def base_name(text: Column) -> Column:
    found = F.lower(_found(F.regexp_replace(text, BLANK, ""), NAME))
    return F.when(found == "", "unknown").otherwise(found)


def event_type(text: Column) -> Column:
    found = F.upper(_found(text, EVENT))
    return F.when(found == "", "UNKNOWN").otherwise(found)


def sigma(text: Column) -> Column:
    return F.coalesce(_found(text, SIGMA).try_cast("double"), F.lit(0.0))


def percent(text: Column) -> Column:
    return F.coalesce(F.abs(_found(text, PERCENT).try_cast("double")), F.lit(0.0))


def family(name: Column, consensus: Column) -> Column:
    """The consensus family where there is one, else the first whose words the name holds."""
    told = F.lower(F.trim(consensus))
    guess = F.lit("unknown")
    for fam, words in reversed(FAMILY_WORDS.items()):
        guess = F.when(name.rlike("|".join(words)), fam).otherwise(guess)
    return F.when(told != "", told).otherwise(guess)


def family_sql(name: str, consensus: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({name}, '{'|'.join(words)}') THEN '{fam}'" for fam, words in FAMILY_WORDS.items())
    return f"CASE WHEN lower(trim({consensus})) <> '' THEN lower(trim({consensus})) {cases} ELSE 'unknown' END"
