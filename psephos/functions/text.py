"""Names and small vocabularies."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from psephos.functions.nulls import clean_text, col, collapse_text, truthy

#: Labels that name no particular party; fixed values.
GENERIC_LABELS = ("alliance", "coalition", "list", "independent", "others", "other", "party", "movement", "front")
#: Normalised ballot labels of low value; fixed values.
LOW_VALUE_LABELS = ("independent", "mixed vote", "against all", "nul")
#: Patterns of answers that are no party; fixed values.
NON_PARTY_PATTERNS = (
    r"\bother\b", r"\bblank\b", r"\bblanc\b", r"\bblanco\b", r"\bnulo\b", r"\bnull\b", r"\bspoiled\b", r"\binvalid\b", r"\bdid not vote\b",
    r"\bdidn['’]?t vote\b", r"\bdon['’]?t know\b", r"\bdk\b", r"\brefus", r"\brefuse", r"\bnone\b", r"\bno party\b", r"\bwhite ballot\b",
    r"\banother party\b", r"\bmaggioritario\b", r"\bmajoritarian\b", r"\bnot eligible\b",
)
#: Roles that say nothing, and words that make a role clear; fixed values.
UNCLEAR_ROLES = ("?", "many leader", "chamber of deputies", "l")
CLEAR_ROLE_WORDS = ("leader", "lead candidate", "candidate", "president", "prime minister", "top candidate", "chair")
#: Words for genders and truth values; fixed values.
MALE = ("m", "male", "man", "masculine")
FEMALE = ("f", "female", "woman", "feminine")
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
#: Characters that betray UTF-8 read as Latin-1; fixed values.
MOJIBAKE_MARKS = ("Ã", "â", "ð", "Ð", "Å", "Ä")


def norm_name(x: Column | str) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one space; accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(collapse_text(x)), "[^a-z0-9]+", " "))


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _marks(text: str) -> int:
    """How many of the marks occur."""
    return sum(m in text for m in MOJIBAKE_MARKS)


def _repair(text: str | None) -> str | None:
    if not text or not (before := _marks(text)):
        return text
    for codec in ("latin-1", "cp1252"):  # the first reading with fewer marks is taken
        try:
            other = text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        if _marks(other) < before:
            return other
    return text


@F.pandas_udf(StringType())
def ascii_fold(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks (no built-in does that)."""
    return x.map(_fold, na_action="ignore")


@F.pandas_udf(StringType())
def repair_mojibake(x: pd.Series) -> pd.Series:
    """Text that was UTF-8 but was read as Latin-1 or Windows-1252, read again."""
    return x.map(_repair, na_action="ignore")


def match_name(x: Column | str) -> Column:
    """Folded name for matching: '&' is 'and', everything but a-z and 0-9 is a space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(ascii_fold(clean_text(x))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def repaired_name(x: Column | str) -> Column:
    """The name for matching of a text that may have been read in the wrong encoding."""
    return match_name(repair_mojibake(clean_text(x)))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1; 0 if either side is empty. The order of the arguments matters slightly."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def is_generic_label(x: Column | str) -> Column:
    text = F.lower(collapse_text(x))
    return (text == "") | text.isin(*GENERIC_LABELS)


def is_non_party(*xs: Column | str) -> Column:
    """Whether any of the names, taken together, looks like an answer that is no party."""
    joined = F.concat_ws(" | ", *(F.nullif(clean_text(x), F.lit("")) for x in xs))
    return (joined != "") & F.lower(joined).rlike("|".join(NON_PARTY_PATTERNS))


def is_low_value_label(normal: Column | str) -> Column:
    return col(normal).isin(*LOW_VALUE_LABELS)


def is_missing_label(x: Column | str) -> Column:
    return clean_text(x) == ""


def several_persons(x: Column | str) -> Column:
    text = F.lower(clean_text(x))
    return text.isin("m/f", "f/m") | text.rlike("[/;]| and | & ")


def unclear_role(x: Column | str) -> Column:
    text = F.lower(clean_text(x))
    return (text != "") & (text.isin(*UNCLEAR_ROLES) | ~text.rlike("|".join(CLEAR_ROLE_WORDS)))


def male1(x: Column | str) -> Column:
    """1 for male, 0 for female, else NULL. A text that merely contains 'male' counts as male unless it contains 'female'."""
    text = F.lower(clean_text(x))
    return (
        F.when(text.isin(*MALE), 1.0).when(text.isin(*FEMALE), 0.0).when(text.contains("male") & ~text.contains("female"), 1.0)
    )


def bool_like(x: Column | str) -> Column:
    text = F.lower(clean_text(col(x).cast("string")))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def election_key(region: Column | str, year: Column | str) -> Column:
    """First four characters of the region and the year, lower case, without spaces; NULL without a year."""
    name = F.trim(F.replace(F.coalesce(col(region), F.lit("")), F.lit("\u00a0"), F.lit(" ")))
    return F.lower(F.replace(F.concat(F.substring(name, 1, 4), F.rint(col(year).cast("double")).cast("bigint").cast("string")), F.lit(" "), F.lit("")))


def joined_key(*xs: Column | str) -> Column:
    """Parts joined by bars, missing parts empty."""
    return F.concat_ws("|", *(F.coalesce(col(x).cast("string"), F.lit("")) for x in xs))


def party_label(short: Column | str, name: Column | str) -> Column:
    """'SHORT, Name', or the name alone."""
    s, n = clean_text(short), clean_text(name)
    return F.when(s == "", n).otherwise(F.concat(s, F.lit(", "), n))


def contains_any(x: Column | str, parts: tuple[str, ...]) -> Column:
    """Whether the text holds one of the fixed parts; one expression, however many there are."""
    return truthy(col(x).rlike("|".join(map(re.escape, parts))))


def labelled_lines(values: dict[str, Column]) -> Column:
    """'Label: value' lines for what is not missing, as a request to a provider holds them."""
    return F.concat_ws("\n", *(F.when(clean_text(v) != "", F.concat(F.lit(f"{label}: "), clean_text(v))) for label, v in values.items()))
