"""Arrow UDFs for what Spark's functions cannot express: Unicode folding, the lexical
analyzer and ISO date-times that keep their offset."""

from __future__ import annotations

import unicodedata
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import CJK_ANALYZER


def _cjk(c: str) -> bool:
    return any(low <= ord(c) <= high for low, high in CJK_ANALYZER)


def terms(text: str | None) -> list[str]:
    """Distinct search terms in order of appearance. A CJK run gives each character, followed
    by the pair it begins; a run of other letters and digits is one term, and may hold
    single hyphens inside."""
    folded = unicodedata.normalize("NFKC", text or "").lower()
    kinds = ["c" if _cjk(c) else "w" if c.isalnum() else "-" if c == "-" else " " for c in folded]
    found: dict[str, None] = {}
    run = ""
    for i, (c, kind) in enumerate(zip(folded, kinds, strict=True)):
        after = kinds[i + 1] if i + 1 < len(kinds) else " "
        if kind == "w" or (kind == "-" and run and (after == "w" or after == "c")):
            run += c
            continue
        if run:
            found[run] = None
            run = ""
        if kind == "c":
            found[c] = None
            if after == "c":
                found[c + folded[i + 1]] = None
    if run:
        found[run] = None
    return list(found)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


@F.pandas_udf(ArrayType(StringType()))
def analyzed(texts: pd.Series) -> pd.Series:
    return texts.map(terms)


def iso_datetime(text: str | None) -> str | None:
    """ISO text with its own offset (UTC if it has none), or null if it cannot be parsed."""
    if not text or not text.strip():
        return None
    value = text.strip().replace("Z", "+00:00")
    if "T" not in value:
        value = value.replace(" ", "T", 1)
    try:
        at = datetime.fromisoformat(value)
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).isoformat()


@F.pandas_udf(StringType())
def parsed_datetime(texts: pd.Series) -> pd.Series:
    return texts.map(iso_datetime)
