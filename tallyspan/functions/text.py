"""Text evidence between two transactions, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand on both sides of most records and name nobody.
BOILERPLATE = (
    "neft", "rtgs", "imps", "upi", "chq", "cheque", "dep", "deposit", "wdl",
    "withdrawal", "trf", "transfer", "payment", "paymt", "payt", "paid", "pymt",
    "to", "from", "for", "by", "of", "the", "and", "a", "an", "ref", "no",
    "ltd", "limited", "pvt", "private", "inc", "co", "company", "corp",
    "bank", "account", "ac", "credit", "debit", "cr", "dr", "amt", "amount",
    "traders", "trading", "enterprises", "enterprise", "services", "solutions",
    "industries", "supplies", "associates", "agencies", "stores", "sons",
)
NO_NARRATION = "(no narration)"
MIN_TOKEN = 3
MIN_PREFIX = 4
#: A narration alone never reaches the certainty of an equal reference.
MOST_WITHOUT_REFERENCE = 0.99


def normalized(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def distinctive_tokens(text: Column) -> Column:
    """The distinct words of a narration that can identify a counterparty."""
    words = F.regexp_extract_all(normalized(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"))
    # told word by word: array_except would make a set of the stop words anew for every row
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN) & ~w.isin(*BOILERPLATE)))


def tokens_correspond(a: Column, b: Column) -> Column:
    """Equal words, or one that opens the other when both have four letters or more."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= MIN_PREFIX) & (a.startswith(b) | b.startswith(a)))


def token_dice(a: Column, b: Column) -> Column:
    """Share of both token sets that corresponds to something on the other side."""
    hits = lambda x, y: F.size(F.filter(x, lambda t: F.exists(y, lambda u: tokens_correspond(t, u))))
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise((hits(a, b) + hits(b, a)) / total)


def any_correspond(a: Column, b: Column) -> Column:
    return F.exists(a, lambda t: F.exists(b, lambda u: tokens_correspond(t, u)))


def reference_forms(reference: Column, others: Column) -> Column:
    """Comparable forms of all identifiers of a row; numbers also without leading zeros."""
    given = F.concat(F.array(reference), F.coalesce(others, F.array().cast("array<string>")))
    forms = F.filter(F.transform(F.filter(given, lambda x: x.isNotNull()), normalized), lambda x: x != "")
    bare = F.transform(F.filter(forms, lambda x: x.rlike(r"^[0-9]+$")), lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0")))
    return F.array_distinct(F.concat(forms, bare))


def references_match(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def same_reference(a: Column, b: Column) -> Column:
    """Both rows have a reference, and the same one up to case and spacing."""
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    return given(a) & given(b) & F.coalesce(normalized(a) == normalized(b), F.lit(False))


def ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def character_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of normalised texts, for rows without any distinctive
    word: no built-in function computes it, so only such rows may reach it."""
    ratio = F.pandas_udf(_ratio, "double")
    return ratio(normalized(F.coalesce(a, F.lit(""))), normalized(F.coalesce(b, F.lit(""))))
