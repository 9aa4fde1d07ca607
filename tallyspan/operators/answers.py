"""What language models are asked and answer, as column expressions: no model is needed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import money

ROWS = "array<struct<date:string,description:string,reference:string,debit:string,credit:string,balance:string>>"
CONFIRMATION = "struct<is_match:boolean,confidence:double,reasoning:string>"


def _json(text: Column, pattern: str, schema: str, strict: bool, what: str) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    said = F.concat(F.lit(f"no {what} in the answer: "), F.substring(F.coalesce(text, F.lit("null")), 1, 200))
    if not strict:
        return F.from_json(found, schema)
    return F.from_json(F.coalesce(found, F.raise_error(said).cast("string")), schema, {"mode": "FAILFAST"})


def rows_of(text: Column, schema: str = ROWS, strict: bool = True) -> Column:
    """The array of rows in an answer, from its first [ to its last ]: bare, in an object, or
    between fences. An answer without one raises; if not strict, it gives null."""
    return _json(text, r"(?s)\[.*\]", schema, strict, "JSON array")


def confirmation_of(text: Column, strict: bool = True) -> Column:
    """is_match, confidence and reasoning of an answer, from its first { to its last }."""
    return _json(text, r"(?s)\{.*\}", CONFIRMATION, strict, "JSON object")


def question() -> Column:
    """What a model is asked about a pair of bank_* and ledger_* columns. Figures have two
    decimals, and all differences are given, so that none has to be reckoned."""
    side = lambda p: F.concat_ws(
        "\n",
        F.concat(F.lit(f"{p.title()} row"), F.lit("\n- says: "), F.coalesce(f"{p}_description", F.lit(""))),
        F.concat(F.lit("- reference: "), F.coalesce(F.nullif(F.col(f"{p}_reference"), F.lit("")), F.lit("none"))),
        F.concat(F.lit("- amount: "), F.col(f"{p}_amount").cast(money.AMOUNT).cast("string")),
        F.concat(F.lit("- date: "), F.col(f"{p}_date").cast("string")),
    )
    gap = F.abs(F.col("bank_amount") - F.col("ledger_amount")).cast(money.AMOUNT)
    share = F.when(F.col("bank_amount") == 0, F.lit("n/a")).otherwise(F.concat((gap * 100 / F.abs("bank_amount")).cast("decimal(18,2)").cast("string"), F.lit("%")))
    days = money.days_between(F.col("bank_date"), F.col("ledger_date")).cast("string")
    return F.concat_ws(
        "\n",
        F.lit("Do these two records describe one payment?"),
        side("bank"),
        side("ledger"),
        F.concat(F.lit("They differ by "), gap.cast("string"), F.lit(" ("), share, F.lit(" of the bank's amount) and "), days, F.lit(" day(s).")),
        F.lit('Answer with one JSON object: {"reasoning": text, "is_match": true or false, "confidence": 0 to 1}'),
    )
