"""Explanations, review tabs and the balancing proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from .nearest import nearest_plausible

# Fragments of narrations of bank postings, in the order they are tried.
BANK_ORIGINATED = (
    ("chrg", "bank charge"),
    ("charge", "bank charge"),
    ("int.pd", "interest paid by bank"),
    ("int pd", "interest paid by bank"),
    ("interest", "interest"),
    ("gst", "tax debited by bank"),
    ("tds", "tax deducted at source"),
)
FIELDS = ("id", "date", "amount", "description", "reference")


def paired(pairs: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs with both rows' fields, their gaps and what a reviewer should look at."""
    side = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in FIELDS])
    rows = pairs.join(side(bank, "bank"), "bank_id").join(side(ledger, "ledger"), "ledger_id")
    rows = rows.withColumns({"amount_gap": F.col("bank_amount") - F.col("ledger_amount"), "date_gap": money.days_between(F.col("bank_date"), F.col("ledger_date")).cast("long")})
    return rows.withColumn("issue", issue())


def issue() -> Column:
    parts = (
        F.when(F.col("amount_gap") != 0, F.concat(F.lit("amount differs by "), F.abs("amount_gap").cast("decimal(18,2)").cast("string"))),
        F.when(F.col("date_gap") != 0, F.concat(F.lit("booked "), F.col("date_gap").cast("string"), F.lit(" day(s) apart"))),
        F.when(F.col("corroboration") == "amount_and_date_only", F.lit("no shared reference or payee — matched on figures alone")),
    )
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def review(rows: DataFrame) -> dict[str, DataFrame]:
    """The review tabs over paired rows; a pair may be in several."""
    return {"amount": rows.where("amount_gap <> 0"), "date": rows.where("date_gap <> 0"), "weak": rows.where("corroboration = 'amount_and_date_only'")}


def classify(left: DataFrame, others: DataFrame, source: str, days: int = 3) -> DataFrame:
    """left (id, date, amount, description) with `reason`: why a row found no partner, judged
    against all rows of the other side, those already matched too. Same amounts are counted
    before the join; the nearest row of plausible amount comes from nearest_plausible."""
    said = F.lower(F.coalesce("description", F.lit("")))
    where = "not yet booked in the ledger" if source == "bank" else "not on the statement"
    by_bank = F.coalesce(*[F.when(said.contains(f), F.lit(f"{label} — {where}")) for f, label in BANK_ORIGINATED])
    rows = left.select("id", "ord", "date", "amount", "description", by_bank.alias("by_bank"))
    same = others.groupBy(F.col("amount").alias("same_amount")).agg(F.count("*").alias("n"), F.min("date").alias("only_date"))
    rows = rows.join(same, F.col("amount") == F.col("same_amount"), "left")
    settled = F.col("by_bank").isNotNull() | F.col("n").isNotNull()
    rows = rows.join(nearest_plausible(rows.where(~settled), others), ["amount", "date"], "left")
    gap = money.days_between(F.col("date"), F.col("only_date")).cast("string")
    default = F.lit("no counterpart on the ledger side") if source == "bank" else F.when(F.col("amount") > 0, "no counterpart — receipt not yet on the statement").otherwise("no counterpart — payment not yet presented")
    reason = (
        F.when(F.col("by_bank").isNotNull(), F.col("by_bank"))
        .when(F.col("n") > 1, F.concat(F.lit("ambiguous — "), F.col("n").cast("string"), F.lit(" rows on the other side share this amount; none chosen rather than guessing")))
        .when(F.col("n") == 1, F.concat(F.lit("same amount exists on the other side but is dated "), F.col("only_date").cast("string"), F.lit(" ("), gap, F.lit(f" days away, outside the {days}-day window)")))
        .when(F.col("near").isNotNull(), F.concat(F.lit("no exact amount; closest is "), F.col("near.amount").cast("string"), F.lit(" on "), F.col("near.date").cast("string"), F.lit(" ("), F.substring("near.description", 1, 40), F.lit(")")))
        .otherwise(default)
    )
    return rows.select("id", reason.alias("reason"))


SUMMARY_ITEMS = (
    ("Bank transactions", "bank_n", "bank_total"), ("Ledger transactions", "ledger_n", "ledger_total"), ("Difference to explain", None, "difference"),
    ("Matched", "matched_n", None), ("  amounts disagree", "amounts_n", None), ("  booked on different dates", "dates_n", None), ("  matched on figures alone", "weak_n", None),
    ("Bank-only items", "bank_only_n", "bank_only"), ("Ledger-only items", "ledger_only_n", "ledger_only"),
    ("Explained by matched-pair differences", None, "pair_differences"), ("Explained by bank-only items", None, "bank_only"), ("Less ledger-only items", None, "less_ledger"),
    ("Total explained", None, "explained"), ("UNEXPLAINED", None, "unexplained"),
)


def totals(bank: DataFrame, ledger: DataFrame, rows: DataFrame, bank_left: DataFrame, ledger_left: DataFrame) -> DataFrame:
    """The one row of counts and sums that the proof is made of. rows are paired rows."""
    zero = F.lit(0).cast("decimal(28,2)")
    total = lambda c: F.coalesce(F.sum(c), zero).cast("decimal(28,2)")
    side = lambda df, p: df.agg(F.count("*").alias(f"{p}_n"), total("amount").alias(p if p.endswith("only") else f"{p}_total"))
    matched = rows.agg(F.count("*").alias("matched_n"), F.count_if(F.col("amount_gap") != 0).alias("amounts_n"), F.count_if(F.col("date_gap") != 0).alias("dates_n"), F.count_if(F.col("corroboration") == "amount_and_date_only").alias("weak_n"), total("amount_gap").alias("pair_differences"))
    one = side(bank, "bank").crossJoin(side(ledger, "ledger")).crossJoin(matched).crossJoin(side(bank_left, "bank_only")).crossJoin(side(ledger_left, "ledger_only"))
    one = one.withColumns({"difference": F.col("bank_total") - F.col("ledger_total"), "less_ledger": -F.col("ledger_only"), "explained": F.col("pair_differences") + F.col("bank_only") - F.col("ledger_only")})
    return one.withColumn("unexplained", (F.col("difference") - F.col("explained")).cast("decimal(28,2)"))


def summary(one: DataFrame) -> DataFrame:
    """The balancing proof, one row an item; UNEXPLAINED must be 0.00."""
    items = [F.struct(F.lit(i).cast("long").alias("line"), F.lit(name).alias("item"), (F.col(n).cast("long") if n else F.lit(None).cast("long")).alias("count"), (F.col(a).cast("decimal(28,2)") if a else F.lit(None).cast("decimal(28,2)")).alias("amount")) for i, (name, n, a) in enumerate(SUMMARY_ITEMS)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


# The notes of the summary's lines, and after which lines a blank one stands.
SUMMARY_NOTES = {
    "Bank transactions": "net movement on the statement",
    "Ledger transactions": "net movement in the books",
    "Difference to explain": "bank net less ledger net",
    "Matched": "paired between the two documents",
    "  amounts disagree": "see Review - Amount",
    "  booked on different dates": "see Review - Date",
    "  matched on figures alone": "see Review - Weak Evidence",
    "Bank-only items": "on the statement, not in the ledger",
    "Ledger-only items": "in the ledger, not on the statement",
    "UNEXPLAINED": "must be 0.00 — anything else means a row was mismatched, double-counted or dropped",
}
BLANK_AFTER = ("Difference to explain", "Ledger-only items")


def summary_sheet(one: DataFrame) -> DataFrame:
    """The summary as a sheet shows it: line, item, count, amount and note, blank lines between its parts."""
    rows = summary(one)
    note = F.coalesce(*[F.when(F.col("item") == item, F.lit(said)) for item, said in SUMMARY_NOTES.items()], F.lit(""))
    line = {name: i for i, (name, *_) in enumerate(SUMMARY_ITEMS)}
    # a blank line's place is half a line below
    blank = rows.where(F.col("item").isin(*BLANK_AFTER)).select((F.col("line") + 0.5).alias("place"), F.lit("").alias("item"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("decimal(28,2)").alias("amount"), F.lit("").alias("note"))
    every = rows.select(F.col("line").cast("double").alias("place"), "item", "count", "amount", note.alias("note")).unionByName(blank)
    before = sum(((F.col("place") > line[name] + 0.5).cast("long") for name in BLANK_AFTER), F.lit(0))
    return every.select((F.ceil("place") + before).cast("long").alias("line"), "item", "count", "amount", "note")


def citation(kind: Column, page: Column, start: Column, end: Column) -> Column:
    """Where a row was read, as a reviewer would say it."""
    paged = F.coalesce(F.concat(F.lit("page "), page.cast("string"), F.lit(", ")), F.lit(""))
    return (
        F.when(kind == "model_extracted", "read by the model — no source line")
        .when(start.isNull(), "location unknown")
        .when(kind == "sheet_row", F.concat(F.lit("row "), start.cast("string")))
        .when(end.isNotNull() & (end != start), F.concat(paged, F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string")))
        .otherwise(F.concat(paged, F.lit("line "), start.cast("string")))
    )
