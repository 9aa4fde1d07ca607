"""Streaming counterparts: candidates and duplicates while rows arrive.

State is bounded by watermarks; rows later than those are left to the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized


def exact_candidates(bank: DataFrame, ledger: DataFrame, days: int = 3, late: str = "2 days") -> DataFrame:
    """Stream-stream join of equal amounts dated within `days`; ts is a row's event time."""
    b = bank.select(F.col("id").alias("bank_id"), F.col("amount").alias("bank_amount"), F.col("ts").alias("bank_ts")).withWatermark("bank_ts", late)
    r = ledger.select(F.col("id").alias("ledger_id"), F.col("amount").alias("ledger_amount"), F.col("ts").alias("ledger_ts")).withWatermark("ledger_ts", late)
    near = F.expr(f"ledger_ts BETWEEN bank_ts - INTERVAL {days} DAYS AND bank_ts + INTERVAL {days} DAYS")
    return b.join(r, (F.col("bank_amount") == F.col("ledger_amount")) & near)


def duplicates(txns: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sessions of equal source, amount and description with more than one row."""
    rows = txns.withWatermark("ts", late).withColumn("what", normalized(F.coalesce("description", F.lit(""))))
    session = F.session_window("ts", window)
    return rows.groupBy("source", "amount", "what", session).agg(F.count("*").alias("n"), F.collect_list("id").alias("members")).where("n > 1")
