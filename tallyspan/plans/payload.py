"""A run as JSON: one entry a row, by section, so that a run of any size is written by tasks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import growing, interim, keep
from .reconcile import Reconciliation

SECTIONS = ("summary", "matched", "unmatched_bank", "unmatched_ledger", "anomalies")
FIELDS = ("id", "date", "amount", "description", "reference")


def sections(run: Reconciliation, names: Iterable[str] = SECTIONS) -> dict[str, DataFrame]:
    """section and body (JSON) of everything that a client of a run reads in these sections, a frame each.
    What a section needs beside the run's tables is stored when its work is done, so that
    the shuffles of one don't lie on the disk beside those of the next."""
    fields = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in FIELDS])
    body = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    named = lambda rows, section, *columns: rows.select(F.lit(section).alias("section"), body(*columns).alias("body"))
    names, out = set(names), {}
    if "summary" in names:
        figures = [F.col("bank_total"), F.col("bank_n").alias("bank_count"), F.col("ledger_total"), F.col("ledger_n").alias("ledger_count"), F.col("difference"), F.col("unexplained")]
        out["summary"] = named(keep(run.totals(), "totals"), "summary", *figures)
    if "matched" in names:
        matched = run.paired.withColumns({"bank": fields("bank"), "ledger": fields("ledger")})
        out["matched"] = named(matched, "matched", "bank", "ledger", "rule", "corroboration", "issue")
    for section, source, rows in (("unmatched_bank", "bank", run.bank_left), ("unmatched_ledger", "ledger", run.ledger_left)):
        if section in names:
            with interim() as result:
                reasons = result(run.reasons_of(source).select("id", "reason"), "reasons")
            out[section] = named(rows.join(reasons, "id"), section, *FIELDS, "reason")
    if "anomalies" in names:
        flags = run.flags()
        txns = run.bank.unionByName(run.ledger).select(*FIELDS)
        members = flags.select("flag_id", F.posexplode("members").alias("place", "id")).join(growing(txns), "id")
        members = members.groupBy("flag_id").agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*FIELDS).alias("t")))).alias("ts"))
        flagged = flags.select("flag_id", "rule", "reason").join(members, "flag_id").withColumn("transactions", F.transform("ts", lambda x: x["t"]))
        out["anomalies"] = named(flagged, "anomalies", "rule", "reason", "transactions")
    return out


def entries(run: Reconciliation, names: Iterable[str] = SECTIONS) -> DataFrame:
    """section and body (JSON) of everything that a client of a run reads in these sections."""
    return reduce(DataFrame.unionByName, sections(run, names).values())


def write(run: Reconciliation, path: str) -> None:
    """Files of JSON lines, a folder for each section."""
    entries(run).write.mode("overwrite").partitionBy("section").text(path)


def headline(parts: dict[str, DataFrame]) -> DataFrame:
    """The one row of figures that a run is listed by, from its sections. Each is counted by
    itself, so no body is made but the summary's."""
    out = parts["summary"].agg(*[F.max(F.get_json_object("body", f"$.{c}")).cast("decimal(28,2)").alias(c) for c in ("difference", "unexplained")])
    for name in SECTIONS[1:]:
        out = out.crossJoin(keep(parts[name].agg(F.count("*").alias(name)), "counts"))
    return out.select(*SECTIONS[1:], "difference", "unexplained")
