"""The whole reconciliation: stages, flags, explanations and proof."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomalies, matching, report
from ..shared import growing, interim, keep_rows
from ..sources import sheets
from ..sources.workbooks import write_workbook


@dataclass
class Reconciliation:
    bank: DataFrame
    ledger: DataFrame
    pairs: DataFrame
    paired: DataFrame
    bank_left: DataFrame
    ledger_left: DataFrame

    def totals(self) -> DataFrame:
        return report.totals(self.bank, self.ledger, self.paired, self.bank_left, self.ledger_left)

    def summary(self) -> DataFrame:
        return report.summary(self.totals())

    def summary_sheet(self) -> DataFrame:
        return report.summary_sheet(self.totals())

    def flags(self, config: anomalies.Config = anomalies.Config()) -> DataFrame:
        return anomalies.detect(self.bank, self.ledger, self.pairs, config)

    def reasons_of(self, source: str) -> DataFrame:
        left, others = (self.bank_left, self.ledger) if source == "bank" else (self.ledger_left, self.bank)
        return report.classify(left, others, source).withColumn("source", F.lit(source))

    def reasons(self) -> DataFrame:
        """Those of both sides, each stored before the next begins."""
        out = []
        for source in ("bank", "ledger"):
            with interim() as result:
                out.append(result(self.reasons_of(source), "reasons"))
        return out[0].unionByName(out[1])

    def tabs(self) -> dict[str, DataFrame]:
        """The nine tabs of the report."""
        review = report.review(self.paired)
        reasons = self.reasons()
        left = lambda rows, source: rows.join(reasons.where(F.col("source") == source).select("id", "reason"), "id")
        return {
            "Summary": self.summary_sheet(), "Matched": self.paired,
            "Review - Amount": review["amount"], "Review - Date": review["date"], "Review - Weak Evidence": review["weak"],
            "Unmatched Bank": left(self.bank_left, "bank"), "Unmatched Ledger": left(self.ledger_left, "ledger"),
            "Anomalies": anomaly_rows(self.flags(), self.bank.unionByName(self.ledger)), "Transactions": self.bank.unionByName(self.ledger),
        }

    def write(self, path: str, format: str = "parquet") -> None:
        """One folder a tab; an empty tab keeps its columns."""
        for name, rows in self.tabs().items():
            out = rows if format == "parquet" else rows.select([F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in rows.columns])
            out.write.mode("overwrite").option("header", True).format(format).save(f"{path}/{name.replace(' ', '_')}")

    def write_workbook(self, path: str) -> None:
        """The nine tabs as one workbook, joined from what the tasks wrote."""
        order = {"Summary": ["line"], "Matched": ["bank_id"], "Transactions": ["source", "ord"], "Anomalies": ["flag_id", "place"]}
        write_workbook(self.tabs(), path, order)


def reconcile_files(spark: SparkSession, bank: str, ledger: str, template: str | None = None) -> Reconciliation:
    """The run over files. A file that is on both sides, byte for byte, is refused: it would match
    itself, and the proof would balance without saying anything."""
    if bank == ledger or sheets.same_content(spark, bank, ledger):
        raise ValueError("the same file is on both sides")
    return reconcile(sheets.read_transactions(spark, bank, "bank", template), sheets.read_transactions(spark, ledger, "ledger", template))


def reconcile(bank: DataFrame, ledger: DataFrame) -> Reconciliation:
    """The run. Both sides and what is left of them are stored once, as every stage and tab
    reads them."""
    bank, ledger = keep_rows(bank, "bank"), keep_rows(ledger, "ledger")
    pairs = matching.match(bank, ledger)
    left = (keep_rows(matching.leftovers(side, pairs, column), "left") for side, column in ((bank, "bank_id"), (ledger, "ledger_id")))
    return Reconciliation(bank, ledger, pairs, report.paired(pairs, bank, ledger), *left)


def anomaly_rows(flags: DataFrame, txns: DataFrame) -> DataFrame:
    """One row for each transaction of each flag."""
    members = flags.select("flag_id", "rule", "reason", F.posexplode("members").alias("place", "id"))
    return members.join(growing(txns.select("id", "source", "date", "amount", "description")), "id")
