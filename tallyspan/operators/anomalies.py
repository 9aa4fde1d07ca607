"""Audit flags over all transactions of both sides."""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..shared import growing, interim, keep_rows
from .folds import fold_islands, numbered


@dataclass(frozen=True)
class Config:
    duplicate_window: int = 1
    thresholds: tuple[int, ...] = (50_000, 100_000, 200_000)
    margin: str = "0.02"
    round_unit: int = 1_000
    round_least: int = 10_000
    round_most_share: str = "0.30"
    mirrored_window: int = 3
    gap_days: int = 14


def percent(share: Column) -> Column:
    """A whole percentage, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def duplicate_rows(txns: DataFrame, window: int = 1) -> DataFrame:
    """source, amount, what, chain, n, id, date and ord of every row of a duplicate cluster: rows of one
    source with equal amount and description, each within `window` days of the one before. Chains
    are told by days alone, so a task orders at most one row a day and key, and a cluster's
    rows stay rows, however many they are. Rows without a date belong to the first chain."""
    keys = ["source", "amount", "what"]
    rows = keep_rows(txns.select("source", "amount", normalized(F.coalesce("description", F.lit(""))).alias("what"), "id", "date", "ord"), "said")
    per_day = rows.groupBy(*keys, "date").agg(F.count("*").alias("here"))
    chains = numbered(per_day, keys, window).withColumnRenamed("island", "chain")
    # only keys with two rows or more go further
    sized = chains.withColumn("n", F.sum("here").over(Window.partitionBy(*keys, "chain"))).where("n > 1").drop("here")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*keys, "date")]
    return rows.alias("r").join(sized.alias("c"), same).select(*[f"r.{c}" for c in keys], "chain", "n", "r.id", "r.date", "r.ord")


def duplicate_clusters(txns: DataFrame, window: int = 1) -> DataFrame:
    """source, amount, what, members (ids by date and input), dates: the clusters of duplicate_rows, each
    as one row, since a flag names its members."""
    keys = ["source", "amount", "what"]
    grouped = duplicate_rows(txns, window).groupBy(*keys, "chain").agg(F.sort_array(F.collect_list(F.struct("date", "ord", "id"))).alias("rows"))
    return grouped.select(*keys, F.transform("rows", lambda r: r["id"]).alias("members"), F.transform("rows", lambda r: r["date"]).alias("dates"), F.element_at("rows", 1)["ord"].alias("first"))


def duplicate_reason(window: int) -> Column:
    dates = F.array_join(F.transform("dates", lambda d: d.cast("string")), ", ")
    return F.concat(F.size("members").cast("string"), F.lit(" transactions with identical amount ("), F.col("amount").cast("string"), F.lit(f") and matching description within {window} day(s) of each other (dates: "), dates, F.lit(") — possible duplicate payment."))


def collapse_duplicates(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """clusters with kind: `both` for a bank cluster all of whose rows are matched to exactly
    the rows of a ledger cluster (members of both, the ledger's own row goes), else `one_side`."""
    b = clusters.where("source = 'bank'").withColumn("key", F.array_sort("members"))
    r = clusters.where("source = 'ledger'").withColumn("key", F.array_sort("members"))
    legs = b.select("key", F.explode("members").alias("bank_id")).join(pairs.select("bank_id", "ledger_id"), "bank_id", "left")
    other = legs.groupBy("key").agg(F.array_sort(F.collect_set("ledger_id")).alias("other"), F.count_if(F.col("ledger_id").isNull()).alias("open")).where("open = 0")
    mirrored = other.join(r.select(F.col("key").alias("other"), F.col("members").alias("ledger_members")), "other").select("key", "other", "ledger_members")
    merged = b.join(mirrored.select("key", "ledger_members"), "key", "left")
    kind = lambda c: F.when(c.isNotNull(), "both").otherwise("one_side")
    bank_rows = merged.select("source", "amount", "what", F.concat("members", F.coalesce("ledger_members", F.array().cast("array<string>"))).alias("members"), "dates", "first", kind(F.col("ledger_members")).alias("kind"))
    alone = r.join(mirrored.select(F.col("other").alias("key")), "key", "left_anti").select("source", "amount", "what", "members", "dates", "first", F.lit("one_side").alias("kind"))
    return bank_rows.unionByName(alone)


def threshold_avoidance(txns: DataFrame, thresholds=(50_000, 100_000, 200_000), margin: str = "0.02") -> DataFrame:
    """Rows just below an approval threshold: the first in the list that they are below."""
    size, share = F.abs("amount"), F.lit(margin).cast("decimal(4,2)")
    below = F.array_compact(F.array(*[F.when((size >= F.lit(t).cast("decimal(18,2)") * (1 - share)) & (size < t), F.lit(t)) for t in thresholds]))
    rows = txns.withColumn("threshold", F.get(below, F.lit(0))).where("threshold IS NOT NULL")
    reason = F.concat(F.lit("Amount "), size.cast("string"), F.lit(" is just below the "), F.col("threshold").cast("string"), F.lit(" approval threshold (within "), percent(share), F.lit(")."))
    return rows.withColumn("reason", reason)


def round_numbers(txns: DataFrame, unit: int = 1_000, least: int = 10_000, most_share: str = "0.30") -> DataFrame:
    """Exact multiples of `unit`, unless such amounts are common: over all eligible rows of
    both sides, a share above `most_share` silences the rule."""
    size = F.abs("amount")
    eligible = txns.where(size >= least).withColumn("is_round", size % unit == 0)
    share = eligible.agg(F.try_divide(F.count_if("is_round"), F.count("*")).alias("share"))
    rows = eligible.where("is_round").crossJoin(F.broadcast(share)).where(F.col("share") <= float(most_share))
    reason = F.concat(F.lit("Amount "), size.cast("string"), F.lit(f" is an exact multiple of {unit}, which is unusual here ("), percent(F.col("share")), F.lit(" of comparable entries are round)"))
    return rows.withColumn("reason", reason).drop("is_round")


def mirrored_entries(txns: DataFrame, window: int = 3) -> DataFrame:
    """source, positive_id, negative_id: each inflow, by date, takes the first unused outflow
    of the same size within `window` days, in one pass over each size's rows by date."""
    rows = txns.select("source", "id", "ord", "date", F.abs("amount").alias("size"), (F.col("amount") > 0).alias("inflow")).where("size <> 0")
    both = rows.groupBy("source", "size").agg(F.min("inflow").alias("a"), F.max("inflow").alias("b")).where("a <> b").select("source", "size")
    rows = keep_rows(rows.join(both, ["source", "size"]), "sizes")
    result = "source string, positive_id string, negative_id string, size decimal(18,2)"
    return fold_islands(rows, "source string, size decimal(18,2)", window, ["date", "ord", "id"], result, lambda group: mirror(group, window), "inflow", "negative_id")


def mirror(rows: Iterator[dict], window: int) -> Iterable[tuple]:
    """The mirrored pairs of one island: outflows stand in a queue by date and order."""
    span, waiting, outflows = datetime.timedelta(window), deque(), deque()

    def due(date) -> Iterator[tuple]:
        while waiting and (date is None or date > waiting[0]["date"] + span):
            row = waiting.popleft()
            while outflows and outflows[0]["date"] < row["date"] - span:
                outflows.popleft()
            if outflows:
                yield row["source"], row["id"], outflows.popleft()["id"], row["size"]

    for row in rows:
        yield from due(row["date"])
        (waiting if row["inflow"] else outflows).append(row)
    yield from due(None)


def timing_gaps(txns: DataFrame, days: int = 14, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Consecutive dates of a source that lie `days` or more apart, with the last row before
    and the first row after. Rows are first reduced to their dates, so what one task orders
    is at most one row a day."""
    per_day = txns.groupBy(*by, "date").agg(F.min_by("id", "ord").alias("first_id"), F.max_by("id", "ord").alias("last_id"))
    order = Window.partitionBy(*by).orderBy("date")
    rows = per_day.withColumn("before", F.lag("date").over(order)).withColumn("before_id", F.lag("last_id").over(order))
    gap = F.datediff("date", "before")
    return rows.where(gap >= days).select(*by, "before_id", F.col("first_id").alias("after_id"), F.col("before").alias("from_date"), F.col("date").alias("to_date"), gap.cast("long").alias("gap_days"))


def detect(bank: DataFrame, ledger: DataFrame, pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """flag_id, rule, reason, members of all rules over matched and unmatched rows, in report
    order: merged duplicates, other duplicates, then per source mirrored entries and gaps,
    then thresholds and round numbers."""
    txns = bank.unionByName(ledger)
    side = lambda source: F.when(source == "bank", 0).otherwise(1)
    both = F.concat((F.size("members") / 2).cast("int").cast("string"), F.lit(" payments of the same amount and description, recorded identically on both sides"))
    # each rule's flags are stored before the next rule begins, so that the disk holds one rule's work at a time
    with interim() as result:
        found = collapse_duplicates(keep_rows(duplicate_clusters(txns, config.duplicate_window), "clusters"), pairs)
        found = found.select(F.lit("duplicate_payment").alias("rule"), F.when(F.col("kind") == "both", both).otherwise(duplicate_reason(config.duplicate_window)).alias("reason"), "members", F.when(F.col("kind") == "both", 0).otherwise(1).alias("rank"), side(F.col("source")).alias("side"), "first")
        flags = [result(found, "duplicates")]
    with interim() as result:
        mirrored = mirrored_entries(txns, config.mirrored_window).join(growing(txns.select(F.col("id").alias("positive_id"), F.col("ord").alias("first"))), "positive_id")
        mirrored = mirrored.select(F.lit("reversed_mirrored_entry").alias("rule"), F.concat(F.lit("Equal and opposite amounts of "), F.col("size").cast("string"), F.lit(f" within {config.mirrored_window} day(s).")).alias("reason"), F.array("positive_id", "negative_id").alias("members"), F.lit(2).alias("rank"), side(F.col("source")).alias("side"), "first")
        flags.append(result(mirrored, "mirrored"))
    gaps = timing_gaps(txns, config.gap_days)
    flags.append(gaps.select(F.lit("unusual_timing_gap").alias("rule"), F.concat(F.col("gap_days").cast("string"), F.lit("-day gap between transactions on "), F.col("from_date").cast("string"), F.lit(" and "), F.col("to_date").cast("string")).alias("reason"), F.array("before_id", "after_id").alias("members"), F.lit(3).alias("rank"), side(F.col("source")).alias("side"), F.unix_date("from_date").cast("long").alias("first")))
    for rank, rule, rows in ((4, "just_below_approval_threshold", threshold_avoidance(txns, config.thresholds, config.margin)), (5, "round_number_entry", round_numbers(txns, config.round_unit, config.round_least, config.round_most_share))):
        flags.append(rows.select(F.lit(rule).alias("rule"), "reason", F.array("id").alias("members"), F.lit(rank).alias("rank"), side(F.col("source")).alias("side"), F.col("ord").alias("first")))
    out = flags[0]
    for more in flags[1:]:
        out = out.unionByName(more)
    # an identifier that needs no global order: the flag's own contents
    return out.withColumn("flag_id", F.substring(F.sha2(F.concat_ws("|", "rule", F.array_join("members", ",")), 256), 1, 12))
