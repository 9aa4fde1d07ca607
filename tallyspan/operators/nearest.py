"""The nearest row of a plausible amount, for many rows at once.

Rows are dealt by sign, step of amount and span of days; those that ask, which are few, also to the
neighbouring steps and spans, so whatever is plausible and near meets, and the others are dealt once. Both sides come once for each amount and day:
what a group holds is bounded by the amounts that a step has, not by its rows. In a group the
others stand in order of amount, so the plausible ones are a run; a tree over that order, with
each node's rows by date, splits a run into a few nodes, and a search in each gives its
nearest dates. So a group costs n log n however many rows are plausible for each other. Groups
are small, so a task looks through some thousand rows of many groups at once.

Rows that found nothing go on to wider spans, in REACHES, the last without a limit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..shared import growing, interim, keep, keep_rows

REACHES = (7, 500, None)
#: Rows of groups that are looked through together.
BUCKET_ROWS = 50_000
#: Rows that ask, of 8 bytes each, whose groups are sent to all tasks.
BROADCAST_GROUPS = 200_000


def plausible_run(cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest amounts that are plausibly the same, in cents."""
    fee, size = 100 * money.MAX_FEE, np.abs(cents)
    low, high = np.minimum(size - fee, -((-49 * size) // 50)), np.maximum(size + fee, 50 * size // 49)
    return np.where(cents < 0, -high, low), np.where(cents < 0, -low, high)


def nearest_in(cents: np.ndarray, days: np.ndarray, of_cents: np.ndarray, of_days: np.ndarray, of_order: np.ndarray, group: np.ndarray | None = None, of_group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, gap in days) of the others' row with plausible cents, the least gap and then the least
    order; -1 where there is none. With groups, a row sees only the others of its own."""
    best, gap = np.full(len(cents), -1), np.full(len(cents), np.iinfo(np.int64).max)
    if not len(of_cents) or not len(cents):
        return best, gap
    run = plausible_run(cents)
    if group is None:
        group, of_group = np.zeros(len(cents), np.int64), np.zeros(len(of_cents), np.int64)
    # amounts by their rank, after those of the groups before
    names, amounts = np.unique(np.concatenate([group, of_group])), np.unique(np.concatenate([of_cents, *run]))
    ranked = lambda group, cents: np.searchsorted(names, group) * len(amounts) + np.searchsorted(amounts, cents)
    of_rank = ranked(of_group, of_cents)
    place = np.argsort(of_rank, kind="stable")
    low, high = np.searchsorted(of_rank[place], ranked(group, run[0]), "left"), np.searchsorted(of_rank[place], ranked(group, run[1]), "right")
    first = min(days.min(), of_days.min())
    days, of_days, level = days - first, of_days - first, 0
    while (low < high).any():
        node = np.arange(len(place)) >> level
        order = np.lexsort((of_order[place], of_days[place], node))
        key = (node[order] << 32) + of_days[place][order]

        def look(rows: np.ndarray, nodes: np.ndarray) -> None:
            begin, end = np.searchsorted(key, nodes << 32), np.searchsorted(key, (nodes + 1) << 32)
            at = np.searchsorted(key, (nodes << 32) + days[rows])
            before = np.searchsorted(key, key[np.maximum(at - 1, 0)])  # the first row of that day
            for found, there in ((at, at < end), (before, at > begin)):
                mine, row = rows[there], place[order[found[there]]]
                own = np.abs(of_days[row] - days[mine])
                better = (own < gap[mine]) | ((own == gap[mine]) & (of_order[row] < of_order[best[mine]]))
                gap[mine[better]], best[mine[better]] = own[better], row[better]

        odd = np.flatnonzero((low < high) & (low % 2 == 1))
        look(odd, low[odd])
        low[odd] += 1
        odd = np.flatnonzero((low < high) & (high % 2 == 1))
        high[odd] -= 1
        look(odd, high[odd])
        low, high, level = low // 2, high // 2, level + 1
    return best, gap


def sign(amount: Column) -> Column:
    return F.when(amount > 0, 1).when(amount < 0, -1).otherwise(0)


def finder(reach: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What the groups of a bucket find within so many days."""

    def find(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        column = lambda t, c: t[c].to_numpy().copy()
        best, gap = nearest_in(*(column(t, c) for t in (mine, theirs) for c in ("cents", "day")), column(theirs, "ord"), column(mine, "group"), column(theirs, "group"))
        at = np.flatnonzero((best >= 0) & (gap <= (gap if reach is None else reach)))
        theirs = theirs.select(["ord", "cents", "day", "description"]).take(pa.array(best[at]))
        return pa.table([*mine.select(["cents", "day"]).take(pa.array(at)).columns, pa.array(gap[at]), *theirs.columns], names=["cents", "day", "gap", "o_ord", "o_cents", "o_day", "description"])

    return find


def nearest_plausible(rows: DataFrame, others: DataFrame) -> DataFrame:
    """amount, date and near (amount, date, description) for each amount and date of rows (amount, date)
    that has a plausible one among the others (amount, date, ord, description): the nearest in
    date, then the first in input."""
    with interim() as result:
        cents = (F.col("amount") * 100).cast("long").alias("cents")
        first = others.where("amount IS NOT NULL AND date IS NOT NULL").groupBy("amount", "date").agg(F.min_by(F.struct("ord", "description"), "ord").alias("row"))
        first = first.select(cents, F.unix_date("date").cast("long").alias("day"), F.col("row.ord").alias("ord"), F.substring("row.description", 1, 40).alias("description"), sign(F.col("amount")).alias("sign"), money.step(F.col("amount")).alias("step"))
        first = keep_rows(first, "nearest-others")
        # small amounts of both signs can be within the flat fee of each other, so those of both signs' low steps meet
        signs = F.when(F.abs("amount") <= 4 * money.MAX_FEE, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(sign(F.col("amount"))))
        left = rows.where("amount IS NOT NULL AND date IS NOT NULL").select("amount", "date").distinct()
        left = keep_rows(left.select(cents, F.unix_date("date").cast("long").alias("day"), signs.alias("signs"), money.steps_around(F.col("amount")).alias("steps")), "nearest-rows")
        others_n, done = first.count(), None
        for reach in REACHES:
            span = F.floor(F.col("day") / reach).cast("long") if reach else F.lit(0).cast("long")
            spans = F.array(*[span + i for i in (-1, 0, 1)]) if reach else F.array(span)
            # two groups may share a number: what is plausible is told by the amounts alone
            group = F.xxhash64("sign", "step", "span").alias("group")
            wide = left.select("cents", "day", F.explode("signs").alias("sign"), "steps", spans.alias("spans")).withColumn("step", F.explode("steps")).withColumn("span", F.explode("spans")).select("cents", "day", group)
            wide, theirs = keep_rows(wide, "nearest-groups"), first.withColumn("span", span).select("cents", "day", "ord", "description", group)
            asked = wide.count()
            if asked <= BROADCAST_GROUPS:
                theirs = theirs.join(F.broadcast(keep(wide.select("group").distinct(), "groups")), "group", "left_semi")
            bucket = F.pmod(F.col("group"), F.lit(-(-(others_n + asked) // BUCKET_ROWS) or 1)).alias("bucket")
            met = wide.select("*", bucket).groupBy("bucket").cogroup(theirs.select("*", bucket).groupBy("bucket")).applyInArrow(finder(reach), "cents long, day long, gap long, o_ord long, o_cents long, o_day long, description string")
            found = met.groupBy("cents", "day").agg(F.min(F.struct("gap", "o_ord", "o_cents", "o_day", "description")).alias("best")).select("cents", "day", "best.o_cents", "best.o_day", "best.description")
            found = result(found, "nearest")
            done = found if done is None else done.unionByName(found)
            if reach is not None:
                left = keep_rows(left.join(found.select("cents", "day"), ["cents", "day"], "left_anti"), "nearest-rows")
                if not left.limit(1).count():
                    break
    money_of, date_of = (lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(18,2)")), (lambda c: F.date_from_unix_date(F.col(c).cast("int")))
    near = F.struct(money_of("o_cents").alias("amount"), date_of("o_day").alias("date"), "description")
    return growing(done).select(money_of("cents").alias("amount"), date_of("day").alias("date"), near.alias("near"))
