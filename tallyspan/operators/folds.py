"""Greedy rules that decide rows in order, as streams over sorted groups.

Rows are hashed to tasks by their keys, and a task reads each key's in order of date, holding
only the rows inside the window. So the number of jobs does not depend on how many rows share a
key, no pairs are listed, and no group is held whole.

Keys of more than SLICE_ROWS rows are parted where dates follow each other with a gap wider than the
rule's window, which it can't see beyond (an island), and an island is cut into slices of whole days, which are decided side
by side. What a slice hands to the next is its queue: the rows near its end that it has taken. At
first each slice assumes that the one before takes nothing; then slices that were handed
another queue than they had assumed are decided again, until none is. The first slice assumes
right, so the n-th is right after n rounds at the latest, and what stays equals the pass in order; as a
rule a slice forgets its beginning before its end, and two rounds do. One day of one key is
in one slice.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import keep

#: Rows of an island to a slice.
SLICE_ROWS = 50_000
#: Hot keys, of a few bytes each, that are sent to all tasks.
BROADCAST_KEYS = 200_000


def numbered(per_day: DataFrame, keys: list[str], days: int) -> DataFrame:
    """per_day (keys, date) with `island`: its number among those of its keys."""
    order = Window.partitionBy(*keys).orderBy("date")
    cut = F.coalesce((F.datediff("date", F.lag("date").over(order)) > days).cast("int"), F.lit(0))
    return per_day.withColumn("cut", cut).withColumn("island", F.sum("cut").over(order)).drop("cut")


def fold(rows: DataFrame, keys: list[str], order: list[str], schema: str, decide: Callable[[Iterator[dict]], Iterable[tuple]]) -> DataFrame:
    """What `decide` gives for the rows of each group of equal keys, in this order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, types = [], _types(schema)
        each = (row for batch in batches for row in dicts(batch))
        for _, group in groupby(each, key=lambda row: tuple(row[k] for k in keys)):
            for found in decide(group):
                out.append(found)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    # by number, as a row costs far more in Python than its few bytes tell: partitions are not put together by size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """As batch.to_pylist(), by columns: values that repeat, and are costly to make, are made once, lists from what
    they hold together."""
    names, columns = batch.schema.names, [_values(column) for column in batch.columns]
    return (dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True))


def _values(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_decimal(kind) or pa.types.is_date(kind):
        packed = column.dictionary_encode()
        held = packed.dictionary.to_pylist()
        held.append(None)
        return [held[i] for i in packed.indices.fill_null(len(held) - 1).to_numpy().tolist()]
    if pa.types.is_list(kind) and not column.null_count:
        each, ends = _values(column.flatten()), column.offsets.to_numpy().tolist()
        return [each[low - ends[0] : high - ends[0]] for low, high in zip(ends, ends[1:], strict=False)]
    if pa.types.is_string(kind) or not column.null_count and (pa.types.is_boolean(kind) or pa.types.is_integer(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _types(schema: str) -> list[pa.DataType]:
    known = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "decimal(18,2)": pa.decimal128(18, 2)}
    return [known[c.split()[1]] for c in schema.split(", ")]


def fold_islands(rows: DataFrame, keys: str, days: int, order: list[str], schema: str, decide: Callable[[Iterator[dict]], Iterable[tuple]], chooses: str, chosen: str) -> DataFrame:
    """As fold over rows (keys, date, id, ...), slices of hot keys side by side.
    keys and schema are DDL; rows with `chooses` each take at most one of the others within
    `days`, whose id is the column `chosen` of the result."""
    names = [c.split()[0] for c in keys.split(", ")]
    hot = keep(rows.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > SLICE_ROWS).select(*names), "hot-keys")
    found = hot.count()
    # the rules look no further than their window, so the islands of a key that is not hot are one stream
    if not found:
        return fold(rows, names, order, schema, decide)
    hot = F.broadcast(hot) if found <= BROADCAST_KEYS else hot
    cold = fold(rows.join(hot, names, "left_anti"), names, order, schema, decide)
    return cold.unionByName(fold_slices(rows.join(hot, names, "left_semi"), keys, days, order, schema, decide, chooses, chosen))


def slices(rows: DataFrame, keys: list[str], days: int, chooses: str) -> tuple[DataFrame, DataFrame]:
    """(rows with island, slice and until, the first day of the next slice; the slices): rows that
    choose are in their own slice, the others also in all slices that can see them."""
    per_day = numbered(rows.groupBy(*keys, "date").agg(F.count("*").alias("n")), keys, days)
    before = F.sum("n").over(Window.partitionBy(*keys, "island").orderBy("date")) - F.col("n")
    own = per_day.withColumn("slice", F.floor(before / SLICE_ROWS)).groupBy(*keys, "island", "slice").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    order = Window.partitionBy(*keys, "island").orderBy("low")
    own = keep(own.withColumns({"slice": F.row_number().over(order).cast("long") - 1, "until": F.lead("low").over(order)}), "slices")
    seen = own.withColumn("date", F.explode(F.sequence(F.date_sub("low", days), F.date_add("high", days))))
    laid = rows.join(seen.withColumn("own", F.col("date").between(F.col("low"), F.col("high"))).drop("low", "high"), [*keys, "date"])
    return keep(laid.where(F.col("own") | ~F.col(chooses)).drop("own"), "sliced"), own


def fold_slices(rows: DataFrame, keys: str, days: int, order: list[str], schema: str, decide: Callable[[Iterator[dict]], Iterable[tuple]], chooses: str, chosen: str) -> DataFrame:
    """The slices' results, each of the last round in which it was decided."""
    names, columns = ([c.split()[0] for c in ddl.split(", ")] for ddl in (keys, schema))
    place = [*names, "island", "slice"]
    prefix = [f"_{n}" for n in place]
    ddl = ", ".join([*(f"_{c}" for c in keys.split(", ")), "_island long", "_slice long", schema, "exit_id string"])
    at, width = columns.index(chosen), len(columns)

    def decided(group: Iterator[dict]) -> Iterable[tuple]:
        first = next(group)
        where = tuple(first[n] for n in place)
        edge = first["until"] and first["until"] - datetime.timedelta(days)
        near, none = set(), (None,) * width

        def free() -> Iterator[dict]:
            for row in chain([first], group):
                here = edge and not row[chooses] and row["date"] >= edge
                if row["taken"]:
                    if here:
                        gone.append(row["id"])
                    continue
                if here:
                    near.add(row["id"])
                yield row

        gone: list[str] = []
        for found in decide(free()):
            yield (*where, *found, None)
            if found[at] in near:
                gone.append(found[at])
        for name in gone:
            yield (*where, *none, name)

    laid, own = slices(rows, names, days, chooses)
    again = own.where("slice > 0").select(*place)
    now, outs, settled = laid.withColumn("taken", F.lit(False)), [], None
    while True:
        out = keep(fold(now, place, order, ddl, decided).withColumn("_turn", F.lit(len(outs))), "slice-results")
        outs.append(out)
        handed = out.where("exit_id IS NOT NULL").select(*[F.col(p).alias(n) for p, n in zip(prefix, place, strict=True)], F.col("exit_id").alias("id")).withColumn("slice", F.col("slice") + 1)
        # which rows a slice is handed, told by their number and the sum of their hashes
        told = handed.groupBy(*place).agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).cast("string")).alias("told"))
        again = again.join(told, place, "left").withColumn("told", F.coalesce("told", F.lit("")))
        again = again.withColumn("was", F.lit("")) if settled is None else again.join(settled.select(*place, F.col("told").alias("was")), place, "left")
        again = keep(again.where(F.col("told") != F.coalesce("was", F.lit(""))).drop("was").withColumn("turn", F.lit(len(outs))), "again")
        if not again.limit(1).count():
            break
        settled = again if settled is None else keep(settled.join(again, place, "left_anti").unionByName(again), "settled-slices")
        again = again.select(*place)
        now = laid.join(again, place, "left_semi").join(handed.withColumn("taken", F.lit(True)), [*place, "id"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        again = again.withColumn("slice", F.col("slice") + 1)
    every = outs[0]
    for out in outs[1:]:
        every = every.unionByName(out)
    if settled is not None:
        last = settled.select(*[F.col(n).alias(p) for p, n in zip(prefix, place, strict=True)], F.col("turn").alias("_last"))
        every = every.join(last, prefix, "left").where(F.coalesce("_last", F.lit(0)) == F.col("_turn"))
    return every.where("exit_id IS NULL").select(*columns)
