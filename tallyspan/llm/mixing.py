"""Mixing sources to target weights.

Documents get hash-random keys, are range-sorted by key within each source, and distributed
prefix sums of their sizes give every document its place in its source's order. A source's
budget is then cut exactly: whole epochs first, then documents up to the budget, the last
one in part.

The keys are uniform, so ranges of equal width hold equal shares of a source: a source is
sorted in as many ranges as it needs for RANGE_DOCS documents each, and a hot source only has
more of them. Prefix sums go over range totals, in two levels, then within each range.

Defined results: a null or empty text has size 0 and is taken 0 times; the null source is a
source like any other, the last in order; repeated rows are separate documents with the same
key, which share a place in the order by their ids and a tie number; an empty table gives an
empty mix; input columns named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import keep, read

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix asks for, and the most times a document is taken.
SHARE = 1.5
EPOCHS = 2.0
RANGE_DOCS = 256
RANGES_IN_GROUP = 1024
#: Up to so many sources (about 100 bytes each) their targets are broadcast, else joined.
BROADCAST_SOURCES = 50_000
_KEYS = 1 << 62


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranged(rows: DataFrame, label: str, *order: Column) -> DataFrame:
    """rows dealt in ranges of an order, stored, with `part`: the number of the range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), label)


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows (part) with the sums over all rows before each one: first over whole parts, of which
    there are as many as shuffle partitions, then within each part."""
    parts = rows.groupBy("part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(parts), "part")
    return joined.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).drop(*[f"_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, docs, source_size, target for each source. Weights repeat over the sources in
    code point order. What a capped source can't take is reshared by weight: a source is
    capped when its cap per weight is below the level c that solves
    sum(min(cap, c * weight)) = total. Sorted by cap per weight, the capped ones are a prefix,
    so running sums find c. Ranks and running sums go over ranges of the sources, so there may
    be as many as web sites."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = _before(_ranged(sizes, "sources", *by_name), by_name, rank=F.lit(1)).drop("part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    caps = ranked.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")).withColumn("per_weight", F.col("cap") / F.col("weight"))
    by_level = [F.col("per_weight").asc(), F.col("rank").asc()]
    caps = keep(_before(_ranged(caps, "source-caps", *by_level), by_level, caps_before=F.col("cap"), weights_before=F.col("weight")), "source-levels")
    whole = caps.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(share * (whole["size"] or 0)) - F.col("caps_before")) / (F.lit(whole["weight"] or 1.0) - F.col("weights_before"))
    c = caps.where(F.col("per_weight") > level).agg(F.min_by(level, F.struct("per_weight", "rank")).alias("c")).first()["c"]
    target = F.col("cap") if c is None else F.least("cap", F.lit(c) * F.col("weight"))
    return caps.select("source", "docs", "source_size", target.alias("target"))


def ordered(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with each one's `before`: the sizes of its source's
    documents with smaller keys."""
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "tie", F.lit("mix")), 2)
    small = sources.select(F.col("source").alias("_source"), "docs", "source_size", "target")
    if small.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    keyed = rows.withColumn("key", key).join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = F.ceil(F.col("docs") / RANGE_DOCS)
    keyed = keyed.withColumn("range", F.least((F.col("key").cast("double") / _KEYS * ranges).cast("long"), ranges - 1))
    keyed = keyed.withColumn("group", F.floor(F.col("range") / RANGES_IN_GROUP))
    totals = keyed.groupBy("source", "group", "range").agg(F.sum("size").alias("range_size"))
    up_to = lambda *by: Window.partitionBy("source", *by)
    groups = totals.groupBy("source", "group").agg(F.sum("range_size").alias("group_size"))
    groups = groups.select("source", "group", (F.sum("group_size").over(up_to().orderBy("group")) - F.col("group_size")).alias("groups_before"))
    totals = totals.withColumn("ranges_before", F.sum("range_size").over(up_to("group").orderBy("range")) - F.col("range_size"))
    starts = totals.join(groups.withColumnsRenamed({"source": "_s", "group": "_g"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("group") == F.col("_g")))
    starts = starts.select(F.col("source").alias("_s"), F.col("range").alias("_r"), (F.col("groups_before") + F.col("ranges_before")).alias("range_start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    return joined.withColumn("before", F.col("range_start") + F.col("within")).drop("_s", "_r")


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, source, tie, size, source_size, target, epochs (whole times it is taken), part
    (words of one more, partial time) and taken = epochs * size + part. Texts are read once
    and not shuffled: only ids, sources and sizes are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("tie"), n_words(text).alias("size"))
    rows = keep(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    placed = ordered(rows, targets(sizes, weights, share, epochs))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("times") * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    out = placed.withColumn("times", whole).withColumn("part", part).withColumn("taken", F.col("times") * F.col("size") + F.col("part"))
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", F.col("times").alias("epochs"), "part", "taken")


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: every document as many whole times as it
    is taken, and the one that a budget cuts also as its first words, joined by blanks."""
    plan = mix(docs, text).where("taken > 0").groupBy("doc_id", "tie").agg(F.max("epochs").alias("_epochs"), F.max("size").alias("_size"), F.sum("part").alias("_part"), F.count("*").alias("_rows"))
    named = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_tie": F.coalesce(F.xxhash64(F.col(text)), F.lit(0))})
    plan = plan.withColumnsRenamed({"doc_id": "_plan_id", "tie": "_plan_tie"})
    rows = named.join(plan, F.col("_id").eqNullSafe(F.col("_plan_id")) & (F.col("_tie") == F.col("_plan_tie")))
    # repeated rows share the parts that they were given
    share = F.ceil(F.col("_part") / F.col("_rows"))
    whole = F.array_repeat(F.lit(0).cast("long"), F.col("_epochs").cast("int"))
    copies = F.when(share <= 0, whole).when(share >= F.col("_size"), F.concat(whole, F.array(F.lit(0).cast("long")))).otherwise(F.concat(whole, F.array(share)))
    rows = rows.withColumn("_cut", F.explode(copies))
    words = F.split(F.trim(F.col(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_cut").cast("int")), " ")
    rows = rows.withColumn(text, F.when(F.col("_cut") > 0, cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL: dict[str, str] = {}
