"""Where on a page a read line stands: its words, their boxes, and the box of each cell.

Words are rows (doc, page, word, text, x0, x1, top, bottom, width, height) of any word extractor, lines are
rows (doc, page, line, text). Two extractors agree on characters but not on how they group them,
so a line is looked for by its words: each height at which one of them stands is scored by how
many different words of the line stand within BAND of it, and the best, then highest, wins. Words
meet lines by document, page and characters: a line meets the heights of each of its words as one
list, so a word that every line has is no row a pair of lines. Words with more heights than MOST_HEIGHTS meet as
rows, by bands, so a page of a million words is only more rows.

Boxes are fractions of their page. A line or word without characters has no place; rows with null names
or places are left out; a word that a line has twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import growing, interim, keep

#: Points around a height in which a row's words stand: a row's parts are 3 to 6 apart, rows 15.
BAND = 9.0
#: Heights of one word on a page that are compared as a list; lines of words with more are scored as rows.
MOST_HEIGHTS = 256
#: Cells of one word, in the order in which they claim it, and those that hold money.
CELLS = ("date", "reference", "debit", "credit", "balance")
MONEY = ("debit", "credit", "balance")
LINE = ("doc", "page", "line")
EDGES = ("x0", "y0", "x1", "y1")


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def united() -> list[Column]:
    """The box around some boxes."""
    return [(F.min if c in ("x0", "y0") else F.max)(c).alias(c) for c in EDGES]


def located_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """doc, page, line, height and score of the best place of each line, and word, key, x0, y0, x1, y1 of
    each of its words there."""
    boxes = words.select("doc", "page", "word", squashed(F.col("text")).alias("key"), "top", (F.col("x0") / F.col("width")).alias("x0"), (F.col("top") / F.col("height")).alias("y0"), (F.col("x1") / F.col("width")).alias("x1"), (F.col("bottom") / F.col("height")).alias("y1"))
    tokens = lines.select(*LINE, F.explode(F.array_distinct(F.transform(F.split("text", r"\s+"), squashed))).alias("key")).where("key <> ''")
    with interim() as result:
        places = keep(few_heights(tokens, boxes), "places")
        crowded = places.where("best IS NULL").select(*LINE)
        best = places.where("best IS NOT NULL").select(*LINE, "best.height", "best.score", "best.keys")
        if crowded.limit(1).count():
            best = best.unionByName(many_heights(tokens.join(crowded, [*LINE], "left_semi"), boxes))
        asked = best.select(*LINE, "height", "score", F.explode("keys").alias("key"))
        return result(growing(asked).join(boxes, ["doc", "page", "key"]).where(F.abs(F.col("top") - F.col("height")) <= BAND).drop("top"), "located")


def few_heights(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc, page, line and best (score, height, keys): a word's heights on a page are one list, which a line
    meets as one row a word. best is null where a word of the line has more than MOST_HEIGHTS."""
    heights = boxes.where("top IS NOT NULL").groupBy("doc", "page", "key").agg(F.collect_set("top").alias("tops"))
    heights = heights.select("doc", "page", "key", (F.size("tops") > MOST_HEIGHTS).alias("crowded"), F.when(F.size("tops") <= MOST_HEIGHTS, F.col("tops")).alias("tops"))
    met = growing(tokens).join(heights, ["doc", "page", "key"])
    rows = met.groupBy(*LINE).agg(F.max("crowded").alias("crowded"), F.collect_set(F.struct("key", "tops")).alias("found"))
    near = lambda h: F.filter("found", lambda w: F.exists(w["tops"], lambda t: F.abs(t - h) <= BAND))
    all_heights = F.array_distinct(F.flatten(F.transform("found", lambda w: F.transform(w["tops"], lambda t: F.round(t, 1)))))
    scores = F.transform(all_heights, lambda h: F.struct(F.size(near(h)).cast("long").alias("score"), (-h).alias("first"), h.alias("height")))
    rows = rows.select(*LINE, "found", F.when(~F.col("crowded"), F.array_max(scores)).alias("best"))
    keys = F.transform(near(F.col("best.height")), lambda w: w["key"])
    return rows.select(*LINE, F.when(F.col("best").isNotNull(), F.struct("best.score", "best.height", keys.alias("keys"))).alias("best"))


def many_heights(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc, page, line, height, score and keys of the best place, a row for each height and word."""
    met = tokens.distinct().join(boxes.select("doc", "page", "key", "top").distinct(), ["doc", "page", "key"]).withColumn("band", F.floor(F.col("top") / BAND))
    heights = met.select(*LINE, F.round("top", 1).alias("height")).distinct()
    around = heights.withColumn("band", F.explode(F.array(*[F.floor(F.col("height") / BAND) + i for i in (-1, 0, 1)])))
    # rounding a height may move it into the next band, but never by one band and more
    near = growing(met).join(around, [*LINE, "band"]).where(F.abs(F.col("top") - F.col("height")) <= BAND)
    rows = near.groupBy(*LINE, "height").agg(F.collect_set("key").alias("keys")).withColumn("score", F.size("keys").cast("long"))
    best = rows.groupBy(*LINE).agg(F.max_by(F.struct("height", "score", "keys"), F.struct("score", -F.col("height"))).alias("best"))
    return best.select(*LINE, "best.height", "best.score", "best.keys")


def located_lines(lines: DataFrame, words: DataFrame) -> DataFrame:
    """doc, page, line, height, score, words and the box of each line that stands somewhere."""
    return located_words(lines, words).groupBy(*LINE, "height", "score").agg(F.count("*").alias("words"), *united())


def cell_boxes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc, page, line, field and box of each cell of rows (doc, page, line and CELLS as they were
    printed) among the words found for their lines. Cells of equal value take the words that spell it
    from the left, in the order of CELLS; the description is what is left between the date and
    the first figure."""
    order = {c: i for i, c in enumerate(CELLS)}
    none, word = [F.lit(None).cast("double").alias(c) for c in EDGES], found.schema["word"].dataType
    # a line's cells and words are dealt once, by line; the cell without a key tells that a line is among the rows
    cells = rows.select(*LINE, F.explode(F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(-1).alias("turn"), F.lit("").alias("key")), *[F.struct(F.lit(c).alias("field"), F.lit(i).alias("turn"), squashed(F.col(c).cast("string")).alias("key")) for c, i in order.items()])).alias("cell")).select(*LINE, "cell.*").where("key IS NOT NULL AND key <> '0' AND (key <> '' OR field IS NULL)")
    cells = cells.select(*LINE, "key", "field", F.struct("turn", F.lit(None).cast("double").alias("x0"), F.lit(None).cast(word).alias("word")).alias("turn"), F.lit(False).alias("is_word"), *none)
    words = found.select(*LINE, "key", F.lit(None).cast("string").alias("field"), F.struct(F.lit(0).alias("turn"), F.col("x0").cast("double").alias("x0"), "word").alias("turn"), F.lit(True).alias("is_word"), *EDGES)
    dealt = cells.unionByName(words).repartition(*LINE)
    dealt = dealt.withColumn("claim", F.row_number().over(Window.partitionBy(*LINE, "key", "is_word").orderBy("turn")))
    taken = dealt.groupBy(*LINE, "key", "claim").agg(F.max("field").alias("field"), F.max("is_word").alias("is_word"), *[F.max(c).alias(c) for c in EDGES])
    line = Window.partitionBy(*LINE)
    of = lambda fields, edge, take: take(F.when(F.col("is_word") & F.col("field").isin(*fields), F.col(edge))).over(line)
    taken = taken.withColumns({"after": of(("date",), "x1", F.max), "before": of(MONEY, "x0", F.min), "kept": F.max(F.col("key") == "").over(line)}).where("is_word")
    between = F.col("kept") & (F.col("after").isNull() | (F.col("x0") >= F.col("after"))) & (F.col("before").isNull() | (F.col("x1") <= F.col("before")))
    said = F.coalesce("field", F.when(between, F.lit("description")))
    taken = taken.select(*LINE, said.alias("field"), F.when(F.col("field").isNotNull(), F.struct("key", "claim")).alias("cell"), *EDGES).where("field IS NOT NULL")
    return taken.groupBy(*LINE, "field", "cell").agg(*united()).drop("cell")
