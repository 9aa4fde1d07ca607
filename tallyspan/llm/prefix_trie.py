"""A Z-fast trie of conversations: nodes of shared turns, with what sharing them would save.

Turns are 128-bit digests, and a prefix of d turns is named by 128 bits of a sum over them and
their places, so any prefix is compared by one join. The trie is compact: a branch is a
chain, named by the conversation that made it, from where it leaves its parent chain to that
conversation's end; where other chains leave it or conversations end, it is parted into edges.
An edge (top, bottom] has one handle: its prefix at the 2-fattest number (that with most trailing
zeros) in (top, bottom]. Handles are a table keyed by their hash.

Conversations are inserted in BATCHES, in order of id. A batch finds its exits by fat binary search:
the 2-fattest depth of what is open is looked up among the handles, which halves it or goes on
below the edge found; so one of n turns takes log2(n) + 1 lookups. They are all in one row, as one
join brings every handle that is a prefix of it, at most one for each edge of its path. The last edge
is then compared turn by turn. Of the conversations that leave at one place with one turn the
least becomes a new chain, and the rest, which share that turn, are compared with it, in rounds that
end when none is left. As ids ascend, a chain's conversation is the least member of its nodes.

Equal conversations are one sequence. Sums over subtrees go up by level of chains (the edges of a
chain by running sums from its end), so a third of all conversations below one node are
summed before they meet. Then edges are expanded to one row a node.

Defined results: rows without a conv_id are left out; null roles and texts are empty; null turns
come first, and rows of one turn stand in order of role, then of their digests; repeated rows are
turns of their own; a conversation may be rebuilt to no turn at all, and is then a member of the
root alone; long texts are hashed whole; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merkle import CRC32
from .numbering import numbered
from .tables import keep, read

#: Where batches of insertion end, as shares of all sequences by id; the last one has the rest. Later ones
#: search what earlier ones made. Every batch is more jobs for the driver.
BATCHES = (0.5,)
#: Ids of one sequence that are put in order at once.
IDS = 1024
#: A rebuilt conversation takes fewer turns than this from its family's first, and FAMILY ids are one.
GRAFT = 9
FAMILY = 5


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] with most trailing zeros."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, number (from 0, in order), a and b (digest of role and text), bytes of the text, and
    _part, the range of rows that it lies in."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    rows = rows.select("conv", "turn", "role", half(1).alias("a"), half(17).alias("b"), "bytes")
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("a").asc(), F.col("b").asc()]
    return keep(numbered(rows, order, "conv", "turns").drop("turn", "role"), "numbered-turns")


def regrafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, a, b, bytes and part of every rebuilt turn; conv of all conversations): the
    first turns of the family's first conversation, then a conversation's own from there on."""
    spark = turns.sparkSession
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"), F.min("_part").alias("first_part"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string")) % GRAFT).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    convs = keep(convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    own = turns.join(convs.select("conv", "h", "k"), "conv").where("number >= h")
    own = own.select("conv", (F.col("k") + F.col("number") - F.col("h") + 1).alias("depth"), "a", "b", "bytes", F.col("_part").alias("part"))
    heads = turns.where(F.col("number") < GRAFT - 1).select(F.col("conv").alias("base"), "number", "a", "b", "bytes")
    graft = convs.where("k > 0").select("conv", "base", "k", "first_part").join(heads, "base").where("number < k")
    graft = graft.select("conv", (F.col("number") + 1).alias("depth"), "a", "b", "bytes", F.col("first_part").alias("part"))
    return own.unionByName(graft), convs.select("conv")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, h1, h2 (name of the first depth turns), cum (bytes of their texts), bytes, a and b.
    Sums run within a conversation's part of each range, and over its ranges."""
    value = lambda n, *by: F.xxhash64(F.lit(n), F.col("depth"), *map(F.col, by)).cast("decimal(20,0)")
    rows = turns.withColumns({"s1": value(1, "a", "b"), "s2": value(2, "b", "a")})
    sums = ("s1", "s2", "bytes")
    totals = rows.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv", "part", *[F.sum(c).over(before).alias(f"{c}_before") for c in sums]).where("bytes_before IS NOT NULL")
    # one row for each conversation and range that it goes on into: fewer than there are ranges
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}_sum": F.sum(c).over(so_far) for c in sums}).join(F.broadcast(carried), ["conv", "part"], "left")
    total = lambda c, t: (F.col(f"{c}_sum") + F.coalesce(F.col(f"{c}_before"), F.lit(0))).cast(t)
    name = {"h1": F.xxhash64("depth", total("s1", "decimal(38,0)")), "h2": F.xxhash64(total("s2", "decimal(38,0)"), "depth")}
    return rows.select("conv", F.col("depth").cast("long").alias("depth"), *[c.alias(n) for n, c in name.items()], total("bytes", "long").alias("cum"), "bytes", "a", "b")


def at_depth(paths: DataFrame, rows: DataFrame, conv: str, depth: Column, **names: str) -> DataFrame:
    """rows with columns of their conversation's prefix at some depth, null where it has none."""
    part = paths.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), *[F.col(c).alias(n) for n, c in names.items()])
    return rows.withColumn("_at", depth).join(part, (F.col(conv) == F.col("_conv")) & (F.col("_at") == F.col("_depth")), "left").drop("_conv", "_depth", "_at")


def compared(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows (conv, len, chain, level, low, upto) with low raised to the last depth up to upto at which
    conv and chain are alike, as column depth."""
    own = rows.select("conv", "chain", "low", "upto").join(paths.select("conv", "depth", "h1", "h2"), "conv").where("depth > low AND depth <= upto")
    same = own.join(paths.select(F.col("conv").alias("chain"), "depth", "h1", "h2"), ["chain", "depth", "h1", "h2"]).groupBy("conv").agg(F.max("depth").alias("alike"))
    return rows.join(same, "conv", "left").select("conv", "len", "chain", "level", F.coalesce("alike", "low").alias("depth"))


def edges_of(placed: DataFrame) -> DataFrame:
    """chain, level, parent, attach, len, top and bottom of all edges."""
    chains = placed.where("head = conv").select(F.col("conv").alias("chain"), F.col("chain").alias("parent"), F.col("depth").alias("attach"), (F.col("level") + 1).alias("level"), "len")
    breaks = placed.where("head IS NULL OR head = conv").select("chain", F.col("depth").alias("bottom")).where("chain IS NOT NULL")
    breaks = breaks.union(chains.select("chain", "len")).distinct()
    previous = F.lag("bottom").over(Window.partitionBy("chain").orderBy("bottom"))
    return breaks.join(chains, "chain").withColumn("top", F.coalesce(previous, F.col("attach")))


def handles(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The edges with the hashes of their handle, of their bottom and of their first turn's prefix."""
    points = {"g": fattest("top", "bottom"), "x": F.col("bottom"), "o": F.col("top") + 1}
    rows = edges.select("chain", "level", "top", "bottom", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), d.alias("depth")) for k, d in points.items()])).alias("point"))
    rows = rows.select("chain", "level", "top", "bottom", "point.what", "point.depth").join(paths.select(F.col("conv").alias("chain"), "depth", "h1", "h2"), ["chain", "depth"])
    pick = lambda k, h: F.max(F.when(F.col("what") == k, F.col(h)))
    return rows.groupBy("chain", "level", "top", "bottom").agg(*[pick(k, f"h{i}").alias(f"{k}{i}") for k in points for i in (1, 2)])


def searched(low: str, high: str, steps: int, found: tuple[str, ...]) -> Column:
    """The edge that fat binary search ends at, from `hits`: the edges (fat, then found) whose handles are prefixes of
    this conversation. A hit goes on below its edge, a miss halves what is open."""
    kinds = {"level": "int"}
    blank = ", ".join(f"'{c}', CAST({'NULL' if c == 'chain' else '0'} AS {kinds.get(c, 'bigint')})" for c in found)
    kept = lambda source: ", ".join(f"'{c}', {source}.{c}" for c in found)
    fat = "s.high & shiftleft(-1L, length(bin(s.low ^ s.high)) - 1)"  # as fattest()
    hit = f"get(filter(hits, h -> h.fat = ({fat})), 0)"
    met = f"transform(array({hit}), m -> if(m IS NULL, named_struct('low', s.low, 'high', ({fat}) - 1, {kept('s')}), named_struct('low', m.bottom, 'high', s.high, {kept('m')})))[0]"  # the array only names the hit
    return F.expr(f"aggregate(sequence(1, {steps}), named_struct('low', CAST({low} AS bigint), 'high', CAST({high} AS bigint), {blank}), (s, i) -> if(s.low < s.high, {met}, s))")


def located(batch: DataFrame, nodes: DataFrame, paths: DataFrame, steps: int) -> DataFrame:
    """conv, len, chain (null at the root), level and depth of where each of a batch leaves the trie. All
    look-ups of a search are one join: a conversation's prefixes meet the handles, and it searches among its hits."""
    found = ("chain", "level", "top", "bottom", "x1", "x2")
    own = paths.select("conv", "depth", "h1", "h2").join(batch.select("conv"), "conv", "left_semi")
    hits = own.join(nodes.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), *found), ["h1", "h2"])
    hits = hits.groupBy("conv").agg(F.collect_list(F.struct(F.col("depth").alias("fat"), *found)).alias("hits"))
    state = batch.select("conv", "len").join(hits, "conv", "left").withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))
    state = state.select("conv", "len", searched("0", "len", steps, found).alias("s")).select("conv", "len", *[F.col(f"s.{c}").alias(c) for c in found])
    state = at_depth(paths, state, "conv", F.col("bottom"), e1="h1", e2="h2")
    passed = (F.col("bottom") == 0) | F.coalesce((F.col("e1") == F.col("x1")) & (F.col("e2") == F.col("x2")), F.lit(False))
    state = at_depth(paths, state.withColumn("passed", passed), "conv", F.when(F.col("passed"), F.col("bottom") + 1), n1="h1", n2="h2")
    by_first = nodes.select(F.col("o1").alias("_o1"), F.col("o2").alias("_o2"), F.col("chain").alias("_chain"), F.col("level").alias("_level"), F.col("bottom").alias("_bottom"))
    state = state.join(by_first, (F.col("n1") == F.col("_o1")) & (F.col("n2") == F.col("_o2")), "left")
    exits = state.select(
        "conv", "len", F.coalesce("_chain", "chain").alias("chain"), F.coalesce("_level", "level").alias("level"),
        F.when(F.col("passed"), F.col("bottom")).otherwise(F.col("top")).alias("low"),
        F.least("len", F.coalesce(F.col("_bottom"), F.col("bottom"))).alias("upto"),
    )
    return compared(exits, paths)


def inserted(sequences: DataFrame, paths: DataFrame) -> DataFrame | None:
    """conv, len, chain, level, depth and head of every sequence with a turn, if there is any: it leaves `chain` at
    `depth` as a new chain (head = conv) or ends there (no head); rows with another head were waiting."""
    some = sequences.where("len > 0").select("conv", "len")
    bounds = some.agg(F.percentile_approx("conv", list(BATCHES)).alias("ids"), F.max("len").alias("len")).first()
    if bounds["len"] is None:
        return None
    placed, ends = None, sorted(set(bounds["ids"]))
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        batch = some if low is None else some.where(F.col("conv") > low)
        batch = batch if high is None else batch.where(F.col("conv") <= high)
        if placed is None:
            waiting = batch.select("conv", "len", F.lit(None).cast("long").alias("chain"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("depth"))
        else:
            nodes = keep(handles(edges_of(placed), paths), "handles")
            waiting = located(batch, nodes, paths, int(bounds["len"]).bit_length())
        while True:
            going = at_depth(paths, waiting, "conv", F.col("depth") + 1, n1="h1", n2="h2")
            going = keep(going, "waiting")
            heads = going.where("n1 IS NOT NULL").groupBy("n1", "n2").agg(F.min("conv").alias("head"))
            now = keep(going.join(heads, ["n1", "n2"], "left").drop("n1", "n2"), "placed")
            placed = now if placed is None else placed.unionByName(now)
            rest = now.where("head <> conv")
            if not rest.limit(1).count():
                break
            rest = rest.select("conv", "len", F.col("head").alias("chain"), (F.col("level") + 1).alias("level"), (F.col("depth") + 1).alias("low"), F.col("len").alias("upto"))
            waiting = compared(rest, paths)
    return placed


def id_digests(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """conv (of a sequence) and sha256 of the ids of all conversations of that sequence, ascending.
    A digest reads its bytes one after another; of a sequence of many ids it gets them as
    strings of IDS ids, so that no task holds them all."""
    decimal = F.col("conv").cast("string")
    single = sequences.where("n = 1").select("conv", F.sha2(decimal, 256).alias("sha256"))
    several = sequences.where("n > 1").select(F.col("conv").alias("sequence"), "h1", "h2", "n")
    pairs = keep(members.join(several, ["h1", "h2"]).select("sequence", "conv", "n"), "copies")
    listed = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    few = pairs.where(F.col("n") <= IDS).groupBy("sequence").agg(listed(pairs).alias("ids")).select(F.col("sequence").alias("conv"), F.sha2("ids", 256).alias("sha256"))
    out = single.unionByName(few)
    many = pairs.where(F.col("n") > IDS).select("sequence", "conv")
    if not many.limit(1).count():
        return out
    order = [F.col("sequence").asc(), F.col("conv").asc()]
    chunks = numbered(many, order, "sequence", "ids").groupBy("sequence", F.floor(F.col("number") / IDS).alias("chunk")).agg(listed(many).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, sums = None, [], []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not names or names[-1] != name:
                    if held:
                        sums.append(held.hexdigest())
                    names.append(name)
                    held = hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
        if held:
            sums.append(held.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums)], ["conv", "sha256"])

    dealt = keep(chunks, "id-chunks").repartition("sequence").sortWithinPartitions("sequence", "chunk")
    return out.unionByName(dealt.select("sequence", "ids").mapInArrow(digest, "conv long, sha256 string"))


def summed(edges: DataFrame, level: int, below: DataFrame | None) -> DataFrame:
    """The edges of one level with n, leaves, children and saved (below the bottom, and in all), from
    the chains that leave them: below has their parent, attach, n, leaves, saved and children."""
    rows = edges.where(F.col("level") == level)
    names = ("c_n", "c_leaves", "c_saved", "c_children")
    if below is None:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in names})
    else:
        rows = rows.join(below.withColumnsRenamed({"parent": "chain", "attach": "bottom"}), ["chain", "bottom"], "left").fillna(0, list(names))
    up = Window.partitionBy("chain").orderBy(F.col("bottom").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("bottom") == F.col("len")
    rows = rows.withColumn("n_convs", F.sum(F.col("n_ends") + F.col("c_n")).over(up))
    rows = rows.withColumn("n_leaves", F.sum(F.col("c_leaves") + (last & (F.col("c_children") == 0)).cast("long")).over(up))
    rows = rows.withColumn("own", (F.col("n_convs") - 1) * (F.col("cum") - F.col("cum_top")))
    return rows.withColumn("saved", F.sum(F.col("own") + F.col("c_saved")).over(up)).withColumn("n_children", F.col("c_children") + (~last).cast("long"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix: conv_id (its least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and a and b, the digest of its last turn.
    turns: conv, depth (from 1), a, b, bytes, part; convs: conv of all, with turns or without."""
    every = keep(prefixes(turns), "prefixes")
    last = every.groupBy("conv").agg(F.max("depth").alias("len"), F.max_by(F.struct("h1", "h2"), "depth").alias("h"))
    zero = F.lit(0).cast("long")
    members = convs.join(last, "conv", "left").select("conv", F.coalesce("len", zero).alias("len"), F.coalesce("h.h1", zero).alias("h1"), F.coalesce("h.h2", zero).alias("h2"))
    members = keep(members, "members")
    sequences = keep(members.groupBy("h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("len").alias("len")), "sequences")
    paths = keep(every.join(sequences.select("conv"), "conv", "left_semi"), "paths")
    sums = keep(id_digests(members, sequences), "digests")
    none = F.sha2(F.lit(""), 256)
    placed = inserted(sequences, paths)
    top, parts = None, []
    if placed is not None:
        edges = edges_of(placed)
        stays = placed.where("head IS NULL").select("chain", F.col("depth").alias("bottom"), "conv").union(placed.where("head = conv").select(F.col("conv").alias("chain"), "len", "conv"))
        stays = stays.join(sequences.select("conv", F.col("n").alias("n_ends")), "conv").join(sums, "conv")
        edges = edges.join(stays.drop("conv"), ["chain", "bottom"], "left").withColumn("n_ends", F.coalesce("n_ends", zero))
        edges = at_depth(paths, at_depth(paths, edges, "chain", F.col("bottom"), cum="cum"), "chain", F.col("top"), cum_top="cum").withColumn("cum_top", F.coalesce("cum_top", zero))
        edges, below = keep(edges, "edges"), None
        for level in range(edges.agg(F.max("level")).first()[0], 0, -1):
            parts.append(keep(summed(edges, level, below), f"sums-{level}"))
            heads = parts[-1].where("top = attach")
            below = heads.groupBy("parent", "attach").agg(F.sum("n_convs").alias("c_n"), F.sum("n_leaves").alias("c_leaves"), F.sum("saved").alias("c_saved"), F.count("*").alias("c_children"))
        top = below.select("c_n", "c_leaves", "c_saved", "c_children")
    least = members.agg(F.min("conv").alias("least"), F.count("*").alias("all"))
    turnless = sequences.where("len = 0").join(sums, "conv").select("sha256")
    root = least.where("least IS NOT NULL").join(turnless, F.lit(True), "left")  # one row and one at most
    blank = F.lit(None).cast("long")
    if top is None:
        root = root.withColumns({"c_children": zero, "c_leaves": zero + 1, "c_saved": zero})
    else:
        root = root.join(top, F.lit(True), "left")
    out = root.select(F.col("least").alias("conv_id"), zero.alias("depth"), blank.alias("parent_conv_id"), F.col("all").alias("n_convs"), F.col("c_children").alias("n_children"), F.col("c_leaves").alias("n_leaves"), F.col("c_saved").alias("saved_tokens"), F.coalesce("sha256", none).alias("ends_sha256"), blank.alias("a"), blank.alias("b"))
    if not parts:
        return out
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    rows = whole.join(F.broadcast(least.select("least")), F.lit(True)).withColumn("depth", F.explode(F.sequence(F.col("top") + 1, F.col("bottom"))))
    rows = rows.select("chain", "depth", "attach", "bottom", F.coalesce("parent", "least").alias("parent"), "n_convs", "n_children", "n_leaves", F.col("cum").alias("end"), (F.col("saved") - F.col("own")).alias("rest"), F.when(F.col("depth") == F.col("bottom"), F.col("sha256")).alias("sha256"))
    rows = rows.join(paths.select(F.col("conv").alias("chain"), "depth", "cum", "bytes", "a", "b"), ["chain", "depth"])
    inside = F.col("depth") < F.col("bottom")
    return out.unionByName(rows.select(
        F.col("chain").alias("conv_id"), "depth", F.when(F.col("depth") - 1 > F.col("attach"), F.col("chain")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(inside, F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves",
        ((F.col("n_convs") - 1) * (F.col("end") - F.col("cum") + F.col("bytes")) + F.col("rest")).alias("saved_tokens"), F.coalesce("sha256", none).alias("ends_sha256"), "a", "b",
    ))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*regrafted(turns_of(read(spark, sf_dir, "conversations")))).drop("a", "b")


_CRC = f"(xor({CRC32.format('conv_id::VARCHAR')}, 4294967295))"
ORACLE_SQL = {
    "op11_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) AS j
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id AS conv, {_CRC} % {GRAFT} AS h, conv_id - conv_id % {FAMILY} AS base, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM convs c LEFT JOIN convs b ON b.conv = c.base),
rebuilt AS (
  SELECT s.conv, t.j AS depth, t.role, t.text FROM sized s JOIN turns t ON t.conv = s.base AND t.j <= s.k
  UNION ALL SELECT s.conv, s.k + t.j - s.h, t.role, t.text FROM sized s JOIN turns t ON t.conv = s.conv AND t.j > s.h),
steps AS (SELECT conv, depth, strlen(text) AS bytes, sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, ',') OVER (PARTITION BY conv ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv, 0, 0, '' FROM convs),
lens AS (SELECT conv, max(depth) AS len FROM steps GROUP BY conv),
nodes AS (
  SELECT node, min(s.conv) AS conv_id, any_value(s.depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs,
    coalesce(string_agg(s.conv::VARCHAR, ',' ORDER BY s.conv) FILTER (s.depth = l.len), '') AS ends
  FROM steps s JOIN lens l USING (conv) GROUP BY node),
parents AS (SELECT DISTINCT c.node, p.node AS parent FROM steps c JOIN steps p ON c.conv = p.conv AND p.depth = c.depth - 1),
below AS (SELECT DISTINCT a.node, b.node AS other FROM steps a JOIN steps b ON a.conv = b.conv AND a.depth <= b.depth),
children AS (SELECT parent AS node, count(*) AS n FROM parents GROUP BY parent),
sums AS (
  SELECT b.node, sum((o.n_convs - 1) * o.bytes) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM below b JOIN nodes o ON o.node = b.other LEFT JOIN children c ON c.node = b.other GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN parents p USING (node) LEFT JOIN nodes q ON q.node = p.parent""",
}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
