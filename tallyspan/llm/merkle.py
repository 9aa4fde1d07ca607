"""A Merkle manifest of a dataset: checkpoints every few levels, the rest made anew for proofs.

A row's leaf is the SHA-256 of its fields, each written as its UTF-8 length, a colon and its
value. Leaves of a source stand in order of id; every FANOUT consecutive nodes become one, the
digest of their hexadecimal digests, until one is left, the source's subroot. Subroots, in
order of source, become the root in the same way.

Only every STEP-th level is stored. A stored level is cut into aligned subtrees of FANOUT ** STEP
nodes, one row each: that many are grouped at most, however large a source is, and what they
give is the next stored level. A proof goes down from the root: each subtree makes its missing
levels anew from its stored nodes, adds their siblings to what its top node already has, and
drops them. All of it is column expressions.

Defined results: null fields are written as '-'; a null source is a source of its own, before
all others; null ids come first, and rows that repeat an id follow each other in the order of
their leaves; empty and very long texts are hashed whole; an empty table has no leaves, no root
and no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered
from .tables import keep, read

FANOUT = 16
#: Levels from one stored level to the next.
STEP = 2
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ids of which proofs of tampered rows are tried: those whose decimal's CRC-32 divides by this.
TAMPER = 5


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of some fields."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return digest(*written)


def runs(nodes: Column) -> Column:
    """The digests of every FANOUT consecutive nodes of an array."""
    starts = F.when(F.size(nodes) > 0, F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT)))
    return F.transform(starts, lambda at: F.sha2(F.array_join(F.slice(nodes, at, F.lit(FANOUT)), ""), 256))


def siblings(nodes: Column, at: Column) -> Column:
    """What stands left and right of place `at` (from 0) in its run."""
    begin = at - at % FANOUT
    return F.struct(
        F.array_join(F.slice(nodes, begin + 1, at - begin), "").alias("left"),
        F.array_join(F.slice(nodes, at + 2, F.lit(FANOUT - 1) - (at - begin)), "").alias("right"),
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda held, s: digest(s["left"], held, s["right"]))


def inner_levels(blocks: DataFrame, upto: int) -> DataFrame:
    """blocks with nodes_0, nodes_1, ...: the levels of each aligned subtree, made anew. Each is
    a column of its own, as one nested in the next would be worked out again for every run."""
    blocks = blocks.withColumnRenamed("nodes", "nodes_0")
    for k in range(1, upto):
        blocks = blocks.withColumn(f"nodes_{k}", runs(F.col(f"nodes_{k - 1}")))
    return blocks


@dataclass
class Forest:
    """Trees whose stored levels are rows (tree, block, n, nodes): n nodes has the tree on that
    level, nodes are the digests of one aligned subtree, and rows, on the lowest level, what the
    leaves carry. tops: tree, top (its last node)."""

    levels: list[DataFrame]
    tops: DataFrame


def grown(leaves: DataFrame, most: int, label: str) -> Forest:
    """The trees over leaves (tree, number, n, node, and row, a struct, if they carry anything), n the
    tree's leaves and most their maximum."""
    width, levels, level = FANOUT**STEP, [], leaves
    while True:
        carried = [c for c in ("node", "row") if c in level.columns]
        blocks = level.groupBy("tree", F.floor(F.col("number") / width).alias("block"))
        blocks = blocks.agg(F.max("n").alias("n"), F.collect_list(F.struct("number", *carried)).alias("all"))
        blocks = blocks.withColumn("all", F.array_sort("all", lambda x, y: F.when(x["number"] < y["number"], -1).otherwise(1)))
        blocks = blocks.select("tree", "block", "n", *[F.col("all")[c].alias(f"{c}s") for c in carried])
        levels.append(keep(blocks, f"{label}-{len(levels)}"))
        tops = inner_levels(levels[-1], STEP + 1)
        node = F.element_at(f"nodes_{STEP}", 1)
        for k in reversed(range(STEP)):  # a tree ends where one node is left
            node = F.when(F.col("n") <= FANOUT**k, F.element_at(f"nodes_{k}", 1)).otherwise(node)
        level = tops.select("tree", F.col("block").alias("number"), node.alias("node"), F.ceil(F.col("n") / width).alias("n"))
        if most <= width:
            return Forest(levels, level.select("tree", F.col("node").alias("top")))
        most = -(-most // width)


def proofs(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """tree, number, node, proof (siblings of each level up, from the leaf's) and row of all leaves;
    above (tree, proof) is what follows a tree's own."""
    width = FANOUT**STEP
    found = forest.tops.select("tree", F.lit(0).cast("long").alias("number"))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    found = found.withColumn("proof", empty) if above is None else found.join(above, "tree", "left").withColumn("proof", F.coalesce("proof", empty))
    for blocks in reversed(forest.levels):
        inner = inner_levels(blocks, STEP).join(found.select("tree", F.col("number").alias("block"), "proof"), ["tree", "block"])
        inner = inner.select("*", F.posexplode("nodes_0").alias("at", "node"))
        carried = [F.get("rows", F.col("at")).alias("row")] if "rows" in inner.columns else []
        own = [F.when(F.col("n") > FANOUT**k, F.array(siblings(F.col(f"nodes_{k}"), F.floor(F.col("at") / FANOUT**k).cast("int")))).otherwise(empty) for k in range(STEP)]
        found = inner.select("tree", (F.col("block") * width + F.col("at")).alias("number"), "node", F.concat(*own, "proof").alias("proof"), *carried)
    return found


@dataclass
class Manifest:
    """sources: a tree each, whose leaves carry source, doc_id, leaf and what was asked for; roots: the
    tree over them; subroots: tree, source and subroot; root: one row, or none for an empty table."""

    sources: Forest
    roots: Forest
    subroots: DataFrame
    root: DataFrame

    def proofs(self) -> DataFrame:
        """What each leaf carries, with tree, number, subroot, root and proof."""
        above = proofs(self.roots).select(F.col("number").alias("tree"), "proof")
        found = proofs(self.sources, above).join(self.subroots.drop("source"), "tree").crossJoin(F.broadcast(self.root))  # one row
        return found.select("row.*", "tree", "number", "proof", "subroot", "root")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs; also: more columns to keep beside the leaves."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of([F.col(f) for f in fields]).alias("leaf"), *[c.alias(n) for n, c in (also or {}).items()])
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    leaves = keep(numbered(rows, order, "source", "leaves"), "numbered")
    # sources are numbered as rows are, so there may be any number of them
    counts = numbered(leaves.groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), [F.col("all").asc(), F.col("source").asc_nulls_first()], "all", "sources")
    counts = keep(counts.select(F.col("source").alias("_source"), F.col("number").alias("tree"), "n"), "trees")
    bound = counts.agg(F.max("n").alias("n"), F.count("*").alias("sources")).first()
    leaves = leaves.drop("_part").join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    carried = F.struct("source", "doc_id", "leaf", *(also or {}))
    sources = grown(leaves.select("tree", "number", "n", F.col("leaf").alias("node"), carried.alias("row")), bound["n"] or 0, "tree")
    named = counts.select("tree", F.col("_source").alias("source")).join(sources.tops, "tree").withColumnRenamed("top", "subroot")
    roots = grown(named.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("number"), F.lit(bound["sources"]).cast("long").alias("n"), F.col("subroot").alias("node")), bound["sources"], "root")
    return Manifest(sources, roots, named, roots.tops.select(F.col("top").alias("root")))


def lowered(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from its leaf as it is, or tampered where so dealt."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    changed = leaf_of([lowered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, changed)
    rows = manifest(docs, also={"tampered": tampered}).proofs()
    joined = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a decimal number in SQL: its bytes, and eight steps of the polynomial for each.
CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"""
_CRC = f"(xor({CRC32.format('doc_id::VARCHAR')}, 4294967295))"


def _levels(name: str, of: str) -> str:
    """SQL of a forest's nodes: name(tree, level, i, n, node) from of(tree, i, n, node)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, n, node FROM {of}
  UNION ALL
  SELECT tree, min(level) + 1, i // 16, (min(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, i // 16)"""


def _written(text: str) -> str:
    return " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", text))


ORACLE_SQL = {
    "op12_manifest": f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, sha256({_written("text")}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_written("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered
  FROM documents),
sources AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM docs GROUP BY source),
leaves AS (
  SELECT d.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node
  FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
{_levels("inner_nodes", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, node FROM inner_nodes WHERE n = 1),
{_levels("outer_nodes", "subroots")},
every AS (SELECT 0 AS part, * FROM inner_nodes UNION ALL SELECT 1, * FROM outer_nodes),
climb AS (
  SELECT doc_id, leaf, tree AS source_tree, 0 AS part, tree, 0 AS level, i, n, coalesce(tampered, leaf) AS held, '' AS proof FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.source_tree,
    CASE WHEN c.n = 1 THEN 1 ELSE c.part END, CASE WHEN c.n = 1 THEN 0 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.n = 1 THEN c.tree ELSE c.i // 16 END,
    CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + 15) // 16 END,
    CASE WHEN c.n = 1 THEN c.held ELSE sha256(coalesce(s.before, '') || c.held || coalesce(s.after, '')) END,
    CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || coalesce(s.before, '') || coalesce(s.after, '') END
  FROM climb c LEFT JOIN (
    SELECT a.part, a.tree, a.level, a.i,
      string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i) AS before, string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i) AS after
    FROM every a JOIN every b ON a.part = b.part AND a.tree = b.tree AND a.level = b.level AND a.i // 16 = b.i // 16
    GROUP BY ALL) s ON c.part = s.part AND c.tree = s.tree AND c.level = s.level AND c.i = s.i
  WHERE c.part = 0 OR c.n > 1)
SELECT c.doc_id, c.leaf, r.node AS subroot, o.node AS root, sha256(c.proof) AS proof_sha256, c.held AS folded_root, c.held = o.node AS verified
FROM climb c JOIN subroots r ON r.i = c.source_tree, outer_nodes o
WHERE c.part = 1 AND c.n = 1 AND o.n = 1""",
}
QUERIES = {"op12_manifest": op12_manifest}
