import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    fields = [*row[:4], row[4] if text is None else text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climbed(nodes):
    """(levels of one tree)"""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climbed([leaf(r) for r in by_source[s]])
    upper = climbed([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            held, proof = leaf(r, low(r[4])) if tampered else leaf(r), ""
            for levels, at in ((trees[s], i), (upper, k)):
                for level in levels[:-1]:
                    run = level[at - at % 16 : at - at % 16 + 16]
                    proof += "".join(run[: at % 16] + run[at % 16 + 1 :])
                    held = sha(*run[: at % 16], held, *run[at % 16 + 1 :])
                    at //= 16
            root = upper[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha(proof), held, held == root))
    return sorted(map(repr, out))


def run(spark, rows, tmp_path, extra=False):
    frame = spark.createDataFrame(rows, DOCS)
    if extra:
        frame = frame.select("*", *[F.lit(1).alias(c) for c in ("tree", "number", "node", "leaf", "n", "block")])
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op12_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(repr(tuple(r)) for r in found)


def table():
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(4200)]
    rows += [(i, "one more than a run", None, None, "Äx" * i) for i in range(17)]
    rows += [(i, None, "de", 1, "Null Source") for i in range(16)] + [(5, "alone", "en", 2, None)]
    rows += [(None, "odd", None, None, None), (7, "odd", "en", 1, ""), (7, "odd", "en", 1, "Same Id"), *[(9, "odd", "en", 1, "REPEAT")] * 40, (-3, "odd", "en", 1, "L" * 300_000)]
    return rows + [(i, f"s{i % 270}", "en", 3, "Many Sources") for i in range(300)]


def test_equals_a_plain_tree(spark, tmp_path):
    rows = table()
    assert run(spark, rows, tmp_path, extra=True) == brute(rows)


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_sizes_at_the_edges(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_only_every_second_level_is_stored(spark):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(5000)]
    held = merkle.manifest(spark.createDataFrame(rows, DOCS))
    counts = [sum(len(r.nodes) for r in level.select("nodes").collect()) for level in held.sources.levels]
    assert counts == [5000, 20]
    assert all(len(r.nodes) <= 256 for level in held.sources.levels for r in level.select("nodes").collect())


def test_proofs_show_every_sibling(spark):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(300)]
    proof = merkle.manifest(spark.createDataFrame(rows, DOCS)).proofs().where("doc_id = 299").first().proof
    leaves = [leaf(r) for r in rows]
    assert proof[0].left == "".join(leaves[288:299]) and proof[0].right == ""
    assert [(len(p.left) // 64, len(p.right) // 64) for p in proof] == [(11, 0), (2, 0), (1, 0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(merkle.ORACLE_SQL["op12_manifest"])
    columns = [d[0] for d in found.description]
    assert sorted(repr(tuple(r)) for r in found.fetchall()) == sorted(repr(tuple(r)) for r in merkle.op12_manifest(spark, "/root/testdata/sf0.001").select(*columns).collect())
