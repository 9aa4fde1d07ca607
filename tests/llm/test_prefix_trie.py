import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c].sort(key=lambda r: r[:3])
    rebuilt = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(r[2:] for r in convs.get(base, [])[:h] + own[h:])
    members, children = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in own) or 1
        saved[node] = sum(saved[x] for x in own) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, path):
    frame = spark.createDataFrame(rows, TURNS).repartition(3).select("*", *[F.lit(1).alias(c) for c in ("conv", "depth", "n", "chain")])
    frame.write.parquet(f"{path}/conversations.parquet")
    return sorted(repr(tuple(r)) for r in prefix_trie.op11_prefix_trie(spark, str(path)).select(*COLUMNS).collect())


def shared(seed, n, texts=3):
    """Conversations of few different turns, so that they branch everywhere."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * n), n):
        rows += [(c, t, "user", "é" * rng.randrange(texts)) for t in range(rng.randrange(1, 14))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, tmp_path, seed):
    rows = shared(seed, 150)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, 0, "user", "left out"), (0, None, None, None), (0, 1, "user", "x"), (0, 1, "a", "y"), (1, 5, "user", "one"), (-7, 0, "user", "neg"), (-7, 1, "u", None), (-5, 0, "b", "base")]
    rows += [(10, t, "user", "hi" * t) for t in range(700)] + [(11, t, "user", "hi" * t) for t in range(690)] + [(12, t, "user", "hi" * t if t != 333 else "other") for t in range(700)]
    rows += [(c, 0, "user", "L" * 200_000) for c in (20, 25, 30)] + [(40, 0, "r", "same")] * 30
    assert run(spark, rows, tmp_path) == brute(rows)


def test_many_copies_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    from tallyspan.llm import numbering

    monkeypatch.setattr(numbering, "ROWS_A_RANGE", 40)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400, 5) for t in range(3)] + [(c, 0, "user", "alone") for c in range(1001, 1040)] + [(7000, t, "u", str(t % 2)) for t in range(150)] + shared(4, 40)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_ids_of_all_64_bits(spark, tmp_path):
    """Where batches end is approximate, and no id may lie beyond the last one."""
    rows = [(c, t, "user", f"{c % 3} {t}") for c in [2**63 - 1 - i for i in range(12)] + [-(2**63) + i for i in range(12)] for t in range(3)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_only_turnless(spark, tmp_path):
    absent = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:4]
    rows = [(c, 0, "user", "gone") for c in absent]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    found = spark.createDataFrame(pairs, "low long, high long").select("low", "high", prefix_trie.fattest("low", "high").alias("f")).collect()
    assert all(r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x) for r in found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    found = con.execute(prefix_trie.ORACLE_SQL["op11_prefix_trie"])
    assert [d[0] for d in found.description] == list(COLUMNS)
    assert sorted(repr(tuple(r)) for r in found.fetchall()) == sorted(repr(tuple(r)) for r in prefix_trie.op11_prefix_trie(spark, "/root/testdata/sf0.001").select(*COLUMNS).collect())


def test_lookups_of_a_search_are_one_join(spark):
    """The driver plans as many joins for long conversations as for short ones."""
    batch = spark.createDataFrame([(7, 3)], "conv long, len long")
    paths = spark.createDataFrame([(7, 1, 1, 1), (7, 2, 2, 2), (7, 3, 3, 3)], "conv long, depth long, h1 long, h2 long")
    nodes = spark.createDataFrame([(5, 1, 0, 2, 2, 2, 2, 2, 1, 1)], "chain long, level int, top long, bottom long, g1 long, g2 long, x1 long, x2 long, o1 long, o2 long")
    short, long = (prefix_trie.located(batch, nodes, paths, steps) for steps in (2, 20))
    joins = [df._jdf.queryExecution().analyzed().toString().count("Join ") for df in (short, long)]
    assert joins[0] == joins[1]
    assert [tuple(r) for r in long.select("conv", "chain", "level", "depth").collect()] == [(7, 5, 1, 2)]
