"""corpus_pipeline.run against a plain pass over the same rows, and its stages on odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspan.llm import fm_index, mixing, rule_ledger, token_shards, weighted_minhash


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class_id string, taken string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with nulls, empty, short and very long texts, repeats, copies, near copies and
    benchmark passages, and extra columns named like the stages' own; benchmark."""
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("corpus"))
    base = [prose(rng, 120) for _ in range(40)]
    items = [(f"i{k}", prose(rng, 30)) for k in range(4)] + [("null", None), ("empty", "")]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[1].title() + "!!", "s0") for i in range(30)]  # copies but for case and signs
    rows += [(200 + i, base[2].replace(base[2].split()[60], prose(rng, 1)), None) for i in range(10)]  # near copies
    rows += [(300 + i, f"{prose(rng, 70)} {items[i % 4][1]} {prose(rng, 40)}", "s1") for i in range(8)]  # contaminated
    rows += [(400, None, "s1"), (401, "", "s1"), (402, "too short", "s2"), (403, prose(rng, 60_000), "s2"), (404, "word " * 5000, "s2")]
    rows += [rows[5], rows[5], (None, prose(rng, 90), None), (7, prose(rng, 100), "s2")]
    full = [(i, t, "en", s, len(t or ""), False, "clash", None) for i, t, s in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split()


def kept_by_rules(text):
    own = (text or "").split()
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    upper = sum(c.isupper() for c in text or "")
    return len(own) >= 50 and 100 * len(repeated) <= 50 * len(own) and 10 * upper <= 3 * len("".join(own))


def test_run_equals_a_plain_pass(spark, tables):
    """Rules, copies and contamination by definition; the mix by its targets; tokens by the plain
    tokenizer over the documents that the stages left."""
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    path = lambda name: f"{folder}/{name.split()[0]}-out"
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(path(name))
        assert spark.read.parquet(path(name)).columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        docs = spark.read.parquet(path(name))
        left[name] = sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)
    first = sorted([r for r in rows if kept_by_rules(r[1])], key=str)
    assert left["quality rules"] == first
    # one row of each class: equal words, or a near copy of document 2
    best = {}
    for r in sorted(first, key=lambda r: (r[0] is None, r[0] or 0)):
        near = "two" if r[1] and len(set(words(r[1])) ^ set(words(rows[2][1]))) <= 2 else tuple(words(r[1]))
        best.setdefault(near, r)
    assert left["MinHash near-dedup"] == sorted(best.values(), key=str)
    windows = {tuple(words(t)[i : i + 13]) for _, t in items if t for i in range(max(1, len(words(t)) - 12)) if words(t)}

    def contaminated(text):
        own = words(text)
        hit = {i + k for i in range(len(own) - 12) if tuple(own[i : i + 13]) in windows for k in range(13)}
        return bool(hit) and 20 * len(hit) >= len(own)

    clean = [r for r in left["MinHash near-dedup"] if not contaminated(r[1])]
    assert left["benchmark decontamination"] == clean and len(clean) < len(best)
    size = lambda r: len(r[1].split())
    got, want = {}, {r.source: r.target for r in mixing.mix(spark.createDataFrame(clean, "doc_id long, text string, source string")).collect()}
    for r in left["mixing sources to target weights"]:
        got[r[2]] = got.get(r[2], 0) + size(r)
    assert {s: got.get(s, 0) for s in want} == {s: pytest.approx(t, abs=1) for s, t in want.items()}
    out = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    again = [tuple(r) for r in stages["token-ID / binary output"](spark, docs, folder).collect()]
    assert sorted(out, key=lambda r: r[1]) == sorted(again, key=lambda r: r[1])
    encoder = token_shards.Encoder(token_shards.tokenizer_path()).tokenizer
    ids = lambda t: [*encoder.encode(t or "", add_special_tokens=False).ids, token_shards.END]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert sorted((r[0] or -1, r[2], r[3]) for r in out) == sorted((i or -1, len(ids(t)), crc(t)) for i, t, _ in left["mixing sources to target weights"])
    assert [r[1] for r in sorted(out, key=lambda r: r[1])][:1] == [0]


def test_stages_of_an_empty_table(spark, tables, tmp_path):
    folder, _, items = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_those_of_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(hasattr(m, f) for m, f in ((rule_ledger, "filter_documents"), (weighted_minhash, "keep_one"), (fm_index, "clean_documents"), (mixing, "mixed_documents"), (token_shards, "tokenize")))
    assert F is not None and corpus_pipeline.ORACLE_SQL is None
