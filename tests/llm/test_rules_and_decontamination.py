import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import fm_index, rule_ledger

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "  \n\t ", "a b c a b c a b", "x\n\nx\nx \ny", "a a a a", "#one* two$ |three|", "é ü\u00a0z\x0bq", "w " * 70_000 + "end", "\n".join(["same line here"] * 40), " ".join(f"w{i}" for i in range(60))]


def test_measurements(spark):
    rows = {r.doc_id: r for r in rule_ledger.ledger(docs_of(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t), repr(t)[:40]


def test_policies_read_the_ledger_alone(spark):
    rows = rule_ledger.ledger(docs_of(spark, TEXTS)).select("doc_id", "failed_bits")
    base = {r.doc_id for r in rule_ledger.apply_policy(rows, "base").where("kept").collect()}
    assert base == {10} and rule_ledger.mask("base") == 3
    found = {r.rule: r for r in rule_ledger.ablation(rows).collect()}
    assert found["short"].failed >= 8 and found["short"].rejected_by_policy == 10


def test_filter_keeps_columns_and_survives_clashes(spark):
    docs = docs_of(spark, TEXTS).withColumn("n_words", F.lit("mine")).withColumn("failed_bits", F.lit(1))
    kept = rule_ledger.filter_documents(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r.n_words) for r in kept.collect()] == [(10, "mine")]
    assert rule_ledger.filter_documents(docs.limit(0)).count() == 0


def brute(texts, items):
    split = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            phrases.setdefault(tuple(w[i : i + 13]), set()).add(name)
    out = {}
    for i, t in enumerate(texts):
        w, hit, names = split(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (own := phrases.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= own
        ids = sorted(str(x) for x in names)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    long_item = " ".join(f"k{i}" for i in range(20))
    items = [(1, long_item), (2, "short ITEM"), (3, None), (4, "..."), (10, "short item"), (5, "a a a"), (1, long_item)]
    texts = [None, "", "x " + long_item + " y short item", "Short-Item short", "a a a a a", " ".join(f"k{i}" for i in range(19)), long_item[3:] * 2, "é " * 400 + "short item", "short item"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for words, block in ((1 << 20, 20_000), (30, 2)):  # one shard and block, then many
        monkeypatch.setattr(fm_index, "BLOCK_PHRASES", block)
        found = fm_index.find(fm_index.build_indexes(docs_of(spark, texts), shard_words=words), fm_index.phrases_of(benchmark))
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
        rows = {r.doc_id: r for r in found.withColumn("n_hit", n_hit).collect()}
        for i, (n, hit, n_items, sha, _) in brute(texts, items).items():
            assert (rows[i].n_words, rows[i].n_hit, len(rows[i]["items"])) == (n, hit, n_items), (i, words)
            assert hashlib.sha256(",".join(rows[i]["items"]).encode()).hexdigest() == sha


def test_contaminated_documents_go(spark):
    long_item = " ".join(f"k{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, long_item)], "item_id long, text string")
    docs = docs_of(spark, [long_item, "clean text", None, "w " * 600 + long_item])
    assert {r.doc_id for r in fm_index.clean_documents(docs, benchmark).collect()} == {1, 2, 3}
    assert fm_index.clean_documents(docs, benchmark.limit(0)).count() == 4
    assert fm_index.clean_documents(docs.limit(0), benchmark).count() == 0
    assert fm_index.without_spans("a, b c! d", [{"start": 1, "end": 3}]) == "a, ! d"


@pytest.mark.parametrize("seed", [0, 1])
def test_index_finds_all_places(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 40, 12)
    words = rng.integers(1, 5, lengths.sum()).astype(np.uint64)
    index = fm_index.FMIndex.from_bytes(fm_index.FMIndex.of(words, lengths).to_bytes())
    ends = np.cumsum(lengths)
    for _ in range(40):
        p = rng.integers(1, 6, rng.integers(1, 5)).astype(np.uint64)
        want = sorted(int(i + d) for d in range(12) for i in range(ends[d] - lengths[d], ends[d] - len(p) + 1) if (words[i : i + len(p)] == p).all())
        alive, low, high = index.search(p[None, :], np.array([len(p)]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(alive) else []
        assert got == want
