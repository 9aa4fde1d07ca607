import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPAN = 50


def brute(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept hash) of (id, text) rows."""
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        for p in range(len(data) - SPAN + 1) if i is not None else ():
            g = data[p : p + SPAN]
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data) + 1)
        for p in range(len(data) - SPAN + 1) if i is not None else ():
            if first[data[p : p + SPAN]] < i:
                gone[p : p + SPAN] = b"\1" * SPAN
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, extra=False):
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(3)
    if extra:
        frame = frame.select("*", *[F.lit(1).alias(c) for c in ("hash", "key", "spans", "start", "kept")])
    rows = repeats.without_repeats(frame).collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool):x}é"[: rng.randrange(2, 6)] for _ in range(n))


def mixed(seed, n=120):
    """Texts that share passages of all lengths about SPAN, whole copies and near copies."""
    rng = random.Random(seed)
    passages = [words(rng, k) for k in (8, 11, 12, 13, 14, 15, 16, 18, 25, 60)] + [("x" * k) for k in (49, 50, 51, 130)]
    docs = []
    for i in range(n):
        parts = [words(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(3)
            parts += [p[cut : len(p) - rng.randrange(3)], words(rng, rng.randrange(0, 30))]
        docs.append((i * 3 % n, " ".join(parts) if rng.random() < 0.5 else "".join(parts)))
    docs += [(n + i, docs[i][1]) for i in range(10)] + [(n + 20 + i, docs[i][1].replace("1", "2", 1)) for i in range(20)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = mixed(seed)
    assert run(spark, docs, extra=True) == brute(docs)


def test_crowded_minimizers_and_cut_runs(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 5)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    monkeypatch.setattr(repeats, "LOCAL", 3)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 5000)
    monkeypatch.setattr(repeats, "BLOCK", 700)
    docs = mixed(3, 60)
    assert run(spark, docs) == brute(docs)


def test_odd_rows(spark):
    rng = random.Random(5)
    passage = words(rng, 30)
    docs = [(1, None), (2, ""), (3, "short"), (4, passage), (5, passage), (5, passage), (5, passage + " more"), (None, passage), (None, passage), (-7, "x" + passage)]
    docs += [(10, "ab" * 30_000), (11, "ab" * 200), (12, "z" * 80 + "ab" * 60), (13, passage + " " + passage + " unlike " + words(rng, 20)), (14, "\0" * 70), (15, "q\0" + "\0" * 60)]
    docs += [(30, "one " + words(rng, 40)), (31, "é" * 60), (32, "é" * 24 + "è"), (33, "è" + "é" * 25)]
    assert run(spark, docs) == brute(docs)


def test_repeats_inside_one_document_follow_the_first(spark):
    rng = random.Random(6)
    long, head = words(rng, 60), words(rng, 14)
    docs = [(9, f"{long} - {words(rng, 5)} - {long}"), (2, words(rng, 30) + head), (1, long[30:100]), (5, f"{head} {head} {words(rng, 9)}")]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_longest_previous_factors():
    texts = [b"abcabcab" * 8, b"zabcabcab" * 8, b"abcabcab" * 7 + b"zzzzzzzz"]
    offsets = np.cumsum([0, *map(len, texts)])
    string, place, common = repeats.suffix_array(np.zeros(3), np.frombuffer(b"".join(texts), np.uint8), offsets, None)
    docs = np.array([7, 3, 5])
    got = repeats.previous_factors(docs[string], common)
    suffixes = [texts[s][p:] for s, p in zip(string, place)]
    assert suffixes == sorted(suffixes)
    for s, p, longest in zip(string, place, got):
        match = 0
        for o in range(3):
            for q in range(len(texts[o]) - SPAN + 1):
                if docs[o] < docs[s]:
                    k = 0
                    while p + k < len(texts[s]) and q + k < len(texts[o]) and texts[s][p + k] == texts[o][q + k]:
                        k += 1
                    match = max(match, k)
        assert longest == (match if match >= SPAN else 0)
