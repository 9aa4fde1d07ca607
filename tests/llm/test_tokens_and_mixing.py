import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import mixing, token_shards, words
from tallyspan.llm.wavelet import WaveletMatrix

TEXTS = [(3, "Plain text, twice.\nPlain text"), (1, None), (2, ""), (4, " a  b   c \n\n d "), (5, "x\u00a0 y"), (6, "<|endoftext|> é 日本語"), (None, "hello  world"), (7, "word " * 3000), (8, " "), (9, "tail ")]


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(token_shards.tokenizer_path())
    encoder.encode_special_tokens = True
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    path, want, start = f"file://{tmp_path}/shards", [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_shards.tokenize(docs, path=path, shard_bytes=4000).collect()]
    assert sorted(got, key=lambda r: r[1]) == want and spark.read.parquet(path).count() > 1
    token = encoder.encode("word word").ids[1]
    assert token_shards.lookup(spark, path, token).where("doc_id = 7").count() == 2999
    assert token_shards.tokenize(docs.limit(0)).count() == 0


def test_pieces_encode_as_whole_texts():
    import random

    import pyarrow as pa

    own, rng = token_shards.Encoder(token_shards.tokenizer_path()), random.Random(1)
    some = [*"ab's.t,!? \n\t\r 12  '\x1c\x0b\x00_-#<|>", *"é\u2003\xa0“”\u3000日٣\x85½😀\u200b", "n't", "'ll", "<|endoftext|>", " ", " the", "\n\n"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(20_000)] + ["", "  ", "x" * 5000]
    for at in range(0, len(texts), 4000):
        part = texts[at : at + 4000]
        ids, sizes = own.batch(pa.array([t or None for t in part]))
        want = [[*e.ids, token_shards.END] for e in own.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    held = len(own.end)
    own.forget()
    assert len(own.end) == 2 < held and own.batch(pa.array(["a b a"]))[1].tolist() == [4]


def test_memory_of_pieces_is_bounded_by_bytes(monkeypatch):
    """Texts without a place to cut pass the memory by; others make it start anew."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(token_shards, "POOL_BYTES", 1 << 16)
    own, rng, most = token_shards.Encoder(token_shards.tokenizer_path()), random.Random(2), 0
    signs = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 600))
    for n in range(10):
        texts = ["".join(rng.choices(signs, k=1000)) for _ in range(500)] + [f"word{rng.randrange(10**6)} x" for _ in range(3000)]
        ids, sizes = own.batch(pa.array(texts))
        most = max(most, own.pool.nbytes)
        if n in (0, 9):
            want = [[*e.ids, token_shards.END] for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert most < 2 << 16 and own.end.dtype == np.int64


def test_equal_and_null_ids_are_dealt_to_several_parts(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text {i} " * 50) for i in range(400)], "doc_id long, text string").withColumn("start", F.lit("clash"))
    token_shards.write_shards(docs, f"file://{tmp_path}/s", token_shards.tokenizer_path(), 8)
    shards = spark.read.parquet(f"{tmp_path}/s")
    assert shards.select("part").distinct().count() >= 6 and shards.agg(F.sum("n_docs")).first()[0] == 400
    rows = token_shards.read_documents(spark, f"file://{tmp_path}/s").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 200 + [5] * 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n, top", [(0, 3), (1, 1), (1000, 2), (777, 50257)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    w = WaveletMatrix.of(x, max(1, top.bit_length()))
    assert (w.all() == x).all()
    for s in set(x[:5].tolist()):
        at = np.flatnonzero(x == s)
        assert w.count(s) == len(at) and (w.occurrences(s) == at).all() and (w.rank(np.full(len(at), s), at) == np.arange(len(at))).all()
    assert (w.access(np.arange(n)) == x).all()


def test_words_equal_the_pattern():
    import pyarrow as pa

    texts = ["Ab c-d", "", None, "x", "x y", "éé É!z9 ", "a" * 70_000, "end"]
    found = words.Words(pa.array(texts), (2,))
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        spans = zip(found.start[found.first[i] : found.first[i + 1]], found.end[found.first[i] : found.first[i + 1]], strict=True)
        assert [re.sub("[A-Z]", lambda m: m[0].lower(), bytes(found.data[a:b]).decode()) for a, b in spans] == want
    assert found.of(3)[0] == found.of(4)[0] and len(set(found.hashes.tolist())) == len(found.hashes) - 1


def test_far_bytes_of_a_long_word_count():
    import pyarrow as pa

    long = ["a"] * 140_000
    long[5], long[5 + (1 << 16)] = "b", "c"
    other = long.copy()
    other[5], other[5 + (1 << 16)] = "c", "b"
    found = words.Words(pa.array(["".join(long), "".join(other)]))
    assert len(set(found.hashes.tolist())) == 2


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """By water filling: cap, reshare the excess by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= epochs * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = epochs * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 17), None if i % 9 == 0 else f"s{i % 5}") for i in range(400)] + [(i, "hot word", "s0") for i in range(400, 1000)] + [(1000, None, "empty"), (7, "w " * 7, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).withColumn("size", F.lit("clash"))
    found = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in found if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and sum(r.taken for r in own) == int(own[0].target)
    assert all(0 <= r.taken <= 2 * r.size for r in found) and len(found) == len(rows)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    assert all(abs(got.get(s, 0) - int(t)) <= 1 for s, t in want.items())
    assert mixing.mix(docs.limit(0)).count() == 0
