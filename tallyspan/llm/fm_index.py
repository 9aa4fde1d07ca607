"""Benchmark decontamination by FM-indexes of training shards.

Each task packs its documents into shards of about SHARD_WORDS words and indexes the word
sequence of each: suffix array, Burrows-Wheeler transform in a wavelet matrix, every
SAMPLE-th suffix position. Test phrases are found by backward search and located by walking
to a sampled position; the hits of a document merge into removal spans.

Defined results: a null text has no words and hits nothing; a benchmark item of fewer than
WINDOW words is one phrase, one without words none; a very long text is a shard of its own;
repeated documents each get their row, repeated items (same id) count once; items with a
null id mark words but are not named; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep, read
from .wavelet import BitVector, WaveletMatrix
from .words import Words, slices

WINDOW = 13
SHARD_WORDS = 1 << 20
SAMPLE = 16
#: Phrases to a block, and in all for the blocks to be broadcast (about 150 bytes each).
BLOCK_PHRASES = 20_000
BROADCAST_PHRASES = 200_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over the groups that are still tied.
    Symbols are positive, and their last is unique, so no two suffixes are equal."""
    n, width = len(symbols), int(symbols.max()).bit_length()
    step = max(1, 62 // width)
    padded = np.append(symbols.astype(np.int64), np.zeros(step, np.int64))
    key = padded[:n].copy()
    for k in range(1, step):
        key = key << width | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    head = np.append(True, ordered[1:] != ordered[:-1])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied):
        at = order[tied]
        key = group[tied] << 32 | (rank[np.minimum(at + step, n)] + 1)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        head = np.append(True, key[1:] != key[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        rank[at] = group[tied]
        tied = tied[~(head & np.append(head[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Of documents given as word hashes. Symbol 0 of the transform is the end of a document."""

    def __init__(self, alphabet, starts, transform, marked, samples):
        self.alphabet, self.starts, self.transform, self.marked, self.samples = alphabet, starts, transform, marked, samples
        # how many suffixes start with a smaller symbol
        width = len(transform.planes)
        symbols = np.arange(len(alphabet) + 1)
        counts = transform.rank(symbols, np.full(len(symbols), transform.n)) if width else np.array([transform.n])
        self.smaller = np.append(0, np.cumsum(counts))

    @classmethod
    def of(cls, hashes: np.ndarray, lengths: np.ndarray) -> FMIndex:
        alphabet, word = np.unique(hashes, return_inverse=True)
        docs = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.zeros(len(hashes) + docs, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = word + docs + 1
        symbols[ends] = np.arange(1, docs + 1)  # each end sorts apart, so suffixes differ within their document
        order = suffix_array(symbols)
        symbols[ends] = 0
        symbols[inside] -= docs
        transform = WaveletMatrix.of(symbols[order - 1], max(1, len(alphabet).bit_length()))
        starts = np.append(0, ends[:-1] + 1) if docs else np.zeros(0, np.int64)
        sampled = order % SAMPLE == 0
        first = np.zeros(len(symbols), bool)
        first[starts] = True
        sampled |= first[order]  # walks never cross the end of a document
        return cls(alphabet, starts, transform, BitVector.of(sampled), order[sampled])

    def to_bytes(self) -> bytes:
        head = np.array([self.transform.n, len(self.transform.planes), len(self.alphabet), len(self.starts), len(self.samples)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.alphabet, self.starts, self.samples.astype(np.uint32), *(p.words for p in self.transform.planes), self.marked.words))

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        n, width, letters, docs, samples = np.frombuffer(data, np.int64, 5)
        at = 40

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        alphabet, starts, places = take(np.uint64, letters), take(np.int64, docs), take(np.uint32, samples).astype(np.int64)
        words = (len(data) - at) // 8 // (int(width) + 1)
        planes = [BitVector(take(np.uint64, words), int(n)) for _ in range(width + 1)]
        return cls(alphabet, starts, WaveletMatrix(planes[:-1], int(n)), planes[-1], places)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: a row of word hashes each, lengths: how many of them count.
        Gives the phrases that occur and their ranges of suffixes."""
        if not len(self.alphabet) or not len(phrases):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.minimum(np.searchsorted(self.alphabet, phrases), len(self.alphabet) - 1)
        used = np.arange(phrases.shape[1]) < lengths[:, None]
        alive = np.flatnonzero(((self.alphabet[found] == phrases) | ~used).all(1) & (lengths > 0))
        symbols, left = found[alive] + 1, lengths[alive] - 1
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.transform.n)
        while len(alive) and (left >= 0).any():
            go = left >= 0
            c = symbols[go, left[go]]
            low[go] = self.smaller[c] + self.transform.rank(c, low[go])
            high[go] = self.smaller[c] + self.transform.rank(c, high[go])
            left -= 1
            some = low < high
            alive, symbols, left, low, high = alive[some], symbols[some], left[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in these rows."""
        out, steps, which, now = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(which):
            done = self.marked.get(now)
            out[which[done]] = self.samples[self.marked.rank(now[done])] + steps
            which, now = which[~done], now[~done]
            symbol, before = self.transform.access_rank(now)
            now, steps = self.smaller[symbol] + before, steps + 1
        return out


INDEX_SCHEMA = "shard long, keys array<string>, doc_ids array<long>, lengths array<long>, fm binary"


def build_indexes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its documents in order and the serialised index over them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids, hashes = TaskContext.get().partitionId() << 24, [], []

        def flush():
            nonlocal shard, ids, hashes
            lengths = np.array([len(h) for h in hashes], np.int64)
            fm = FMIndex.of(np.concatenate(hashes), lengths).to_bytes()
            keys = [f"{shard}.{i}" for i in range(len(ids))]
            out = pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([keys], pa.list_(pa.string())), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([fm])], ["shard", "keys", "doc_ids", "lengths", "fm"])
            shard, ids, hashes = shard + 1, [], []
            return out

        held = 0
        for batch in batches:
            texts, names = batch.column(1), batch.column(0).to_pylist()
            for low, high in slices(texts):
                words = Words(texts[low:high])
                for i in range(high - low):
                    own = words.of(i)
                    if ids and held + len(own) > shard_words:
                        yield flush()
                        held = 0
                    ids.append(names[low + i])
                    hashes.append(own)
                    held += len(own) + 1
        if ids:
            yield flush()

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(build, INDEX_SCHEMA)


def phrases_of(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each distinct window of the items once: its word hashes and the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for low, high in slices(texts):
                words, rows, items = Words(texts[low:high]), [], []
                for i in range(high - low):
                    own = words.of(i).view(np.int64)
                    if len(own):
                        size = min(window, len(own))
                        rows += list(np.lib.stride_tricks.sliding_window_view(own, size))
                        items += [batch.column(0)[low + i].as_py()] * (len(own) - size + 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(items, pa.string())], ["words", "item"])

    rows = benchmark.select(F.col(id_column).cast("string"), F.col(text).cast("string")).mapInArrow(cut, "words array<long>, item string")
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


HIT_SCHEMA = "key string, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def find(indexes: DataFrame, phrases: DataFrame) -> DataFrame:
    """key, doc_id, n_words, spans (merged, of word places, end excluded) and items of every
    document. Phrases come in blocks; blocks are broadcast while they number at most
    BROADCAST_PHRASES, and above that every shard is stored and meets them one by one."""
    n = phrases.count()
    blocks = phrases.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(-(-n // BLOCK_PHRASES) or 1))).groupBy("block").agg(F.collect_list(F.struct("words", "items")).alias("phrases"))
    none = indexes.sparkSession.range(1).select(F.lit(-1).cast("long").alias("block"), F.array().cast("array<struct<words:array<long>,items:array<string>>>").alias("phrases"))
    blocks = none.unionByName(blocks)  # the block -1 gives every document its row
    pairs = indexes.crossJoin(F.broadcast(blocks)) if n <= BROADCAST_PHRASES else keep(indexes, "fm-index").crossJoin(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for batch in batches:
            for r in range(batch.num_rows):
                keys, ids, lengths, block = (batch.column(c)[r].as_py() for c in ("keys", "doc_ids", "lengths", "block"))
                if block < 0:
                    spans, items = [[]] * len(ids), [[]] * len(ids)
                else:
                    shard = batch.column("shard")[r].as_py()
                    if held[0] != shard:
                        held = shard, FMIndex.from_bytes(batch.column("fm")[r].as_buffer().to_pybytes())
                    keys, ids, lengths, spans, items = hits(held[1], keys, ids, lengths, batch.column("phrases")[r].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], ["key", "doc_id", "n_words", "spans", "items"])

    found = pairs.mapInArrow(search, HIT_SCHEMA)
    merged = found.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return merged.withColumns({"spans": merge_spans(F.col("spans")), "items": F.array_sort(F.array_distinct("items"))})


def hits(index: FMIndex, keys: list, ids: list, lengths: list, phrases: list) -> tuple:
    """The documents of a shard that phrases hit, with merged spans and the items' names."""
    size = np.array([len(p["words"]) for p in phrases])
    table = np.zeros((len(phrases), size.max()), np.uint64)
    table[np.arange(size.max()) < size[:, None]] = np.concatenate([np.array(p["words"], np.int64) for p in phrases]).view(np.uint64)
    which, low, high = index.search(table, size)
    times = high - low
    rows = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
    at, phrase = index.locate(rows), np.repeat(which, times)
    change = np.zeros(index.transform.n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size[phrase], -1)
    covered = np.cumsum(change) > 0
    edge = np.flatnonzero(np.diff(covered, prepend=False))
    spans, items = {}, {}
    for a, b, doc in zip(edge[::2].tolist(), edge[1::2].tolist(), (np.searchsorted(index.starts, edge[::2], "right") - 1).tolist(), strict=True):
        first = int(index.starts[doc])
        spans.setdefault(doc, []).append({"start": a - first, "end": b - first})
    doc_of = np.searchsorted(index.starts, at, "right") - 1
    for doc, p in np.unique(np.stack([doc_of, phrase], 1), axis=0).tolist():
        items.setdefault(doc, set()).update(phrases[p]["items"])
    hit = sorted(spans)
    return [keys[d] for d in hit], [ids[d] for d in hit], [lengths[d] for d in hit], [spans[d] for d in hit], [sorted(x for x in items[d] if x is not None) for d in hit]


def merge_spans(spans):
    """Sorted spans with those that overlap or touch joined into one."""

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # several blocks only: one block's spans are merged already
    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), empty, add))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, n_words, spans, items, n_hit and contaminated for every document."""
    rows = find(build_indexes(docs), phrases_of(benchmark))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated ones. Texts are judged under their own 64-bit hash, so
    rows without an id, or that share one, are told apart."""
    named = docs.select(F.xxhash64(F.col(text)).alias("doc_id"), F.col(text).alias("text"))
    gone = judge(named, benchmark).where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.xxhash64(F.col(text)) == F.col("_gone"), "left_anti")


def without_spans(text: str, spans: list) -> str:
    """The text with the words of the removal spans cut out, and what lies between them."""
    words = Words(pa.array([text]))
    kept, at = [], 0
    for span in spans:
        kept.append(words.data[at : words.start[span["start"]]].tobytes())
        at = int(words.end[span["end"] - 1])
    return b"".join([*kept, words.data[at:].tobytes()]).decode()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS g FROM b, range(1, greatest(0, len(w) - 12) + CASE WHEN len(w) BETWEEN 1 AND 12 THEN 2 ELSE 1 END) AS t(i)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, i, n, w[i:i + n - 1] AS g FROM d, sizes, range(1, len(w) - n + 2) AS t(i)),
hit AS MATERIALIZED (SELECT r, i, p.n, item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
words AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit), range(0, n) AS t(k) GROUP BY r),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL = {"op7_decontaminate": SQL}
