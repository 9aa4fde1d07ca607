"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document is a weighted set of five-word shingles: weight = occurrences x IDF. SAMPLES
consistent samples of it are banded; documents that share a band are compared by their exact
weighted Jaccard similarity, and pairs of SIMILARITY or more are linked. Classes are the
connected components of the links.

IDF of a shingle is the mean of its words' IDF, ln((1 + N) / (1 + df)) + 1, with df over all
documents. Document frequencies of whole shingles would count the very copies sought: the
members of a large group would weigh what they share at next to nothing and what sets them
apart at full, and fall below the threshold. Words in fewer than one in RARE documents share
the IDF of one in RARE, so the words that need a number of their own are at most RARE times
the mean count of distinct words in a document, however many documents there are.

Steps: (1) document frequencies of words; (2) samples of each document; documents with equal
words are one text from here on, named by 64 of the 128 bits of their hash, not by a document's
id, which several texts may share; (3) texts that share a band are
compared with the least text of its bucket (a star, not all pairs); (4) all texts that share a
bucket but no class yet are compared, however many there are: a bucket is dealt in blocks of
two chunks, a block's texts travel once, and its pairs are formed inside the task, where those
whose total weights differ too much for SIMILARITY are passed over; (5) components of the
links, by rounds that are written to the shared folder.

Defined results: documents without words are each a class of their own; texts of one to four
words have one shingle, all their words; repeated rows (same id) get one row each with equal
classes; different texts under one id are classed apart; rows with a null id are classed like
others, and a class of such rows alone has a null class_id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import keep, read
from .words import Words, mix, slices, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: A block compares two chunks of a bucket, each of about CROWD texts and CROWD_BYTES at most.
CROWD = 1024
CROWD_BYTES = 4 << 20
RARE = 64


class Idf:
    """IDF by word hash: a sorted table of the words that are not rare, and the rare one's."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, documents: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = (np.log((1 + documents) / (1 + df[order])) + 1).astype(np.float32)
        self.rare = np.float32(np.log((1 + documents) / (1 + max(1, documents / RARE))) + 1)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), self.rare, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.values[at], self.rare)


def shingles(words: np.ndarray, idf: Idf, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of one text and their TF-IDF weights."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    grams = windows(words, size)
    word_idf = idf.of(words)
    mean = np.convolve(word_idf, np.full(size, np.float32(1 / size)), "valid")
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    times = np.diff(np.append(first, len(grams)))
    return grams[first], times.astype(np.float32) * mean[order[first]].astype(np.float32)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """sum of minima over sum of maxima of two sorted weighted sets."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    same = b[0][at] == a[0]
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    low = np.minimum(x[same], y[at[same]]).sum()
    return float(low / (x.sum() + y.sum() - low))


class Sampler:
    """ICWS: for shingle s with weight w and sample k, r and c are Gamma(2, 1) and b uniform,
    all drawn from hash(s, k); t = floor(ln w / r + b), and s with the least
    ln c - r (t - b + 1) is the sample, together with t. Each draw takes 16 bits of the hash
    and a table of quantiles, which costs a fraction of three logarithms."""

    def __init__(self, samples: int):
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
        for _ in range(60):  # quantiles of Gamma(2, 1): 1 - (1 + x) exp(-x) = p
            x = (low + high) / 2
            below = 1 - (1 + x) * np.exp(-x) < p
            low, high = np.where(below, x, low), np.where(below, high, x)
        self.r = low.astype(np.float32)
        self.inverse = (1 / low).astype(np.float32)
        self.ln_c = np.log(low).astype(np.float32)
        self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def sample(self, hashes: np.ndarray, weights: np.ndarray, cells: int = 1 << 15) -> np.ndarray:
        """One 64-bit code of (shingle, t) for each sample of a non-empty weighted set."""
        n, best = len(self.seeds), None
        ln_w, block = np.log(weights).astype(np.float32), max(1, cells // len(self.seeds))  # tables that stay in cache
        for low in range(0, len(hashes), block):
            own = hashes[low : low + block]
            x = (own[None, :] ^ self.seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            draws = x.view(np.uint16).reshape(n, -1, 4)
            k = draws[:, :, 3]
            b = draws[:, :, 1] * np.float32(1 / 65536)
            t = np.floor(ln_w[None, low : low + block] * self.inverse[k] + b)
            score = self.ln_c[draws[:, :, 2]] - self.r[k] * (t - b + np.float32(1))
            at = score.argmin(1)
            rows = np.arange(n)
            found = score[rows, at], own[at], t[rows, at]
            if best is None:
                best = found
            else:
                less = found[0] < best[0]
                best = tuple(np.where(less, new, old) for new, old in zip(found, best, strict=True))
        return mix(best[1] ^ mix(best[2].astype(np.int64).view(np.uint64)))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[Idf, int]:
    """Counts over all documents, in how many each word is; words rarer than one in RARE
    are dropped after the exact count. What comes to the driver is bounded as above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, n, kept = [], np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def merged():
            every = np.concatenate([words, *held])
            times = np.concatenate([n, np.ones(sum(map(len, held)), np.int64)])
            order = np.argsort(every)
            every, times = every[order], times[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
            return every[first], np.add.reduceat(times, first) if len(first) else times

        def out(words, n):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for low, high in slices(batch.column(0)):
                found = Words(batch.column(0)[low:high])
                for i in range(high - low):
                    own = np.sort(found.of(i))
                    if len(own):
                        held.append(own[np.append(True, own[1:] != own[:-1])])
                        kept += len(held[-1])
                if kept > 1 << 20:
                    words, n = merged()
                    held, kept = [], 0
                    if len(words) > 1 << 21:
                        yield out(words, n)
                        words, n = words[:0], n[:0]
        words, n = merged()
        if len(words):
            yield out(words, n)

    total = docs.count()
    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = rows.where(F.col("n") * RARE >= total).toArrow()
    return Idf(common["word"].to_numpy().view(np.uint64), common["n"].to_numpy(), total), total


def text_hash(words: np.ndarray) -> tuple[int, int]:
    """128 bits of a text's words in order."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
        return int(np.bitwise_xor.reduce(mix(words + place)).view(np.int64)), int((mix(words ^ place) * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64))


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _hi and _lo, the text's hash; null without words."""
    names = [*docs.columns, "_hi", "_lo"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for low, high in slices(texts):
                found = Words(texts[low:high])
                own = [text_hash(found.of(i)) if len(found.of(i)) else (None, None) for i in range(high - low)]
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array([x[k] for x in own], pa.int64()) for k in (0, 1))], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("_hi", T.LongType()), T.StructField("_lo", T.LongType())])
    return docs.select("*", F.col(text).cast("string").alias("_text")).mapInArrow(add, schema)


def signatures(docs: DataFrame, idf: Idf, id_column: str = "doc_id", text: str = "text", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hi and text_lo (128 bits of its words; null without words), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(n_bands * rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts):
                found, hi, lo, bands = Words(texts[low:high]), [], [], []
                for i in range(high - low):
                    words = found.of(i)
                    if not len(words):
                        hi.append(None), lo.append(None), bands.append(None)
                        continue
                    for held, part in zip((hi, lo), text_hash(words), strict=True):
                        held.append(part)
                    with np.errstate(over="ignore"):
                        codes = sampler.sample(*shingles(words, idf)).reshape(n_bands, rows)
                        band = np.zeros(n_bands, np.uint64)
                        for r in range(rows):
                            band = mix(band + codes[:, r])
                    bands.append(band.view(np.int64))
                yield pa.RecordBatch.from_arrays([ids[low:high], pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_hi", "text_lo", "bands"])

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(sign, "doc_id long, text_hi long, text_lo long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """The pairs (a, b) with their exact weighted Jaccard similarity. texts: text_id, text. A
    hot text's pairs are split between tasks by the skew join."""
    both = pairs.join(texts.select(F.col("text_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("text_id").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # of the pairs before: a hot text's pairs follow each other
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            sets: dict[int, tuple] = {}
            names = [batch.column(c).to_pylist() for c in (0, 1)]
            for ids, texts in zip(names, (batch.column(2), batch.column(3)), strict=True):
                fresh = {name: i for i, name in enumerate(ids) if name not in sets}
                sets.update({name: held[name] for name in fresh.keys() & held.keys()})
                fresh = {name: i for name, i in fresh.items() if name not in sets}
                own, order = texts.take(pa.array(list(fresh.values()), pa.int64())), list(fresh)
                for low, high in slices(own):
                    found = Words(own[low:high])
                    for i in range(high - low):
                        sets[order[low + i]] = shingles(found.of(i), idf)
            held = sets
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([weighted_jaccard(sets[a], sets[b]) for a, b in zip(*names, strict=True)])], ["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component) of all ends of edges (a, b). Each round
    links every node to the least label near it and then follows labels one step; rounds
    needed grow with the logarithm of a component's diameter. Every round is written out."""
    pairs = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        of = labels.withColumnsRenamed({"id": "b", "label": "near"})
        near = pairs.join(of, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "id")
        least = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        # the label's own label, and what a member of the label found, are labels of all its members
        best = least.groupBy(F.col("label").alias("old")).agg(F.min("low").alias("best"))
        moved = least.join(best, F.col("label") == F.col("old")).select("id", "label", F.least("low", "best").alias("next"))
        now = keep(moved, "labels")
        if not now.where("next < label").limit(1).count():
            return now.select("id", F.col("next").alias("label"))
        labels = now.select("id", F.col("next").alias("label"))


def bucketed(bands: DataFrame) -> DataFrame:
    """text_id, band, code, least (the least text of the bucket) and n (its texts) for all
    buckets of more than one text."""
    rows = bands.select("text_id", F.posexplode("bands").alias("band", "code"))
    shared = rows.groupBy("band", "code").agg(F.min("text_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # stored first: a join that reads shuffled rows on both sides can split a hot bucket's
    return keep(rows.join(keep(shared, "shared"), ["band", "code"]), "buckets")


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text and the least text of each of its buckets: b < a."""
    return members.where("text_id <> least").select(F.col("text_id").alias("a"), F.col("least").alias("b")).distinct()


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, code, text_id, label and main (the label of most of the bucket's texts) of buckets
    whose texts have several labels. Of buckets of the same texts one is enough, and a bucket
    of two is settled by its star."""
    named = keep(members.where("n > 2").join(labels, "text_id", "left").select("band", "code", "text_id", F.coalesce("label", "text_id").alias("label")), "named")
    mark = F.xxhash64("text_id")
    of_label = named.groupBy("band", "code", "label").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("y"))
    spread = of_label.groupBy("band", "code").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    spread = spread.where("labels > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "code", "main")).alias("one")).select("one.*")
    return named.join(keep(spread, "spread"), ["band", "code"])


def block_links(rows: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """Links (a, b, similarity), b < a, that join all labels of open buckets whose texts are
    alike by SIMILARITY. A pair of different labels has a text that is not of the main label:
    chunks of those ask, and chunks of all texts answer. texts: text_id, text."""
    rows = rows.join(texts.select("text_id", F.octet_length("text").alias("size")), "text_id")
    rows = keep(rows, "open")
    chunks = lambda n, size: F.greatest(F.ceil(n / CROWD), F.ceil(size / CROWD_BYTES), F.lit(1)).cast("int")
    minor = F.col("label") != F.col("main")
    counts = rows.groupBy("band", "code").agg(chunks(F.count_if(minor), F.sum(F.when(minor, F.col("size")))).alias("asking"), chunks(F.count("*"), F.sum("size")).alias("asked"))
    rows = rows.join(keep(counts, "chunks"), ["band", "code"])
    own = lambda n: F.pmod(F.xxhash64("text_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "code", "text_id", "label"]
    asked = rows.select(*columns, F.lit(False).alias("asks"), every("asking").alias("q"), own("asked").alias("t"))
    asking = rows.where(minor).select(*columns, F.lit(True).alias("asks"), own("asking").alias("q"), every("asked").alias("t"))
    dealt = asked.unionByName(asking).join(texts, "text_id")

    def compare(block: pa.Table) -> pa.Table:
        found = links_of_block(*(block[c].to_pylist() for c in ("text_id", "label", "asks")), block["text"].combine_chunks(), idf)
        return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return dealt.groupBy("band", "code", "q", "t").applyInArrow(compare, "a long, b long, similarity double")


def links_of_block(ids: list[int], labels: list[int], asks: list[bool], texts: pa.Array, idf: Idf) -> list[tuple[int, int, float]]:
    """Links of one block: each joins two labels that no link before it has joined."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    place = {name: i for i, name in enumerate(ids)}  # a text can be in both chunks
    sets: dict[int, tuple] = {}
    for low, high in slices(texts):
        found = Words(texts[low:high])
        for i in range(high - low):
            if place[ids[low + i]] == low + i:
                sets[ids[low + i]] = shingles(found.of(i), idf)
    total = {name: float(own[1].sum(dtype=np.float64)) for name, own in sets.items()}
    parent = {label: label for label in labels}

    def root(label):
        while parent[label] != label:
            parent[label] = label = parent[parent[label]]
        return label

    of = dict(zip(ids, labels, strict=True))
    asked = sorted({name for name, ask in zip(ids, asks, strict=True) if not ask}, key=total.__getitem__)
    asking = sorted({name for name, ask in zip(ids, asks, strict=True) if ask})
    if not asked or not asking:
        return []
    sums = np.array([total[name] for name in asked])
    names, at = np.unique(np.concatenate([sets[name][0] for name in asked]), return_inverse=True)
    weights = np.concatenate([sets[name][1] for name in asked]).astype(np.float64)
    first = np.append(0, np.cumsum([len(sets[name][0]) for name in asked]))
    dense, out = np.zeros(len(names)), []
    for name in asking:
        # more than SIMILARITY apart in total weight is more than that apart; the margin is for rounding
        low = int(np.searchsorted(sums, total[name] * SIMILARITY * (1 - 1e-9)))
        high = int(np.searchsorted(sums, total[name] / SIMILARITY * (1 + 1e-9), "right"))
        mine = root(of[name])
        if all(root(of[other]) == mine for other in asked[low:high]):
            continue
        own, weight = sets[name]
        where = np.minimum(np.searchsorted(names, own), len(names) - 1)
        same = names[where] == own
        dense[where[same]] = weight[same]
        part = slice(first[low], first[high])
        shared = np.add.reduceat(np.minimum(dense[at[part]], weights[part]), first[low:high] - first[low])
        dense[where[same]] = 0
        alike = shared / (total[name] + sums[low:high] - shared)
        for i in np.flatnonzero(alike >= SIMILARITY).tolist():
            other = asked[low + i]
            x, y = root(of[name]), root(of[other])
            if x != y:
                parent[x] = y
                out.append((max(name, other), min(name, other), float(alike[i])))
    return out


def classes_of(texts: DataFrame, named: DataFrame, idf: Idf) -> DataFrame:
    """text_id and label of all texts that are linked to another: stars first, then all pairs
    of the buckets whose texts stars have not put in one class, in blocks. texts: text_id,
    bands; named: text_id, text, of rows that may repeat a text."""
    members = bucketed(texts)
    # one row a text first: copies are merged before the shuffle, and the join follows its deal
    own = named.where("text_id IS NOT NULL").groupBy("text_id").agg(F.min("text").alias("text"))
    own = keep(own.join(members.select("text_id").distinct(), "text_id"), "bucket-texts")
    found = keep(verify(stars(members), own, idf), "compared")
    links = found.where(F.col("similarity") >= SIMILARITY)
    labels = components(links).withColumnRenamed("id", "text_id")
    rows = keep(open_buckets(members, labels), "open-buckets")
    more = keep(block_links(rows, own, idf), "block-links")
    if not more.limit(1).count():
        return labels
    return components(links.select("a", "b").unionByName(more.select("a", "b"))).withColumnRenamed("id", "text_id")


def classed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hi, text_lo of every row; text_hi, text_lo, label, first (the least id,
    text of its class, null ids last), text_id and class_texts of every text with words)."""
    idf, _ = document_frequencies(docs, text)
    signed = keep(signatures(docs, idf, id_column, text), "signatures")
    texts = signed.where("bands IS NOT NULL").groupBy("text_hi", "text_lo").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("least"))
    texts = keep(texts.withColumn("text_id", F.col("text_hi")), "texts")
    named = with_hash(docs.select(F.col(text).cast("string").alias("text"))).select(F.col("_hi").alias("text_id"), "text")
    labels = classes_of(texts.select("text_id", "bands"), named, idf)
    classes = texts.join(labels, "text_id", "left").select("text_hi", "text_lo", F.col("least").alias("text_id"), F.coalesce("label", "text_id").alias("label"))
    first = F.min(F.struct(F.col("text_id").isNull().alias("no_id"), "text_id", "text_hi", "text_lo")).alias("first")
    sizes = classes.groupBy("label").agg(F.count("*").alias("class_texts"), first)
    return signed.select("doc_id", "text_hi", "text_lo"), keep(classes.join(sizes, "label"), "classes")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), text_id (the least
    id with the same words) and class_texts (different texts in the class)."""
    signed, classes = classed(docs, id_column, text)
    rows = signed.join(classes.withColumn("worded", F.lit(True)), ["text_hi", "text_lo"], "left")
    own = lambda c: F.when(F.col("worded"), F.col(c)).otherwise(F.col("doc_id"))
    return rows.select("doc_id", own("first.text_id").alias("class_id"), own("text_id").alias("text_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class: that of the least (id, text hash, text), rows without an
    id last. Rows without words all stay. Rows that repeat the first one are told by their
    other columns, or any one of them stays; only such rows are shuffled whole."""
    signed, classes = classed(docs, id_column, text)
    first = classes.select("first.*").distinct().select(F.col("text_id").alias("_id"), F.col("text_hi").alias("_hi"), F.col("text_lo").alias("_lo"))
    times = signed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hi").alias("_hi"), F.col("text_lo").alias("_lo")).agg(F.count("*").alias("_n"))
    first = keep(first.alias("f").join(times.alias("t"), F.expr("f._id <=> t._id AND f._hi = t._hi AND f._lo = t._lo")).select("f.*", "_n"), "first")
    rows = with_hash(docs, text).withColumn("_id", F.col(id_column).cast("long"))
    fits = F.expr("r._id <=> f._id AND r._hi = f._hi AND r._lo = f._lo")
    columns = docs.columns
    once = rows.alias("r").join(first.where("_n = 1").alias("f"), fits, "left_semi").select(*columns)
    many = rows.alias("r").join(first.where("_n > 1").alias("f"), fits, "left_semi")
    tie = F.struct(F.col(text).cast("string"), F.to_json(F.struct(*columns)))
    many = many.groupBy("_hi", "_lo").agg(F.min_by(F.struct(*columns), tie).alias("_row")).select("_row.*")
    return once.unionByName(many).unionByName(rows.where("_hi IS NULL").select(*columns))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLE_SQL: dict[str, str] = {}
