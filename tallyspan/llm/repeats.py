"""Repeats across documents by longest-previous-factor arrays: all but the first copy goes.

A byte goes if a run of SPAN bytes over it also starts in a document of a smaller id. Suffixes
are sorted into suffix arrays; for each suffix the previous and the next place of a document with
a smaller id give its longest earlier match (its longest previous factor), and matches of SPAN
bytes or more are removed.

Suffixes that share their first SPAN bytes must meet, and no others need to. So every run of
SPAN bytes is filed under its minimizer, the least hash of its GRAM-byte pieces; neighbouring
runs with one minimizer are one string (SPAN to SPAN + RUN - 1 bytes, about one in 17 bytes begins
one). Three steps:

1. Strings are packed by slices of documents and dealt by minimizer, as hashes: of equal strings
   only those of the least document remain, the others are removed whole. A minimizer that
   is left with one string has no other repeats.
2. The strings of all other minimizers, about one in twenty, are cut from the texts and dealt by
   minimizer. A task builds the suffix array of its minimizers' strings, shard by shard, and reads the
   longest previous factors from it. A minimizer of more than CROWD strings is several shards:
   each keeps the first of every SPAN-byte beginning, and these meet again, dealt by beginning.
3. Each document's removed spans are merged and cut from it.

Strings that repeat within one document and nowhere before it are carried once, the others as
aliases that take over what becomes of it.

Defined results: a null or empty text has no bytes, and its hash is that of no bytes; texts
shorter than SPAN keep all; rows that repeat an id, with the same text or another, don't remove each
other's bytes, and repeated rows get the same result; rows without an id have no smaller or larger
neighbour, remove nothing and keep all; very long texts are read whole, in blocks; an
empty table gives no rows; extra columns are ignored. Equal means equal 64-bit hashes of both the
minimizer and the string in step 1, and equal bytes in step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import drop, keep, read
from .words import mix, slices, text_bytes

#: Bytes of the shortest repeat, of the pieces whose least hash files it, and most starts of one string.
SPAN = 50
GRAM = 20
RUN = 64
#: Text of a slice, whose strings are packed together, text to a bucket of minimizers and to a
#: partition, and starts that are hashed at once.
SLICE_BYTES = 14 << 20
BUCKET_BYTES = 8 << 20
PART_BYTES = 16 << 20
BLOCK = 1 << 17
#: From so many different strings of one minimizer in a slice on, they go to step 2 at once.
LOCAL = 8
#: Most strings of a shard, bytes of strings whose suffix arrays are built together.
CROWD = 2048
SHARD_BYTES = 1 << 20
PARTITIONS = 20_000
BROADCAST_KEYS = 500_000

SPANS, REQUESTS, ALIASES, ENTRIES, MARKS = range(5)

with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _BASE = 0x9E3779B97F4A7C15
    _POWER = np.cumprod(np.append(np.uint64(1), np.full(BLOCK + SPAN + RUN, _BASE, np.uint64)))
    _INVERSE = np.cumprod(np.append(np.uint64(1), np.full(BLOCK + SPAN + RUN, pow(_BASE, -1, 1 << 64), np.uint64)))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def block_strings(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, starts in it, minimizer, hash) of the strings of a block; ends: where texts end in
    it, or the block itself. A block's last SPAN - 1 bytes begin no string."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POWER[: len(data)], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * _INVERSE[: len(data) - GRAM + 1])
        key = least(grams, SPAN - GRAM + 1)
        valid, fresh = np.ones(n + 1, bool), np.ones(n + 1, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:n])
        valid[n] = False
        for end in ends.tolist():
            valid[max(0, end - SPAN + 1) : end] = False
            fresh[min(end, n)] = True
        fresh |= ~valid
        edge = np.flatnonzero(fresh)
        start, size = edge[:-1], np.diff(edge)
        real = valid[start]
        start, size = start[real], size[real]
        parts = -(-size // RUN)
        at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(RUN, np.repeat(size, parts) - at * RUN)
        start = np.repeat(start, parts) + at * RUN
        whole = mix((total[start + size + SPAN - 1] - total[start]) * _INVERSE[start] + size.astype(np.uint64))
    return start, size, key[start], whole


def strings(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All strings of some texts: doc (index), start (in its text), size (starts), key, whole."""
    found = []
    for low in range(0, len(data), BLOCK):
        block = data[low : low + BLOCK + SPAN - 1]
        ends = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, low + len(block), "right")] - low
        start, *rest = block_strings(block, ends)
        found.append((start + low, *rest))
    start, size, key, whole = (np.concatenate(x) for x in zip(*found, strict=True)) if found else block_strings(data, offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    return {"doc": doc.astype(np.int32), "start": (start - offsets[doc]).astype(np.int32), "size": size.astype(np.uint8), "key": key, "whole": whole}


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by some columns differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Indices of the rows whose key occurs twice or more."""
    order = np.argsort(keys)
    edge = np.flatnonzero(np.append(firsts(keys[order]), True))
    return order[np.repeat(np.diff(edge) > 1, np.diff(edge))]


def settle(rows: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with keys that occur twice or more: (removed, alias, alias of, left, different strings
    of a left row's key), indices but for the last. ids: of each row's document."""
    at = repeated(rows["key"])
    key, whole, doc, start, name = (x[at] for x in (rows["key"], rows["whole"], rows["doc"], rows["start"], ids[rows["doc"]]))
    order = np.lexsort((start, doc, name, whole, key))
    at, key, whole, doc, name = (x[order] for x in (at, key, whole, doc, name))
    same = firsts(key, whole)
    group = np.cumsum(same) - 1
    later = name > name[np.flatnonzero(same)][group] if len(at) else np.zeros(0, bool)
    own = firsts(key, whole, doc)
    alias = ~later & ~own
    first = np.flatnonzero(own)[np.cumsum(own) - 1] if len(at) else np.zeros(0, np.int64)
    left = ~later & own
    bucket = np.cumsum(firsts(key)) - 1
    count = np.bincount(bucket[same], minlength=1)
    return at[later], at[alias], at[first[alias]], at[left], count[bucket[left]] if len(at) else np.zeros(0, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *(a.tobytes() for a in arrays)]))


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8, []
    n = int.from_bytes(data[:8], "little")
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


#: Columns of what is packed.
COLUMNS = {"doc": np.int64, "hash": np.int64, "start": np.int32, "size": np.uint8, "key": np.uint64, "whole": np.uint64, "of": np.int32}
FORMS = {SPANS: ("doc", "hash", "start", "size"), REQUESTS: ("doc", "hash", "start", "size", "key"), ALIASES: ("doc", "hash", "start", "size", "of"), ENTRIES: ("doc", "hash", "start", "size", "key", "whole"), MARKS: ("key",)}


def packed_strings(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, kind and blob: the strings of all slices, those that a slice can settle apart."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for low, high in slices(batch.column(2), SLICE_BYTES):
                ids, hashes = (batch.column(c)[low:high].to_numpy(zero_copy_only=False) for c in (0, 1))
                once = np.sort(np.unique(np.stack([ids, hashes]), axis=1, return_index=True)[1])
                texts = batch.column(2)[low:high].take(pa.array(once))
                ids, hashes = ids[once], hashes[once]
                rows = strings(*text_bytes(texts))
                removed, alias, of, left, different = settle(rows, ids)
                crowded = left[different >= LOCAL]
                sent = np.ones(len(rows["key"]), bool)
                for gone in (removed, alias, crowded):
                    sent[gone] = False
                column = lambda c, at: {"doc": lambda: ids[rows["doc"][at]], "hash": lambda: hashes[rows["doc"][at]]}.get(c, lambda: rows[c][at])()
                out, number = [], number + 1
                for kind, at in ((SPANS, np.sort(removed)), (REQUESTS, np.sort(crowded))):
                    if len(at):
                        out.append((number % buckets, kind, packed(*(column(c, at) for c in FORMS[kind]))))
                if len(alias):
                    out.append((number % buckets, ALIASES, packed(*(column(c, alias) for c in FORMS[ALIASES][:-1]), rows["start"][of])))
                for kind, at in ((ENTRIES, np.flatnonzero(sent)), (MARKS, np.unique(rows["key"][crowded]))):
                    bucket = ((rows["key"][at] if kind == ENTRIES else at) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                        blob = packed(*(column(c, at[part]) for c in FORMS[ENTRIES])) if kind == ENTRIES else packed(at[part])
                        out.append((int(bucket[part[0]]), kind, blob))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "blob"])

    return docs.select("doc_id", "hash", "text").mapInArrow(pack, "bucket int, kind int, blob binary")


JUDGED = "kind int, doc_id long, hash long, start int, size int, key long, of int"


def judged(blobs: DataFrame, buckets: int) -> DataFrame:
    """Spans to remove, aliases, and strings to compare byte by byte, of all buckets. A task
    holds one bucket at a time."""

    def rows_of(kind: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["start"])
        whole = [pa.array(np.full(n, kind, np.int32)), pa.array(columns["doc"]), pa.array(columns["hash"]), pa.array(columns["start"]), pa.array(columns["size"].astype(np.int32) + (SPAN - 1))]
        key = pa.array(columns["key"].view(np.int64)) if kind == REQUESTS else pa.nulls(n, pa.int64())
        of = pa.array(columns["of"]) if kind == ALIASES else pa.nulls(n, pa.int32())
        return pa.RecordBatch.from_arrays([*whole, key, of], ["kind", "doc_id", "hash", "start", "size", "key", "of"])

    def judge(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        found = {kind: [unpacked(b, *(COLUMNS[c] for c in FORMS[kind])) for b in blobs] for kind, blobs in held.items()}
        found = {kind: dict(zip(FORMS[kind], (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)) for kind, parts in found.items()}
        for kind in (SPANS, REQUESTS, ALIASES):
            if kind in found:
                yield rows_of(kind, found[kind])
        if ENTRIES in found:
            rows = found[ENTRIES]
            names, doc = np.unique(np.stack([rows["doc"], rows["hash"]]), axis=1, return_inverse=True)
            view = {"key": rows["key"], "whole": rows["whole"], "start": rows["start"], "doc": doc.ravel()}
            marked = np.unique(found[MARKS]["key"]) if MARKS in found else np.empty(0, np.uint64)
            removed, _, _, left, different = settle(view, names[0])
            many = np.zeros(len(doc), bool)
            many[left[different > 1]] = True
            if len(marked):
                known = np.minimum(np.searchsorted(marked, rows["key"]), len(marked) - 1)
                many |= marked[known] == rows["key"]
                many[removed] = False
            for kind, at in ((SPANS, removed), (REQUESTS, np.flatnonzero(many))):
                if len(at):
                    yield rows_of(kind, {c: x[at] for c, x in rows.items()})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = {}, None
        for batch in batches:
            for b, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    yield from judge(held)
                    held = {}
                bucket = b
                held.setdefault(kind, []).append(blob)
        if held:
            yield from judge(held)

    dealt = blobs.repartition(max(1, min(PARTITIONS, buckets * BUCKET_BYTES // PART_BYTES)), "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "kind", "blob").mapInArrow(each, JUDGED)


def cut_strings(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """key, doc_id, hash, start and string (bytes) of all requested strings."""
    lists = requests.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("key", "start", "size")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(3), 4 << 20):
                data, offsets = text_bytes(batch.column(3)[low:high])
                asked = batch.column(2)[low:high]
                key, start, size = asked.flatten().flatten()
                times = np.diff(asked.offsets.to_numpy())
                at = start.to_numpy().astype(np.int64) + np.repeat(offsets[:-1], times)
                length = size.to_numpy().astype(np.int64)
                ends = np.append(0, np.cumsum(length))
                own = data[np.arange(ends[-1]) + np.repeat(at - ends[:-1], length)]
                string = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.tobytes())])
                names = [batch.column(c)[low:high].take(pa.array(np.repeat(np.arange(high - low), times))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([key, *names, start, string], ["key", "doc_id", "hash", "start", "string"])

    return lists.join(docs, ["doc_id", "hash"]).select("doc_id", "hash", "asked", "text").mapInArrow(cut, "key long, doc_id long, hash long, start int, string binary")


def suffix_array(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(string and place of every suffix in order of group and bytes, matching bytes of each with the
    one before). starts: how many suffixes of a string are sorted, from its first."""
    times = np.diff(offsets) - (SPAN - 1) if starts is None else starts
    string = np.repeat(np.arange(len(times)), times)
    place = np.arange(len(string)) - np.repeat(np.cumsum(times) - times, times)
    length = np.diff(offsets)[string] - place
    width = int(length.max())
    padded = np.append(data, np.zeros(width, np.uint8))
    table = np.empty((len(string), 4 + width), np.uint8)
    table[:, :4] = (np.cumsum(firsts(group)) - 1)[string].astype(">u4").view(np.uint8).reshape(-1, 4)
    table[:, 4:] = np.lib.stride_tricks.sliding_window_view(padded, width)[offsets[:-1][string] + place]
    table[:, 4:][np.arange(width) >= length[:, None]] = 0
    order = np.argsort(table.view(f"S{4 + width}").ravel())
    table, string, place, length = table[order], string[order], place[order], length[order]
    differ = np.empty((len(order), 5 + width), bool)
    differ[0] = True
    differ[1:, :-1] = table[1:] != table[:-1]
    differ[:, -1] = True
    common = np.maximum(differ.argmax(axis=1) - 4, 0)
    common[1:] = np.minimum(common[1:], np.minimum(length[1:], length[:-1]))
    return string, place, common


def previous_factors(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest match of each suffix with a suffix of a lesser document, if of SPAN bytes or
    more, else 0. Such matches lie in runs of suffixes that share SPAN bytes; in a run, a
    stack gives the previous lesser document's place, and from the end the next one's."""
    out = np.zeros(len(doc), np.int64)
    linked = common >= SPAN
    linked[0] = False
    edge = np.append(np.flatnonzero(~linked), len(doc))
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if high - low < 2:
            continue
        docs, shared = doc[low:high].tolist(), common[low:high].tolist()
        if min(docs) == max(docs):
            continue
        best = [0] * len(docs)
        for order, step in ((range(len(docs)), 0), (range(len(docs) - 1, -1, -1), 1)):
            stack: list[tuple[int, int]] = []  # document, bytes shared with the stack's item below
            for i in order:
                now = shared[i] if not step else (shared[i + 1] if i + 1 < len(docs) else 0)
                while stack and stack[-1][0] >= docs[i]:
                    now = min(now, stack.pop()[1])
                if stack and now > best[i]:
                    best[i] = now
                stack.append((docs[i], now))
        out[low:high] = best
    return out


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each group, joined where they overlap or touch."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    if not len(group):
        return group, start, end
    rank = np.cumsum(firsts(group)) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * far)
    fresh = np.ones(len(group), bool)
    fresh[1:] = start[1:] + rank[1:] * far > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], reach[last] - rank[last] * far


SHARDS = "shard long, chunk int, doc_id long, hash long, start int, string binary, crowded boolean"
FOUND = "doc_id long, hash long, start int, size int, beginning long, string binary"


def factors(shards: DataFrame, partitions: int, whole: bool) -> DataFrame:
    """Spans to remove (start, size) of shards' strings, and, of crowded shards, the suffixes that
    stay (with string and the hash of its beginning). whole: all suffixes of a string are looked
    at, not only the first. A task holds about SHARD_BYTES of strings, or one shard."""

    def solve(batch: pa.Table) -> pa.RecordBatch:
        column = lambda c: batch.column(c).combine_chunks()
        string_column = column("string").cast(pa.large_binary())
        offsets = np.frombuffer(string_column.buffers()[1], np.int64)[string_column.offset : string_column.offset + len(string_column) + 1]
        data = np.frombuffer(string_column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        doc, start, crowded = (column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "crowded"))
        group = np.cumsum(firsts(column("shard").to_numpy(), column("chunk").to_numpy()))
        string, place, common = suffix_array(group, data, offsets, None if whole else np.ones(len(doc), np.int64))
        longest = previous_factors(doc[string], common)
        gone = longest > 0
        of, low, high = merged(string[gone], place[gone], (place + longest)[gone])
        left = np.flatnonzero(~gone & crowded[string])
        suffixes = [data[offsets[s] + p : offsets[s + 1]].tobytes() for s, p in zip(string[left].tolist(), place[left].tolist(), strict=True)]
        begin = [int.from_bytes(hashlib.blake2b(s[:SPAN], digest_size=8).digest(), "little", signed=True) for s in suffixes]
        rows = pa.array(np.append(of, string[left]))
        at = np.append(start[of] + low, start[string[left]] + place[left]).astype(np.int32)
        none = len(of)
        return pa.RecordBatch.from_arrays(
            [column("doc_id").take(rows), column("hash").take(rows), pa.array(at), pa.array(np.append(high - low, np.zeros(len(left), np.int64)).astype(np.int32)), pa.array([None] * none + begin, pa.int64()), pa.array([None] * none + suffixes, pa.binary())],
            [c.split()[0] for c in FOUND.split(", ")],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            edge = np.flatnonzero(firsts(table["shard"].to_numpy(), table["chunk"].to_numpy()))
            # whole shards go, about SHARD_BYTES at a time; the last may go on in the next batch
            low, per = 0, max(1, SHARD_BYTES * len(table) // max(1, table.nbytes))
            while low < edge[-1]:
                high = int(edge[max(np.searchsorted(edge, low, "right"), np.searchsorted(edge, low + per, "right") - 1)])
                yield solve(table.slice(low, high - low))
                low = high
            rest = table.slice(low)
            held, size = rest.to_batches(), 0
        if held and (table := pa.Table.from_batches(held)).num_rows:
            edge = np.append(np.flatnonzero(firsts(table["shard"].to_numpy(), table["chunk"].to_numpy())), len(table))
            low, per = 0, max(1, SHARD_BYTES * len(table) // max(1, table.nbytes))
            while low < len(table):
                high = int(edge[max(np.searchsorted(edge, low, "right"), np.searchsorted(edge, low + per, "right") - 1)])
                yield solve(table.slice(low, high - low))
                low = high

    dealt = shards.repartition(partitions, "shard", "chunk").sortWithinPartitions("shard", "chunk")
    return dealt.select(*[c.split()[0] for c in SHARDS.split(", ")]).mapInArrow(each, FOUND)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, hash, kind (SPANS or ALIASES), start, size and of: what goes from each document.
    docs has doc_id, hash (of the text) and text."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    first = keep(judged(packed_strings(docs, buckets), buckets), "judged")
    asked = first.where(F.col("kind") == REQUESTS).select("doc_id", "hash", "key", "start", "size")
    # rows that repeat an id and a text cut the same strings
    cut = keep(cut_strings(asked, docs).dropDuplicates(["key", "doc_id", "hash", "start"]), "strings")
    counts = cut.groupBy("key").agg(F.count("*").alias("n"))
    crowds = keep(counts.where(F.col("n") > CROWD).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "crowds")
    found = crowds.count()
    parts = cut.join(F.broadcast(crowds) if found <= BROADCAST_KEYS else crowds, "key", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("doc_id", "hash", "start"), F.col("parts")), F.lit(0)).cast("int")
    shards = parts.select(F.col("key").alias("shard"), chunk.alias("chunk"), "doc_id", "hash", "start", "string", F.col("parts").isNotNull().alias("crowded"))
    partitions = max(1, min(PARTITIONS, -(-total // (2 * PART_BYTES))))
    second = keep(factors(shards, partitions, whole=True), "factors")
    drop(cut)
    spans = second.where("size > 0")
    if found:
        # the firsts of all shards of a crowded minimizer meet by their beginnings
        again = second.where("size = 0").select(F.col("beginning").alias("shard"), F.lit(0).alias("chunk"), "doc_id", "hash", "start", "string", F.lit(False).alias("crowded"))
        spans = spans.unionByName(factors(again, partitions, whole=False))
    spans = spans.select("doc_id", "hash", F.lit(SPANS).alias("kind"), "start", "size", F.lit(None).cast("int").alias("of"))
    return first.where(F.col("kind") != REQUESTS).select("doc_id", "hash", "kind", "start", "size", "of").unionByName(spans)


def removed_spans(kind: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of one text's removed runs. An alias takes the spans inside the string it
    stands for."""
    plain = kind == SPANS
    low, high = start[plain], start[plain] + size[plain]
    if not plain.all():
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        more = [(low, high)]
        for s, n, o in zip(start[~plain].tolist(), size[~plain].tolist(), of[~plain].tolist(), strict=True):
            at = slice(*np.searchsorted(low, (o, o + n - SPAN + 1)))
            inside = high[at] <= o + n
            more.append((low[at][inside] + (s - o), high[at][inside] + (s - o)))
        low, high = (np.concatenate(x) for x in zip(*more, strict=True))
    _, low, high = merged(np.zeros(len(low), np.int64), low, high)
    return low, high


def named(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("hash", F.xxhash64("text"))


KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """doc_id, kept (the bytes that stay, which may begin or end inside a character; null unless
    asked for), n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    rows = named(docs, id_column, text)
    lists = spans_of(rows.where("doc_id IS NOT NULL")).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("kind", "start", "size", "of")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), 4 << 20):
                data, offsets = text_bytes(batch.column(1)[low:high])
                out = []
                for i, spans in enumerate(batch.column(2)[low:high]):
                    own = data[offsets[i] : offsets[i + 1]]
                    count, gone = 0, 0
                    if spans.is_valid:
                        kind, start, size, of = (c.fill_null(0).to_numpy() for c in spans.values.flatten())
                        begin, end = removed_spans(kind, start.astype(np.int64), size.astype(np.int64), of)
                        edges = np.zeros(len(own) + 1, np.int8)
                        edges[begin] += 1
                        edges[end] -= 1
                        stays = np.cumsum(edges[:-1], dtype=np.int8) == 0
                        count, gone, own = len(begin), int((end - begin).sum()), own[stays]
                    out.append((own.tobytes() if with_kept else None, len(own) + gone, gone, count, hashlib.sha256(own).hexdigest()))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *columns], [c.split()[0] for c in KEPT.split(", ")])

    return rows.join(lists, ["doc_id", "hash"], "left").select("doc_id", "text", "spans").mapInArrow(remove, KEPT)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"), with_kept=False).drop("kept")


QUERIES = {"op13_repeats": op13_repeats}
#: Suffix arrays have no SQL form; tests hold the results against brute force.
ORACLE_SQL: dict[str, str] = {}
