"""Token ids in wavelet matrices, compressed shards in Spark's own files.

Documents are range-sorted by id (ties by a hash of the text, so that equal or null ids can be
split); a task encodes its whole texts with a public tokenizer, ends each document with END and
stores the ids of about every SHARD_BYTES of text as one wavelet matrix: bit planes with rank
and select, so a shard answers token access, counting and occurrence lookup. Shards are rows of
Parquet files, written by Spark and thus to any store:

    part long, shard long (order within the part), n_docs long, n_tokens long,
    doc_ids array<long>, ends array<long> (running count of ids at each document's end),
    width int (bits an id), planes binary (all planes' 64-bit words, zstd-compressed)

Encoding cuts a text where the tokenizer's own pattern always ends a match, whatever follows
(see `cuts`): the pieces' ids joined are the whole text's ids. A distinct piece is encoded once
per worker while the worker's memory of pieces, which is bounded by PIECES and POOL_BYTES, holds
it. Pieces of more than LONG_PIECE bytes, as texts in scripts without blanks are, pass it by.

Defined results: a null or empty text has the END id alone; null ids sort first; rows that
repeat an id are separate documents in the order of their texts' hashes; very long texts are
encoded whole; an empty table writes no shard and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read, shared_path
from .wavelet import BitVector, WaveletMatrix
from .words import mix, slices, text_bytes

END = 0
#: Bytes of text to a shard, and the most range partitions: beyond, a partition has more shards.
SHARD_BYTES = 16 << 20
PARTITIONS = 20_000
#: Pieces, and bytes of their ids, from which on a Python worker starts anew, and bytes of the longest
#: piece that it keeps. A piece costs 28 bytes and its ids, so the memory is bounded by the sum of
#: both and what one slice adds.
PIECES = 1 << 20
POOL_BYTES = 32 << 20
LONG_PIECE = 128
#: Bytes that are cut into pieces at once.
SLICE_BYTES = 4 << 20

#: Kinds of bytes: other ASCII, letters and digits, the blank, white space, separators 28 to
#: 31 (which not all patterns take for white space), and bytes of non-ASCII characters.
OTHER, ALNUM, BLANK, SPACE, SEPARATOR, WIDE = range(6)
_KIND = np.zeros(256, np.uint8)
for _low, _high, _kind in ((48, 58, ALNUM), (65, 91, ALNUM), (97, 123, ALNUM), (9, 14, SPACE), (28, 32, SEPARATOR), (32, 33, BLANK), (128, 256, WIDE)):
    _KIND[_low:_high] = _kind


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where pieces begin, and the end of data. A byte-level pattern of the form
    'contraction | blank? letters | blank? digits | blank? others | white space' ends a match
    at each of them and looks no further: after a letter or digit before any other ASCII byte;
    before a blank that follows no white space; between other bytes and a letter or digit, but
    for the apostrophe of a contraction; around one line end between such bytes."""
    if not len(data):
        return np.zeros(1, np.int64)
    kind = _KIND[data]
    left, right = kind[:-1], kind[1:]
    solid = left <= ALNUM
    cut = np.ones(len(data) + 1, bool)
    inner = cut[1:-1]
    np.logical_and(left == ALNUM, (right != ALNUM) & (right != WIDE), out=inner)
    inner |= (left == OTHER) & ((right == BLANK) | (right == SPACE))
    inner |= (left == OTHER) & (right == ALNUM) & (data[:-1] != ord("'"))
    inner[1:] |= solid[:-1] & (left[1:] == SPACE) & (right[1:] <= ALNUM)
    wide = np.flatnonzero((left == WIDE) & (right == BLANK))
    if len(wide):
        # non-ASCII white space (C2 85, C2 A0, and some of E1 to E3 followed by 80, 81, 9A or A0) is no place to cut
        second, third = data[wide - 1], data[np.maximum(wide - 2, 0)]
        space = (second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3) & np.isin(second, (0x80, 0x81, 0x9A, 0xA0)))
        inner[wide[~space]] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


def pieces_of(data: np.ndarray, begin: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(np.ascontiguousarray(begin, np.int64)), pa.py_buffer(data)])


def hashes(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every non-empty piece, in two halves."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint64)
    within = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    with np.errstate(over="ignore"):
        value = mix((within << np.uint64(8) | data) + np.uint64(1))
        return np.add.reduceat(value, offsets[:-1]), np.add.reduceat(mix(value), offsets[:-1])


class Encoder:
    """Texts to ids, with a memory of the pieces that have been encoded: sorted hashes of 128
    bits and the pieces' ids one after another. Fresh pieces are encoded many to a call."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.starts_blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts_blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # a byte-level blank
        self.forget()

    def forget(self) -> None:
        """Keeps one piece, number 0: the END id."""
        self.high, self.low, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.pool, self.end = np.array([END], self.dtype), np.array([0, 1], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode(texts)
        return np.array([i for own in ids for i in own], self.dtype), np.array(list(map(len, ids)), np.int64)

    def learn(self, fresh: pa.LargeBinaryArray) -> np.ndarray:
        """The numbers of new pieces. Those that hold one blank, at their start, are joined in
        calls of 2000 and told apart by the tokens that start with a blank."""
        joined = pc.and_(pc.starts_with(fresh, " "), pc.equal(pc.count_substring(fresh, " "), 1))
        joined = joined.to_numpy(zero_copy_only=False)
        order, found = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)]), []
        together = fresh.take(pa.array(np.flatnonzero(joined)))
        for at in range(0, len(together), 2000):
            own = together.slice(at, 2000)
            data, _ = text_bytes(own)
            ids = np.array(self.encode([data.tobytes().decode()])[0], self.dtype)
            first = np.flatnonzero(self.starts_blank[ids])
            found.append((ids, np.diff(np.append(first, len(ids)))) if len(first) == len(own) else self.each([x.decode() for x in own.to_pylist()]))
        found.append(self.each([x.decode() for x in fresh.take(pa.array(np.flatnonzero(~joined))).to_pylist()]))
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        number = np.empty(len(fresh), np.int32)
        number[order] = len(self.end) - 1 + np.arange(len(fresh), dtype=np.int32)
        self.pool = np.concatenate([self.pool, ids])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(sizes)])
        return number

    def numbers(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """The number of each of some distinct pieces."""
        high, low = hashes(pieces)
        at = np.searchsorted(self.high, high)
        inside = np.minimum(at, max(0, len(self.high) - 1))
        known = (self.high[inside] == high) & (self.low[inside] == low) if len(self.high) else np.zeros(len(high), bool)
        number = self.number[inside] if len(self.high) else np.zeros(len(high), np.int32)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            number[fresh] = self.learn(pieces.take(pa.array(fresh)))
            fresh = fresh[np.argsort(high[fresh])]
            at = np.searchsorted(self.high, high[fresh])
            self.high, self.low, self.number = (np.insert(held, at, new[fresh]) for held, new in ((self.high, high), (self.low, low), (self.number, number)))
        return number

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each followed by END; ids of each text)."""
        data, offsets = text_bytes(texts)
        begin = cuts(data, offsets)
        coded = pieces_of(data, begin).dictionary_encode()
        if len(self.end) > PIECES or self.pool.nbytes > POOL_BYTES:
            self.forget()
        long = pc.greater(pc.binary_length(coded.dictionary), LONG_PIECE).to_numpy(zero_copy_only=False)
        known = np.empty(len(long), np.int32)
        known[~long] = self.numbers(coded.dictionary.filter(pa.array(~long))) if not long.all() else 0
        kept = len(self.pool), len(self.end)
        if long.any():  # after the others, so that they can be cut off again
            known[long] = self.learn(coded.dictionary.filter(pa.array(long)))
        number = known[coded.indices.to_numpy()]
        after = np.searchsorted(begin, offsets[1:])
        number = np.insert(number, after, 0)
        size = np.diff(self.end)[number]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        ids = self.pool[np.repeat(self.end[number] - ends[:-1], size) + np.arange(ends[-1])]
        if long.any():
            self.pool, self.end = self.pool[: kept[0]].copy(), self.end[: kept[1]].copy()
        return ids, np.diff(np.append(0, ends[after + np.arange(1, len(texts) + 1)]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder to a Python worker: its memory serves all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SHARD_SCHEMA = "part long, shard long, n_docs long, n_tokens long, doc_ids array<long>, ends array<long>, width int, planes binary"


def pack(matrix: WaveletMatrix) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.words.tobytes() for p in matrix.planes))


def unpack(planes: bytes, width: int, n: int) -> WaveletMatrix:
    """The matrix of a shard's row: access, rank, select, count and occurrences work on it."""
    import zstandard

    words = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), np.uint64).reshape(width, -1)
    return WaveletMatrix([BitVector(w, n) for w in words], n)


def packed(part: int, shard: int, ids: list[pa.Array], tokens: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """One shard's row."""
    every, ends, names = np.concatenate(tokens), np.cumsum(np.concatenate(sizes)), pa.concat_arrays(ids)
    tokens.clear()
    width = max(1, int(every.max()).bit_length())
    data = pack(WaveletMatrix.of(every, width))
    numbers = [pa.array([x], pa.int64()) for x in (part, shard, len(ends), len(every))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, pa.array(ends))]
    return pa.RecordBatch.from_arrays([*numbers, *lists, pa.array([width], pa.int32()), pa.array([data])], ["part", "shard", "n_docs", "n_tokens", "doc_ids", "ends", "width", "planes"])


def write_shards(docs: DataFrame, path: str, tokenizer: str, parts: int, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text: str = "text") -> None:
    """Writes the shards of `parts` ranges of ids under path. A shard ends with the first slice
    of texts that brings it to shard_bytes, so no task holds more than that and one text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, shard, held = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, tokens, sizes = [], [], []
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1)[low:high]
                found, size = own.batch(texts)
                ids.append(batch.column(0)[low:high])
                tokens.append(found)
                sizes.append(size)
                held += pc.sum(pc.binary_length(texts)).as_py() or 0
                if held >= shard_bytes:
                    yield packed(part, shard, ids, tokens, sizes)
                    shard, held = shard + 1, 0
                    ids, tokens, sizes = [], [], []
        if ids:
            yield packed(part, shard, ids, tokens, sizes)

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    order = F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_rows.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """part, shard and the ids before it. Prefix sums in two levels: over parts, which are
    PARTITIONS at most, and over the shards of each."""
    totals = shards.select("part", "shard", "n_tokens")
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return totals.withColumn("within", within).join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("within")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files alone."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, width = batch.column("n_tokens")[r].as_py(), batch.column("width")[r].as_py()
                ids = unpack(batch.column("planes")[r].as_buffer().to_pybytes(), width, n).all().astype("<u4")
                ends = batch.column("ends")[r].values.to_numpy()
                begin = np.append(0, ends[:-1])
                data, crc = memoryview(ids).cast("B"), zlib.crc32
                sums = [crc(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                place = [pa.array(np.full(len(ends), batch.column(c)[r].as_py())) for c in ("part", "shard")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[r].values, *place, pa.array(begin), pa.array(ends - begin), pa.array(sums, pa.int64())], ["doc_id", "part", "shard", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "n_tokens", "doc_ids", "ends", "width", "planes").mapInArrow(decode, "doc_id long, part long, shard long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards), ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs and reads every document back from them."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    write_shards(docs, path, tokenizer or tokenizer_path(), min(PARTITIONS, max(1, -(-total // shard_bytes))), shard_bytes)
    return read_documents(spark, path)


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """part, shard, doc_id and place of every occurrence of one token: select in each shard."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("width")[r].as_py()
                if token >> width:
                    continue
                at = unpack(batch.column("planes")[r].as_buffer().to_pybytes(), width, batch.column("n_tokens")[r].as_py()).occurrences(token)
                ends = batch.column("ends")[r].values.to_numpy()
                doc = np.searchsorted(ends, at, "right")
                place = [pa.array(np.full(len(at), batch.column(c)[r].as_py())) for c in ("part", "shard")]
                yield pa.RecordBatch.from_arrays([*place, batch.column("doc_ids")[r].values.take(pa.array(doc)), pa.array(at - np.append(0, ends)[doc])], ["part", "shard", "doc_id", "place"])

    return shards.mapInArrow(find, "part long, shard long, doc_id long, place long")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(read(spark, sf_dir, "documents"))


QUERIES = {"op2_token_shards": op2_token_shards}
ORACLE_SQL: dict[str, str] = {}
