"""Token ids in wavelet matrices: one compressed file for each shard.

A shard holds whole documents in ascending order of their ids. Its tokens are numbered by
frequency and written as bit-planes, the highest bit first; each plane is ordered by the bits
above it. Ranks and selects on the planes give the token at a place, the number of a token's
occurrences in a range and the places where it occurs, without decoding the rest.

Layout of a shard's payload: magic, numbers of documents, tokens, alphabet and planes, lengths of
the sections, then the sections as zstandard frames: document ids, null flags, document
lengths, alphabet, zeros of each plane, then for each plane its directory (the ones before every
block of BLOCK_WORDS words) and its bits in 64-bit words. A frame is decompressed when it is first
asked for, so a rank in one plane touches that plane alone. A shard is one row of one Parquet file,
beside its place in the order and its number of tokens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .word_ids import encoder

MAGIC = b"WVM2"
HEAD = struct.Struct("<4sQQII")
SHARD_TOKENS = 1 << 21
END_ID = 1
BLOCK_WORDS = 8
SHARD = common.fields("part int, seq int, n_docs long, n_tokens long, payload binary")
TOKENS = common.fields("part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")


class Plane:
    """A bit vector with rank and select over a directory of blocks."""

    def __init__(self, packed: bytes, n: int, directory: bytes | None = None):
        """directory: as stored, or made from the bits."""
        self.n = n
        self.bytes = np.frombuffer(packed, np.uint8)
        self.words = self.bytes.view("<u8")
        if directory is None:
            ones = np.bitwise_count(self.words)
            ones = np.concatenate([ones, np.zeros(-len(ones) % BLOCK_WORDS, ones.dtype)]).reshape(-1, BLOCK_WORDS).sum(1, dtype=np.int64)
            self.ones = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        else:
            self.ones = np.frombuffer(directory, "<u8")

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.bytes, count=self.n, bitorder="little").view(bool)

    def get(self, i: int) -> int:
        return int(self.bytes[i >> 3]) >> (i & 7) & 1

    def rank(self, bit: int, i: int) -> int:
        """How often bit occurs before place i."""
        word = i >> 6
        block = word // BLOCK_WORDS
        r = int(self.ones[block])
        for w in range(block * BLOCK_WORDS, word):
            r += int(self.words[w]).bit_count()
        if i & 63:
            r += (int(self.words[word]) & ((1 << (i & 63)) - 1)).bit_count()
        return r if bit else i - r

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th occurrence of bit, from 0: a binary search in the directory, then within a block."""
        low, high = 0, len(self.ones) - 1  # the last block whose count is k at most
        while high - low > 1:
            middle = (low + high) // 2
            before = int(self.ones[middle])
            low, high = (middle, high) if (before if bit else middle * BLOCK_WORDS * 64 - before) <= k else (low, middle)
        k -= int(self.ones[low]) if bit else low * BLOCK_WORDS * 64 - int(self.ones[low])
        w = low * BLOCK_WORDS
        while True:
            word = int(self.words[w]) if bit else ~int(self.words[w]) & (1 << 64) - 1
            if k < (n := word.bit_count()):
                break
            k, w = k - n, w + 1
        for _ in range(k):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1


class _Planes:
    """The planes of a stored shard, each decompressed when it is first used."""

    def __init__(self, frames: list, n: int):
        self.frames, self.n = frames, n
        self.made: list = [None] * (len(frames) // 2)

    def __len__(self) -> int:
        return len(self.made)

    def __getitem__(self, i: int) -> Plane:
        if not 0 <= i < len(self.made):
            raise IndexError(i)
        if self.made[i] is None:
            d = zstandard.ZstdDecompressor()
            self.made[i] = Plane(d.decompress(self.frames[2 * i + 1]), self.n, d.decompress(self.frames[2 * i]))
        return self.made[i]


class WaveletShard:
    def __init__(self, doc_ids: list, lengths: np.ndarray, alphabet: np.ndarray, zeros: list[int], planes: list[Plane] | _Planes):
        self.doc_ids, self.lengths, self.alphabet, self.zeros, self.planes = doc_ids, lengths, alphabet, zeros, planes
        self.n = int(lengths.sum())
        self._code = None

    @classmethod
    def build(cls, doc_ids: list, lengths: list[int], tokens: np.ndarray) -> WaveletShard:
        n = len(tokens)
        counts = np.bincount(tokens) if n else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(counts)
        alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
        code = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        level = code[tokens] if n else np.zeros(0, np.uint16)
        zeros, planes = [], []
        for b in reversed(range(max(0, len(alphabet) - 1).bit_length())):
            ones = (level & level.dtype.type(1 << b)) != 0
            packed = np.packbits(ones, bitorder="little").tobytes()
            planes.append(Plane(packed + bytes(-len(packed) % 8), n))
            low = np.compress(~ones, level)  # several times as fast as indexing by a mask
            zeros.append(len(low))
            level = np.concatenate([low, np.compress(ones, level)])
        return cls(doc_ids, np.asarray(lengths, np.int64), alphabet.astype(np.uint32), zeros, planes)

    def to_bytes(self) -> bytes:
        nulls = np.array([x is None for x in self.doc_ids], bool)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        raw = [ids.tobytes(), np.packbits(nulls).tobytes(), self.lengths.astype("<i8").tobytes(), self.alphabet.astype("<u4").tobytes(), np.asarray(self.zeros, "<u8").tobytes()]
        for p in self.planes:
            raw += [p.ones.tobytes(), p.bytes.tobytes()]
        c = zstandard.ZstdCompressor(level=1)
        frames = [c.compress(x) for x in raw]
        return b"".join([HEAD.pack(MAGIC, len(ids), self.n, len(self.alphabet), len(self.planes)), np.array([len(x) for x in frames], "<u8").tobytes(), *frames])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        magic, n_docs, n, _, n_planes = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        sizes = np.frombuffer(data, "<u8", 5 + 2 * n_planes, HEAD.size)
        at, frames, d = HEAD.size + 8 * len(sizes), [], zstandard.ZstdDecompressor()
        for size in map(int, sizes):
            frames.append(data[at : at + size])
            at += size
        parts = [d.decompress(x) for x in frames[:5]]
        nulls = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs) if n_docs else ()
        ids = [None if z else x for x, z in zip(np.frombuffer(parts[0], "<i8").tolist(), nulls)]
        return cls(ids, np.frombuffer(parts[2], "<i8"), np.frombuffer(parts[3], "<u4"), np.frombuffer(parts[4], "<u8").astype(np.int64).tolist(), _Planes(frames[5:], n))

    def decode(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest."""
        if not self.n:
            return np.zeros(0, "<u4")
        v = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = plane.bits()
            w = np.empty_like(v)
            w[np.flatnonzero(~ones)] = v[:z]
            w[np.flatnonzero(ones)] = v[z:] | v.dtype.type(1 << b)
            v = w
        return self.alphabet[v].astype("<u4", copy=False)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane, z in zip(self.planes, self.zeros):
            bit = plane.get(i)
            i = z + plane.rank(1, i) if bit else plane.rank(0, i)
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _path(self, token: int) -> list[int] | None:
        if self._code is None:
            self._code = {int(t): i for i, t in enumerate(self.alphabet)}
        code = self._code.get(token)
        return None if code is None else [code >> b & 1 for b in reversed(range(len(self.planes)))]

    def rank(self, token: int, i: int) -> int:
        """How often token occurs before place i."""
        path = self._path(token)
        if path is None:
            return 0
        start, end = 0, i
        for plane, z, bit in zip(self.planes, self.zeros, path):
            start, end = plane.rank(bit, start) + z * bit, plane.rank(bit, end) + z * bit
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of token, from 0."""
        path = self._path(token)
        if path is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        start = 0
        for plane, z, bit in zip(self.planes, self.zeros, path):
            start = plane.rank(bit, start) + z * bit
        i = start + k
        for plane, z, bit in zip(reversed(self.planes), reversed(self.zeros), reversed(path)):
            i = plane.select(bit, i - z * bit)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def encode_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard; (part, seq) orders shards as their documents' ids ascend.

    Documents are dealt in ranges of (key, hash of the text), so neither a long run of one
    key nor a large source falls to one task. Null and empty texts have the end id alone, null
    keys come first, and rows of one key are ordered by the text's hash. Memory is bounded by a
    shard and one document. An empty table has no shards.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    arrow = to_arrow_schema(SHARD)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(path).encode_many, TaskContext.get().partitionId(), 0
        ids, pieces, lengths, total = [], [], [], 0

        def shard():
            built = WaveletShard.build(ids, lengths, np.frombuffer(b"".join(pieces), "<u4"))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [total], "payload": [built.to_bytes()]}, schema=arrow)

        for batch in batches:
            for rows in common.slices(batch, 1):
                for k, piece in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist())):
                    piece += end
                    if total and total + len(piece) // 4 > shard_tokens:
                        yield shard()
                        seq += 1
                        ids, pieces, lengths, total = [], [], [], 0
                    ids.append(k)
                    pieces.append(piece)
                    lengths.append(len(piece) // 4)
                    total += len(piece) // 4
        if ids:
            yield shard()

    return rows.mapInArrow(run, SHARD)


def write_shards(shards: DataFrame, path: str) -> None:
    """A file for each shard. The payload is compressed as it is."""
    shards.write.option("compression", "uncompressed").option("maxRecordsPerFile", 1).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files.

    Only small rows are shuffled: the shards' first tokens are summed over their sizes, which
    are read without the payload, and are joined with what was decoded.
    """
    files = spark.read.schema(SHARD).parquet(path)
    arrow = to_arrow_schema(TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = WaveletShard.from_bytes(payload)
                raw = memoryview(s.decode().tobytes())
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts), pa.array(s.lengths), pa.array(crcs, pa.int64())], schema=arrow)

    decoded = files.select("part", "seq", "payload").mapInArrow(run, TOKENS)
    return decoded.join(_offsets(files), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _offsets(files: DataFrame) -> DataFrame:
    """The tokens before each shard: those of the parts before, which are as many as the tasks that wrote them, and those before it in its part."""
    shards = files.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))
    return shards.withColumn("own", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("first") + F.col("own")).alias("base"))


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each token occurs, by ranks in the shards' planes."""
    arrow = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                s = WaveletShard.from_bytes(payload)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([s.count(t) for t in tokens], pa.int64())], schema=arrow)

    return spark.read.schema(SHARD).parquet(path).select("payload").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(place): where a token occurs in the whole sequence, by selects in the shards' planes."""
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                places = WaveletShard.from_bytes(payload).occurrences(token)
                yield pa.RecordBatch.from_pydict({"part": [part] * len(places), "seq": [seq] * len(places), "local": places}, schema=arrow)

    files = spark.read.schema(SHARD).parquet(path)
    found = files.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, local long")
    return found.join(_offsets(files), ["part", "seq"]).select((F.col("base") + F.col("local")).alias("place"))


def op1_wavelet(spark, sf_dir):
    """doc_id, start, n_tokens, ids_crc32 of each row of documents, read back from the shards; odd texts as encode_shards has them."""
    import public_tokenizers

    path = common.folder(spark, "wavelet")
    write_shards(encode_shards(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), path)
    return read_tokens(spark, path)
