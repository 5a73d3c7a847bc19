"""Packing by vector bin packing with the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens. A sequence is filled
by taking, again and again, the waiting piece whose demands have the largest dot product with
what is left, among those that fit. If no piece fits, or the last segment would leave a gap,
the piece with the largest dot product is cut to fill it, where cutting is allowed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .word_ids import encoder

END_ID = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


@dataclass(slots=True)
class Piece:
    item: object  # what the piece is of
    start: int
    length: int
    loss: int


class Packer:
    """Pieces in, filled sequences out. At most `waiting` pieces wait at a time."""

    def __init__(self, limits: Limits, cut: bool = True, waiting: int = 2048):
        self.limits, self.cut, self.most = limits, cut, waiting
        self.pieces: list[Piece | None] = []
        self.demand = np.zeros((3, 2 * waiting), np.float32)  # zero where no piece is left
        self.live = np.zeros(2 * waiting, bool)
        self.alive = 0
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float32)

    def add(self, item, start: int, length: int, loss: int) -> Iterator[list[Piece]]:
        """Yields the sequences that are full by now. A piece over a limit is cut to it; without cutting it is an error."""
        lim = self.limits
        while length > lim.tokens or loss > lim.loss_tokens:
            if not self.cut:
                raise ValueError(f"a piece of {length} tokens, {loss} with loss, is over the limits")
            n = min(lim.tokens, length, length - loss + lim.loss_tokens)  # its first n tokens bear at most n - 1, and at most the limit
            n = min(n, lim.loss_tokens + 1) if loss else n
            head = Piece(item, start, n, min(loss, n - 1))
            if n == lim.tokens:
                yield [head]
            else:
                self._wait(head)
            start, length = start + n, length - n
            loss = max(0, min(length - 1, loss - head.loss - 1))
        if length:
            self._wait(Piece(item, start, length, loss))
        while self.alive >= self.most:
            yield self.fill()

    def _wait(self, p: Piece) -> None:
        if len(self.pieces) == len(self.live):
            at = np.flatnonzero(self.live)
            n = len(at)
            if n == len(self.live):
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)], axis=1)
                self.live = np.concatenate([self.live, np.zeros_like(self.live)])
            self.pieces = [self.pieces[i] for i in at.tolist()]
            self.demand[:, :n] = self.demand[:, at]
            self.demand[:, n:] = 0
            self.live[:] = np.arange(len(self.live)) < n
        n = len(self.pieces)
        self.demand[:, n] = p.length, 1, p.loss
        self.live[n] = True
        self.pieces.append(p)
        self.alive += 1

    def _take(self, i: int) -> Piece:
        p = self.pieces[i]
        self.pieces[i] = None
        self.live[i] = False
        self.demand[:, i] = 0
        self.alive -= 1
        return p

    def fill(self) -> list[Piece]:
        """One sequence from the waiting pieces."""
        out: list[Piece] = []
        left = self.cap.copy()
        n = len(self.pieces)
        d, live = self.demand[:, :n], self.live[:n]
        tokens, loss = d[0], d[2]
        weight = 1 / np.maximum(d.sum(1), 1) / self.cap  # demands count by how scarce what they need is
        while left[0] > 0 and left[1] > 0 and left[2] >= 0 and self.alive:
            need = left * weight
            last = self.cut and left[1] == 1
            fits = np.flatnonzero(live & ((tokens == left[0]) if last else (tokens <= left[0])) & (loss <= left[2]))
            if len(fits):
                p = self._take(int(fits[(need @ d[:, fits]).argmax()]))
            elif self.cut and len(wide := np.flatnonzero(tokens > 1)):
                if last and len(longer := wide[tokens[wide] >= left[0]]):
                    wide = longer
                i = int(wide[(need @ d[:, wide]).argmax()])
                whole = self.pieces[i]
                size = int(min(left[0], whole.length - 1, left[2] + 1))
                if last and whole.length < left[0]:  # no piece is as long as the gap: take the longest as it is
                    i = int(wide[tokens[wide].argmax()])
                    whole = self.pieces[i]
                    if whole.loss > left[2]:
                        break
                    size = whole.length
                p = Piece(whole.item, whole.start, size, min(whole.loss, size - 1))
                if size == whole.length:
                    self._take(i)
                else:
                    rest = whole.length - size
                    self.pieces[i] = Piece(whole.item, whole.start + size, rest, max(0, min(rest - 1, whole.loss - p.loss - 1)))
                    d[:, i] = rest, 1, self.pieces[i].loss
            else:
                break
            out.append(p)
            left -= (p.length, 1, p.loss)
        return out

    def finish(self) -> Iterator[list[Piece]]:
        """The sequences of what still waits. With cutting the last one is cut into sequences whose lengths are powers of two, which need no padding."""
        while self.alive:
            done = self.fill()
            total = sum(p.length for p in done)
            if not self.cut or total == self.limits.tokens:
                yield done
                continue
            while done:
                size = 1 << (total.bit_length() - 1)
                total -= size
                head = []
                while size:
                    p = done[0]
                    n = min(size, p.length)
                    head.append(Piece(p.item, p.start, n, min(p.loss, n - 1)))
                    size -= n
                    if n == p.length:
                        done.pop(0)
                    else:
                        done[0] = Piece(p.item, p.start + n, p.length - n, max(0, p.loss - n))
                yield head


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss (all long but the key).

    Each task packs the documents that it reads, so nothing is shuffled and memory is bounded by
    the waiting pieces; sequence ids hold the task's number in their upper bits. All tokens of
    a document bear loss but the first of each piece, which has nothing before it. Null and
    empty texts are the end id alone; repeated rows are packed as often as they occur; an empty
    table has no pieces. A key named like a column of the result gets an underscore before its name.
    """
    kind = docs.schema[key].dataType
    result = common.fields("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long")
    schema = T.StructType([T.StructField(common.unlike(key, result.names), kind), *result])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, next_id = encoder(path).encode_many, Packer(limits), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def put(sequences):
            nonlocal next_id
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    k, raw = p.item
                    rows.append((k, p.start, p.length, zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]), len(raw) // 4, next_id, offset, p.loss))
                    offset += p.length
                next_id += 1

        def out():
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for part in common.slices(batch, 1):
                for k, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    raw = memoryview(ids + end)
                    n = len(raw) // 4
                    put(packer.add((k, raw), 0, n, n - 1))
                if len(rows) > 20_000:
                    yield out()
        put(packer.finish())
        if rows:
            yield out()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), key: str = "conv_id", tokens: str = "n_tokens", loss: str = "n_loss") -> DataFrame:
    """A row for each example of instruction data: key, sequence_id, offset, n_tokens, n_loss, fits.

    Examples come with their numbers of tokens and of loss-bearing tokens and are never cut. One
    that is over a limit by itself is a sequence of its own with fits false; nulls count as 0, and
    an example without tokens takes a segment of length 0. Nothing is shuffled.
    """
    kind = examples.schema[key].dataType
    result = common.fields("sequence_id long, offset long, n_tokens long, n_loss long, fits boolean")
    schema = T.StructType([T.StructField(common.unlike(key, result.names), kind), *result])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, next_id = Packer(limits, cut=False), TaskContext.get().partitionId() << 36

        def out(sequences):
            nonlocal next_id
            rows = []
            for pieces, fits in sequences:
                offset = 0
                for p in pieces:
                    rows.append((p.item, next_id, offset, p.length, p.loss, fits))
                    offset += p.length
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow) if rows else None

        for batch in batches:
            done = []
            for k, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                n, m = n or 0, m or 0
                if n > limits.tokens or m > limits.loss_tokens or not n:
                    done.append(([Piece(k, 0, n, m)], n <= limits.tokens and m <= limits.loss_tokens))
                else:
                    done += [(s, True) for s in packer.add(k, 0, n, m)]
            if done:
                yield out(done)
        rest = out([(s, True) for s in packer.finish()])
        if rest is not None:
            yield rest

    return examples.select(F.col(key), F.col(tokens).cast("long"), F.col(loss).cast("long")).mapInArrow(run, schema)


def example_sizes(turns: DataFrame, path: str, end_id: int = END_ID, key: str = "conv_id", role: str = "role", text: str = "text", bears: str = "assistant") -> DataFrame:
    """(key, n_tokens, n_loss) of conversations given by turns: each turn's ids and one end id; those of the role `bears` bear loss.

    Counts are summed before the shuffle, so a conversation may have any number of turns. Null texts are the end id alone; turns with a null key are one conversation.
    """

    def make():
        encode = encoder(path).encode_many
        return lambda texts: {"n_ids": [len(x) // 4 + 1 for x in encode(texts)]}

    counted = common.add_columns(turns.select(F.col(key).alias("k"), F.col(role).alias("r"), F.col(text).alias("t")), "t", common.fields("n_ids long"), make, drop=("t",))
    sums = counted.groupBy("k").agg(F.sum("n_ids").alias("n_tokens"), F.sum(F.when(F.col("r") == bears, F.col("n_ids")).otherwise(0)).alias("n_loss"))
    return sums.withColumnRenamed("k", common.unlike(key, ["n_tokens", "n_loss"]))


#: Limits of the query over conversations: each of the three binds for some of them.
EXAMPLE_LIMITS = Limits(tokens=2048, segments=12, loss_tokens=768)


def op7_examples(spark, sf_dir):
    """Whole conversations packed under all three limits, none cut: a row for each, as pack_examples has it."""
    import public_tokenizers

    return pack_examples(example_sizes(common.read(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json")), EXAMPLE_LIMITS)


def op7_packing(spark, sf_dir):
    """The pieces of all documents, each cut where a sequence ends; odd texts as pack has them."""
    import public_tokenizers

    return pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
