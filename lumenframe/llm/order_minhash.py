"""Near-duplicate documents by Order MinHash and banded alignment.

A document is a sequence of lower-cased words. Its k-mers are runs of K words, labelled with
their occurrence number, so repetition counts. Each of many random orders picks the two smallest
k-mers of a document; kept in the order in which they stand in the text, they are a band's
key. Documents that share a key are candidates, and a banded alignment of their words verifies
that their edit similarity, 1 - distance / words of the longer, is THRESHOLD at least. Texts of
fewer than LONG_WORDS words have too few runs of K words that survive scattered edits and take
runs of SHORT_K; those of fewer than FEW_WORDS share one of a few segments at nearly the same
place with every text that is alike, which makes the search for them exact.

A group of thousands of copies never becomes all its pairs. Equal word sequences are one node from
the start. Within a batch, neighbours in the buckets (by number of words) are aligned on the
spot until the batch's groups hang together, and a group sends one row for each key on to the
other batches, where neighbours are aligned likewise. Links become classes by repeated joins.
Buckets that then hold more than one class are opened: their documents meet, in cells of bounded
size, and all pairs of different classes that a lower bound of their distance does not rule out
are aligned there, the likeliest first, until the classes hang together. So every pair that shares a key ends in one class, or was
aligned and refuted, or is ruled out by the bound. Nothing of the size of the corpus comes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
THRESHOLD = 0.8
#: Words of a k-mer and number of orders: for texts of LONG_WORDS words or more, and for shorter ones.
K, BANDS = 5, 72
SHORT_K, SHORT_BANDS = 3, 32
LONG_WORDS, FEW_WORDS = 120, 20
#: Bins of the histograms of a document's words: a quick look, and a closer one.
BINS, FINE_BINS = 128, 768
#: Rows of three numbers that are broadcast at most; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows and words of a block of an open bucket; larger buckets are cut into blocks, and each two blocks meet in a cell.
CELL, CELL_WORDS = 2048, 2_000_000

_rng = np.random.default_rng(20240229)
_SEEDS = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)[:, None]
_ODD = (_rng.integers(0, 2**62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_ROLL = _rng.integers(0, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = common.fields("row long, doc_id long, k1 long, k2 long, n_words int, words binary")
LOCAL = common.fields("key long, node long, rep long, n_words int, lead boolean")
GLOBAL = common.fields("key long, a long, b long")
PAIR = common.fields("a long, b long")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """32-bit hashes of words; the most that a task remembers bounds its memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def most_edits(n_words: int) -> int:
    """The largest distance of a text of so many words, the longer of two, to one that is alike."""
    return int((1 - THRESHOLD) * n_words + 1e-9)


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers; fewer than k words are one k-mer."""
    k = min(k, len(h))
    n = len(h) - k + 1
    g = h[:n] * _ROLL[0]
    for j in range(1, k):
        g = g + h[j : n + j] * _ROLL[j]
    g = mix(g)
    u, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
    if len(u) < n:
        order = np.argsort(inverse, kind="stable")
        label = np.empty(n, np.uint64)
        label[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        again = label > 0  # first occurrences keep the hash that they have in texts without repetition
        g[again] = mix(g[again] + label[again] * _ROLL[7])
    return g


def band_keys(g: np.ndarray, bands: int) -> np.ndarray:
    """A key for each order: its two smallest k-mers, in the order of the text."""
    first, second = np.empty(bands, np.int64), np.empty(bands, np.int64)
    for at in range(0, bands, step := max(1, min(bands, 60_000 // len(g)))):  # of a size that stays in the cache
        v = (g ^ _SEEDS[at : min(bands, at + step)]) * _ODD[at : min(bands, at + step)]
        i = v.argmin(1)
        first[at : at + step] = i
        v[np.arange(len(v)), i] = np.uint64(2**64 - 1)
        second[at : at + step] = v.argmin(1) if len(g) > 1 else i
    return mix(mix(g[np.minimum(first, second)] + _SEEDS[:bands, 0]) + g[np.maximum(first, second)] * np.uint64(3))


@lru_cache(64)
def segment_plan(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and salts of the segments that a text of n words has keys for.

    Two texts of l <= m words, l < FEW_WORDS, within the distance t = most_edits(m): of t + 1
    segments of the shorter one, one stands unchanged in the longer one, moved by no more than the edits
    before and after it allow (the bounds of partition-based similarity joins).
    """
    found: set[tuple[int, int, int]] = set()

    def parts(length: int, t: int):
        at = 0
        for i in range(t + 1):
            size = length // (t + 1) + (i >= t + 1 - length % (t + 1))
            yield i, at, size, (length * 32 + t) * 32 + i
            at += size

    for m in range(n, n + n // 4 + 2):  # as the shorter one
        t = most_edits(m)
        if t and m - n <= t and n < FEW_WORDS:
            found.update((at, size, salt) for _, at, size, salt in parts(n, t))
    t = most_edits(n)
    for length in range(max(t + 1, n - t), min(n, FEW_WORDS - 1) + 1) if t else ():  # as the longer one
        off = n - length
        for i, at, size, salt in parts(length, t):
            low, high = max(0, at - i, at + off - (t - i)), min(n - size, at + i, at + off + t - i)
            found.update((start, size, salt) for start in range(low, high + 1))
    rows = np.array(sorted(found), np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2].astype(np.uint64)


def keys_of(h: np.ndarray) -> np.ndarray:
    """All keys under which a document is looked for, from the 32-bit hashes of its words. Alike texts share the kind of their keys, as a kind reaches beyond its limit."""
    n, h = len(h), mix(h.astype(np.uint64) + np.uint64(1))
    out = [np.empty(0, np.uint64)]
    if n < FEW_WORDS / THRESHOLD:
        start, size, salt = segment_plan(n)
        if len(start):
            span = np.arange(int(size.max()))
            own = np.concatenate([h, np.zeros(len(span), np.uint64)])[start[:, None] + span] * _ROLL[: len(span)]
            own[span >= size[:, None]] = 0
            out.append(mix(own.sum(1, dtype=np.uint64) + salt * _ROLL[6]))
    if n >= FEW_WORDS and n < LONG_WORDS / THRESHOLD:
        out.append(band_keys(kmers(h, SHORT_K), SHORT_BANDS) + np.uint64(SHORT_K))
    if n >= LONG_WORDS:
        out.append(band_keys(kmers(h, K), BANDS) + np.uint64(K))
    return np.unique(np.concatenate(out)).view(np.int64)


def histogram(h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """How often words fall in each bin, 255 at most. An edit changes two bins by one each at most, so half the difference of two histograms bounds the distance from below."""
    return np.minimum(np.bincount(h % np.uint32(bins), minlength=bins), 255).astype(np.uint8)


def sketch(text: str | None, hashes: dict) -> tuple:
    """k1, k2 (a hash of the words), n_words and the words' hashes; nulls without words."""
    w = words(text)
    if not w:
        return None, None, 0, None
    h = np.fromiter(map(hashes.__getitem__, w), np.uint32, len(w))
    return *np.frombuffer(xxhash.xxh3_128_digest(b" ".join(w)), "<i8").tolist(), len(w), h.astype("<u4").tobytes()


def sketches(docs: DataFrame, row: str, key: str, text: str) -> DataFrame:
    """The fields of SKETCH."""
    arrow = to_arrow_schema(SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()  # of the task: reused workers keep nothing
        for batch in batches:
            for part in common.slices(batch, 2):
                rows = [(r, k, *sketch(t, hashes)) for r, k, t in zip(*(part.column(i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(F.col(row), F.col(key).cast("long"), F.col(text)).mapInArrow(run, SKETCH)


def distance(a: list, b: list, band: int) -> int:
    """The edit distance of two sequences along paths within `band` of the diagonal: exact if it is band at most.

    Myers' bit vectors over a window of 2 * band + 1 rows that moves down with the columns
    (Hyyro 2003), in integers of any size. The sequences' lengths differ by band at most.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > band:
        return m
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    width = 2 * band + 1
    mask, top, middle = (1 << width) - 1, 1 << width - 1, 1 << band
    # column 0: rows above the text (bits up to band) grow upwards, those below it downwards
    vn = (1 << band + 1) - 1
    vp = mask ^ vn
    score = 0
    for j, x in enumerate(b):
        vp, vn = vp >> 1 | top, vn >> 1
        shift = j - band
        pm = at.get(x, 0)
        pm = (pm >> shift if shift >= 0 else pm << -shift) & mask
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        x1 = (hp << 1 | 1) & mask
        vp = (hn << 1 | ~(d0 | x1)) & mask
        vn = d0 & x1
        score += not d0 & middle
    below = ((1 << m - n) - 1) << band + 1
    return score + (vp & below).bit_count() - (vn & below).bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = THRESHOLD) -> float:
    """The edit similarity of two word sequences if it is `least` or more, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    # words in common bound the alignment from above
    u, c = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(u)
    if np.minimum(np.bincount(c[: len(a)], minlength=n), np.bincount(c[len(a) :], minlength=n)).sum() < longer - most:
        return 0.0
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :][::-1] != b[len(b) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    band = max(8, abs(len(x) - len(y)))
    while True:
        band = min(band, most)
        d = distance(x, y, band)
        if d <= band or band == most:
            return 1 - d / longer if d <= most else 0.0
        band *= 4


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences' edit similarity is THRESHOLD or more."""
    if len(a) == len(b) and np.count_nonzero(a != b) <= most_edits(len(a)):
        return True
    return similarity(a, b) >= THRESHOLD


class _Sets:
    """Disjoint sets of the places 0 .. n - 1; a set's root is its smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _group_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, n_words, words): rows of LOCAL, one for each key of each document. rep: the smallest row of the document's group in the batch; lead: the first of its group under this key."""
    arrow = to_arrow_schema(LOCAL)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        batch = batch.take(np.argsort(batch.column(0).to_numpy(), kind="stable"))
        rows, n_words = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        own = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(2)]
        hist = np.stack([histogram(h) for h in own]).astype(np.int16)
        keys = [keys_of(h) for h in own]
        at = np.repeat(np.arange(n), [len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.lexsort((at, n_words[at], keys))
        keys, at = keys[order], at[order]
        # neighbours in a bucket, those that meet in most buckets first
        next_to = np.flatnonzero((keys[1:] == keys[:-1]) & (n_words[at[:-1]] >= THRESHOLD * n_words[at[1:]]))
        pairs, often = np.unique(at[next_to] * n + at[next_to + 1], return_counts=True)
        pairs = pairs[np.argsort(-often, kind="stable")]
        x, y = pairs // n, pairs % n
        sets = _Sets(n)
        for s in range(0, len(x), 50_000):
            some = slice(s, s + 50_000)
            near = np.abs(hist[x[some]] - hist[y[some]]).sum(1) <= 2 * ((1 - THRESHOLD) * n_words[y[some]] + 1e-9)
            for i, j in zip(x[some][near].tolist(), y[some][near].tolist()):
                if sets.root(i) != sets.root(j) and alike(own[i], own[j]):
                    sets.join(i, j)
        root = np.fromiter(map(sets.root, range(n)), np.int64, n)
        order = np.lexsort((root[at], keys))  # stable: the shortest of a group stays the first under a key
        keys, at = keys[order], at[order]
        lead = np.ones(len(keys), bool)
        lead[1:] = (keys[1:] != keys[:-1]) | (root[at[1:]] != root[at[:-1]])
        for s in range(0, len(keys), 100_000):
            i = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + 100_000]), pa.array(rows[i]), pa.array(rows[root[i]]), pa.array(n_words[i].astype(np.int32)), pa.array(lead[s : s + 100_000])], schema=arrow)
        # a document without keys (of fewer words than any other could be alike) is in no group


def _group_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, node, rep, n_words) sorted by key, n_words and node: neighbours of a bucket as (null, a, b), and (key, rep, null) for each row of a bucket of several."""
    arrow = to_arrow_schema(GLOBAL)
    left = np.zeros((4, 0), np.int64)  # the last row so far, as what follows is not known
    before = False  # whether it shares its key with the row before

    def shared(x: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0][some]), pa.array(x[2][some]), pa.nulls(int(some.sum()), pa.int64())], schema=arrow)

    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.concatenate([left, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        same = x[0, 1:] == x[0, :-1]
        some = np.concatenate([[before], same])
        some[:-1] |= same
        yield shared(x[:, :-1], some[:-1])
        pair = np.flatnonzero(same & (x[2, 1:] != x[2, :-1]) & (x[3, :-1] >= THRESHOLD * x[3, 1:]))
        a, b = np.unique(np.sort(np.stack([x[1, pair], x[1, pair + 1]]), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=arrow)
        left, before = x[:, -1:], bool(same[-1]) if len(same) else before
    if left.size:
        yield shared(left, np.array([before]))


def _open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, i, j, block, node, n_words, label, words, keys) sorted by the first three and n_words: links between the labels of a cell, whose pairs are of two blocks unless i = j.

    keys: the open buckets of the document. A pair that meets in several is aligned in the one with the smallest key.
    """
    arrow = to_arrow_schema(PAIR)

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        key, i, j = rows[0][:3]
        block, n_words, label = (np.array([r[c] for r in rows], np.int64) for c in (3, 5, 6))
        words, keys = [np.frombuffer(r[7], "<u4") for r in rows], [set(r[8]) for r in rows]
        hist, fine = np.stack([histogram(h) for h in words]).astype(np.int16), np.stack([histogram(h, FINE_BINS) for h in words])
        label = np.unique(label, return_inverse=True)[1]
        sets, found = _Sets(len(rows)), []
        for at in range(1, len(rows)):
            low = int(np.searchsorted(n_words[:at], THRESHOLD * n_words[at] - 1e-9))
            other = label[low:at] != label[at]
            if i != j:
                other &= block[low:at] != block[at]
            other = np.flatnonzero(other) + low
            most = 2 * most_edits(len(words[at]))
            off = np.abs(hist[other] - hist[at]).sum(1)
            other, off = other[off <= most], off[off <= most]
            if not len(other):
                continue
            off = np.abs(fine[other].astype(np.int16) - fine[at]).sum(1)
            other, off = other[off <= most], off[off <= most]
            for x in other[np.argsort(off, kind="stable")].tolist():
                if sets.root(label[x]) != sets.root(label[at]) and min(keys[x] & keys[at]) == key and alike(words[x], words[at]):
                    sets.join(label[x], label[at])
                    found.append((rows[x][4], rows[at][4]))
        return found

    kept, out = [], []
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if kept and r[:3] != kept[0][:3]:
                out += links(kept)
                kept = []
            kept.append(r)
    out += links(kept) if kept else []
    if out:
        a, b = np.unique(np.sort(np.array(out, np.int64), axis=1), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(PAIR)
    for batch in batches:
        for part in common.slices(batch, 2):
            keep = [alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep, pa.bool_())).columns[:2], schema=arrow)


def small(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast in a join if its counted rows are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def aligned(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose alignment reaches THRESHOLD, written."""
    ids = common.written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "ids")
    own = known.select("row", "words").join(small(ids, ids.count()), "row", "left_semi")
    sides = pairs.join(own.select(F.col("row").alias("a"), F.col("words").alias("wa")), "a").join(own.select(F.col("row").alias("b"), F.col("words").alias("wb")), "b")
    return common.written(sides.select("a", "b", "wa", "wb").mapInArrow(_verify, PAIR), "aligned")


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of links (a, b) the smallest node it is connected with.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so long chains halve. A round is written to the shared folder; the driver sees a count.
    """
    edges = common.written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = common.written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        step = common.written(near.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        changed = step.where(F.col("new") != F.col("label")).limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def wider(known: DataFrame, links: DataFrame) -> DataFrame:
    """(label, wider) of the classes that links (a, b) between nodes join. known: (node, label); other nodes are their own label."""
    ends = common.written(links.select("a", "b").withColumn("i", F.monotonically_increasing_id()), "ends")
    of = lambda end: ends.select("i", F.col(end).alias("node")).join(known, "node", "left").select("i", F.coalesce("label", "node").alias(end))
    return components(of("a").join(of("b"), "i").select("a", "b").distinct()).select(F.col("node").alias("label"), F.col("label").alias("wider"))


def relabel(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows with their labels widened, written."""
    out = rows.join(small(by, by.count()), "label", "left").withColumn("label", F.coalesce("wider", "label"))
    return common.written(out.select(*rows.columns), "labels")


def open_links(nodes: DataFrame, local: DataFrame, met: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between the classes of all buckets where several met, written. met: (key, a) with the groups that met under a key.

    A document meets its label and its words once, with the list of its open buckets, and only
    then goes to their cells. No pair is a row unless it is a link.
    """
    keys = met.select("key", F.col("a").alias("rep")).join(labels.withColumnRenamed("node", "rep"), "rep").groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    keys = common.written(keys, "keys")
    open_rows = common.written(local.join(small(keys, keys.count()), "key", "left_semi").select("key", "node", "n_words"), "open")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n_words") / CELL_WORDS)).cast("int")
    large = common.written(open_rows.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    sized = open_rows.join(small(large, large.count()), "key", "left").select("node", F.struct("key", F.coalesce("blocks", F.lit(1)).alias("blocks")).alias("bucket"))
    own = sized.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # as many as a document has keys
    rows = own.join(labels, "node").join(nodes.select(F.col("row").alias("node"), "n_words", "words"), "node")
    rows = rows.select("node", "n_words", "label", "words", F.col("buckets.key").alias("keys"), F.inline("buckets"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "n_words", "label", "words", "keys")
    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n_words", "node").mapInArrow(_open_cells, PAIR)
    return common.written(found.distinct(), "more")


def classes(docs: DataFrame, row: str, key: str, text: str) -> DataFrame:
    """(row, doc_id, class_id, keep) of docs whose column `row` numbers the rows, written. keep: the row that stands for the class."""
    every = common.written(sketches(docs, row, key, text), "sketches")
    known = every.where("n_words > 0")
    copies = known.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "node")
    copies = common.written(copies, "copies")
    again = known.select("row", "k1", "k2").join(small(copies, copies.count()), ["k1", "k2"]).where("row != node").select("row", "node")
    again = common.written(again, "again")
    n_again = again.count()
    nodes = known.select("row", "n_words", "words").join(small(again.select("row"), n_again), "row", "left_anti")
    local = common.written(nodes.mapInArrow(_group_batch, LOCAL), "local")
    found = local.where("lead").select("key", "node", "rep", "n_words").repartition("key").sortWithinPartitions("key", "n_words", "node").mapInArrow(_group_buckets, GLOBAL)
    found = common.written(found, "buckets")
    links = aligned(known, common.written(found.where("b IS NOT NULL").select("a", "b").distinct(), "pairs"))
    labels = common.written(local.groupBy("node").agg(F.first("rep").alias("label")), "labels")
    labels = relabel(labels, wider(labels, links))
    labels = relabel(labels, wider(labels, open_links(nodes, local, found.where("b IS NULL"), labels)))
    # rows of equal words, then the class of each; texts without words are classes of their own
    rows = every.select("row", "doc_id").join(small(again, n_again), "row", "left").withColumn("node", F.coalesce("node", "row"))
    rows = common.written(rows.join(labels, "node", "left").select("row", "doc_id", F.coalesce("label", "node").alias("label")), "rows")
    of = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    of = common.written(of, "of")
    out = rows.join(small(of, of.count()), "label", "left")
    return common.written(out.select("row", "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("first", "row") == F.col("row")).alias("keep")), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id long, class_id long (the smallest doc_id of its class).

    Rows with equal words are one class, and classes with an alignment of THRESHOLD or more
    are joined transitively. Null, empty and wordless texts are classes of their own. Classes are of rows: rows
    that share an id may be in different ones. A null id gets the smallest id of its class, null
    if there is none. An empty table gives an empty result; further columns are not read.

    Pairs of fewer than FEW_WORDS words are all found; for longer ones the README states which share is.
    """
    numbered = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("row", F.monotonically_increasing_id())
    return classes(numbered, "row", "k", "t").select("doc_id", "class_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class of near_duplicates, with all its columns: that with the smallest id, null ids last; of rows with one id, any one whose text is of the class.

    Null, empty and wordless texts all stay, repeated ones too. Columns keep their names, whatever they are.
    The rows are written once with a number; those to drop are broadcast if they are few, else joined, so texts are not shuffled then.
    """
    row = common.unused(docs, "row")
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    drop = classes(numbered, row, key, text).where("NOT keep").select(F.col("row").alias(row))
    return numbered.join(small(drop, drop.count()), row, "left_anti").drop(row)


def op3_order_minhash(spark, sf_dir):
    """doc_id, class_id of each row of documents; odd rows as near_duplicates has them."""
    return near_duplicates(common.read(spark, sf_dir, "documents"))
