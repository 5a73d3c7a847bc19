"""Language-model scoring by logistic context mixing.

A text is its lower-cased words, each spelt byte by byte and closed by a space; a space at the
start of a word ends the text. Bytes are spelt in bits by a Huffman code, and every bit is
predicted. Predictors look up how often it was 0 and 1 in hashed contexts: the word so far, the
word so far under a gate, and the last bytes under a gate. Their stretched probabilities are
combined by weights that the gate and the confidence select; the weights are learned online by
gradient steps over the training vocabulary, each word predicted without its own occurrence, and
an adaptive map, learned along with them, refines the mixed probability. The gate follows the
text: frequent words that occur together form classes, and two successive ones of a class open it.

While a text is scored, the model adapts to it: beside the spelt word there are two predictors
that learn from the text alone, the words so far and what followed the word before, and the
weights of the three move after every word by what each would have said (exponentiated
gradient, from equal weights at the start of each text). Every text starts anew, so scores do
not depend on the order of the texts, and on their partitioning in the last digits only.

Statistics cover every training document. Their way through the cluster: each task splits
its texts into parts and keeps a part's distinct words and their counts beside its texts, which
are numbers of these words from then on; words meet by hash to get their total counts and, once
the weights are learned, the probabilities of their spelling, each word and gate once; these go
back to the parts that hold them.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Frequent words that make gates, their least share of all words, classes at most, least likeness of two classes that merge.
TOP_WORDS, TOP_SHARE, GATES, LIKE = 96, 1 / 500, 12, 0.35
#: Bits of the slot numbers of each predictor's table. The model that is broadcast, about 50 MB, has this size whatever the corpus; counts of words, from which the base score and the spelling's counts come, grow with it.
SLOT_BITS = (21, 21, 21, 18, 18)
PREDICTORS = len(SLOT_BITS)
#: Words that occur less often than this in training feed the short contexts alone.
LEAST = 2
#: Steps of confidence of the gated word so far, and of the gated last five bytes; together with the gate they select the weights.
CONFIDENCES, CONFIDENCES_SHORT = 6, 4
MAP_STEPS = 33
PART_BYTES, BLOB_BYTES = 32_000_000, 4_000_000
#: Texts of a part are counted by so many bytes.
SOME_BYTES = 6_000_000
BLOCK = 1 << 16
RATE = 0.03
#: How fast the weights of a text's own predictors move, and the least weight of each.
ADAPT, FLOOR = 0.3, 0.01

PART = common.fields("kind int, p long, r int, words binary, counts binary, tokens long, known long")
SUMS = common.fields("predictor int, block int, counts binary")
SCORE = common.fields("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_NODE = _rng.integers(0, 2**62, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**62, PREDICTORS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z alone, and the six ASCII spaces


_SPACE = bytes(int(b in b" \t\n\r\x0b\x0c") for b in range(256))


def tokens_of(raws: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Of texts in UTF-8: how many tokens each has, and all tokens, as `words` has them, each text closed by the end. No word becomes an object."""
    data = b"\n".join([*raws, b""]).lower()
    space = np.frombuffer(data.translate(_SPACE), bool)
    first = ~space
    kept = np.compress(first, np.frombuffer(data, np.uint8))
    first[1:] &= space[:-1]
    at, before = np.flatnonzero(first), np.cumsum(space, dtype=np.int32)
    ends = np.cumsum([len(raw) + 1 for raw in raws], dtype=np.int64)
    lengths = np.diff(np.searchsorted(at, ends), prepend=0) + 1
    close = np.zeros(len(at) + len(raws) + 1, bool)
    close[np.cumsum(lengths) - 1] = True
    starts = np.full(len(close), len(kept), np.int32)
    starts[close] = ends - before[ends - 1]
    close[-1] = True
    starts[~close] = at - before[at]
    return lengths, pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)])


def numbered(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts in UTF-8: how many tokens each has, each token's place among the distinct ones, and these."""
    lengths, tokens = tokens_of(raws)
    d = tokens.dictionary_encode()
    return lengths, d.indices.to_numpy().astype(np.int64), d.dictionary


def listed(raw: bytes) -> pa.Array:
    """Words with a line feed between two."""
    buf = np.frombuffer(raw + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    at = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.compress(buf != 10, buf))])


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Code:
    """A Huffman code for bytes: for each byte the nodes passed and the bits taken."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children, serial = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[serial] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], serial, serial))
            serial += 1
        paths: dict[int, list] = {}
        stack = [(heap[0][2], [])]
        while stack:
            node, path = stack.pop()
            if node < 256:
                paths[node] = path
            else:
                stack += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
        self.length = np.array([len(paths[b]) for b in range(256)])
        most = int(self.length.max())
        self.node, self.bit = np.zeros((256, most), np.int64), np.zeros((256, most), bool)
        for b, path in paths.items():
            for k, (node, bit) in enumerate(path):
                self.node[b, k], self.bit[b, k] = node, bit


class Gates:
    """Classes of frequent words, and the state that a text's words lead to."""

    def __init__(self, classes: dict[bytes, int]):
        self.classes = classes
        self.n = max(classes.values(), default=-1) + 2  # the last one: no frequent word yet

    @classmethod
    def cluster(cls, tops: list[bytes], together: np.ndarray) -> Gates:
        """together: in how many documents two of the words occur. The most alike classes merge, by mean cosine, while over GATES - 1 classes or alike by LIKE at least."""
        size = np.sqrt(np.maximum(np.diag(together), 1))
        like = together / size[:, None] / size
        groups = [[i] for i in range(len(tops))]
        while len(groups) > 1:
            mean = np.array([[like[np.ix_(a, b)].mean() if x < y else -1 for y, b in enumerate(groups)] for x, a in enumerate(groups)])
            x, y = np.unravel_index(mean.argmax(), mean.shape)
            if len(groups) <= GATES - 1 and mean[x, y] < LIKE:
                break
            groups[x] += groups.pop(y)
        return cls({tops[i]: g for g, members in enumerate(groups) for i in members})

    def of(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The gate of each token, from its class (-1: none), in texts that begin at `starts`: what opens a gate counts from the next token on."""
        n = len(classes)
        at = np.flatnonzero(classes >= 0)
        text = np.searchsorted(starts, at, "right")
        c = classes[at]
        opens = np.ones(len(at), bool)  # the first frequent word of a text opens its gate at once
        opens[1:] = (c[1:] == c[:-1]) | (text[1:] != text[:-1])
        # the last opening before each token, if it is of the same text
        last = np.full(n + 1, -1)
        last[at[opens] + 1] = at[opens]
        last = np.maximum.accumulate(last)[:n]
        begin = np.repeat(starts, np.diff([*starts, n]))
        return np.where(last >= begin, classes[np.maximum(last, 0)], self.n - 1).astype(np.int8)


class Events:
    """The bits of words under their gates: slots of each predictor, the bits, and the word of each."""

    def __init__(self, code: Code, items: list[bytes], gates: np.ndarray):
        lengths = np.fromiter(map(len, items), np.int64, len(items)) + 1
        buf = np.frombuffer(b" ".join([*items, b""]), np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word = np.repeat(np.arange(len(items)), lengths)
        pos = np.arange(len(buf)) - starts[word]
        sums = np.cumsum(_BYTE[buf] * _POWER[np.minimum(pos, 4095)], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]])
        prefix = before - before[starts][word]
        gate = (gates.astype(np.uint64)[word] + np.uint64(1)) * _SALT[0]
        # the last five bytes within the word; places before its start are 0, which no word holds with its own salt
        b = buf.astype(np.uint64)
        last, recent = np.zeros(len(buf), np.uint64), {}
        for k in range(1, 6):
            shifted = np.concatenate([np.zeros(min(k, len(b)), np.uint64), b[: max(0, len(b) - k)]])
            last |= np.where(pos >= k, shifted + np.uint64(1), np.uint64(0)) << np.uint64(9 * (k - 1))
            recent[k] = last.copy()
        contexts = [prefix, prefix + gate, recent[5] * _SALT[2] + gate, recent[3] * _SALT[3] + gate, recent[1] * _SALT[4] + gate]
        n_bits = code.length[buf]
        self.byte = np.repeat(np.arange(len(buf)), n_bits)
        k = np.arange(len(self.byte)) - np.repeat(np.cumsum(n_bits) - n_bits, n_bits)
        at = buf[self.byte]
        node = _NODE[code.node[at, k]]
        self.bit = code.bit[at, k]
        self.word = word[self.byte]
        self.slots = []
        for c, bits in zip(contexts, SLOT_BITS):
            x = ((c ^ (c >> np.uint64(29))) * _MULTIPLY).take(self.byte)
            x += node
            x ^= x >> np.uint64(32)
            x *= _MULTIPLY
            x >>= np.uint64(64 - bits)
            self.slots.append(x.view(np.int64))


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logit of (n1 + 0.3) / (n0 + n1 + 0.6), from the counts: finite however large one of them is."""
    return np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3))).clip(-12, 12)


class Model:
    def __init__(self, code: Code, gates: Gates, tables: list[np.ndarray]):
        """tables: for each predictor, float32 counts of 0 and 1 for each slot."""
        self.code, self.gates, self.tables = code, gates, tables
        self.weights = np.full((gates.n * CONFIDENCES * CONFIDENCES_SHORT, PREDICTORS + 1), 0.3, np.float64)
        self.weights[:, PREDICTORS] = 0
        self.steps = np.zeros_like(self.weights)  # squared gradients so far
        # the map starts as the identity
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, MAP_STEPS))), (gates.n, 1))
        self._ready = None

    def __getstate__(self):
        """Tables travel compressed: most slots of a small corpus are empty."""
        return (self.code, self.gates, [pack(t.astype("<f4").tobytes()) for t in self.tables], self.weights, self.map)

    def __setstate__(self, state):
        code, gates, tables, weights, steps = state
        self.__init__(code, gates, [np.frombuffer(unpack(t), "<f4").reshape(2, -1) for t in tables])
        self.weights, self.map = weights, steps

    def _inputs(self, e: Events, gates: np.ndarray, own: np.ndarray | None = None):
        """Stretched predictions and the weight set of each bit. own: words whose occurrence is in the long contexts' counts; it is taken out, as it is of the short ones."""
        x = []
        if own is None:
            if self._ready is None:
                self._ready = [stretch(t[0], t[1]).astype(np.float32) for t in self.tables], (confidence(self.tables[1].sum(0)) * CONFIDENCES_SHORT).astype(np.int8), confidence(self.tables[2].sum(0), CONFIDENCES_SHORT).astype(np.int8)
            x = [r.take(s) for r, s in zip(self._ready[0], e.slots)]
            sure = (self._ready[1].take(e.slots[1]) + self._ready[2].take(e.slots[2])).astype(np.int64)
        else:
            zero = ~e.bit
            for i, s in enumerate(e.slots):
                n0, n1 = self.tables[i][0].take(s), self.tables[i][1].take(s)
                less = own.take(e.word) if i < 2 else np.float32(1)
                n0, n1 = np.maximum(n0 - less * zero, 0), np.maximum(n1 - less * e.bit, 0)
                x.append(stretch(n0, n1))
                if i == 1:
                    sure = confidence(n0 + n1) * CONFIDENCES_SHORT
                elif i == 2:
                    sure = sure + confidence(n0 + n1, CONFIDENCES_SHORT)
        x.append(np.full(len(e.bit), 0.3, np.float32))
        return x, gates.take(e.word) * (CONFIDENCES * CONFIDENCES_SHORT) + sure

    def _mix(self, x: list[np.ndarray], sets: np.ndarray) -> np.ndarray:
        z = np.zeros(len(sets))
        for j, v in enumerate(x):
            z += np.ascontiguousarray(self.weights[:, j]).take(sets) * v
        return z.clip(-8, 8)

    def _refine(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mean of the mixed probability and what the map, between its two nearest steps, has for it."""
        at = (z + 8) * ((MAP_STEPS - 1) / 16)
        low = np.minimum(at.astype(np.int64), MAP_STEPS - 2)
        share = at - low
        mapped = self.map[gate, low] * (1 - share) + self.map[gate, low + 1] * share
        return np.clip((1 / (1 + np.exp(-z)) + mapped) / 2, 1e-5, 1 - 1e-5)

    def learn(self, items: list[bytes], gates: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
        """One online step over words with their counts under a gate; total: their counts in training."""
        e = Events(self.code, items, gates)
        x, sets = self._inputs(e, gates, (total >= LEAST).astype(np.float32))
        z = self._mix(x, sets)
        weight = counts[e.word].astype(np.float64)
        miss = weight * (e.bit - 1 / (1 + np.exp(-z)))
        norm = np.bincount(sets, weight, len(self.weights)) + 1
        for j in range(PREDICTORS + 1):
            g = np.bincount(sets, miss * x[j], len(self.weights)) / norm
            self.steps[:, j] += g * g
            self.weights[:, j] += RATE * g / (np.sqrt(self.steps[:, j]) + 1e-6)
        gate = gates[e.word]
        cell = gate * MAP_STEPS + np.rint((z + 8) * ((MAP_STEPS - 1) / 16)).astype(np.int64)
        size = self.map.size
        n, ones = np.bincount(cell, weight, size).reshape(self.map.shape), np.bincount(cell, weight * e.bit, size).reshape(self.map.shape)
        rate = n / (n + 2000)
        self.map += rate * (ones / np.maximum(n, 1) - self.map)

    def log_probabilities(self, items: list[bytes], gates: np.ndarray) -> np.ndarray:
        """log10 of each word's probability under its gate."""
        out = np.zeros(len(items))
        for at in range(0, len(items), 8_000):
            some, g = items[at : at + 8_000], gates[at : at + 8_000]
            e = Events(self.code, some, g)
            x, sets = self._inputs(e, g)
            p = self._refine(self._mix(x, sets), g[e.word])
            out[at : at + len(some)] = np.bincount(e.word, np.log10(np.where(e.bit, p, 1 - p)), len(some))
        return out


def confidence(n: np.ndarray, steps: int = CONFIDENCES) -> np.ndarray:
    return np.minimum(np.log2(n + 1) / 2, steps - 1).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        yield from common.slices(batch, column)


def _profile(batches):
    """Every word that may have a share of TOP_SHARE of the task's words or more, and the task's bytes, over training documents.

    Rare words are forgotten when they are many, by a count that `missed` bounds for every word,
    so none that is frequent is lost: a word with that share of all words has it in some task.
    """
    tops, total, n, missed = Counter(), np.zeros(256, np.int64), 0, 0
    for part in _texts(batches, 0):
        lengths, tokens = tokens_of([utf8(t) for t in part.column(0).to_pylist()])
        n += len(tokens) - len(lengths)
        total += np.bincount(np.frombuffer(tokens.buffers()[2], np.uint8), minlength=256)
        total[32] += len(tokens)
        d = tokens.dictionary_encode()
        often = np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary))
        cut = max(0, int(TOP_SHARE / 8 * n) - missed)  # half of what may be missed, the other half is left to the sum
        at = np.flatnonzero(often > cut)
        tops.update(dict(zip(d.dictionary.take(pa.array(at)).to_pylist(), often[at].tolist())))
        tops.pop(b"", None)  # the end
        missed += cut
        if len(tops) > 200_000 and (cut := int(TOP_SHARE / 4 * n) - missed) > 0:
            tops = Counter({w: c for w, c in tops.items() if c > cut})
            missed += cut
    best = [w for w, c in tops.items() if c + missed >= TOP_SHARE * n]
    yield pa.RecordBatch.from_pydict({"kind": [0] * len(best) + [1] * 256 + [2], "key": best + [bytes([b]) for b in range(256)] + [b""], "n": [0] * len(best) + total.tolist() + [n]}, schema=pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("n", pa.int64())]))


def _together(batches, tops: list[bytes]):
    """In how many documents two of the words occur (i, j), and how often each occurs at all (i, null)."""
    names = pa.array(tops, pa.binary())
    total, often = np.zeros((len(tops), len(tops)), np.int64), np.zeros(len(tops), np.int64)
    for part in _texts(batches, 0):
        lengths, tokens = tokens_of([utf8(t) for t in part.column(0).to_pylist()])
        top = pc.index_in(tokens, value_set=names).fill_null(-1).to_numpy()
        own = np.flatnonzero(top >= 0)
        cell = np.repeat(np.arange(len(lengths)), lengths)[own] * len(tops) + top[own]
        x = np.bincount(cell, minlength=len(lengths) * len(tops)).reshape(len(lengths), -1)
        often += x.sum(0)
        x = (x > 0).astype(np.float32)
        total += np.rint(x.T @ x).astype(np.int64)
    i, j = np.nonzero(total)
    k = np.arange(len(tops))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, k]).astype(np.int32)), pa.array([*j.tolist(), *[None] * len(k)], pa.int32()), pa.array(np.concatenate([total[i, j], often]))], schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())]))


def _row(kind=0, p=0, r=0, words=b"", counts=b"", tokens=0, known=0):
    return pa.RecordBatch.from_pydict({"kind": [kind], "p": [p], "r": [r], "words": [words], "counts": [counts], "tokens": [tokens], "known": [known]}, schema=to_arrow_schema(PART))


#: What a part says of each document: its id, whether that is null, whether it is learned from, its tokens, the bytes of its words with one more each.
DOCUMENT = np.dtype([("key", "<i8"), ("null", "?"), ("train", "?"), ("tokens", "<i8"), ("size", "<i8")])


class _Part:
    """The texts of a part as numbers, its distinct words, and how often each occurs in training and whether it occurs at all, by gate."""

    def __init__(self, gates: Gates):
        self.gates, self.found = gates, []  # found: distinct words, and gate, place, count of what is seen
        self.names, classes = pa.array(list(gates.classes), pa.binary()), list(gates.classes.values())
        self.classes = np.array([*classes, -1], np.int8)
        self.docs, self.size, self.pending, self.held = [], 0, [], 0  # docs: of each round, the documents and their tokens' places in its distinct words

    def add(self, key, text: str | None, train: bool) -> None:
        raw = utf8(text)
        self.size += len(raw)
        self.pending.append((raw, key, train))
        self.held += len(raw)
        if self.held > SOME_BYTES:
            self.count()

    def count(self) -> None:
        """Numbers the pending texts' words and counts them by gate."""
        if not self.pending:
            return
        lengths, at, distinct = numbered([raw for raw, _, _ in self.pending])
        starts = np.cumsum(lengths) - lengths
        name = pc.index_in(distinct, value_set=self.names).fill_null(-1).to_numpy()
        gate = self.gates.of(self.classes[name][at], starts)
        cell = gate.astype(np.int64) * len(distinct) + at
        train = np.repeat(np.array([t for _, _, t in self.pending], bool), lengths)
        seen = np.flatnonzero(np.bincount(cell))
        n = np.bincount(cell[train], minlength=self.gates.n * len(distinct))[seen]
        self.found.append((distinct, (seen // len(distinct)).astype(np.int8), (seen % len(distinct)).astype(np.int32), n.astype(np.int32)))
        docs = np.zeros(len(lengths), DOCUMENT)
        docs["key"], docs["null"] = [k or 0 for _, k, _ in self.pending], [k is None for _, k, _ in self.pending]
        docs["train"], docs["tokens"] = [t for _, _, t in self.pending], lengths
        docs["size"] = np.maximum(np.add.reduceat((pc.binary_length(distinct).to_numpy() + 1)[at], starts, dtype=np.int64) - 1, 1)
        self.docs.append((docs, at.astype(np.int32)))
        self.pending, self.held = [], 0

    def texts(self, p: int):
        """Rows of some documents each, their tokens as places among the part's words in the order of the shards; after vocabulary, which settles that."""
        for (docs, at), places in zip(self.docs, self.places):
            ends = np.cumsum(docs["tokens"])
            cuts = np.flatnonzero(np.diff(np.cumsum(docs["size"]) // BLOB_BYTES)) + 1
            for own, tokens in zip(np.split(docs, cuts), np.split(places[at], ends[cuts - 1])):
                yield _row(1, p, -1, pack(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()), pack(own.tobytes()), len(own))

    def vocabulary(self, p: int, shards: int):
        """A row for each shard that has words of the part, in their order: the words and, gate by gate, twice the count and one more if it is seen."""
        self.count()
        self.places: list[np.ndarray] = []
        if not self.found:
            return
        d = pa.concat_arrays([x[0] for x in self.found]).dictionary_encode()
        number, words, done, ends = d.indices.to_numpy(), d.dictionary.to_pylist(), 0, np.cumsum([len(x[0]) for x in self.found])
        both = np.zeros((self.gates.n, len(words)), np.int32)
        for distinct, gate, at, n in self.found:
            at = number[done : done + len(distinct)][at]
            both[gate, at] = (both[gate, at] & ~1) + 2 * n + 1
            done += len(distinct)
        shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.places = np.split(place[number], ends[:-1])
        both = both[:, order].astype("<i4", copy=False)
        for own in np.split(np.arange(len(order)), np.flatnonzero(np.diff(shard[order])) + 1):
            if len(own):
                yield _row(0, p, int(shard[order[own[0]]]), pack(b"\n".join([words[i] for i in order[own].tolist()])), pack(both[:, own].tobytes()), len(own))


def _parts(batches, gates: Gates, shards: int):
    """Rows of kind 0: a part's words of a shard with counts by gate; of kind 1: some of its documents."""
    p, part = TaskContext.get().partitionId() << 32, _Part(gates)
    for rows in _texts(batches, 1):
        for k, t, train in zip(*(rows.column(i).to_pylist() for i in range(3))):
            part.add(k, t, bool(train))
            if part.size > PART_BYTES:
                yield from part.vocabulary(p, shards)
                yield from part.texts(p)
                p, part = p + 1, _Part(gates)
    yield from part.vocabulary(p, shards)
    yield from part.texts(p)


def _merge(batches, n_gates: int, shared=None):
    """From rows of kind 0 sorted by shard. Without a model, rows of kind 2: the shard's distinct words with counts by gate, its tokens and its known words. With one, again kind 0: a part's words, their total counts and then, gate by gate, the log10 probabilities of those that are seen there."""

    def shard(r, rows):
        index: dict[bytes, int] = {}
        places, parts = [], []
        for _, raw, counts in rows:
            own = unpack(raw).split(b"\n")
            places.append(np.fromiter((index.setdefault(w, len(index)) for w in own), np.int64, len(own)))
            parts.append(np.frombuffer(unpack(counts), "<i4").reshape(n_gates, -1))
        total, seen = np.zeros((n_gates, len(index)), np.int64), np.zeros((n_gates, len(index)), bool)
        for at, c in zip(places, parts):
            total[:, at] += c >> 1  # words of one row are distinct
            seen[:, at] |= (c & 1).astype(bool)
        every = total.sum(0)
        if shared is None:
            yield _row(2, 0, r, pack(b"\n".join(index)), pack(total.astype("<i8").tobytes()), int(every.sum()), int((every > 0).sum()))
            return
        items, (g, at) = list(index), np.nonzero(seen)
        scores = np.zeros(seen.shape, "<f4")
        scores[g, at] = shared.value.log_probabilities([items[i] for i in at.tolist()], g)
        for (p, raw, _), at, c in zip(rows, places, parts):
            own = (c & 1).astype(bool)
            yield _row(0, p, r, raw, pack(every[at].astype("<i8").tobytes() + np.packbits(own).tobytes() + scores[:, at][own].tobytes()), len(at))

    last, rows = None, []
    for batch in batches:
        for p, r, raw, counts in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if r != last and rows:
                yield from shard(last, rows)
                rows = []
            last = r
            rows.append((p, raw, counts))
    if rows:
        yield from shard(last, rows)


def _vocabulary(batches, n_gates: int, most: int = 10_000):
    """(words, gate of each, counts under the gate, total counts) of kind 2 rows, by at most so many words."""
    for batch in batches:
        for raw, counts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            own = unpack(raw).split(b"\n")
            c = np.frombuffer(unpack(counts), "<i8").reshape(n_gates, -1)
            g, at = np.nonzero(c)
            order = np.random.default_rng(len(own)).permutation(len(at))  # words stand in no order of their own
            g, at = g[order], at[order]
            total = c.sum(0)
            for i in range(0, len(at), most):
                some = at[i : i + most]
                yield [own[j] for j in some.tolist()], g[i : i + most], c[g[i : i + most], some], total[some]


def _count_bits(batches, code: Code, n_gates: int):
    """The task's counts of bits by slot, in blocks."""
    tables = [np.zeros((2, 1 << b), np.float64) for b in SLOT_BITS]
    any_words = False
    for items, gates, counts, total in _vocabulary(batches, n_gates):
        any_words = True
        e = Events(code, items, gates)
        weight = counts[e.word].astype(np.float64)
        long = weight * (total >= LEAST)[e.word]
        for i, (t, s) in enumerate(zip(tables, e.slots)):
            w = long if i < 2 else weight
            np.add.at(t.reshape(-1), s + e.bit * t.shape[1], w)
    for i, t in enumerate(tables if any_words else ()):
        for b in range(0, t.shape[1], BLOCK):
            yield pa.RecordBatch.from_pydict({"predictor": [i], "block": [b // BLOCK], "counts": [pack(t[:, b : b + BLOCK].astype("<f8").tobytes())]}, schema=to_arrow_schema(SUMS))


def _add_blocks(batches):
    """Rows sorted by predictor and block become their sums."""
    last, total = None, None

    def row():
        return pa.RecordBatch.from_pydict({"predictor": [last[0]], "block": [last[1]], "counts": [pack(total.astype("<f8").tobytes())]}, schema=to_arrow_schema(SUMS))

    for batch in batches:
        for i, b, raw in zip(*(batch.column(j).to_pylist() for j in range(3))):
            c = np.frombuffer(unpack(raw), "<f8")
            if (i, b) != last:
                if last is not None:
                    yield row()
                last, total = (i, b), c
            else:
                total = total + c
    if last is not None:
        yield row()


def _train(batches, shared, n_gates: int):
    """The task's weights and map after one online pass, numbered for averaging."""
    base: Model = shared.value
    model, n = Model(base.code, base.gates, base.tables), 0
    for items, g, counts, total in _vocabulary(batches, n_gates, 1_000):
        model.learn(items, g, counts, total)
        n += int(counts.sum())
    if n:
        flat = np.concatenate([model.weights.reshape(-1), model.map.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), n, np.int64))], schema=pa.schema([("i", pa.int32()), ("x", pa.float64()), ("n", pa.int64())]))


def earlier(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key occurred before its place, and a number for each distinct key."""
    bits = len(key).bit_length()
    if len(key) and key.min() >= 0 and int(key.max()).bit_length() + bits < 63:  # place and key in one number: quicker to sort
        k = key << bits | np.arange(len(key))
        k.sort()
        order = k & ((1 << bits) - 1)
        k >>= bits
    else:
        order = np.argsort(key, kind="stable")
        k = key[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    out, number = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - np.flatnonzero(first)[group]
    number[order] = group
    return out, number


def adapted(spelt: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 probability of each token of texts that begin at `starts`, by three predictors whose weights follow the text.

    spelt: log10 probabilities of the spelt words; word: their numbers. The words so far predict
    (n_w + d * spelt) / (t + d), with d distinct words among t; what followed the word before predicts
    (n_vw + words so far) / (n_v + 1). All three are distributions, and so is their mixture.
    """
    n = len(word)
    if not n:
        return np.zeros(0)
    lengths = np.diff([*starts, n])
    text = np.repeat(np.arange(len(starts)), lengths)
    begin = starts[text]
    n_w, own = earlier(text * (int(word.max()) + 1) + word)
    t = (np.arange(n) - begin).astype(np.float64)
    new = (n_w == 0).astype(np.int64)
    d = np.cumsum(new) - new  # before this token, over all texts
    d = (d - d[begin]).astype(np.float64)
    p = 10.0 ** np.maximum(spelt, -300)
    words = np.where(t > 0, (n_w + d * p) / np.maximum(t + d, 1), p)
    before = np.concatenate([[0], own[:-1]])
    before[starts] = n + text[starts]  # a text's first word has none before it: a key that occurs once
    n_v, _ = earlier(before)
    n_vw, _ = earlier(before * n + own)
    pairs = (n_vw + words) / (n_v + 1)
    x = np.log(np.stack([p, words, pairs]))
    z = np.cumsum(x, axis=1) - x
    z = ADAPT * (z - z[:, begin])
    w = np.exp(z - z.max(0))
    w = FLOOR + (1 - 3 * FLOOR) * w / w.sum(0)
    return np.log10((w * np.exp(x)).sum(0))


def _score(batches, shared, train_tokens: int, train_words: int):
    """Rows sorted by part and kind: a part's words, then its documents."""
    gates: Gates = shared.value
    floor = math.log10(train_tokens + 0.1 * (train_words + 1)) if train_tokens else 0.0
    arrow = to_arrow_schema(SCORE)
    names, kinds = pa.array(list(gates.classes), pa.binary()), np.array([*gates.classes.values(), -1], np.int8)
    part, rows, ready = None, [], None

    def vocabulary():
        """Total counts, scores by gate and classes of the part's words, in the order of the shards."""
        counts, scores, classes = [], [], []
        for _, raw, own in sorted(rows):
            w, data = listed(unpack(raw)), unpack(own)
            bits = -(-gates.n * len(w) // 8)
            seen = np.unpackbits(np.frombuffer(data, np.uint8, bits, 8 * len(w)), count=gates.n * len(w)).astype(bool).reshape(gates.n, -1)
            s = np.zeros(seen.shape, np.float32)
            s[seen] = np.frombuffer(data, "<f4", -1, 8 * len(w) + bits)
            counts.append(np.frombuffer(data, "<i8", len(w)))
            scores.append(s)
            classes.append(kinds[pc.index_in(w, value_set=names).fill_null(-1).to_numpy()])
        counts = np.concatenate(counts)
        return np.log10(counts + 0.1), counts > 0, np.concatenate(scores, axis=1), np.concatenate(classes)

    for batch in batches:
        for kind, p, r, raw, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if p != part:
                part, rows, ready = p, [], None
            if kind == 0:
                rows.append((r, raw, own))
                continue
            if ready is None:
                ready, rows = vocabulary(), []
            logs, known, scores, classes = ready
            docs = np.frombuffer(unpack(own), DOCUMENT)
            word = np.ascontiguousarray(np.frombuffer(unpack(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
            lengths = docs["tokens"]
            starts = np.cumsum(lengths) - lengths
            score = adapted(scores[gates.of(classes[word], starts), word].astype(np.float64), word, starts)
            base = np.add.reduceat(logs[word], starts) - lengths * floor if train_tokens else np.zeros(len(starts))
            cols = [pa.array(docs["key"], pa.int64(), mask=docs["null"]), ~docs["train"], lengths, np.add.reduceat(known[word], starts, dtype=np.int64), np.full(len(docs), train_tokens, np.int64), base, np.add.reduceat(score, starts), docs["size"]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x), f.type) for x, f in zip(cols, arrow)], schema=arrow)


def score(docs: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of docs.

    train: which documents the model learns from; all are scored. Null and empty texts are the
    end token alone; repeated rows are scored, and learned, as often as they occur. Without any
    training token the base is 0.1 / (0 + 0.1 * 1) for each token, and the model is untrained. An
    empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    learn = rows.where("train").select("t")
    n_docs = rows.select("k").count()
    profile = learn.mapInArrow(_profile, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()  # a few hundred words at most, as each has a least share
    tops, byte_counts, n_words = sorted(bytes(r.key) for r in profile if r.kind == 0), np.zeros(256, np.int64), 0
    for r in profile:
        if r.kind == 1:
            byte_counts[r.key[0]] = r.n
        elif r.kind == 2:
            n_words = r.n
    code = Code(byte_counts)
    together, often = np.zeros((len(tops), len(tops)), np.int64), np.zeros(len(tops), np.int64)
    if tops:
        for r in learn.mapInArrow(partial(_together, tops=tops), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
            if r.j is None:
                often[r.i] = r.n
            else:
                together[r.i, r.j] = r.n
    best = [i for i in sorted(range(len(tops)), key=lambda i: (-often[i], tops[i]))[:TOP_WORDS] if often[i] >= TOP_SHARE * n_words]
    gates = Gates.cluster([tops[i] for i in best], together[np.ix_(best, best)]) if best else Gates({})
    shards, few = max(16, n_docs // 8_000), max(3, n_docs // 20_000)
    few = min(few, 512 + math.isqrt(few))  # each of these tasks sends a table of fixed size
    parts = common.written(rows.mapInArrow(partial(_parts, gates=gates, shards=shards), PART), "parts")
    dealt = parts.where("kind = 0").repartition("r").sortWithinPartitions("r", "p")
    merged = common.written(dealt.mapInArrow(partial(_merge, n_gates=gates.n), PART), "merged")
    vocabulary = merged.where("kind = 2")
    train_tokens, train_words = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    own = vocabulary.repartition(few, "r")
    sums = own.mapInArrow(partial(_count_bits, code=code, n_gates=gates.n), SUMS).repartition("predictor", "block").sortWithinPartitions("predictor", "block").mapInArrow(_add_blocks, SUMS)
    tables = [np.zeros((2, 1 << b), np.float32) for b in SLOT_BITS]
    for r in sums.collect():  # the tables' size is fixed
        tables[r.predictor][:, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(unpack(r.counts), "<f8").reshape(2, -1)
    model = Model(code, gates, tables)
    raw = spark.sparkContext.broadcast(model)
    learned = own.mapInArrow(partial(_train, shared=raw, n_gates=gates.n), "i int, x double, n long").groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).collect()
    raw.destroy()
    if learned:
        flat = np.array([r.x for r in sorted(learned, key=lambda r: r.i)])
        model.weights = flat[: model.weights.size].reshape(model.weights.shape)
        model.map = flat[model.weights.size :].reshape(model.map.shape)
    shared = spark.sparkContext.broadcast(model)
    known = dealt.mapInArrow(partial(_merge, n_gates=gates.n, shared=shared), PART)
    both = parts.where("kind = 1").unionByName(known)
    classes = spark.sparkContext.broadcast(gates)
    out = both.repartition("p").sortWithinPartitions("p", "kind").mapInArrow(partial(_score, shared=classes, train_tokens=train_tokens, train_words=train_words), SCORE)
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))


def op10_context_mixing(spark, sf_dir):
    """The contract's columns, n_bytes and bits_per_byte for each row of documents; null texts are the end token alone."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.remainder("doc_id", 10) != 0)
