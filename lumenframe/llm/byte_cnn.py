"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks of WIDTH bytes, a chunk every
STRIDE bytes, over the whole document; the rectified outputs are max-pooled over all chunks, and
two dense layers combine them into one probability. Beside the embedding a byte has a channel
that tells whether the four bytes that end there occurred a few bytes before: a filter
is linear and could not see repetition otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STRIDE, BLOCKS = 8, 4
WIDTH = STRIDE * BLOCKS
EMBED, FILTERS, HIDDEN = 7, 48, 16
LAGS = range(2, 25)
#: The documented bound of the training sample: documents of each label. Their texts are whole.
SAMPLE_DOCS = 1500
EPOCHS, BATCH, RATE = 12, 32, 0.004
THRESHOLD = 0.3
#: Bytes that are scored at once; the pool carries over, so a document of any length is covered.
SEGMENT = 1 << 17


def match(raw: np.ndarray) -> np.ndarray:
    """For each byte, 1 if the four bytes ending there equal the four that end some LAGS before."""
    n = len(raw)
    out = np.zeros(n, np.float32)
    if n < 5:
        return out
    b = raw.astype(np.uint32)
    grams = b[3:] | b[2:-1] << 8 | b[1:-2] << 16 | b[:-3] << 24
    found = np.zeros(n - 3, bool)
    for lag in LAGS:
        if lag < n - 3:
            found[lag:] |= grams[lag:] == grams[:-lag]
    out[3:] = found
    return out


def blocks_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and match channel in blocks of STRIDE, padded with zeros to a whole chunk at least."""
    n = max(BLOCKS, -(-len(raw) // STRIDE))
    b = np.zeros(n * STRIDE, np.uint8)
    b[: len(raw)] = raw
    m = np.zeros(n * STRIDE, np.uint8)
    m[: len(raw)] = match(raw)
    return b.reshape(n, STRIDE), m.reshape(n, STRIDE)


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)).astype(f),
            "w": r.normal(0, (WIDTH * (EMBED + 1)) ** -0.5, (BLOCKS, STRIDE * (EMBED + 1), FILTERS)).astype(f),
            "c": np.zeros(FILTERS, f),
            "w1": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f),
            "c1": np.zeros(HIDDEN, f),
            "w2": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
            "c2": np.zeros(1, f),
        }

    def inputs(self, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        x = np.empty((*b.shape, EMBED + 1), np.float32)
        x[..., :EMBED] = self.p["e"][b]
        x[..., EMBED] = m
        return x.reshape(len(b), -1)

    def chunks(self, x: np.ndarray) -> np.ndarray:
        """Outputs of the filters for each chunk, before the bias."""
        n = len(x) - BLOCKS + 1
        out = x[:n] @ self.p["w"][0]
        for j in range(1, BLOCKS):
            out += x[j : j + n] @ self.p["w"][j]
        return out

    def pooled(self, raw: np.ndarray) -> np.ndarray:
        """The maximum of each filter over all chunks of a document, in bounded memory."""
        step = SEGMENT - SEGMENT % STRIDE
        best = np.full(FILTERS, -np.inf, np.float32)
        for at in range(0, max(1, len(raw)), step):
            # the first chunks of the next segment are seen here, and some bytes before let the match channel look back
            before = min(at, 32)
            part = raw[at - before : at + step + WIDTH]
            m = match(part)[before:]
            b, mm = blocks_of(part[before:])
            mm.reshape(-1)[: len(m)] = m
            best = np.maximum(best, self.chunks(self.inputs(b, mm)).max(0))
        return best

    def head(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(np.maximum(pooled + self.p["c"], 0) @ self.p["w1"] + self.p["c1"], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["c2"][0], -30, 30)))

    def score(self, texts: list) -> np.ndarray:
        """The probability of label 1 for each text; null counts as empty."""
        if not texts:
            return np.zeros(0)
        return self.head(np.stack([self.pooled(to_bytes(t)) for t in texts])).astype(np.float64)

    def tops(self, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The maximum of each filter over a document's chunks, their places and their inputs block by block; a long document goes segment by segment."""
        best, place, seen = None, None, None
        step = SEGMENT // STRIDE
        for s in range(0, max(1, len(b) - BLOCKS + 1), step):
            x = self.inputs(b[s : s + step + BLOCKS - 1], m[s : s + step + BLOCKS - 1])
            z = self.chunks(x)
            at = z.argmax(0)
            top, own = z[at, np.arange(FILTERS)], x[at[:, None] + np.arange(BLOCKS)]
            if best is None:
                best, place, seen = top, at, own
                continue
            more = top > best
            best[more], place[more], seen[more] = top[more], at[more] + s, own[more]
        return best, (place, seen)

    def grads(self, docs: list, y: np.ndarray) -> tuple[float, dict]:
        """Mean log loss and its gradients; docs: blocks_of() of each document."""
        p = self.p
        tops, rows = zip(*(self.tops(b, m) for b, m in docs))
        a0 = np.stack(tops) + p["c"]
        r0 = np.maximum(a0, 0)
        a1 = r0 @ p["w1"] + p["c1"]
        r1 = np.maximum(a1, 0)
        z = r1 @ p["w2"] + p["c2"][0]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
        dz = ((prob - y) / len(y)).astype(np.float32)
        g = {"w2": r1.T @ dz, "c2": dz.sum(keepdims=True)}
        d1 = np.outer(dz, p["w2"]) * (a1 > 0)
        g["w1"], g["c1"] = r0.T @ d1, d1.sum(0)
        d0 = (d1 @ p["w1"].T) * (a0 > 0)
        g["c"] = d0.sum(0)
        g["w"], g["e"] = np.zeros_like(p["w"]), np.zeros_like(p["e"])
        for (b, _), (at, x), d in zip(docs, rows, d0):
            g["w"] += np.einsum("fbi,f->bif", x, d, optimize=True)
            dx = np.einsum("bif,f->fbi", p["w"], d, optimize=True).reshape(FILTERS, BLOCKS, STRIDE, EMBED + 1)[..., :EMBED]
            np.add.at(g["e"], b[at[:, None] + np.arange(BLOCKS)].reshape(-1), dx.reshape(-1, EMBED))
        return loss, g


def to_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def train(texts: list, labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Net:
    """A network fitted with Adam on balanced batches; the same sample gives the same network."""
    net, r = Net(seed), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    raws = [to_bytes(t) for t in texts]
    docs = [blocks_of(x) for x in raws]
    by = [np.flatnonzero(y == k) for k in (0, 1)]
    if not len(by[0]) or not len(by[1]):  # one label alone: its share is all there is to learn
        net.p["w2"][:] = 0
        net.p["c2"][:] = 4 if len(by[1]) else -4 if len(by[0]) else 0
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    steps = max(40, epochs * max(len(by[0]), len(by[1])) // (BATCH // 2))
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(by[0], BATCH // 2), r.choice(by[1], BATCH // 2)])
        _, g = net.grads([docs[i] for i in pick], y[pick])
        rate = RATE * (1 - (t - 1) / steps)
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Net:
    """Trained on at most sample_docs labelled documents of each label, chosen by a hash of the key; their texts are whole.

    A document with several labels counts as the smallest; of rows that share a key the smallest text counts; null texts and keys do not. The
    sample's keys are joined with docs as a broadcast of at most 2 x sample_docs rows. Without any label the score is 0.5 everywhere.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    chosen = common.bounded_sample(known, "y", "k", sample_docs)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: str(r.k))
    return train([r.t for r in rows], [r.y for r in rows])


def _scorer(shared) -> Callable:
    net = shared.value
    return lambda texts: {"quality_score": net.score(texts)}


def classify(docs: DataFrame, net: Net, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with quality_score double. One pass without a shuffle; the network is of fixed size.

    Null and empty texts get the score of no byte at all, repeated rows the same score each; an empty table stays empty. An input column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return common.add_columns(docs, text, common.fields("quality_score double"), partial(_scorer, shared), drop=() if keep_text else (text,))


def op8_byte_cnn(spark, sf_dir):
    """doc_id, held_out, score, predicted of each row of documents; odd texts as classify has them."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, common.read(spark, sf_dir, "labels").where(common.remainder("doc_id", 5) != 0))
    out = classify(docs, net, keep_text=False)
    return out.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
