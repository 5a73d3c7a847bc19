"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are sequences of lower-cased words, and patterns are the windows of 10 consecutive words
of the benchmark items (a shorter item is one pattern). Words are the symbols: a table of
shifts by blocks of two words skips the positions where no pattern can end, buckets by the last
block select the patterns that might, and comparing the words confirms them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Benchmark texts are searched in blocks of about so many characters, whose tables take some 300 MB of a worker; each block is one pass over the documents.
BLOCK_CHARS = 4_000_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []  # bytes: A-Z alone are lower-cased


class WuManber:
    """Search for patterns of one length, each a tuple of words."""

    def __init__(self, patterns: dict[tuple, tuple]):
        """patterns: pattern -> what to report for it."""
        self.m = m = len(next(iter(patterns)))
        self.b = b = min(2, m)
        self.default = m - b + 1
        shift: dict = {}
        buckets: dict = defaultdict(lambda: defaultdict(list))
        for p, payload in patterns.items():
            for end in range(b, m + 1):  # the block that ends before word `end`
                block = p[end - b : end]
                shift[block] = min(shift.get(block, m), m - end)
            buckets[p[m - b :]][p[:b]].append((p, payload))
        self.shift = shift
        self.buckets = {k: dict(v) for k, v in buckets.items()}

    def find(self, text: list) -> list[tuple[int, tuple]]:
        """(start, payload) of each occurrence."""
        m, b, default, shift, buckets = self.m, self.b, self.default, self.shift, self.buckets
        found, end, n = [], m, len(text)
        while end <= n:
            block = tuple(text[end - b : end])
            s = shift.get(block, default)
            if s:
                end += s
                continue
            start = end - m
            for p, payload in buckets[block].get(tuple(text[start : start + b]), ()):
                if p == tuple(text[start:end]):
                    found.append((start, payload))
            end += 1
        return found


def compile_items(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A searcher for each length of pattern. items: (id, text); a window of several items reports all of them."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length[m][tuple(w[i : i + m])].add(item)
    return [WuManber({p: tuple(sorted(ids)) for p, ids in by_length[m].items()}) for m in sorted(by_length)]


def search(text: str | None, searchers: list[WuManber]) -> tuple[int, list[int], list[str]]:
    """Number of words; the hit words as a flat list of disjoint spans start, end, start, end ...; the sorted ids found."""
    w = words(text)
    spans, ids = [], set()
    for s in searchers:
        for start, payload in s.find(w):
            spans.append((start, start + s.m))
            ids.update(payload)
    return len(w), union(spans), sorted(ids)


def union(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _searcher(shared) -> Callable:
    searchers = shared.value

    def f(texts: list) -> dict[str, list]:
        n, spans, ids = zip(*(search(t, searchers) for t in texts)) if texts else ((), (), ())
        return {"n_words": list(n), "hit_spans": list(spans), "hit_items": list(ids)}

    return f


def merge_spans(a: F.Column, b: F.Column) -> F.Column:
    """The union of two flat lists of disjoint sorted spans."""
    pairs = lambda x: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(x), 1) - 1), lambda i: F.struct(x[2 * i].alias("s"), x[2 * i + 1].alias("e")))
    some = lambda x: F.when(F.size(x) > 0, pairs(x)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
    step = lambda acc, p: F.when((F.size(acc) > 0) & (p["s"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["e"])))).otherwise(F.concat(acc, F.array(p["s"], p["e"])))
    return F.aggregate(F.array_sort(F.concat(some(a), some(b))), F.array().cast("array<bigint>"), step)


def find(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep_text: bool = True) -> DataFrame:
    """docs with n_words long, hit_spans array<long> and hit_items array<string>.

    A pass over docs without a shuffle for each block of the items; a block is of bounded
    size, so its tables are safe to broadcast. Null and empty texts have no words. Items
    without words or with a null id are left out, items with one id count as one. Input
    columns with the names of the result are replaced.
    """
    spark = docs.sparkSession
    items = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    spec = common.fields("n_words long, hit_spans longs, hit_items strings")
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(compile_items([tuple(r) for r in own.collect()], window))
        if out is None:
            out = common.add_columns(docs, text, spec, partial(_searcher, shared), drop=() if keep_text or blocks > 1 else (text,))
            continue
        old_spans, old_items = common.unused(out, "spans"), common.unused(out, "items")
        out = out.withColumnRenamed("hit_spans", old_spans).withColumnRenamed("hit_items", old_items)
        out = common.add_columns(common.written(out, "decontaminate"), text, spec, partial(_searcher, shared))
        out = out.withColumn("hit_spans", merge_spans(F.col(old_spans), F.col("hit_spans"))).withColumn("hit_items", F.array_sort(F.array_union(old_items, "hit_items"))).drop(old_spans, old_items)
    return out if keep_text or blocks == 1 else out.drop(text)


def n_hit(spans: str = "hit_spans") -> F.Column:
    """Words within the spans."""
    return F.coalesce(F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def op4_decontaminate(spark, sf_dir):
    """The contract's columns for each row of documents; null and wordless texts have no words and no hits."""
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


_LIST = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_LIST} AS w FROM documents),
b AS (SELECT item_id, {_LIST} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bw),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM bp),
ms AS (SELECT DISTINCT m FROM win),
dm AS (SELECT doc_id, w, m FROM d CROSS JOIN ms WHERE len(w) >= m),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dm),
ds AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM dp),
hits AS (SELECT DISTINCT doc_id, i, m, item_id FROM ds JOIN win USING (m, s)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
