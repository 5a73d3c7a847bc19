"""Token counts by section, attributed through the tokens' offsets.

A document is encoded once, whole. The lengths of its tokens in bytes give their offsets, which
are joined with the spans of its sections by binary search. The rule for a token that crosses a
boundary is explicit: "largest" gives it to the section that holds most of its bytes, the
earlier one of equals; "first" to the section of its first byte; "last" to that of its last.
So each token counts exactly once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

RULES = ("largest", "first", "last")


@lru_cache(2)
def encoding(path: str):
    """The encoder of a rank file, and the length in bytes of each token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(text: str) -> list[int]:
    """Where sections begin, in characters: at 0 and behind each newline that is followed by something."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def byte_starts(text: str, starts: list[int]) -> np.ndarray:
    """Character offsets as byte offsets of the text in UTF-8."""
    if text.isascii():
        return np.asarray(starts, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.flatnonzero((raw & 0xC0) != 0x80)[np.asarray(starts, np.int64)]


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """For each token, its section, and whether it crosses a boundary. ends: byte offsets behind the tokens; starts: of the sections, the first 0."""
    begins = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    owner = first.copy()
    for i in np.flatnonzero(crosses):  # few: a token can hold a newline only between sections
        edges = np.concatenate([[begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return owner, crosses


def count(text: str | None, starts: list[int], path: str, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those cross a boundary. starts: character offsets of the sections, ascending from 0."""
    n = len(starts)
    if not text:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    enc, lengths = encoding(path)
    ids = np.asarray(enc.encode_ordinary(text), np.int64)
    owner, crosses = attribute(np.cumsum(lengths[ids]), byte_starts(text, starts), rule)
    return np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)


def section_tokens(docs: DataFrame, path: str, rule: str = "largest", key: str = "doc_id", text: str = "text", sections: Callable[[str], list[int]] = line_sections) -> DataFrame:
    """A row for each section of each document: key, section int, start and length long (characters), n_tokens and n_crossing long.

    sections: a function from a text to the character offsets where sections begin, the first 0.
    Documents with a null or empty text have one section of length 0 without tokens; null keys
    and repeated rows are kept as they are, and a key named like a column of the result gets an underscore before its name. No shuffle; a long document is one row of a batch.
    """
    if rule not in RULES:
        raise ValueError(rule)
    kind = docs.schema[key].dataType
    result = common.fields("section int, start long, length long, n_tokens long, n_crossing long")
    schema = T.StructType([T.StructField(common.unlike(key, result.names), kind), *result])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                rows, cols = [], ([], [], [], [], [])
                for i, t in enumerate(part.column(1).to_pylist()):
                    t = t or ""
                    starts = sections(t)
                    n, crossing = count(t, starts, path, rule)
                    rows.append(np.full(len(starts), i))
                    for c, v in zip(cols, (np.arange(len(starts)), starts, np.diff([*starts, len(t)]), n, crossing)):
                        c.append(np.asarray(v, np.int64))
                cols = [np.concatenate(c) for c in cols]
                keys = part.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], schema=arrow)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op9_section_tokens(spark, sf_dir):
    """The lines of each row of documents as sections; odd texts as section_tokens has them."""
    import public_tokenizers

    return section_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
