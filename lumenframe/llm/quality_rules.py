"""Quality rules with risk-controlled cutoffs.

Each rule is a ratio that is high in bad texts. The cutoffs of all rules move together, in
STEPS settings from lenient to strict, and the setting of each stratum (a language) is chosen on
labelled documents so that, with confidence 1 - delta for all strata together, the rules as a
whole reject at most a share alpha of the good documents of that stratum. The bound is the exact
binomial test of H0 "the share is over alpha"; strata share delta by Bonferroni's correction,
and the settings of a stratum are tested from lenient to strict until one is not rejected
(fixed-sequence testing, which needs no further correction, as the order is fixed beforehand).
Among the settings that pass, the one that rejects most bad labelled documents is taken, the
most lenient of equals. A stratum in which nothing passes has no cutoff.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = frozenset("#*$%&|<>")
SPACES = " \t\n\v\f\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: rule -> (ratio from the statistics as SQL, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.4, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0]),
}
#: Settings of all rules; the last one is the strictest cutoff of each.
STEPS = 14


def cutoff_at(rule: str, step: int) -> float | None:
    """The cutoff of a rule in a setting; None while the rule does not act yet."""
    cuts = RULES[rule][1]
    i = (step + 1) * len(cuts) // STEPS - 1
    return cuts[i] if i >= 0 else None


def text_stats(text: str | None) -> tuple[int, ...]:
    """The fields of STATS; all 0 for null, and 0 lines for a text without a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at the six ASCII spaces alone
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n >= 3:
        windows = Counter(zip(words, words[1:], words[2:]))
        if len(windows) < n - 2:
            end = 0  # of the words that are counted
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if windows[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(raw.translate(None, NOT_CAPITAL))


def _stats() -> Callable:
    names = [f.name for f in common.fields(STATS)]
    return lambda texts: dict(zip(names, map(list, zip(*map(text_stats, texts))))) if texts else {n: [] for n in names}


def add_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of STATS in place of the text. Null and empty texts have zeros; repeated rows each get their own."""
    return common.add_columns(docs, text, common.fields(STATS), _stats, drop=(text,))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms."""
    if k >= n:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose(good: list[int], bad: list[int], n_good: int, alpha: float, level: float) -> int | None:
    """The place of the setting to use. good, bad: labelled documents that each setting rejects, lenient to strict."""
    best = None
    for i, k in enumerate(good):
        if n_good == 0 or binomial_tail(k, n_good, alpha) > level:
            break
        if bad[i] and (best is None or bad[i] > bad[best]):
            best = i
    return best


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, key: str = "doc_id", stratum: str = "lang", label: str = "quality") -> dict[tuple[str | None, str], float]:
    """(stratum, rule) -> cutoff, of the rules that act in the stratum's setting.

    stats: the result of add_stats with key and stratum. Documents with several labels count
    once, as bad if one label says so; null labels do not count. Only rows that the fixed base
    rule keeps are counted, as the cutoffs act on those. What comes to the driver is one row of
    counts for each stratum.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    rows = stats.where(~base_failed()).select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), *[F.expr(sql).alias(rule) for rule, (sql, _) in RULES.items()]).join(labels, "_key")
    aggs = [F.count_if(F.col("_label") != 0).alias("n_good"), F.count(F.lit(1)).alias("n")]
    for i in range(STEPS):
        hit = F.lit(False)
        for rule in RULES:
            if (c := cutoff_at(rule, i)) is not None:
                hit = hit | (F.col(rule) > c)
        aggs += [F.count_if(hit & (F.col("_label") != 0)).alias(f"g_{i}"), F.count_if(hit & (F.col("_label") == 0)).alias(f"b_{i}")]
    counts = rows.groupBy("_stratum").agg(*aggs).limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"more than 1000 values of {stratum}")
    found = {}
    for r in counts:
        i = choose([r[f"g_{i}"] for i in range(STEPS)], [r[f"b_{i}"] for i in range(STEPS)], r["n_good"], alpha, delta / len(counts))
        if i is not None:
            found |= {(r["_stratum"], rule): c for rule in RULES if (c := cutoff_at(rule, i)) is not None}
    return found


def apply_cutoffs(stats: DataFrame, cutoffs: dict[tuple[str | None, str], float], stratum: str = "lang") -> DataFrame:
    """stats with base_failed, kept and rejected_by (names of the rules that reject; empty if none).

    A stratum that no cutoff names, null among them, is judged by the base rule alone.
    """
    by_rule = {}
    for rule, (sql, _) in RULES.items():
        cond = F.lit(False)
        for (s, name), c in sorted(cutoffs.items(), key=str):
            if name == rule:
                cond = cond | (F.col(stratum).eqNullSafe(F.lit(s)) & (F.expr(sql) > c))
        by_rule[rule] = cond
    rejected = F.filter(F.array(*[F.when(c, F.lit(rule)) for rule, c in by_rule.items()]), lambda x: x.isNotNull())
    out = common.without(stats, ["base_failed", "kept", "rejected_by"]).withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Statistics, base verdict and risk-controlled verdict of every document, one row for each input row.

    The texts are read once: the statistics are written to the shared folder, the cutoffs
    are fitted on them and applied to them. An empty table gives an empty result.
    """
    stats = common.written(add_stats(docs.select("doc_id", "lang", "text")), "rules")
    return apply_cutoffs(stats, fit_cutoffs(stats, labels, alpha, delta))


def op6_quality_rules(spark, sf_dir):
    out = judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))
