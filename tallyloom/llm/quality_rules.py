"""Quality rules with risk-controlled cutoffs.

Each rule is a share that is high in bad text. Its cutoff is learned per stratum from labelled documents that pass the
base rules: going from the most lenient cutoff to the strictest, a cutoff is certified while the exact binomial test
rejects "more than ``RISK / rules`` of the good documents lie above it". The level of each (stratum, rule) sequence is
``CONFIDENCE_LOSS`` divided by their number (Bonferroni); within a sequence the fixed order needs no further correction.
So with probability 1 - CONFIDENCE_LOSS no stratum loses more than RISK of its good documents. Of the certified cutoffs
the one that separates bad from good best is used, the most lenient one on ties; none certified means no cutoff.

Defined cases: null text has no words and fails the base rules; a null stratum counts as the empty one; a stratum
without (enough) labels has no cutoffs; labels whose quality is null are ignored, repeated labels count each; empty
tables give empty results. Extra columns pass through, one named like a new column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import hand_back_memory, small_or_plain, without
from tallyloom.llm.stats import text_counts
from tallyloom.session import cut_lineage

RISK = 0.02
CONFIDENCE_LOSS = 0.05
#: Cutoffs are the multiples of 1 / STEPS of the share.
STEPS = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_upper", "n_ends", "n_distinct")


def _share(part: str, whole: str) -> Column:
    return F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))



def rules() -> dict[str, Column]:
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "upper_case": _share("n_upper", "word_chars"),
        "sentence_ends": _share("n_ends", "n_words"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "few_words": F.greatest(F.lit(0.0), 1 - _share("n_distinct", "n_words")),
    }


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [text_counts(t) for t in texts]
        yield pd.DataFrame({c: [r[c] for r in rows] for c in COUNTS}, dtype="int64")
    hand_back_memory()


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts of the whole text, ``base_failed`` and the bin of each rule's share."""
    counted = docs.select(*without(docs, (*COUNTS, "base_failed", "_bins")), _counts("text").alias("_counts"))
    flat = counted.select(*without(counted, ["_counts"]), "_counts.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bins = F.create_map(*[x for name, share in rules().items() for x in (F.lit(name), F.floor(share * STEPS).cast("int"))])
    return flat.withColumns({"base_failed": failed, "_bins": bins})


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, summed from its largest term down; 1 where k is at or over the mean."""
    if n == 0 or k >= n * p:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i = 1.0, 1.0, k
    while i > 0 and term > 1e-18 * total:
        term *= i / (n - i + 1) * (1 - p) / p
        total, i = total + term, i - 1
    return min(1.0, math.exp(log_term) * total)


def choose(good: list[int], bad: list[int], risk: float, level: float) -> int | None:
    """The bin from which documents are rejected. ``good`` and ``bad`` hold counts by bin of the share."""
    n, m = sum(good), sum(bad)
    above_good = above_bad = 0
    best: tuple[float, int] | None = None
    for at in range(len(good) - 1, 0, -1):
        above_good, above_bad = above_good + good[at], above_bad + bad[at]
        if tail(above_good, n, risk) > level:
            break
        gain = above_bad / max(m, 1) - above_good / max(n, 1)
        if gain > 0 and (best is None or gain > best[0]):
            best = gain, at
    return best and best[1]


def fit(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, loss: float = CONFIDENCE_LOSS) -> tuple[DataFrame, int]:
    """One row (stratum, cutoffs: rule to bin) for each labelled stratum, and how many rows there are.

    Counts by (stratum, rule, bin) are combinable; a task that chooses cutoffs sees at most one count per rule and bin.
    """
    marked = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("_good"))
    rows = measured.filter(~F.col("base_failed")).select(F.col("doc_id").alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), "_bins")
    counts = (
        rows.join(marked, "_id").select("_stratum", "_good", F.explode("_bins").alias("rule", "bin"))
        .groupBy("_stratum", "rule", "bin").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    )
    counts = cut_lineage(counts)
    strata = counts.select("_stratum").distinct().count()
    n_rules = len(rules())
    level = loss / max(1, strata * n_rules)

    def cutoffs(frame: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for rule, part in frame.groupby("rule"):
            good, bad = [0] * (STEPS + 1), [0] * (STEPS + 1)
            for at, g, b in zip(part["bin"], part["good"], part["bad"], strict=True):
                good[at], bad[at] = int(g), int(b)
            if (at := choose(good, bad, risk / n_rules, level)) is not None:
                found[rule] = at
        return pd.DataFrame({"_stratum": [frame["_stratum"].iloc[0]], "_cutoffs": [found]})

    return counts.groupBy("_stratum").applyInPandas(cutoffs, "_stratum string, _cutoffs map<string,int>"), strata


def judge(measured: DataFrame, cutoffs: DataFrame, strata: int, stratum: str = "lang") -> DataFrame:
    """Adds ``kept``: passes the base rules and lies below every cutoff of its stratum."""
    keyed = measured.select(*without(measured, ["_stratum", "kept"]), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"))
    joined = keyed.join(small_or_plain(cutoffs, strata), "_stratum", "left")
    over = F.coalesce(F.exists(F.map_entries("_cutoffs"), lambda e: F.element_at(F.col("_bins"), e["key"]) >= e["value"]), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_cutoffs", "_bins")


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts and verdict for every document; the texts are read once and not carried on."""
    measured = cut_lineage(measure(docs).drop("text"))
    return judge(measured, *fit(measured, labels, stratum), stratum)


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that are kept, with their own columns."""
    needed = measure(docs.select("doc_id", "text", stratum)).drop("text")
    cutoffs, strata = fit(needed, labels, stratum)
    columns = docs.columns
    packed = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", stratum)
    kept = judge(measure(packed), cutoffs, strata, stratum).filter("kept")
    return kept.select(*[F.col("_doc")[c].alias(c) for c in columns])
