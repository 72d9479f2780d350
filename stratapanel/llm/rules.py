"""Quality rules judged for whole hosts.

Each document is measured and checked against a few rules. Failures are counted for each host,
every host's failure rates are shrunk towards the mean of all hosts with a beta prior estimated from
the hosts themselves, and the verdict on the host goes back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import add_by_text
from stratapanel.sources.scratch import cut_lineage

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: A host is distrusted when, for one of the rules, the shrunk share of its documents that fail it is above this.
HOST_LIMIT = 0.5
#: Rules that a document must pass on any host.
BASE_RULES = ("too_short", "repeats")


def _repeated_words(words: Sequence[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, triples, counts = np.unique(
        pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True
    )
    again = counts[triples] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measures of a text, in the order of ``MEASURES``."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated_words(words),
    )


def _measurer() -> Callable[[list[bytes]], list]:
    return lambda texts: list(zip(*map(measure, texts), strict=True)) or [[]] * len(MEASURES)


def failures() -> dict[str, Column]:
    """The rules, as conditions on the measures that hold when a document fails."""
    words = F.col("n_words")
    return {
        "too_short": words < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
    }


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Judge every host: its name, rates shrunk by the empirical beta prior, and ``distrusted``.

    The prior of a rule has the mean m of the hosts' rates and the concentration
    c = m (1 - m) / variance - 1; the shrunk rate of f failures in n documents is
    (f + c m) / (n + c). Hosts that do not differ all get m; where they differ as far as rates can (c is 0, or
    below by rounding) each has its own rate. Only those two
    numbers for each rule pass through the driver. Documents without a host form one host of their own.
    """
    rules = failures()
    counts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), *(F.count_if(c).alias(f"failed_{r}") for r, c in rules.items())
    )
    counts = cut_lineage(counts, "hosts")
    rate = {r: F.col(f"failed_{r}") / F.col("docs") for r in rules}
    prior = counts.agg(
        *(F.avg(x).alias(f"m_{r}") for r, x in rate.items()), *(F.var_pop(x).alias(f"v_{r}") for r, x in rate.items())
    ).first()
    shrunk = {}
    for r in rules:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        if v > 0:
            c = max(m * (1 - m) / v - 1, 0.0)
            shrunk[f"rate_{r}"] = (F.col(f"failed_{r}") + F.lit(c * m)) / (F.col("docs") + F.lit(c))
        else:
            shrunk[f"rate_{r}"] = F.lit(m)
    judged = counts.select("host", "docs", *(x.alias(n) for n, x in shrunk.items()))
    above = reduce(lambda a, b: a | b, (F.col(n) > limit for n in shrunk))
    return cut_lineage(judged.withColumn("distrusted", above), "host-verdicts")


def with_measures(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the measures of every whole text; a null text has no words."""
    fields = [(n, "long", pa.int64()) for n in MEASURES]
    return add_by_text(docs, text, fields, _measurer, keep)


def judge(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Add base_failed, host_distrusted and kept to a written table of measured documents.

    A document that fails a base rule goes. On a trusted host all others stay; on a distrusted host
    only those stay that fail no rule at all. The host table is broadcast only if Spark finds its
    files small; else the join is a shuffle whose hot hosts AQE splits. Repeated rows count and are judged each for itself;
    an empty table gives no rows.
    """
    verdicts = host_verdicts(measured, host, limit).select("host", "distrusted")
    rules = failures()
    base = reduce(lambda a, b: a | b, (rules[r] for r in BASE_RULES))
    soft = reduce(lambda a, b: a | b, rules.values())
    joined = measured.join(verdicts, measured[host].eqNullSafe(verdicts["host"]), "left").drop(verdicts["host"])
    return joined.withColumns(
        {
            "base_failed": base,
            "host_distrusted": F.coalesce("distrusted", F.lit(False)),
            "kept": ~base & ~(F.coalesce("distrusted", F.lit(False)) & soft),
        }
    ).drop("distrusted")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    shadow = {c: f"in_{c}" for c in docs.columns}  # the caller's names may clash with the measures
    measured = cut_lineage(with_measures(docs.withColumnsRenamed(shadow), shadow["text"]), "measured")
    kept = judge(measured, shadow[host]).filter("kept")
    return kept.select(*(F.col(f"`{b}`").alias(a) for a, b in shadow.items()))
