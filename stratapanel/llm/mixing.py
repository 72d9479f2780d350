"""Mixing sources by temperature.

The weight of a source is its token share to the power of an exponent, normalised. The exponent is
bisected to the largest (nearest to the natural shares) that reaches a target entropy, or to the smallest that keeps within a repetition
limit. Weights become token budgets, and every source fills its budget with passes over its
documents, each pass a new permutation of blocks and of the documents inside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import bucket_count, n_words, with_offsets
from stratapanel.sources.scratch import cut_lineage

#: Points looked at in one pass over the sources, and passes: the exponent is found to 17^-6.
POINTS, PASSES = 16, 6


def _entropy(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy (nats) of the weights at each exponent, in one aggregation over the sources."""
    sums = []
    for i, e in enumerate(exponents):
        p = F.pow("share", F.lit(e))
        sums += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log("share")).alias(f"s{i}")]
    row = shares.agg(*sums).first()
    return [math.log(row[f"z{i}"]) - e * row[f"s{i}"] / row[f"z{i}"] for i, e in enumerate(exponents)]


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None) -> float:
    """The exponent in [0, 1] for the shares of a written table (one row for each source).

    With a target entropy (as a part of the greatest possible one) it is the largest exponent that
    reaches it; entropy falls as the exponent grows. With a repetition limit, no source may
    repeat more than ``max_repeat`` times as often as the largest one: the smallest exponent that
    allows it. With both, the limit has the last word. Sections are cut into ``POINTS`` in each
    round, which bisects several times in one job.
    """
    row = shares.agg(F.min("share").alias("low"), F.max("share").alias("high"), F.count("*").alias("n")).first()
    if not row["n"] or row["low"] == row["high"]:
        return 1.0

    def search(good: list[bool], points: list[float]) -> tuple[float, float]:
        last = max(i for i, g in enumerate(good) if g)
        return points[last], points[min(last + 1, len(points) - 1)]

    found = 1.0
    if target_entropy is not None:
        want = target_entropy * math.log(row["n"])
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
            reached = [h >= want - 1e-12 for h in _entropy(shares, points)]
            low, high = search([True, *reached[1:]], points)
        found = low
    if max_repeat is not None:
        spread = math.log(row["high"] / row["low"])
        low, high = found if target_entropy is not None else 0.0, 1.0
        if (1 - low) * spread <= math.log(max_repeat):
            return low
        while high - low > 1e-12:
            middle = (low + high) / 2
            low, high = (low, middle) if (1 - middle) * spread <= math.log(max_repeat) else (middle, high)
        found = high
    return found


def weigh(tokens: DataFrame, target_entropy: float | None, max_repeat: float | None) -> DataFrame:
    """(source, docs, tokens, share, weight, repeats) for every source of (source, tokens) rows.

    The budget of the whole mix is the least that shows every document at least once: ``repeats`` is
    1 for the source whose weight is smallest against its share. Documents without tokens count as one token.
    """
    by_source = tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    by_source = cut_lineage(by_source, "sources")
    total = by_source.agg(F.sum("tokens")).first()[0] or 1
    shares = by_source.withColumn("share", F.col("tokens") / F.lit(float(total)))
    e = exponent(shares, target_entropy, max_repeat)
    powered = shares.withColumn("raised", F.pow("share", F.lit(e)))
    row = powered.agg(F.sum("raised").alias("z"), F.min(F.col("raised") / F.col("share")).alias("least")).first()
    z, least = row["z"] or 1.0, row["least"] or 1.0
    return cut_lineage(
        powered.select(
            "source", "docs", "tokens", "share", (F.col("raised") / F.lit(z)).alias("weight"),
            F.round(F.col("raised") / F.col("share") / F.lit(least), 9).alias("repeats"),
        ),
        "source-weights",
    )


def mix(
    docs: DataFrame, tokens: Column, target_entropy: float | None = None, max_repeat: float | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every document as often as its source's budget takes it, in the order of the mix.

    A source with ``repeats`` r makes floor(r) whole passes and a part of one more: documents of the last pass
    are taken while the tokens before them are inside the budget. In each pass the source's documents are
    dealt into blocks by hash and ordered by another hash inside; both change with the pass. ``position`` in [0, 1) is
    the part of its source's budget that comes before a row, so sorting by it gives every stretch of
    the mix its sources in proportion to their weights.

    A null source is a source of its own, and so is a sole one, with repeats 1; repeated rows are used each for
    itself, rows with a null doc_id too. A text without tokens counts as one token. An empty table gives no rows.
    Returns doc_id, source, tokens, pass_no, block, tokens_before, weight, repeats, position and the columns in
    ``carry``; a carried column takes the place of the mix's own one of its name.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "source")]
    kept = {f"carried_{i}": c for i, c in enumerate(carry)}
    rows = docs.select(
        "doc_id", "source", F.greatest(tokens, F.lit(1)).cast("long").alias("tokens"),
        F.xxhash64("doc_id", *([F.col("text")] if "text" in docs.columns else [])).alias("ident"),
        *(F.col(f"`{c}`").alias(k) for k, c in kept.items()),
    )
    rows = cut_lineage(rows, "mix-rows")
    weights = weigh(rows.select("source", "tokens"), target_entropy, max_repeat)
    facts = weights.select(
        F.col("source").alias("w_source"), F.col("docs"), F.col("tokens").alias("w_tokens"), "weight", "repeats"
    )
    n_rows = weights.agg(F.sum("docs")).first()[0] or 0
    per_block = max(1, n_rows // bucket_count(n_rows))
    known = rows.join(facts, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    passes = F.sequence(F.lit(0), (F.ceil("repeats") - 1).cast("int"))
    shown = known.withColumn("pass_no", F.explode(passes))
    blocks = F.ceil(F.col("docs") / F.lit(per_block))
    shown = shown.withColumns(
        {
            "block": F.pmod(F.xxhash64("ident", "pass_no", F.lit("block")), blocks).cast("int"),
            "turn": F.xxhash64("ident", "pass_no", F.lit("turn")),
        }
    )
    slim = shown.select("doc_id", "source", "ident", "tokens", "pass_no", "block", "turn", *kept, "w_tokens", "weight", "repeats")
    w_order = [F.col("turn"), F.col("doc_id"), F.col("tokens")]
    placed = with_offsets(slim, ["source", "pass_no", "block"], w_order, {"in_pass": "tokens"}, restart=2)
    before = F.col("in_pass") + F.col("pass_no") * F.col("w_tokens")
    budget = F.col("repeats") * F.col("w_tokens")
    own = ("doc_id", "source", "tokens", "pass_no", "block", "tokens_before", "weight", "repeats", "position")
    return (
        placed.withColumn("tokens_before", before)
        .filter(F.col("tokens_before") < budget)
        .withColumn("position", F.col("tokens_before") / budget)
        .select(*(c for c in own if c not in carry), *(F.col(k).alias(c) for k, c in kept.items()))
    )


def text_tokens(text: Column) -> Column:
    """Tokens of a text as the mix counts them: words."""
    return n_words(text)
