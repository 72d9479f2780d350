"""Importance resampling towards a target distribution.

Word n-grams are hashed into buckets. A bucket's gain is the log-ratio of its share in the target to
its share in the documents; a document's weight is the mean gain of its features, scored from its
array of buckets. Gumbel noise on the weights turns "the highest scores" into a draw without
replacement. The last drawn key is found by quickselect: random keys of the rows that are left serve as
pivots, one pass counts the rows below, at and above each exactly, and the rows between two pivots
go on. Only the rows at or above that key are ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import add_by_text, with_offsets
from stratapanel.sources.scratch import cut_lineage

#: Words of lower-cased UTF-8 text: ASCII digits and letters and all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
NGRAMS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Random pivots in one pass over the rows that are left.
PIVOTS = 24


def buckets_of(text: bytes, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each feature of a text, repeats included."""
    words = WORD.findall(text.lower())  # lowers A-Z only
    found = list(map(zlib.crc32, words))
    for n in range(2, ngrams + 1):
        found += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return (np.array(found, dtype=np.int64) % buckets).astype("<u4")


def with_buckets(df: DataFrame, text: str, keep: Sequence[str], ngrams: int, buckets: int) -> DataFrame:
    """(kept columns, n_features, n_words, buckets): the buckets as little-endian 32-bit numbers."""
    def make() -> Callable[[list[bytes]], list]:
        def compute(texts: list[bytes]) -> list:
            found = [buckets_of(t, ngrams, buckets) for t in texts]
            n = [len(f) for f in found]
            words = n if ngrams == 1 else [len(WORD.findall(t.lower())) for t in texts]
            return [n, words, [f.tobytes() for f in found]]

        return compute

    fields = [("n_features", "long", pa.int64()), ("n_words", "long", pa.int64()), ("buckets", "binary", pa.binary())]
    return add_by_text(df, text, fields, make, keep=keep)


def bucket_totals(df: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. Tasks add up their own, so at most ``buckets`` rows leave a task."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, dtype="<u4"), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    partial = df.select("buckets").mapInArrow(add_up, "bucket long, n long")
    totals = np.zeros(buckets, dtype=np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket
        totals[r["bucket"]] = r["n"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target to that in the source, one added to each count."""
    k = len(source)
    all_s, all_t = float(source.sum() + k), float(target.sum() + k)
    ratio = [((t + 1) * all_s) / ((s + 1) * all_t) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def _weigh(gain: np.ndarray, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw, dtype="<u4") for raw in batch.column(batch.num_columns - 1).to_pylist()]
            weight = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())], names=[*names, "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number fixed by the seed and the id; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _after(low: Sequence, row: Sequence[Column]) -> Column:
    """Whether a row's key comes after a given one."""
    found = F.lit(False)
    for value, column in reversed(list(zip(low, row, strict=True))):
        found = (column > F.lit(value)) | ((column == F.lit(value)) & found)
    return found


def kth_key(df: DataFrame, key: Sequence[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The key of the k-th row (from 1) in ascending order of the ``key`` columns; None: fewer rows.

    Each pass takes the rows left with the smallest hashes as pivots and counts, exactly and in one
    aggregate, how many of them come before, at and after each. The expected number of
    passes is the logarithm of the rows to the base of the pivots.
    """
    names, columns = list(key), [F.col(c) for c in key]
    low: tuple | None = None
    high: tuple | None = None
    before, turn = 0, 0  # rows up to ``low``
    while True:
        left = df.select(*names)
        if low is not None:
            left = left.filter((columns[0] >= F.lit(low[0])) & _after(low, columns))
        if high is not None:
            left = left.filter((columns[0] <= F.lit(high[0])) & ~_after(high, columns) & ~_same(high, columns))
        draw = left.distinct() if turn else left  # later passes: a very common key is one pivot, not all of them
        drawn = draw.orderBy(F.xxhash64(F.lit(turn), *columns), *columns).limit(pivots).collect()
        marks = sorted({tuple(r) for r in drawn})
        if not marks:
            return None
        counts = left.agg(
            *(F.count_if(~_after(m, columns) & ~_same(m, columns)).alias(f"less_{i}") for i, m in enumerate(marks)),
            *(F.count_if(_same(m, columns)).alias(f"same_{i}") for i, m in enumerate(marks)),
        ).first()
        floor = before
        for i, m in enumerate(marks):
            less, same = floor + counts[f"less_{i}"], counts[f"same_{i}"]
            if less < k <= less + same:
                return m
            if k <= less:
                high = m
                break
            low, before = m, less + same
        turn += 1


def _same(mark: Sequence, row: Sequence[Column]) -> Column:
    found = F.lit(True)
    for value, column in zip(mark, row, strict=True):
        found = found & (column == F.lit(value))
    return found


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED, text: str = "text",
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null: not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down, by
    score, then by doc_id, nulls last, then by a hash of the text; rows that are equal in all of these are
    drawn one by one. Null and empty texts have no feature, weight 0, and are not drawn. Long
    texts count whole. An empty table gives an empty one; an empty target leaves only the documents'
    own distribution to weigh against. Other columns are not read.
    """
    tie = F.xxhash64(F.col(f"`{text}`")).alias("tie")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie, F.col(f"`{text}`").alias("text"))
    made = cut_lineage(with_buckets(chosen, "text", ["doc_id", "tie"], ngrams, buckets), "buckets")
    aim = with_buckets(target.select(F.col(f"`{text}`").alias("text")), "text", [], ngrams, buckets)
    gain = gains(bucket_totals(made, buckets), bucket_totals(aim, buckets))
    names = ["doc_id", "tie", "n_features", "n_words"]
    weighed = made.select(*names, "buckets").mapInArrow(
        _weigh(gain, names), "doc_id long, tie long, n_features long, n_words long, weight long"
    )
    scored = cut_lineage(
        weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        # ascending keys: the highest score, then the smallest doc_id, first; a null id after all others
        .withColumn("down", -F.col("score"))
        .withColumn("no_id", F.col("doc_id").isNull().cast("int"))
        .withColumn("id", F.coalesce("doc_id", F.lit(0))),
        "scored",
    )
    able = scored.filter(F.col("n_words") >= least_words)
    key = ["down", "no_id", "id", "tie"]
    n = able.count() * percent // 100
    last = kth_key(able, key, n) if n else None
    columns = [F.col(c) for c in key]
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= least_words) & (F.col("down") <= F.lit(last[0])) & ~_after(last, columns)
    # scores are bounded by the gains and the noise, so there are at most some ten thousand of them
    winners = cut_lineage(scored.filter(won).withColumn("one", F.lit(1)), "winners")
    ranked = with_offsets(winners, ["down"], columns[1:], {"rank": "one"}).withColumn("rank", F.col("rank") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return ranked.select(*out, "rank").unionByName(scored.filter(~won).select(*out, F.lit(None).cast("long").alias("rank")))
