"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text that shares
patterns with one side compresses better with that side's dictionary; the difference of the two
sizes, by their sum, is the raw score, and a logistic curve fitted on other labelled texts turns it
into a probability of being good.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import add_by_text

#: Labelled texts drawn for each class: half of them make the dictionary, half the curve.
SAMPLE_PER_CLASS = 1500
DICTIONARY_BYTES = 112_640
#: Texts are compressed in pieces of this size, so that a dictionary counts as much at the end of a
#: long text as in a short one.
PIECE_BYTES = 2048
LEVEL = 3
FOLDS = 5
#: Documents with at least this score count as good.
KEEP_FROM = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class CompressionModel:
    """What scoring needs; a few hundred kB whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    plain = zstandard.ZstdCompressor(**options)
    kinds = []
    for content in (good, bad):
        data = zstandard.ZstdCompressionDict(content)
        data.precompute_compress(level=LEVEL)
        kinds.append(zstandard.ZstdCompressor(dict_data=data, **options))
    return (*kinds, plain)


def _sizes(text: bytes, kinds: Sequence[zstandard.ZstdCompressor]) -> list[int]:
    pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
    return [sum(len(kind.compress(p)) for p in pieces) for kind in kinds]


def _features(text: bytes, kinds: Sequence[zstandard.ZstdCompressor]) -> tuple[float, float]:
    """The normalised difference, and how far the text compresses by itself; zeros for no text."""
    if not text:
        return 0.0, 0.0
    good, bad, plain = _sizes(text, kinds)
    return (bad - good) / (bad + good), min(plain / len(text), 1.0)


def _expand(raw: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((raw - centre) / scale, -8.0, 8.0)
    return np.column_stack([np.ones(len(z)), z, z[:, 0] * z[:, 1], z * z])


def _fit_curve(raw: np.ndarray, label: np.ndarray, rate: float) -> tuple[np.ndarray, ...]:
    """Logistic curve by Newton steps with a small ridge; rows weigh as in the labelled corpus."""
    centre, scale = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-9)
    x = _expand(raw, centre, scale)
    share = max(label.mean(), 1e-9)
    weight = np.where(label == 1, rate / share, (1 - rate) / max(1 - share, 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (label - p)) - w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w, centre, scale


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; for too little text, the text itself serves as one."""
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES] or b"\n" * 8


def sample_of(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list, float]:
    """At most ``per_class`` labelled texts of each class from the learning folds, and the good share.

    The draw is by hash of doc_id, so it is the same in every run. Labels are chosen before any
    text is read; the chosen ids (at most twice ``per_class``) are what is broadcast.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rate = usable.agg(F.avg("quality")).first()[0]
    order = F.xxhash64("doc_id", F.lit("classifier-sample"))
    chosen = [
        usable.filter(F.col("quality") == q).groupBy("doc_id", "quality").count().orderBy(order, "doc_id")
        .limit(per_class).select(F.col("doc_id").alias("chosen_id"), "quality")
        for q in (0, 1)
    ]
    picked = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        picked, F.col("doc_id") == F.col("chosen_id")
    ).select("doc_id", "text", "quality").collect()
    return sorted((r.doc_id, r.quality, r.text.encode()) for r in rows), rate


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> CompressionModel:
    """Fit dictionaries and curve on the bounded sample. Without both classes, scores are the good share."""
    rows, rate = sample_of(docs, labels, per_class)
    by_class = [[t for _, q, t in rows if q == c and t] for c in (0, 1)]
    build = [x[0::2] for x in by_class]
    curve = [x[1::2] for x in by_class]
    if not all(build) or not all(curve):
        share = min(max(rate if rate is not None else 0.5, 1e-6), 1 - 1e-6)
        return CompressionModel(b"\n" * 8, b"\n" * 8, (float(np.log(share / (1 - share))), *([0.0] * 5)), (0.0, 0.0), (1.0, 1.0))
    bad, good = _dictionary(build[0]), _dictionary(build[1])
    kinds = _compressors(good, bad)
    raw = np.array([_features(t, kinds) for c in (0, 1) for t in curve[c]])
    label = np.repeat([0, 1], [len(curve[0]), len(curve[1])])
    w, centre, scale = _fit_curve(raw, label, rate)
    return CompressionModel(good, bad, tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, scale)))


def score_texts(model: CompressionModel) -> Callable[[list[bytes]], list[np.ndarray]]:
    """A function from texts to their scores, 0 to 1."""
    kinds = _compressors(model.good, model.bad)
    w, centre, scale = (np.array(x) for x in (model.weights, model.centre, model.scale))

    def score(texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return [np.zeros(0)]
        raw = np.array([_features(t, kinds) for t in texts])
        return [1 / (1 + np.exp(-np.clip(_expand(raw, centre, scale) @ w, -30, 30)))]

    return score


def with_score(
    docs: DataFrame, model: CompressionModel, text: str = "text", out: str = "score", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the score of every whole text. The model travels to the tasks with the function.

    Only the text is looked at: rows with a null doc_id and repeated rows have scores like any other, a null text that
    of an empty one. An empty table gives no rows.
    """
    return add_by_text(docs, text, [(out, "double", pa.float64())], lambda: score_texts(model), keep)
