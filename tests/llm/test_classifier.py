import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stratapanel.llm import classifier

SF = "/root/testdata/sf0.01"


def test_held_out_fold(spark):
    got = spark.range(200).select("id", classifier.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels)
    scored = classifier.with_score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    rows = scored.join(labels, "doc_id").filter(classifier.held_out(F.col("doc_id"))).select("score", "quality").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.95
    right = sum(g >= 0.3 for g in good) + sum(b < 0.3 for b in bad)
    assert right / len(rows) > 0.95
    brier = sum((r.score - r.quality) ** 2 for r in rows) / len(rows)
    assert brier < 0.05


def test_training_never_sees_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, _ = classifier.sample_of(docs, labels, 50)
    assert rows and all(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    assert max(sum(q == c for _, q, _ in rows) for c in (0, 1)) <= 50
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert classifier.train(docs, labels, 80) == classifier.train(docs, flipped, 80)


def test_odd_texts_and_columns(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(2)
    text = {q: [" ".join(rng.choice(w) for _ in range(80)) for _ in range(60)] for q, w in ((0, ["spam!!", "BUY", "$$$"]), (1, ["calm", "prose", "here"]))}
    rows = [(10_000 + 2 * i + q, t, q) for q in (0, 1) for i, t in enumerate(text[q])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (9, None)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    got = classifier.with_score(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.text or "", r.score) == r.score
    assert classifier.with_score(no_docs, model).collect() == []
    assert model == classifier.train(docs, labels)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(3, 0)]])
def test_without_both_classes_the_score_is_constant(spark, odd_docs, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    model = classifier.train(odd_docs, frame)
    scores = {round(r.score, 6) for r in classifier.with_score(odd_docs, model).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def brute_inputs(model, text):
    """The curve's two inputs for one text, each piece compressed by a compressor of its own."""
    data = (text or "").encode()
    if not data:
        return 0.0, 0.0
    options = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    pieces = [data[i : i + 2048] for i in range(0, len(data), 2048)]

    def size(**more):
        return sum(len(zstandard.ZstdCompressor(**options, **more).compress(p)) for p in pieces)

    good, bad = (size(dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad))
    return (bad - good) / (bad + good), min(size() / len(data), 1.0)


def brute_terms(model, text):
    a, b = (min(max((x - c) / s, -8), 8) for x, c, s in zip(brute_inputs(model, text), model.centre, model.scale))
    return [1.0, a, b, a * b, a * a, b * b]


def test_scores_and_curve_against_brute_force(spark, odd_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.train(docs, labels, 60)
    texts = odd_docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    for r in classifier.with_score(texts, model).collect()[:400]:
        at = sum(w * x for w, x in zip(model.weights, brute_terms(model, r.text)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-at)), rel=1e-9)
    # at the fitted weights the weighted likelihood, less half their squares, has no slope
    rows, rate = classifier.sample_of(docs, labels, 60)
    curve = [(t.decode(), q) for c in (0, 1) for t, q in [(t, q) for _, q, t in rows if q == c and t][1::2]]
    share = sum(q for _, q in curve) / len(curve)
    slope = -np.array(model.weights)
    for text, q in curve:
        x = np.array(brute_terms(model, text))
        p = 1 / (1 + math.exp(-float(x @ np.array(model.weights))))
        slope += (rate / share if q else (1 - rate) / (1 - share)) * (q - p) * x
    assert np.abs(slope).max() < 1e-6
