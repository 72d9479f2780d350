import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import Row

from stratapanel.llm import queries, resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, ngrams, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, percent=10, least=20, ngrams=1, buckets=10_000):
    """doc_id, n_features, weight, score, rank of every row, by sorting all."""
    made = [(i, t, *features(t, ngrams, buckets)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for *_, f in made:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x, ngrams, buckets)[1]:
            t[b] += 1
    all_s, all_t = sum(s), sum(t)
    rows = []
    for i, x, words, f in made:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, words, x])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("percent", "ngrams", "buckets"), [(10, 1, 10_000), (50, 2, 97), (100, 1, 5)])
def test_agrees_with_brute_force(spark, odd_docs, odd_rows, percent, ngrams, buckets):
    aim = ["ther on ised", None, "", "ÉÀat " * 30]
    target = spark.createDataFrame([Row(text=t, doc_id="clash", weight=1, buckets="x") for t in aim])
    got = resampling.resample(odd_docs, target, percent=percent, ngrams=ngrams, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert plain(got.collect()) == plain(brute(odd_rows, aim, percent, 20, ngrams, buckets))


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert plain(queries.op12_target_resampling(spark, SF).collect()) == plain(brute(docs, target))


def test_empty_tables_and_repeated_rows(spark, odd_docs, no_docs):
    some = spark.createDataFrame([Row(text="ther on")])
    assert resampling.resample(no_docs, some).count() == 0
    assert resampling.resample(odd_docs, some.filter("false")).count() == odd_docs.count()
    text = "word " * 25
    same = spark.createDataFrame([Row(doc_id=k // 5, text=text) for k in range(40)])  # each row five times
    got = resampling.resample(same, some, percent=30).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 13))
    assert plain((r["doc_id"], r["score"]) for r in got if r["rank"]) == plain(
        sorted(((r["doc_id"], r["score"]) for r in got), key=lambda r: (-r[1], r[0]))[:12]
    )


def test_kth_key_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, rng.randint(-9, 9)]), rng.randint(0, 40)) for _ in range(900)]
    df = spark.createDataFrame(rows, "a long, b long")
    for k in (1, 2, 333, 450, 899, 900):
        assert resampling.kth_key(df, ["a", "b"], k, pivots=3) == sorted(rows)[k - 1]
    assert resampling.kth_key(df, ["a", "b"], 901, pivots=3) is None
    assert resampling.kth_key(df.filter("false"), ["a"], 1) is None
