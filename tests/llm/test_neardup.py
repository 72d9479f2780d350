import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stratapanel.llm import neardup


def brute_hash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    """fp -> one fingerprint of its group."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute_groups(rows):
    """fp -> smallest doc_id reachable from it."""
    root = brute_roots(f for _, f in rows)
    first = {}
    for d, f in rows:
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    return {f: first.get(r) for f, r in root.items()}


def test_fingerprints_and_groups(odd_docs, odd_rows, no_docs):
    rows = [(i, brute_hash(t or "")) for i, t in odd_rows]
    groups = brute_groups(rows)
    got = neardup.near_duplicates(odd_docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(
        ((d, f"{f:016x}", groups[f]) for d, f in rows), key=key
    )
    assert neardup.near_duplicates(no_docs).collect() == []


def test_one_of_each_group_stays(odd_docs, odd_rows, no_docs):
    rows = [(i, brute_hash(t or "")) for i, t in odd_rows]
    groups = brute_groups(rows)
    kept = neardup.keep_one(odd_docs)
    assert kept.dtypes == odd_docs.dtypes
    got = [(r.doc_id, brute_hash(r.text or "")) for r in kept.collect()]
    root = brute_roots(f for _, f in rows)
    assert sorted(root[f] for _, f in got) == sorted(set(root.values()))
    assert all(d == groups[f] for d, f in got)
    assert neardup.keep_one(no_docs).collect() == []


def planted(rng, n, clusters):
    fps = [rng.getrandbits(64) for _ in range(n)]
    for size in clusters:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = rng.choice([centre, rng.choice(fps[-5:])])
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            fps.append(x)
    return sorted(set(fps))


def run(spark, fps, **how):
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = neardup.fingerprint_groups(df, F.col("doc_id"), **how).collect()
    return {r.fp & (2**64 - 1): r["first"] for r in got}


def test_search_is_exact_with_any_number_of_bands_and_overfull_leaves(spark):
    fps = planted(random.Random(1), 400, (2, 3, 30, 120))
    want = brute_groups(list(enumerate(fps)))
    for how in ({}, {"agree": 2}, {"agree": 3, "leaf": 16}, {"agree": 1, "leaf": 8}):
        assert run(spark, fps, **how) == want, how


def test_long_chains_join(spark):
    rng = random.Random(3)
    x, fps = rng.getrandbits(64), []
    for i in range(150):
        fps.append(x)
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    rng.shuffle(fps)
    assert run(spark, fps) == brute_groups(list(enumerate(fps)))


def test_bands_grow_with_the_table():
    assert neardup.bands_to_agree(1000) == 1
    many = [neardup.bands_to_agree(10**k) for k in range(3, 12)]
    assert many == sorted(many) and many[-1] >= 3


def test_links_of_a_dense_cell_are_a_forest():
    fp = np.arange(16, dtype=np.int64)
    a, b = neardup.link_sorted(np.zeros(16, dtype=np.int64), fp)
    assert len(a) == 15 and set(b) == {0}
