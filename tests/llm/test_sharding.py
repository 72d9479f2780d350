import zlib

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import sharding


def check(rows, sizes, n):
    """Sizes near equal, slots gapless."""
    total, widest = sum(sizes), max(sizes)
    load, slots = [0] * n, {}
    for r in rows:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(x - total / n) <= widest for x in load)
    return load


def test_documents_by_bytes(odd_docs, odd_rows, no_docs):
    got = sharding.shard_documents(odd_docs, 5).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    check(got, [w[2] for w in want], 5)
    assert sharding.shard_documents(no_docs, 5).collect() == []


def test_copies_lie_together_unless_they_overfill(spark):
    rows = [(i, "the same text " * 5) for i in range(3000)] + [(5000 + i, f"text {i // 3} " * 7) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(docs, 10).collect()
    load = check(got, [len(t) + 16 for _, t in rows], 10)
    assert max(load) - min(load) < 200
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    hot = homes.pop(zlib.crc32(("the same text " * 5).encode()))
    assert len(hot) >= 3  # a third of all rows fills several shards
    assert sum(len(h) > 1 for h in homes.values()) <= 9


def test_one_hot_key_is_subdivided(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(7).alias("k"))
    out = sharding.shard_by_size(df, 8, F.col("k"), F.lit(10), ["doc_id"]).groupBy("shard").count().collect()
    assert {r["count"] for r in out} == {2500}


def test_heavy_records_weigh_in_the_draw(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 10, 10_000).otherwise(1).alias("size"), F.xxhash64("id").alias("tie"))
    cuts = sharding.splitters(df, "key", "size", 10)
    assert cuts and all(c < 20 for c in cuts)


def brute_shards(rows, n):
    """(id, size, crc, key, tie) rows laid out by one walk through the sorted list."""
    ranges, total = n * sharding.RANGES_PER_SHARD, sum(r[1] for r in rows)
    wanted = ranges * sharding.DRAWN_PER_RANGE
    drawn = []
    for *_, size, _, key, _, chance in rows:
        share = size * (wanted / total)
        drawn += [key] * (int(share) + (chance / 2**40 < share - int(share)))
    drawn.sort()
    cuts = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)]
    cuts = sorted({*cuts, *(a + 1 for a, b in zip(cuts, cuts[1:]) if a == b)})
    homes = [sum(c <= r[3] for c in cuts) for r in rows]
    load = {}
    for h, r in zip(homes, rows):
        load[h] = load.get(h, 0) + r[1]
    split = {h: x * ranges // total + 1 if x * ranges > sharding.OVERFULL * total else 1 for h, x in load.items()}
    line = sorted(
        (h, ((r[4] % 2**64 >> 33) * split[h]) >> 31, r[3], r[4], (r[0] is not None, r[0] or 0), r[2], r[1]) for h, r in zip(homes, rows)
    )
    out, before, slots = [], 0, {}
    for *_, doc, crc, size in line:
        shard = min(int((before + size / 2) * n / total), n - 1)
        slot = slots[shard] = slots.get(shard, -1) + 1
        out.append((doc[1] if doc[0] else None, size, crc, shard, slot))
        before += size
    return out


@pytest.mark.parametrize("n", [3, 40])
def test_layout_against_brute_force(spark, odd_docs, n):
    hot = spark.range(400).select((F.col("id") + 9000).alias("doc_id"), F.lit("the hot text " * 9).alias("text"))
    docs = odd_docs.select("doc_id", "text").unionByName(hot)
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    facts = docs.select("doc_id", (F.octet_length(data) + 16).alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("key"))
    facts = facts.withColumn("tie", F.xxhash64(F.lit("tie"), "doc_id", "text_crc32"))
    facts = facts.withColumn("chance", F.pmod(F.xxhash64("key", "tie", F.lit("draw")), F.lit(1 << 40)))
    want = brute_shards([tuple(r) for r in facts.collect()], n)
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs, n).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_names_of_the_operators_own_columns_in_the_input(spark, odd_docs):
    clash = odd_docs.withColumns({c: F.lit(c) for c in ("size", "shard", "slot", "range", "sub", "key", "tie", "law", "one")})
    rows = [sorted(map(repr, sharding.shard_documents(d, 5).collect())) for d in (odd_docs, clash)]
    assert rows[0] == rows[1]
