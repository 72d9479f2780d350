"""Sharding by sampled splitters.

Records are drawn with a chance in proportion to their size; quantiles of the drawn keys are the
splitters that range-partition all records. Ranges that turn out overfull are subdivided by a second
key. Exact totals of the ranges then place the shard boundaries to the record.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import with_offsets
from stratapanel.llm.packing import in_ranges
from stratapanel.sources.scratch import cut_lineage

#: Ranges for each shard, and records drawn for each range (on average); both bound what the driver sees.
RANGES_PER_SHARD = 32
DRAWN_PER_RANGE = 16
#: A range above this many times the mean size is subdivided.
OVERFULL = 2.0


def splitters(records: DataFrame, key: str, size: str, ranges: int, drawn: int = DRAWN_PER_RANGE) -> list[int]:
    """Boundaries between ``ranges`` key ranges of about equal size, from a size-weighted draw.

    A record is drawn when a hash of its keys falls below size x wanted / total: about ``ranges *
    drawn`` records, whatever the table's size. A record at least as large as a whole share is always drawn,
    and counts as often as its size says.
    """
    total = records.agg(F.sum(size)).first()[0] or 0
    wanted = ranges * drawn
    if not total:
        return []
    share = F.col(size) * F.lit(wanted / total)
    chance = F.pmod(F.xxhash64(key, "tie", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    weight = F.floor(share) + (chance < share - F.floor(share)).cast("long")
    sample = records.select(F.col(key).alias("k"), weight.alias("w")).filter("w > 0").collect()
    keys = sorted(r.k for r in sample for _ in range(r.w))
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    # a key that is more than one quantile fills a range by itself, so only it gets subdivided
    alone = {a + 1 for a, b in itertools.pairwise(cuts) if a == b}
    return sorted({*cuts, *alone})


def shard_by_size(
    docs: DataFrame, n_shards: int, key: Column, size: Column, keep: list[str], per_shard: int = RANGES_PER_SHARD
) -> DataFrame:
    """Give every record of ``docs`` a shard and a slot so that the shards' sizes are near equal.

    ``key`` is a long; records are laid out in its order (inside overfull ranges in the order of the
    hashed id), so records with equal keys lie together as far as sizes allow. A record goes to the shard that its middle byte
    falls into, so shards differ from the mean by less than one record. Adds size, shard and slot to the
    columns in ``keep``.
    """
    records = docs.select(*keep, size.cast("long").alias("size"), key.cast("long").alias("key"))
    records = cut_lineage(records.withColumn("tie", F.xxhash64(F.lit("tie"), *keep)), "records")
    ranges = n_shards * per_shard
    total = records.agg(F.sum("size")).first()[0] or 0
    ranged = in_ranges(records, "key", splitters(records, "key", "size", ranges), "range")
    parts = [
        (r["range"], int(r["bytes"] * ranges / total) + 1)
        for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()
        if r["bytes"] * ranges > OVERFULL * total
    ]
    split = F.lit(1)
    if parts:
        by_range = F.create_map(*(F.lit(x) for p in parts for x in p))
        split = F.coalesce(F.try_element_at(by_range, F.col("range")), F.lit(1))
    # the hashed id is spread evenly, so equal cuts of it subdivide any overfull range
    unit = F.shiftrightunsigned("tie", 33)
    ranged = ranged.withColumn("sub", F.shiftrightunsigned(unit * split, 31).cast("int"))
    ranged = ranged.withColumns({"one": F.lit(1)})
    order = [F.col("key"), F.col("tie"), *(F.col(c) for c in keep)]
    placed = with_offsets(ranged, ["range", "sub"], order, {"bytes_before": "size", "rows_before": "one"})
    middle = F.col("bytes_before") + F.col("size") / 2
    shard = F.least(F.floor(middle * n_shards / F.lit(float(max(total, 1)))), F.lit(n_shards - 1)).cast("int")
    placed = cut_lineage(placed.select(*keep, "size", "rows_before", shard.alias("shard")), "placed")
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("rows_before").alias("first"))
    starts = {r["s"]: r["first"] for r in first.collect()}
    start = F.create_map(*(F.lit(x) for p in starts.items() for x in p)) if starts else F.create_map(F.lit(0), F.lit(0))
    return placed.select(*keep, "size", "shard", (F.col("rows_before") - F.try_element_at(start, F.col("shard"))).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """All documents in ``n_shards`` shards of near equal bytes; equal texts lie together.

    Size is the text's UTF-8 bytes (null: none) plus 16. Returns doc_id, size, text_crc32, law,
    shard, slot (gapless from 0 in each shard) and grown_shard (null: this law has none). Repeated rows
    are placed each for itself, rows with a null doc_id too. An empty table gives no rows.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("text_hash"), F.octet_length(data).alias("n_bytes"))
    out = shard_by_size(rows, n_shards, F.col("text_hash"), F.col("n_bytes") + 16, ["doc_id", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
