"""What several operators share: table access, word rules, exact running totals, salted look-ups."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, newline, vertical tab, form feed and
#: carriage return. ``bytes.split()`` of the UTF-8 text gives the same words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t\n\x0B\f\r]+"

#: Rows a Python task works on at a time; bounds its memory whatever Arrow's batch size is.
SLICE_ROWS = 256
#: Bytes of text that a Python task works on at a time, in at most so many rows; one row may be longer.
TEXT_BYTES, TEXT_ROWS = 2 << 20, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def n_words(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def unused(name: str, df: DataFrame) -> str:
    """A working column name that the caller's table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``SLICE_ROWS``."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def by_bytes(batch: pa.RecordBatch, column: int = -1) -> Iterator[pa.RecordBatch]:
    """A batch in slices that hold ``TEXT_BYTES`` of a binary column, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, before + TEXT_BYTES, side="right"))
        n = min(max(end - at, 1), TEXT_ROWS)
        yield batch.slice(at, n)
        at += n


def add_by_text(
    df: DataFrame,
    text: str,
    fields: Sequence[tuple[str, str, pa.DataType]],
    make: Callable[[], Callable[[list[bytes]], Sequence[Sequence]]],
    keep: Sequence[str] | None = None,
    cut: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] = by_rows,
) -> DataFrame:
    """Add columns that a Python function computes from whole texts, in bounded slices.

    ``fields`` lists (name, Spark type, Arrow type); a field replaces a column of its name.
    ``make`` runs once in each task and returns a function from texts (UTF-8 bytes, null: empty)
    to one sequence of values per field. ``cut`` makes the slices. The text column travels with the row only when kept.
    """
    names = [name for name, _, _ in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    sent = unused("text_for_python", df)
    types = dict(df.dtypes)
    schema = ", ".join(
        [f"`{c.replace('`', '``')}` {types[c]}" for c in keep] + [f"`{n}` {t}" for n, t, _ in fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in cut(batch):
                texts = part.column(part.num_columns - 1).to_pylist()
                made = compute([x or b"" for x in texts])
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(v, type=t) for v, (_, _, t) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    column = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), column.alias(sent))
    return chosen.mapInArrow(run, schema)


def bucket_count(rows: int, per_bucket: int = 20_000, least: int = 2048, most: int = 262_144) -> int:
    """How many ordered buckets a table is cut into; ``most`` bounds what the driver gets to see."""
    return max(least, min(most, rows // per_bucket))


def with_offsets(
    df: DataFrame, bucket: Sequence[str], order: Sequence[Column], sums: dict[str, str], restart: int = 0
) -> DataFrame:
    """Exact running totals over a whole table in the order of (bucket, order).

    ``df`` must be a written table whose ``bucket`` columns cut it into a bounded number of ordered
    ranges. Totals per bucket, one row each, go to the driver, are added up and come back by a
    broadcast join; inside a bucket a window adds up. ``sums`` maps the name of a new column to
    the summed one; it gets the total of all rows before. Totals start anew whenever one of the
    first ``restart`` bucket columns changes.
    """
    names = list(sums)
    if not names:
        return df
    stats = df.groupBy(*bucket).agg(*(F.sum(sums[n]).alias(f"total_{n}") for n in names)).collect()
    stats.sort(key=lambda r: tuple((r[b] is None, r[b]) for b in bucket))
    rows = []
    for _, group in itertools.groupby(stats, key=lambda r: tuple(r[b] for b in bucket[:restart])):
        before = [0] * len(names)
        for r in group:
            rows.append((*(r[b] for b in bucket), *before))
            before = [a + (r[f"total_{n}"] or 0) for a, n in zip(before, names, strict=True)]
    types = dict(df.dtypes)
    keys = [f"offset_{b}" for b in bucket]
    schema = ", ".join([f"`{k}` {types[b]}" for k, b in zip(keys, bucket, strict=True)] + [f"`start_{n}` long" for n in names])
    starts = df.sparkSession.createDataFrame(rows, schema)
    w = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({n: F.coalesce(F.sum(sums[n]).over(w), F.lit(0)) for n in names})
    on = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(bucket, keys, strict=True)]
    joined = inside.join(F.broadcast(starts), on, "left")
    return joined.withColumns({n: F.col(n) + F.col(f"start_{n}") for n in names}).drop(
        *keys, *(f"start_{n}" for n in names)
    )


def salted_lookup(
    left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Join a table whose keys may be very uneven to one with a row for each key.

    The right side is repeated ``salts`` times, the left side's rows of one key are dealt over the
    salts by ``spread``, so no task gets more than a share of a hot key. Null keys meet null keys.
    """
    name = f"right_{key}"
    right = right.withColumnRenamed(key, name).withColumn(
        "salt_right", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    left = left.withColumn("salt_left", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    on = [F.col(key).eqNullSafe(F.col(name)), F.col("salt_left") == F.col("salt_right")]
    return left.join(right, on, how).drop(name, "salt_left", "salt_right")
