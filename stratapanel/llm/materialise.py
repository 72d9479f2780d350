"""Training-order materialisation: token sequences written in the order a training run reads them.

Documents are encoded and cut into sequences of one length. A keyed Feistel permutation of the
sequence numbers gives every sequence its slot in the training order. Ranges of slots are written
as shards of fixed-stride records, so a run that stopped at slot s resumes with one seek.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import SLICE_ROWS, by_bytes
from stratapanel.llm.tokens import word_encoder
from stratapanel.sources.scratch import cut_lineage, new_path

SEQUENCE = 2048
END_ID = 49_407
#: Sequences in a shard: 16 MB at 2 bytes an id. What a writing task holds is one record.
PER_SHARD = 4096
ROUNDS = 4


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Permute 0 .. size - 1. Values that leave the range walk on along their cycle until they are back."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(_scramble(np.array([r + 1], dtype=np.uint64), key & (2**64 - 1))[0]) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_scramble(right, k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def slot_of(index: Column, size: int, key: int) -> Column:
    """The slot of a sequence number as a column."""
    @F.pandas_udf("long")
    def permute(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), size, key))

    return permute(index)


_SEQUENCES = (
    "task int, number long, n_tokens long, packed binary, "
    "pieces array<struct<doc_id: bigint, start: bigint, length: bigint>>"
)
_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def _streamer(path: str, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        squeeze = zstandard.ZstdCompressor(level=3)
        task, number = TaskContext.get().partitionId(), 0
        end = np.uint16(END_ID).tobytes()
        waiting, pieces, held = [], [], 0

        def close() -> tuple[list[bytes], list[dict], int]:
            return squeeze.compress(b"".join(waiting)), pieces, held

        def out(done: list) -> pa.RecordBatch:
            nonlocal number
            n = len(done)
            columns = [
                pa.array([task] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()),
                pa.array([d[2] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary()),
                pa.array([d[1] for d in done], _PIECES),
            ]
            number += n
            return pa.RecordBatch.from_arrays(columns, names=["task", "number", "n_tokens", "packed", "pieces"])

        for whole in batches:
            for batch in by_bytes(whole):
                done = []
                texts = [x or b"" for x in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids, start = ids + end, 0
                    total = len(ids) // 2
                    while start < total:
                        n = min(length - held, total - start)
                        waiting.append(ids[2 * start : 2 * (start + n)])
                        pieces.append({"doc_id": doc, "start": start, "length": n})
                        start, held = start + n, held + n
                        if held == length:
                            done.append(close())
                            waiting, pieces, held = [], [], 0
                if done:
                    yield out(done)
        if held:
            yield out([close()])

    return run


def sequences(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE) -> DataFrame:
    """Cut the stream of each task's documents into sequences; only a task's last one is short.

    Returns a written table: task and number (gapless from 0 in a task) name a sequence; packed has its
    16-bit ids compressed; pieces say which part of which document it holds. A null text
    is an empty one; every document ends with ``END_ID``.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("data"))
    return cut_lineage(chosen.mapInArrow(_streamer(tokenizer_path, length), _SEQUENCES), "sequences")


def _writer(root: str, length: int, per_shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["slot", "shard", "record", "n_tokens", "ids_crc32", "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        expand = zstandard.ZstdDecompressor()
        attempt = TaskContext.get().taskAttemptId()
        pad = np.uint16(END_ID).tobytes()
        sink, open_shard = None, None

        def finish() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{base}/.{open_shard:08d}.{attempt}", f"{base}/{open_shard:08d}.bin")

        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                slots, n_tokens = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sums = []
                for slot, packed in zip(slots, batch.column(2).to_pylist(), strict=True):
                    shard = slot // per_shard
                    if shard != open_shard:
                        finish()
                        sink, open_shard = store.open_output_stream(f"{base}/.{shard:08d}.{attempt}"), shard
                    ids = expand.decompress(packed)
                    record = ids + pad * (length - len(ids) // 2)
                    sink.write(record)
                    sums.append(zlib.crc32(record))
                made = [
                    batch.column(0), pa.array([s // per_shard for s in slots], pa.int64()),
                    pa.array([s % per_shard for s in slots], pa.int64()), pa.array(n_tokens, pa.int64()),
                    pa.array(sums, pa.int64()), batch.column(3),
                ]
                yield pa.RecordBatch.from_arrays(made, names=names)
        finish()

    return run


def write_in_order(
    docs: DataFrame, tokenizer_path: str, key: int = 2024, length: int = SEQUENCE, per_shard: int = PER_SHARD,
    root: str | None = None,
) -> tuple[DataFrame, str]:
    """Write the shards below ``root`` (default: a new folder in the shared one); returns (records, root).

    The files are written when the records are read, which have slot, shard, record (place in the shard),
    n_tokens (without padding), ids_crc32 (of the whole record) and pieces. A shard is written under a
    name of its task attempt and renamed when it is whole, so a task that runs again after a lost
    executor leaves the same file. The folder must be one that all executors share.
    Texts of any length are cut into sequences, repeated rows and rows with a null doc_id are written each for itself;
    an empty table gives no records and no shards. Which number a sequence has goes by task, so another split size of the
    input gives another order under the same key.
    """
    cut = sequences(docs, tokenizer_path, length)
    counts = sorted((r["task"], r["n"]) for r in cut.groupBy("task").agg(F.count("*").alias("n")).collect())
    first, rows = 0, []
    for task, n in counts:  # one row for each task that encoded documents
        rows.append((task, first))
        first += n
    root = root or new_path(docs.sparkSession, "training-order")
    where = root if "://" in root or root.startswith("file:") else f"file://{root}"
    store, base = fs.FileSystem.from_uri(where)
    store.create_dir(base, recursive=True)
    starts = F.broadcast(docs.sparkSession.createDataFrame(rows, "start_task int, first long"))
    placed = cut.join(starts, F.col("task") == F.col("start_task")).withColumn(
        "slot", slot_of(F.col("first") + F.col("number"), max(first, 1), key)
    )
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard))
    shards = max(1, -(-first // per_shard))
    tasks = min(4 * shards, 20_000)  # more than shards, so that few tasks get several
    dealt = placed.repartition(tasks, "shard").sortWithinPartitions("slot")
    schema = (
        "slot long, shard long, record long, n_tokens long, ids_crc32 long, "
        "pieces array<struct<doc_id: bigint, start: bigint, length: bigint>>"
    )
    records = dealt.select("slot", "n_tokens", "packed", "pieces").mapInArrow(_writer(where, length, per_shard), schema)
    return records, where


def read_from(root: str, slot: int, count: int, length: int = SEQUENCE, per_shard: int = PER_SHARD) -> np.ndarray:
    """Up to ``count`` records from a slot on, by one seek in each shard."""
    store, base = fs.FileSystem.from_uri(root)
    out, stride = [], 2 * length
    while count > 0:
        path = f"{base}/{slot // per_shard:08d}.bin"
        if store.get_file_info(path).type != fs.FileType.File:
            break
        n = min(count, per_shard - slot % per_shard)
        with store.open_input_file(path) as f:
            f.seek(slot % per_shard * stride)
            data = f.read(n * stride)
        if not data:
            break
        out.append(np.frombuffer(data, dtype="<u2").reshape(-1, length))
        slot, count = slot + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), dtype=np.uint16)
