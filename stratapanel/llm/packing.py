"""Packing along a space-filling curve.

Each document's tokens are hashed into a vector and projected to a few dimensions; its place on the
Hilbert curve through them is the sort key. Neighbours on the curve are alike, so sequences filled
along it hold related text. Sequences are cut from the one long stream of all tokens in that order:
every sequence but the last is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import SLICE_ROWS, add_by_text, bucket_count, by_bytes, with_offsets
from stratapanel.llm.tokens import word_encoder
from stratapanel.sources.scratch import cut_lineage

SEQUENCE = 2048
END_ID = 1
DIMS, DEPTH = 4, 10
#: Bits below the curve key that order documents in the same cell of the curve by a hash of their
#: id, so that a cell with very many documents (copies) can be cut anywhere.
TIE_BITS = 63 - DIMS * DEPTH


def projection(vocabulary: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    """Fixed random signs: the part of each hashed token in each dimension."""
    return np.random.default_rng(9).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(vocabulary, dims))


def places(documents: list[bytes], signs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Grid cells of documents (16-bit ids): the projected mean of their distinct tokens, squashed to 0 .. 2^depth - 1.

    Distinct tokens, weighed alike, keep the most frequent ones of a language from deciding
    everything. Documents without tokens lie in the middle.
    """
    lengths = np.array([len(x) // 2 for x in documents], dtype=np.int64)
    ids = np.frombuffer(b"".join(documents), dtype="<u2")
    marked = np.repeat(np.arange(len(documents), dtype=np.uint64) << np.uint64(16), lengths) | ids
    marked.sort()
    marked = marked[np.concatenate(([True], marked[1:] != marked[:-1]))] if len(marked) else marked
    counts = np.bincount((marked >> np.uint64(16)).astype(np.int64), minlength=len(documents))
    sums = np.zeros((len(documents), signs.shape[1]))
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        sums[full] = np.add.reduceat(signs[(marked & np.uint64(0xFFFF)).astype(np.int64)], starts, axis=0, dtype=np.float64)
    mean = sums / np.sqrt(np.maximum(counts, 1))[:, None]
    cells = np.minimum((1 << depth) / (1 + np.exp(-1.7 * mean)), (1 << depth) - 1).astype(np.int64)
    cells[~full] = 1 << (depth - 1)
    return cells


def hilbert(cells: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Position of each grid cell (rows of coordinates) on the Hilbert curve.

    Works from the highest bit down: in each dimension a set bit mirrors the first axis below that
    bit, an unset one swaps the lower bits of the two axes; the Gray code of what remains is undone.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap if i else 0
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _encoder(path: str, dims: int, depth: int) -> Callable[[], Callable[[list[bytes]], list]]:
    def make() -> Callable[[list[bytes]], list]:
        encoder, signs = word_encoder(path), projection(dims=dims)

        def encode(texts: list[bytes]) -> list:
            ids = encoder.encode(texts)
            if not ids:
                return [[], [], []]
            return [ids, hilbert(places(ids, signs, depth), depth), [len(x) // 2 + 1 for x in ids]]

        return encode

    return make


def encode_documents(docs: DataFrame, tokenizer_path: str, dims: int = DIMS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, ids, n_tokens, curve): 16-bit ids without the end id, their number with it, and the key.

    The tie bits come from (doc_id, text), so the key orders all rows but exact repeats.
    """
    fields = [("ids", "binary", pa.binary()), ("hilbert", "long", pa.int64()), ("n_tokens", "long", pa.int64())]
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tie"))
    made = add_by_text(rows, "text", fields, _encoder(tokenizer_path, dims, depth), keep=["doc_id", "tie"], cut=by_bytes)
    tie_bits = 63 - dims * depth
    curve = F.shiftleft("hilbert", tie_bits).bitwiseOR(F.shiftrightunsigned("tie", 64 - tie_bits))
    return made.withColumn("curve", curve).drop("hilbert", "tie")


def in_ranges(df: DataFrame, key: str, bounds: list[int], out: str) -> DataFrame:
    """Add the number of the range that a key falls into: how many of the sorted bounds are <= key.

    Found in two steps, first among every n-th bound, so the work grows with the square root of
    the number of bounds.
    """
    if not bounds:
        return df.withColumn(out, F.lit(0))
    n = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + n] for i in range(0, len(bounds), n)]

    def literal(xs: list[int]) -> str:
        return "array(" + ", ".join(f"{x}L" for x in xs) + ")"

    heads = F.expr(literal([b[0] for b in blocks]))
    fine = F.expr("array(" + ", ".join(literal(b) for b in blocks) + ")")
    k = F.col(key)
    block = f"{out}_block"
    df = df.withColumn(block, F.size(F.filter(heads, lambda b: b <= k)))
    inside = F.size(F.filter(F.get(fine, F.col(block) - 1), lambda b: b <= k))
    found = F.when(F.col(block) == 0, F.lit(0)).otherwise((F.col(block) - 1) * n + inside)
    return df.withColumn(out, found.cast("int")).drop(block)


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Boundaries of about equal numbers of rows, from Spark's mergeable quantile summaries."""
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(key, shares, 4 * ranges)).first()[0]
    return sorted(set(found or []))


def _cutter(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    types = (pa.int64(),) * 7 + (pa.binary(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                made: list[list] = [[] for _ in names]
                doc, raw, before = (batch.column(i).to_pylist() for i in range(3))
                for d, x, first in zip(doc, raw, before, strict=True):
                    ids = np.append(np.frombuffer(x, dtype="<u2").astype("<u4"), np.uint32(END_ID))
                    start = 0
                    while start < len(ids):
                        sequence, offset = divmod(first + start, length)
                        n = min(length - offset, len(ids) - start)
                        piece = ids[start : start + n].tobytes()
                        values = (d, start, n, zlib.crc32(piece), len(ids), sequence, offset, piece)
                        for column, v in zip(made, values, strict=True):
                            column.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t) for v, t in zip(made, types, strict=True)], names=list(names)
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE) -> DataFrame:
    """Cut all documents into pieces of full sequences, in curve order.

    A null text is an empty one; a document's ids end with ``END_ID``, so each has at least one
    piece; repeated rows are packed each for itself, rows with a null doc_id too. An empty table
    gives no pieces. Returns for each piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and ids (little-endian, 32 bits).
    """
    encoded = cut_lineage(encode_documents(docs, tokenizer_path), "encoded")
    ranges = bucket_count(encoded.count(), most=16_384)
    placed = in_ranges(encoded, "curve", range_bounds(encoded, "curve", ranges), "range")
    order = [F.col("curve"), F.col("doc_id"), F.col("n_tokens")]
    offset = with_offsets(placed, ["range"], order, {"before": "n_tokens"})
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return offset.select("doc_id", "ids", "before").mapInArrow(_cutter(length), schema)
