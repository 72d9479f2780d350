"""Token counts of fields and sections from one encoding of the whole document.

A document is its fields joined by newlines. It is encoded once; every token's span is then matched
with the spans of fields and of the lines inside the text field, so the counts of all parts add
up to the count of the whole, which separate encodings of the parts would not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import SLICE_ROWS
from stratapanel.llm.tokens import byte_encoder

RULES = ("majority", "first")


def allocate(
    starts: np.ndarray, ends: np.ndarray, part_starts: np.ndarray, part_ends: np.ndarray, rule: str = "majority"
) -> tuple[np.ndarray, np.ndarray]:
    """Which part each token belongs to, and whether it crosses a boundary.

    Parts are sorted and do not overlap; there may be gaps (separators) between them. A token inside one
    part is its own. A token that lies in no part goes to the last part that begins before it.
    A token that touches several parts crosses: by rule "majority" it goes to the part with most of its
    bytes, the earlier one of two equal ones; by rule "first" to the first part it touches.
    """
    # of several parts that begin at one place all but the last are empty
    at = np.maximum(np.searchsorted(part_starts, starts, side="right") - 1, 0)
    last = np.maximum(np.searchsorted(part_starts, ends - 1, side="right") - 1, 0)
    owner, crosses = at.copy(), np.zeros(len(starts), dtype=bool)
    for t in np.flatnonzero(at != last):
        parts = np.arange(at[t], last[t] + 1)
        shared = np.minimum(ends[t], part_ends[parts]) - np.maximum(starts[t], part_starts[parts])
        touched = parts[shared > 0]
        crosses[t] = len(touched) > 1
        if len(touched):
            owner[t] = touched[0] if rule == "first" else parts[np.argmax(shared)]
    return owner, crosses


def _parts(fields: Sequence[bytes], lines_of: int) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """The whole document and (field, section, begin, end) of its parts, in bytes."""
    parts, at = [], 0
    for i, value in enumerate(fields):
        sections = value.split(b"\n") if i == lines_of else [value]
        for k, section in enumerate(sections):
            parts.append((i, k, at, at + len(section)))
            at += len(section) + 1
    return b"\n".join(fields), parts


def count_by_part(
    docs: DataFrame, tokenizer_path: str, pattern: str, fields: Sequence[str] = ("source", "lang", "text"),
    lines_of: str = "text", id_column: str = "doc_id", rule: str = "majority",
) -> DataFrame:
    """One row for each field, and for each line of ``lines_of``, of every document.

    Returns doc_id, field, section (line number from 0), char_start, char_end (code points in the whole
    document), n_tokens (allocated by ``rule``), n_crossing (tokens that touch this part and another,
    counted where they were allocated) and doc_tokens. A null field is an empty one and has a row with no
    tokens of its own. Repeated rows each give their rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]
    line_field = list(fields).index(lines_of) if lines_of in fields else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer_path, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                rows: list[list[np.ndarray]] = [[] for _ in names[1:]]
                sizes = []
                for values in zip(*(batch.column(i + 1).to_pylist() for i in range(len(fields))), strict=True):
                    text, parts = _parts(values, line_field)
                    table = np.array(parts, dtype=np.int64)
                    starts, ends = encoder.spans(text)
                    owner, crosses = allocate(starts, ends, table[:, 2], table[:, 3], rule)
                    # code points before each byte: bytes that do not continue one
                    first = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
                    points = np.concatenate(([0], np.cumsum(first)))
                    made = (
                        table[:, 0], table[:, 1], points[table[:, 2]], points[table[:, 3]],
                        np.bincount(owner, minlength=len(parts)),
                        np.bincount(owner[crosses], minlength=len(parts)), np.full(len(parts), len(starts)),
                    )
                    for column, v in zip(rows, made, strict=True):
                        column.append(v)
                    sizes.append(len(parts))
                if not sizes:
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                flat = [pa.array(np.concatenate(c).astype(np.int64)) for c in rows]
                flat[0] = pa.array(list(fields)).take(flat[0])
                yield pa.RecordBatch.from_arrays([ids, *flat], names=names)

    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        *(F.encode(F.coalesce(F.col(f).cast("string"), F.lit("")), "UTF-8").alias(f"field_{i}") for i, f in enumerate(fields)),
    )
    schema = "doc_id long, field string, " + ", ".join(f"{n} long" for n in names[2:])
    return chosen.mapInArrow(run, schema)
