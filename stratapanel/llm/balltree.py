"""Ranked lexical search: exact inner products by trees of balls over sparse document vectors.

A document's vector holds, for each term of the searched items, the integer that the term adds to its
score; a score is the inner product with the 0/1 vector of an item's terms. Documents with the same
heaviest terms are laid side by side, and runs of them are halved along two far members into a tree.
A node keeps its members' centroid c, the radius R (how far a member exceeds c, at most) and the same
along each axis, r_t. With q the item's terms that the node knows, no member scores above

    min(sum of c_t + sqrt(|q|) R, sum of c_t + r_t)        t in q

(Cauchy-Schwarz on the whole excess, or axis by axis). The bound is rounded up by more than its
floating-point error can be. Subtrees are visited best first and left out when their bound is below the
item's k-th score so far; at leaves scores are added up exactly, in integers.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import SLICE_ROWS, add_by_text
from stratapanel.sources.scratch import cut_lineage

#: Terms of lower-cased UTF-8 text: ASCII digits and letters and all bytes of other characters.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_JAVA_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
LEAF = 32
#: Documents in one tree, which is what a task holds at a time.
TREE = 4096
#: Terms of the items that are searched together; more items are searched block after block.
BLOCK_TERMS = 200_000
#: One document in so many is searched first, to have a k-th score to prune the others with.
FIRST = 8
#: Bounds are raised by this share and by one: sums of doubles are off by less up to a million terms.
SAFE = 1 + 1e-9


@dataclass
class Items:
    """A block of items: each with the numbers of its terms; and, when known, the terms' weights."""

    ids: list
    flat: np.ndarray
    starts: np.ndarray
    vocabulary: dict[bytes, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    documents: int = 0
    length: int = 1

    def terms(self, item: int) -> np.ndarray:
        end = self.starts[item + 1] if item + 1 < len(self.starts) else len(self.flat)
        return self.flat[self.starts[item] : end]

    def parts(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each term adds to a document's score; n: its terms in all, for each entry of counts."""
        m = 100 - 90 + (90 * n * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts)))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of some slices, one slice after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class BallTree:
    """A tree over sparse vectors: row i holds ``values`` at ``terms`` from starts[i] to starts[i + 1]."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF) -> None:
        self.starts, self.terms, self.values, self.width = starts, terms, values, width
        self.real = values.astype(np.float64)
        #: (terms, centroid, centroid + axis radius, radius), children or None, members
        self.nodes: list[tuple] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.scored = 0
        self._dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        todo = [(np.arange(len(starts) - 1), -1)]
        while todo:
            rows, parent = todo.pop()
            halves = self._add(rows, leaf)
            at = len(self.nodes) - 1
            if parent >= 0:
                self.children[parent] = (self.children[parent] or ()) + (at,)
            todo += [(half, at) for half in halves]

    def _add(self, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
        lengths = self.starts[rows + 1] - self.starts[rows]
        at = _spread(self.starts[rows], lengths)
        row = np.repeat(np.arange(len(rows)), lengths)
        terms, place = np.unique(self.terms[at], return_inverse=True)
        values = self.real[at]
        centre = np.bincount(place, values, len(terms)) / len(rows)
        excess = np.maximum(values - centre[place], 0.0)
        axis = np.zeros(len(terms))
        np.maximum.at(axis, place, excess)
        radius = math.sqrt(np.bincount(row, excess * excess, len(rows)).max()) if len(at) else 0.0
        self.nodes.append((terms, centre, centre + axis, radius * SAFE))
        self.children.append(None)
        self.members.append(rows)
        if len(rows) <= leaf:
            return []
        norm = np.bincount(row, values * values, len(rows))

        def toward(direction: np.ndarray) -> np.ndarray:
            return np.bincount(row, values * direction[place], len(rows))

        def vector(i: int) -> np.ndarray:
            return np.bincount(place[row == i], values[row == i], len(terms))

        a = vector(int(np.argmax(norm - 2 * toward(centre))))
        b = vector(int(np.argmax(norm - 2 * toward(a))))
        order = np.argsort(toward(b - a), kind="stable")
        half = len(rows) // 2
        return [rows[order[:half]], rows[order[half:]]]

    def bound(self, node: int, items: Items, spare: np.ndarray) -> np.ndarray:
        """For every item: what no member's score is above. ``spare``: zeros, ``width`` of them."""
        terms, centre, top, radius = self.nodes[node]

        def total(values: np.ndarray | float) -> np.ndarray:
            spare[terms] = values
            found = np.add.reduceat(spare[items.flat], items.starts)
            spare[terms] = 0.0
            return found

        ball = total(centre) + np.sqrt(total(1.0)) * radius
        return np.minimum(ball, total(top)) * SAFE + 1

    def scores(self, leaf: int, terms: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's members."""
        if leaf not in self._dense:
            known, rows = self.nodes[leaf][0], self.members[leaf]
            lengths = self.starts[rows + 1] - self.starts[rows]
            at = _spread(self.starts[rows], lengths)
            table = np.zeros((len(known), len(rows)), dtype=np.int64)
            table[np.searchsorted(known, self.terms[at]), np.repeat(np.arange(len(rows)), lengths)] = self.values[at]
            self._dense[leaf] = known, table
        known, table = self._dense[leaf]
        self.scored += table.shape[1]
        if not len(known):
            return np.zeros(table.shape[1], dtype=np.int64)
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        return table[at[known[at] == terms]].sum(axis=0)

    def search(self, items: Items, best: Best) -> None:
        """Let the best members of every item into ``best``."""
        spare = np.zeros(self.width)
        bounds = {0: self.bound(0, items, spare)}
        for item in np.nonzero(bounds[0] >= best.floor)[0].tolist():
            terms, queue = items.terms(item), [(-bounds[0][item], 0)]
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < best.floor[item]:
                    break
                children = self.children[node]
                if children is None:
                    best.offer(item, self.scores(node, terms), self.members[node])
                    continue
                for child in children:
                    if child not in bounds:
                        bounds[child] = self.bound(child, items, spare)
                    if bounds[child][item] >= best.floor[item]:
                        heapq.heappush(queue, (-bounds[child][item], child))


class Best:
    """Each item's k best documents so far: the highest scores, of equal ones the smallest ids, null last."""

    def __init__(self, items: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.ids: Sequence = ()

    def offer(self, item: int, scores: np.ndarray, rows: np.ndarray) -> None:
        heap = self.heaps[item]
        for i in np.nonzero(scores >= self.floor[item])[0].tolist():
            doc = self.ids[rows[i]]
            entry = (int(scores[i]), doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = max(self.floor[item], heap[0][0])


def _binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed 32-bit ones, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<i4").astype(np.int64), np.array([len(r) // 4 for r in raw], dtype=np.int64)


def _searcher(items: Items, k: int, floor: np.ndarray, tree: int, leaf: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(len(items.ids), k, floor), [], 0

        def search() -> None:
            batch = pa.Table.from_batches(held).combine_chunks()
            terms, counts = _binaries(batch.column("terms"))
            tf, _ = _binaries(batch.column("tfs"))
            parts = items.parts(batch.column("n").to_numpy(), counts, terms, tf)
            best.ids = batch.column("doc_id").to_pylist()
            starts = np.concatenate(([0], np.cumsum(counts)))
            BallTree(starts, terms, parts, len(items.vocabulary), leaf).search(items, best)

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                held.append(part)
                size += part.num_rows
                if size >= tree:
                    search()
                    held, size = [], 0
        if size:
            search()
        rows = [(i, e) for i, heap in enumerate(best.heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([-e[2] if e[1] else None for _, e in rows], pa.int64()),
            pa.array([e[0] for _, e in rows], pa.int64()),
        ], names=["item", "doc_id", "score"])

    return run


def _count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms in all, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most a block's terms

    def make() -> Callable[[list[bytes]], list]:
        known = shared.value.get

        def compute(texts: list[bytes]) -> list:
            made: list[list] = [[], [], []]
            for text in texts:
                found = TERM.findall(text.lower())  # lowers A-Z only
                counts = Counter(map(known, found))
                counts.pop(None, None)
                made[0].append(len(found))
                made[1].append(np.fromiter(counts, dtype="<i4", count=len(counts)).tobytes())
                made[2].append(np.fromiter(counts.values(), dtype="<i4", count=len(counts)).tobytes())
            return made

        return compute

    fields = [("n", "long", pa.int64()), ("terms", "binary", pa.binary()), ("tfs", "binary", pa.binary())]
    return add_by_text(docs, "text", fields, make, keep=["doc_id"])


def _frequencies(counted: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term; tasks add up their own."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_binaries(batch.column(0))[0], minlength=width)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = np.zeros(width, dtype=np.int64)
    for r in counted.select("terms").mapInArrow(add_up, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        found[r[0]] = r[1]
    return found


def _heaviest(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each document's two heaviest terms; documents that add nothing to any score go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = _binaries(batch.column("terms"))
            tf, _ = _binaries(batch.column("tfs"))
            parts = items.parts(batch.column("n").to_numpy(), counts, terms, tf)
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((terms, -parts, row))
            first = np.cumsum(counts) - counts
            able = np.nonzero(np.bincount(row, parts > 0, len(counts)) > 0)[0]
            one = terms[order[first[able]]]
            two = np.where(counts[able] > 1, terms[order[np.minimum(first[able] + 1, len(order) - 1)]], -1)
            kept = batch.take(pa.array(able))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(one), pa.array(two)], names=[*kept.schema.names, "one", "two"])

    return run


def item_blocks(queries: DataFrame, query_id: str, text: str, block_terms: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items with their distinct terms, in blocks of about ``block_terms``; a block is all the driver holds.

    Rows with the same id, null ones too, are one item.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), upper, lower), F.lit(_JAVA_TERM), F.lit(0))
    rows = queries.select(F.col(f"`{query_id}`").alias("item"), F.explode(found).alias("term")).distinct()
    ids: list = []
    lists: list[list[int]] = []
    vocabulary: dict[bytes, int] = {}
    size = 0

    def block() -> Items:
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        return Items(ids, np.array([t for ts in lists for t in ts], dtype=np.int64), starts, vocabulary)

    for item, term in rows.orderBy("item", "term").toLocalIterator():
        if not ids or ids[-1] != item:
            if size >= block_terms:
                yield block()
                ids, lists, vocabulary, size = [], [], {}, 0
            ids.append(item)
            lists.append([])
        lists[-1].append(vocabulary.setdefault(term.encode(), len(vocabulary)))
        size += 1
    if ids:
        yield block()


def _best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank(
    docs: DataFrame, queries: DataFrame, *, k: int = TOP, query_id: str = "item_id", text: str = "text",
    block_terms: int = BLOCK_TERMS, tree: int = TREE, leaf: int = LEAF,
) -> DataFrame:
    """Each item's k documents with the highest score above 0: item id, rank (from 1), doc_id and score.

    Equal scores by doc_id, null last. Null and empty texts have no terms: such documents are never
    found, such items have no row. Long texts count whole, each repeated row is a document of its own;
    an empty table on either side gives an empty result. Other columns are not read. The items are
    searched in blocks, each against all documents.
    """
    spark = docs.sparkSession
    kind = queries.schema[query_id].dataType
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "item long, doc_id long, score long"
    out = None
    for items in item_blocks(queries, query_id, text, block_terms):
        counted = cut_lineage(_count_terms(chosen, items.vocabulary), "counted")
        all_docs = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        items.documents, items.length = all_docs[0], all_docs[1] or 1
        df = _frequencies(counted, len(items.vocabulary))
        items.weights = np.array(
            [math.floor(1000 * math.log((2 * items.documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64
        )
        vectors = counted.filter(F.length("terms") > 0).mapInArrow(
            _heaviest(items), "doc_id long, n long, terms binary, tfs binary, one long, two long"
        )
        spread = F.xxhash64("doc_id", "n", "terms")
        vectors = cut_lineage(vectors.withColumn("spread", spread), "vectors")

        def search(part: DataFrame, floor: np.ndarray, items: Items = items) -> DataFrame:
            laid = part.repartitionByRange("one", "two", "spread").sortWithinPartitions("one", "two", "spread")
            wanted = laid.select("doc_id", "n", "terms", "tfs")
            return cut_lineage(wanted.mapInArrow(_searcher(items, k, floor, tree, leaf), schema), "found")

        turn = F.pmod(F.xxhash64("spread"), F.lit(FIRST))
        floor = np.ones(len(items.ids), dtype=np.int64)  # a score is above 0
        first = _best_of(search(vectors.filter(turn == 0), floor), k)
        for r in first.filter(F.col("rank") == k).collect():  # one row for each item of the block
            floor[r["item"]] = r["score"]
        rest = search(vectors.filter(turn != 0), floor)
        found = _best_of(first.drop("rank").unionByName(rest), k)
        names = spark.createDataFrame(list(enumerate(items.ids)), f"number long, `{query_id}` {kind.simpleString()}")
        named = found.join(names, F.col("item") == F.col("number")).select(
            f"`{query_id}`", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
        )
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"`{query_id}` {kind.simpleString()}, rank int, doc_id long, score long")
    return out
