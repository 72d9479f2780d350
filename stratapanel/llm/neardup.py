"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits; two documents link when theirs differ in at most ``RADIUS`` bits, and the
groups are the connected components of all links.

**Search.** The bits are cut into ``RADIUS + agree`` bands. A pair within the radius leaves at least
``agree`` bands untouched, so for one choice of ``agree`` bands its masked distance is 0. For each
choice there is a vantage-point tree on masked Hamming distance: level j branches by the distance to
vantage point j, and as the masked distance of the pair is 0, the triangle inequality prunes every
branch but one. A fingerprint thus lies in one leaf of each tree, and every linked pair meets in
the leaf of some tree, where all 64 bits are compared.

**Overfull leaves** (many fingerprints that agree in the chosen bands) get one more level with real
boundaries: a member serves as vantage point, shards are rings of equal full distance to it,
cut into chunks of bounded size, and chunks are compared only when their rings are at
most ``RADIUS`` apart, again by the triangle inequality. No leaf is cut off, none meets in one task.

More bands have to agree when there are more fingerprints, so that leaves stay small; the links are the
same for any number.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import add_by_text, salted_lookup, unused
from stratapanel.sources.scratch import cut_lineage

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of a leaf, or of a chunk of an overfull one, that are compared directly.
LEAF = 2048
_HASHES_AT_ONCE = 65_536


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a text (UTF-8), in bounded arrays; none for a text without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII blanks separate
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words)))
    starts = np.concatenate(([0], ends[:-1]))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1], ends[width - 1 :] - 1
    for at in range(0, len(first), _HASHES_AT_ONCE):
        spans = zip(first[at : at + _HASHES_AT_ONCE].tolist(), last[at : at + _HASHES_AT_ONCE].tolist(), strict=True)
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text (UTF-8) as an unsigned number; 0 for a text without words."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def _simhasher() -> Callable[[list[bytes]], list]:
    return lambda texts: [np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64)]


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Add the SimHash of every whole text as a signed long; a null text is an empty one."""
    return add_by_text(docs, text, [(out, "long", pa.int64())], _simhasher, keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def trees(agree: int, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """(mask, vantage points) of every tree; the points are fixed by a seed."""
    bands = radius + agree
    edges = [BITS * i // bands for i in range(bands + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    rng = random.Random(17)
    out = []
    for chosen in itertools.combinations(parts, agree):
        mask = reduce(lambda a, b: a | b, chosen)
        levels = 60 // mask.bit_count().bit_length()
        out.append((mask, [rng.getrandbits(BITS) & mask for _ in range(levels)]))
    return out


def bands_to_agree(distinct: int, leaf: int = LEAF, radius: int = RADIUS) -> int:
    """The fewest bands for which evenly spread fingerprints leave less than a quarter of a full leaf."""
    agree = 1
    while agree < 6 and distinct / 2 ** (BITS * agree / (radius + agree)) > leaf / 4:
        agree += 1
    return agree


def _leaf_of(fp: Column, mask: int, points: list[int]) -> Column:
    """Distances to all vantage points, one after the other in one long."""
    step = mask.bit_count().bit_length()
    near = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))).cast("long") for p in points]
    return reduce(lambda path, d: F.shiftleft(path, step).bitwiseOR(d), near)


def route(fps: DataFrame, agree: int, radius: int = RADIUS) -> DataFrame:
    """(tree, leaf, fp): the leaf of every fingerprint in every tree."""
    fp = F.col("fp")
    leaves = F.array(*(_leaf_of(fp, m, p) for m, p in trees(agree, radius)))
    return fps.select("fp", F.posexplode(leaves).alias("tree", "leaf"))


def to_cells(routed: DataFrame, leaf: int = LEAF, radius: int = RADIUS) -> DataFrame:
    """(cell, fp): what has to be compared. A cell has at most about twice ``leaf`` members."""
    sizes = routed.groupBy("tree", "leaf").agg(F.count("*").alias("members"), F.min("fp").alias("vantage"))
    over = cut_lineage(sizes.filter(F.col("members") > leaf), "overfull-leaves")
    place = F.xxhash64("tree", "leaf")
    full = over.select(F.col("tree").alias("o_tree"), F.col("leaf").alias("o_leaf"), "vantage")
    marked = routed.join(full, (F.col("tree") == F.col("o_tree")) & (F.col("leaf") == F.col("o_leaf")), "left")
    small = marked.filter("o_tree IS NULL").select(place.alias("cell"), "fp")
    inside = marked.filter("o_tree IS NOT NULL").select(
        place.alias("place"), "fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).alias("ring")
    )
    chunks = inside.groupBy("place", "ring").count().select(
        "place", "ring", F.ceil(F.col("count") / leaf).cast("int").alias("chunks")
    )
    by_place = Window.partitionBy("place").orderBy("ring").rangeBetween(-radius, radius)
    reach = chunks.withColumn("reach", F.collect_list(F.struct("ring", "chunks")).over(by_place))
    reach = cut_lineage(
        reach.select(F.xxhash64("place", "ring").alias("where"), F.col("chunks").alias("own"), "reach"), "rings"
    )
    placed = salted_lookup(inside.withColumn("where", F.xxhash64("place", "ring")), reach, "where", F.col("fp"))
    placed = placed.withColumn("mine", F.struct("ring", F.pmod(F.xxhash64("fp"), "own").cast("int").alias("chunk")))
    others = F.flatten(
        F.transform(
            "reach",
            lambda r: F.transform(
                F.sequence(F.lit(0), r["chunks"] - 1), lambda c: F.struct(r["ring"].alias("ring"), c.alias("chunk"))
            ),
        )
    )
    paired = placed.select("place", "fp", "mine", F.explode(others).alias("other"))
    cell = F.xxhash64("place", F.least("mine", "other"), F.greatest("mine", "other"))
    return small.unionByName(paired.select(cell.alias("cell"), "fp"))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; label[i] <= i leads to the smallest member."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            next_label = label[label]
            if (next_label == label).all():
                break
            label[:] = next_label


def link_sorted(cell: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside cells of a table sorted by cell: each linked member with the first of its group.

    All members of a cell are compared, one distance in the order at a time; only a spanning
    forest is returned, never all pairs.
    """
    label = np.arange(len(cell))
    bits = fp.view(np.uint64)
    here, step = np.arange(len(cell)), 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    while True:
        here = here[here + step < len(cell)]
        here = here[cell[here] == cell[here + step]]
        if not len(here):
            break
        hit = here[np.bitwise_count(bits[here] ^ bits[here + step]) <= radius]
        if len(hit):
            found.append((hit, hit + step))
            waiting += len(hit)
        if waiting > 200_000:
            _merge(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
            found, waiting = [], 0
        step += 1
    if found:
        _merge(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
    linked = (label != np.arange(len(cell))) & (fp != fp[label])
    return fp[linked], fp[label[linked]]


def _linker(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = fp = np.zeros(0, dtype=np.int64)

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if whole:
                yield out(*link_sorted(cell[:whole], fp[:whole], radius))
                cell, fp = cell[whole:], fp[whole:]
        yield out(*link_sorted(cell, fp, radius))

    return run


def links(fps: DataFrame, agree: int | None = None, leaf: int = LEAF, radius: int = RADIUS) -> DataFrame:
    """(a, b) between distinct fingerprints whose components are those of all links.

    ``fps`` is a written table with a column fp of distinct values. In a group of n fingerprints
    that link in one leaf there are n - 1 rows, not all pairs.
    """
    agree = agree or bands_to_agree(fps.count(), leaf, radius)
    cells = to_cells(route(fps.select("fp"), agree, radius), leaf, radius)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linker(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): the smallest node it is connected to.

    Alternating large-star and small-star steps; every step is written to the shared folder. A node
    with very many neighbours only gets a minimum (summed up before the shuffle) and a salted
    look-up.
    """
    def seal(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut_lineage(df.distinct(), "stars")
        return df, tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        near = (
            df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
            if large
            else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )
        low = near.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        met = salted_lookup(near, low, "a", F.col("b"))
        moved = met.filter(F.col("b") > F.col("a")) if large else met
        pairs = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            pairs = pairs.union(low.select("a", F.col("low").alias("b")))
        return pairs.filter("a != b")

    edges, mark = seal(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        before = mark
        edges, _ = seal(star(edges, large=True))
        edges, mark = seal(star(edges, large=False))
        if mark == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def fingerprint_groups(fps: DataFrame, member: Column, **how: int) -> DataFrame:
    """(fp, first), written: the smallest ``member`` among all rows whose fingerprints are connected to fp.

    ``fps`` is a written table of rows with a column fp; rows without a member value only count if
    a group has no other.
    """
    alone = cut_lineage(fps.groupBy("fp").agg(F.min(member).alias("least")), "distinct-fingerprints")
    return _firsts(alone, links(alone, **how))


def _firsts(alone: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, first), written: the smallest ``least`` of all (fp, least) rows connected to fp by edges (a, b)."""
    roots = components(edges).withColumnRenamed("node", "fp")
    tied = cut_lineage(roots.join(alone.select("fp", "least"), "fp"), "linked-fingerprints")
    firsts = tied.groupBy("root").agg(F.min("least").alias("first"))
    tied_first = salted_lookup(tied.select("fp", "root"), firsts, "root", F.col("fp")).select("fp", "first")
    groups = alone.select("fp", "least").join(tied_first, "fp", "left")
    return cut_lineage(groups.select("fp", F.coalesce("first", "least").alias("first")), "groups")


def near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id among all documents reachable by links, itself included.
    Rows without a doc_id take part and have the component_id of their group, null if none
    of the group has an id. Repeated rows are all returned. The last join reads two written tables,
    so that AQE can split the rows of a very common fingerprint.
    """
    rows = cut_lineage(with_fingerprint(docs, keep=["doc_id"]), "fingerprints")
    groups = fingerprint_groups(rows, F.col("doc_id"), **how)
    return rows.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def _ident(bits: str) -> Column:
    return F.concat_ws(":", bits, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))


def _member(fp: str) -> Column:
    """What the first row of a group is chosen by: rows without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col(fp).alias("fp"))


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """One document of each group, with the columns it came with: the one with the smallest doc_id.

    Rows without an id come last; of rows that agree in id and fingerprint one stays.
    """
    fp, me = unused("near_duplicate_fp", docs), unused("near_duplicate_row", docs)
    rows = cut_lineage(with_fingerprint(docs, out=fp), "fingerprinted")
    slim = rows.select(F.col(fp).alias("fp"), "doc_id")
    first = fingerprint_groups(slim, _member("fp"), **how).filter(F.col("first.fp") == F.col("fp"))
    first = first.select("fp", "first.doc_id").select(_ident("fp").alias("first_row"))
    marked = rows.withColumn(me, _ident(fp)).drop(fp)
    return marked.join(first, F.col(me) == F.col("first_row"), "left_semi").dropDuplicates([me]).drop(me)
