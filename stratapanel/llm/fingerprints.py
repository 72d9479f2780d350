"""Document fingerprints from closed syncmers.

The units of every text, short or long, are small pieces of it: blanks are left out, and a piece ends at the
first ``a`` or ``o``, digit or character outside ASCII, or after ``PIECE`` characters. Where pieces end depends on the
characters at hand and on nothing else, so texts without blanks have units like any other. A window of ``k`` units is a
closed syncmer when the smallest hash among its units is that of its first or last one. The choice looks at
nothing outside the window, so the same passage gives the same anchors wherever it stands, and an edit only
touches the anchors that overlap it.

The first and last ``EDGE`` characters of every text are looked at by character too, since windows of pieces cover the
edges of a text, and very short texts, only thinly.

Everything here is made of Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import BLANK_RUN, unused
from stratapanel.sources.scratch import cut_lineage

#: Units in a window. Two thirds of all windows of three units are closed syncmers.
WINDOW = 3
#: Characters of a piece at most.
PIECE = 8
#: Characters that do not end a piece: ASCII but ``a``, ``o``, ``A``, ``O`` and digits.
INNER = r"[\x00-\x2F\x3A-\x40B-NP-Z\x5B-\x60b-np-z\x7B-\x7F]"
UNIT = rf"{INNER}{{1,{PIECE - 1}}}+[\s\S]?|[\s\S]"
#: Characters, without blanks, at each end of a text that are also units of their own, and how many of them a window has.
EDGE, EDGE_WINDOW = 16, 3
#: Anchors kept in a fingerprint: all. A number keeps the smallest hashes, a uniform sample of a text's
#: anchors; texts with fewer anchors are held whole.
SKETCH: int | None = None


def _solid(text: Column) -> Column:
    """A text without blanks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, "")


def units(solid: Column) -> Column:
    """The pieces of a text without blanks, in order; an empty text has none."""
    return F.regexp_extract_all(solid, F.lit(UNIT), F.lit(0))


def _hashes(of: Column) -> Column:
    return F.transform(of, lambda u: F.xxhash64(u))


def anchors(hashes: Column, k: int = WINDOW) -> Column:
    """Closed syncmers as an array of longs in text order, from an array of unit hashes.

    The upper 32 bits are the anchor's place in units, from 0, the lower 32 its hash (``places`` and ``marks``
    take them apart). A text with fewer than ``k`` units, but at least one, has a single anchor over all of
    them; a text without units has none.
    """
    def anchor(i: Column, *parts: Column) -> Column:
        mark = F.shiftrightunsigned(F.xxhash64(*parts), 32)
        return F.shiftleft(i.cast("long"), 32).bitwiseOR(mark)

    def window(x: Column, i: Column) -> Column:
        parts = [x, *(F.get(hashes, i + j) for j in range(1, k))]
        closed = F.least(parts[0], parts[-1]) <= F.least(*parts)
        return F.when((i <= F.size(hashes) - k) & closed, anchor(i, *parts))

    return (
        F.when(F.size(hashes) == 0, F.array().cast("array<bigint>"))
        .when(F.size(hashes) < k, F.array(anchor(F.lit(0), hashes)))
        .otherwise(F.array_compact(F.transform(hashes, window)))
    )


def _mark(anchor: Column) -> Column:
    return F.shiftright(F.shiftleft(anchor, 32), 32).cast("int")


def marks(found: Column) -> Column:
    """The hashes of anchors."""
    return F.transform(found, _mark)


def places(found: Column) -> Column:
    """Where anchors stand, in units from 0."""
    return F.transform(found, lambda a: F.shiftright(a, 32).cast("int"))


def with_anchors(
    df: DataFrame, text: str = "text", out: str = "anchors", k: int = WINDOW, edges: str | None = None
) -> DataFrame:
    """Add the closed syncmers of a text column, with their places (see ``anchors``), and those of its ``edges``.

    A null, empty or blank text has neither. The places of edge anchors count from each edge's first character.
    """
    solid, head, tail = (unused(name, df) for name in ("solid", "head", "tail"))
    made = df.withColumn(solid, _solid(F.col(text)))
    made = made.withColumn(out, _hashes(units(F.col(solid)))).withColumn(out, anchors(F.col(out), k))
    if edges is not None:
        def letters(part: Column) -> Column:
            return _hashes(F.filter(F.split(part, ""), lambda c: c != ""))

        # columns of their own: fields of a struct would be put back into the windows and made anew for each of them
        made = made.withColumns({
            head: letters(F.left(solid, F.lit(EDGE))), tail: letters(F.right(solid, F.lit(EDGE))),
        })
        both = F.concat(anchors(F.col(head), EDGE_WINDOW), anchors(F.col(tail), EDGE_WINDOW))
        made = made.withColumn(edges, both).drop(head, tail)
    return made.drop(solid)


def in_place(a: Column, b: Column) -> Column:
    """Share of two texts' anchors (Dice) that are common and stand at the same place in both.

    Two texts without anchors agree (1.0).
    """
    total = F.size(a) + F.size(b)  # places make the anchors of a text distinct
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def aligned(left: DataFrame, right: DataFrame, key: str = "doc_id", found: str = "anchors") -> DataFrame:
    """Positional matches of two tables of anchors: which passages they have in common, and how far apart.

    Anchors that occur once in their own text meet by hash; all meetings of two texts at one offset (place in the
    right text less that in the left one) are one passage. Returns left_id, right_id, offset,
    matches, first_place, last_place (in the left text). The result has a row for each pair and offset, so the left side
    is meant to be the texts that are looked for. Rows with a null key or without anchors give none.
    """
    def once(df: DataFrame, side: str) -> DataFrame:
        each = df.select(F.col(key).alias(f"{side}_id"), F.explode(found).alias("anchor")).filter(F.col(f"{side}_id").isNotNull())
        mark, place = _mark(F.col("anchor")).alias("mark"), F.shiftright("anchor", 32).cast("int")
        counted = each.groupBy(f"{side}_id", mark).agg(F.min(place).alias(f"{side}_place"), F.count("*").alias("n"))
        return counted.filter("n = 1").drop("n")

    met = once(left, "left").join(once(right, "right"), "mark")
    offset = (F.col("right_place") - F.col("left_place")).alias("offset")
    return met.groupBy("left_id", "right_id", offset).agg(
        F.count("*").alias("matches"), F.min("left_place").alias("first_place"), F.max("left_place").alias("last_place")
    )


def sketch(found: Column, edges: Column, size: int | None = SKETCH) -> Column:
    """The sorted array of distinct anchor hashes, of the ``size`` smallest if given."""
    kept = F.sort_array(F.array_distinct(marks(F.concat(found, edges))))
    return kept if size is None else F.slice(kept, 1, size)


def with_sketch(df: DataFrame, text: str, out: str, size: int | None = SKETCH, k: int = WINDOW) -> DataFrame:
    """Add the sketch of a text: the hashes of its anchors and those of its edges."""
    edges = unused("edges", df)
    return with_anchors(df, text, out, k, edges).withColumn(out, sketch(F.col(out), F.col(edges), size)).drop(edges)


def likeness(a: Column, b: Column, size: int | None = SKETCH) -> Column:
    """Shared part of two texts (Dice), estimated from their sketches; exact when both are whole.

    Two texts without anchors are alike (1.0), one without is unlike any other (0.0).
    """
    both = F.array_intersect(a, b)
    if size is None:
        total = F.size(a) + F.size(b)
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(both) / total)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    jaccard = F.size(F.array_intersect(both, union)) / F.size(union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(2.0 * jaccard / (1.0 + jaccard))


def digest(sketch: Column) -> Column:
    """A sketch as text: eight hex digits for each anchor."""
    unsigned = F.transform(sketch, lambda h: h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array_join(F.transform(unsigned, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def followers(keys: DataFrame) -> DataFrame:
    """For each row of (doc_id, id, text_hash, n_chars) the row before it by descending doc_id.

    The row before the first one is the last one. Sorted by range partitions; a partition's first
    row gets its predecessor from a table with one row for each partition. Rows that agree in
    id and text count once; different texts under one doc_id go by text hash; null ids last.
    Returns doc_id, id, text_hash, before_id, before_hash, before_chars.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash")]
    ranged = keys.distinct().repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "doc-order")
    me = F.struct("id", "text_hash", "n_chars")
    w = Window.partitionBy("part").orderBy(*order)
    numbered = ranged.select("*", F.row_number().over(w).alias("row"), F.lag(me).over(w).alias("before"))
    by_part = Window.orderBy("part")
    place = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("text_hash"))
    ends = ranged.groupBy("part").agg(F.max_by(me, place).alias("last")).select(
        F.col("part").alias("end_part"),
        F.coalesce(
            F.lag("last").over(by_part),
            F.last("last").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("end_before"),
    )
    joined = numbered.join(ends, F.col("part") == F.col("end_part"), "left")
    before = F.when(F.col("row") == 1, F.col("end_before")).otherwise(F.col("before"))
    return joined.withColumn("b", before).select(
        "doc_id", "id", "text_hash", F.col("b.id").alias("before_id"),
        F.col("b.text_hash").alias("before_hash"), F.col("b.n_chars").alias("before_chars"),
    )


def edit_comparison(docs: DataFrame, size: int | None = SKETCH, k: int = WINDOW) -> DataFrame:
    """Fingerprint every text and its edited text, and compare.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the first
    as many of the next document's text (by descending doc_id, round to the first), or by all of
    it. A null text is an empty one. Repeated rows are all returned. A sole document is
    its own next one; an empty table gives no rows. Rows with a null doc_id come last in that order and keep it. Whole texts are shuffled once (both joins use the same exchange); what a document
    gives to the one before it, a piece of text and a sketch, is a second, smaller shuffle.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_anchors_kept, in_place_edited (likeness by anchors that stand at the same place in the
    text and in the edited one).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # a row is known by two numbers without nulls; whether its doc_id is null goes into the hash
    keyed = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("text_hash"), text.alias("text"),
    )
    n_chars = F.char_length("text").cast("long")
    links = followers(keyed.select("doc_id", "id", "text_hash", n_chars.alias("n_chars")))
    placed = keyed.select("id", "text_hash", "text").join(links, ["id", "text_hash"])
    sketched = with_anchors(placed, "text", "found", k, "edges")
    # of repeated rows one gives; their exchange and order are those of the join
    same = Window.partitionBy("id", "text_hash").orderBy("text_hash")
    giving = placed.withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    given = with_sketch(giving, "text", "sketch", size, k).select(
        F.col("before_id").alias("id"), F.col("before_hash").alias("text_hash"),
        F.left("text", F.floor(F.col("before_chars") / 2).cast("int")).alias("piece"),
        F.col("sketch").alias("next_sketch"),
    )
    met = sketched.select("doc_id", "id", "text_hash", "text", "found", "edges").join(given, ["id", "text_hash"])
    kept = F.left("text", (n_chars - F.floor(n_chars / 2)).cast("int"))
    edited = met.select(
        "doc_id", n_chars.alias("n_chars"), "found", "edges", "next_sketch", F.concat(kept, F.col("piece")).alias("edited")
    )
    edited = with_anchors(edited, "edited", "edited_found", k, "edited_edges").withColumns({
        "sketch": sketch(F.col("found"), F.col("edges"), size),
        "edited_sketch": sketch(F.col("edited_found"), F.col("edited_edges"), size),
    })
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("sketch")).alias("fingerprint"),
        digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
        F.size("sketch").alias("n_anchors_kept"),
        in_place(F.col("found"), F.col("edited_found")).alias("in_place_edited"),
    )
