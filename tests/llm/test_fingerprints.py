import hashlib
import random
import re
import string
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from stratapanel.llm import fingerprints as F1


def xx_long(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def mark(h):
    x = h >> 32
    return x - (1 << 32) if x >> 31 else x


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def solid(text):
    return "".join(re.split(r"[ \t\n\x0b\f\r]+", text))


def syncmers(units, k):
    """(place, hash) of the closed syncmers, the hash signed."""
    h = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    low = [signed(x) for x in h]
    if not h:
        return []
    if len(h) < k:
        return [(0, mark(xx_long(h)))]
    return [
        (i, mark(xx_long(h[i : i + k]))) for i in range(len(h) - k + 1) if min(low[i : i + k]) in (low[i], low[i + k - 1])
    ]


def found(text, k=F1.WINDOW):
    return syncmers(re.findall(F1.UNIT, solid(text)), k)


def sketch(text, k=F1.WINDOW, size=F1.SKETCH):
    ends = solid(text)[: F1.EDGE], solid(text)[-F1.EDGE :]
    edges = [a for end in ends for a in syncmers(end, F1.EDGE_WINDOW)]
    return sorted({m for _, m in found(text, k) + edges})[:size]


def dice(a, b, size=F1.SKETCH):
    union = sorted(set(a) | set(b))[:size]
    if not union:
        return 1.0
    j = len(set(union) & set(a) & set(b)) / len(union)
    return 2 * j / (1 + j)


def test_edit_comparison_against_brute_force(odd_docs, odd_rows):
    got = F1.edit_comparison(odd_docs).collect()
    assert len(got) == len(odd_rows)
    # distinct (doc_id, text), descending id, nulls last; ties by Spark's text hash
    def order(row):
        i, t = row
        null = (i is None).to_bytes(4, "little")
        return (i is None, -(i or 0), signed(xxhash.xxh64_intdigest(null, xxhash.xxh64_intdigest(t.encode(), 42))))

    rows = sorted({(i, t or "") for i, t in odd_rows}, key=order)
    want = {}
    for n, (i, t) in enumerate(rows):
        nxt = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        s, e, x = sketch(t), sketch(edited), sketch(nxt)
        want.setdefault(i, []).append((
            len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v & 0xFFFFFFFF:08x}" for v in s),
            "".join(f"{v & 0xFFFFFFFF:08x}" for v in e), round(dice(s, e), 9), round(dice(s, x), 9),
            round(dice(found(t), found(edited), None), 9),
        ))
    for r in got:
        mine = (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), round(r.in_place_edited, 9))
        assert mine in want[r.doc_id]


def placed(spark, texts):
    df = F1.with_anchors(spark.createDataFrame([(t,) for t in texts], "text string"))
    return [list(zip(r.p, r.m)) for r in df.select(F1.places(F.col("anchors")).alias("p"), F1.marks(F.col("anchors")).alias("m")).collect()]


def test_anchors_are_context_free_and_placed(spark):
    words = [f"w{i * i % 97}" for i in range(80)]
    a, b = " ".join(words), " ".join(["other", "start", *words, "other", "end"])
    plain, moved = placed(spark, [a, b])
    before = len(re.findall(F1.UNIT, "otherstart"))
    # "w" goes on in a piece that "other start" leaves open; what stands before that is only the first window's
    assert plain and {m for m in plain if m[0] > 0} <= {(p - before + 1, m) for p, m in moved} | {(p - before, m) for p, m in moved}
    assert plain == found(a) and moved == found(b)


def test_one_unit_for_all_lengths(spark):
    """No length at which likeness breaks off: code points 63 and 64, long texts without blanks."""
    prose = "Inonst heble th and shonre ouwhea of rend Thlyer the to bleatio unds"
    assert len(prose) >= 64
    draw = random.Random(7)
    plain = "".join(draw.choices(string.ascii_letters + string.digits + "+/", k=240))
    chinese = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(240))
    pairs = [(prose[:63], prose[:64])]
    spots = range(3, 240, 9)
    for t in (plain, chinese):
        pairs += [(t, t[:i] + ("Q" if t is plain else "\u4dff") + t[i + 1 :]) for i in spots]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a string, b string")
    df = F1.with_sketch(F1.with_sketch(df, "a", "x"), "b", "y").select("n", F1.likeness(F.col("x"), F.col("y")).alias("near"))
    near = [r.near for r in df.orderBy("n").collect()]
    assert near[0] >= 0.7
    assert min(near[1:]) >= 0.75
    for part in (near[1 : 1 + len(spots)], near[1 + len(spots) :]):
        assert sum(part) / len(part) >= 0.9


def test_aligned_passages(spark):
    words = [f"w{i * i % 1999}x{i % 7}y" for i in range(300)]
    passage = " ".join(words[100:160])
    texts = [(1, passage), (2, " ".join(words)), (3, "Something else altogether, " * 9), (4, None), (None, passage)]
    df = F1.with_anchors(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {
        (r.right_id, r.offset): (r.matches, r.first_place, r.last_place)
        for r in F1.aligned(df.filter("doc_id = 1"), df.filter("doc_id > 1")).collect()
    }

    def once(text):
        n = Counter(m for _, m in found(text))
        return {m: p for p, m in found(text) if n[m] == 1}

    want, here = {}, once(passage)
    for i, t in texts[1:3]:
        for m, p in once(t).items():
            if m in here:
                want.setdefault((i, p - here[m]), []).append(here[m])
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    assert max(got, key=got.get)[0] == 2 and 2 * max(got.values())[0] > len(here)
    assert F1.aligned(df.filter("doc_id = 4"), df).collect() == []


def test_short_texts_share_what_they_keep(spark):
    rows = [(k, t) for k, t in enumerate(["Thlyer the to.", "Ouwhea of rend", "Inonst heble th and", "bleati 𝄞𝄞 shonre"])]
    got = F1.edit_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and all(r.near_edited > r.near_next for r in got)


def test_one_document_and_none(odd_docs, no_docs):
    assert F1.edit_comparison(no_docs).collect() == []
    one = odd_docs.filter("doc_id = 1").limit(1)
    r = F1.edit_comparison(one).collect()[0]
    assert r.near_next == 1.0 and 0 < r.near_edited < 1


def test_a_changed_word_shows_in_the_fingerprint_of_a_long_text(spark):
    words = [f"w{i * i % 1999}x{i % 7}" for i in range(1500)]
    texts = [" ".join([*words[:at], "changed", *words[at + 1 :]]) for at in range(10, 1500, 50)]
    df = spark.createDataFrame([(" ".join(words),)] + [(t,) for t in texts], "text string")
    got = [r.fp for r in F1.with_sketch(df, "text", "sketch").select(F1.digest(F.col("sketch")).alias("fp")).collect()]
    assert len(set(got)) >= len(texts)
