from collections import defaultdict

from stratapanel.llm import chat

ROWS = [
    ("a", 0, "user", "hi"), ("a", 1, "assistant", "hello"),
    ("b", 0, "user", "hi"), ("b", 1, "assistant", "hello"), ("b", 2, "user", "more"),
    ("c", 0, "user", "hi"), ("c", 1, "assistant", "hello"), ("c", 2, "user", "more"),
    ("d", 0, "user", "hi"),
    ("e", 0, "user", "hi"), ("e", 1, "assistant", "other"), ("e", 1, "assistant", "other"),
    ("f", 0, "user", None), ("g", 0, "user", ""), ("h", 0, None, ""),
    ("i", 5, "user", "hi"), ("i", 9, "assistant", "hello"), ("i", None, "system", "first"),
    (None, 0, "user", "hi"), (None, 0, "user", "alone"),
    ("j", 1, "user", "x" * 100_000),
]


def brute(rows):
    convs = defaultdict(set)
    for conv, turn, role, text in rows:
        key = (conv,) if conv is not None else (None, turn, role, text)
        convs[key].add((turn, role, text))
    order = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    whole = {k: tuple((r, t) for _, r, t in sorted(v, key=order)) for k, v in convs.items()}
    beginnings = {w[:n] for w in whole.values() for n in range(1, len(w))}
    out = {}
    for k, w in whole.items():
        if w not in beginnings:
            out.setdefault(w, []).append(k[0])
    return sorted(
        (min((c for c in ids if c is not None), default=""), len(w), len(ids),
         "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in w))
        for w, ids in out.items()
    )


def test_maximal_conversations_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "conv_id string, turn int, role string, text string").repartition(3)
    got = sorted((r.conv_id or "", r.n_turns, r.copies, r.rendered) for r in chat.render(df).collect())
    assert got == brute(ROWS)
    assert chat.render(df.filter("false")).collect() == []


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "conv_id string, turn int, role string, text string")
    df = df.withColumns({c: F.lit("theirs") for c in ("number", "p0", "h0", "alone", "copies", "first")})
    got = sorted((r.conv_id or "", r.n_turns, r.copies, r.rendered) for r in chat.render(df).collect())
    assert got == brute(ROWS)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    got = sorted((r.conv_id, r.n_turns, r.copies, r.rendered) for r in chat.render(df).collect())
    assert got == brute(rows) and len({len(r) for r in got}) == 1
