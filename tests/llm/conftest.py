import random

import pytest
from pyspark.sql import Row

WORDS = [a + b for a in ("th", "er", "on", "ÉÀ", "is", "nö", "q|") for b in ("at", "ed", "", "ing,", "s", "Z")]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def odd_texts():
    """Texts with nulls, empties, blanks, one very long, copies, near copies and repeats."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 60, 90, 120, 200, 75, 64, 51, 55, 300)]
    copy = base[3]
    near = copy.split(" ")
    near[5] = "changed"
    loops = " ".join(["again and again"] * 40)
    return [
        *base, copy, copy, " ".join(near), "", None, " \n\t ", "one", "two words", "a b c", loops,
        "line\nline\nline\nother line\n\n\n" * 12, "# * $ %" * 40, prose(rng, 20_000), "x" * 30_000,
        "<|endoftext|> in text 'S İ Σς é é   \x1c end", "a b\u0085c", None, "",
    ]


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(3 * i + 1, t) for i, t in enumerate(odd_texts())]
    rows += [(4, rows[1][1]), (None, "no id here " * 20), (None, None), (7, "another text with an id that is taken " * 9)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    data = [
        Row(doc_id=i, text=t, lang="en" if k % 3 else None, source=f"src{k % 3}" if k % 5 else None,
            n_chars=None if t is None else len(t), score="theirs", fp=1.5, n_words="clash")
        for k, (i, t) in enumerate(odd_rows)
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp double, n_words string"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
