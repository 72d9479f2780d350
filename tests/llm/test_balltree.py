import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from stratapanel.llm import balltree, queries, twins
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every item against every document."""
    counted = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, wanted in items.items():
        rows = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if t in c
            )
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        found += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(rows)[:k], 1)]
    return found


def items_of(spark, texts):
    rows = [Row(item_id=i, text=t, doc_id="clash", score=1.5, rank="x") for i, t in texts]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, score double, rank string")


def merged(texts):
    out = {}
    for i, t in texts:
        out.setdefault(i, set()).update(terms(t))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.mark.parametrize(("tree", "leaf", "block"), [(4096, 32, 200_000), (8, 2, 30)])
def test_agrees_with_brute_force(spark, odd_docs, odd_rows, tree, leaf, block):
    texts = [(k, t) for k, (_, t) in enumerate(odd_rows[:14])]
    texts += [(3, "again one"), (None, "ther on"), (90, ""), (91, None), (92, "nowhere-known"), (93, "ther " * 9), (94, "X" * 30_000)]
    got = balltree.rank(odd_docs, items_of(spark, texts), k=4, tree=tree, leaf=leaf, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(odd_rows, merged(texts), 4), key=key)


def test_empty_tables(spark, odd_docs, no_docs):
    some = items_of(spark, [(1, "ther on")])
    assert balltree.rank(no_docs, some).count() == 0
    assert balltree.rank(odd_docs, some.filter("false")).count() == 0


def test_ties_and_copies(spark):
    docs = [(i, "alpha beta") for i in range(300)] + [(i, f"gamma d{i}") for i in range(300, 340)]
    table = spark.createDataFrame(docs[::-1], "doc_id long, text string")
    texts = [(1, "alpha"), (2, "BETA gamma"), (3, "gamma")]
    got = balltree.rank(table, items_of(spark, texts), tree=64, leaf=8)
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, merged(texts)))


def sparse(rng, rows, width):
    lists = [sorted(rng.sample(range(width), rng.randint(0, 12))) for _ in range(rows)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.array([t for x in lists for t in x], dtype=np.int64)
    return starts, flat, np.array([rng.randint(0, 10**10) for _ in flat], dtype=np.int64)


def test_no_member_is_above_its_nodes_bound():
    rng = random.Random(3)
    starts, flat, values = sparse(rng, 500, 80)
    tree = balltree.BallTree(starts, flat, values, 80, leaf=4)
    dense = np.zeros((500, 80), dtype=np.int64)
    for i in range(500):
        dense[i, flat[starts[i] : starts[i + 1]]] = values[starts[i] : starts[i + 1]]
    wanted = [sorted(rng.sample(range(80), rng.randint(1, 9))) for _ in range(40)]
    items = balltree.Items(
        list(range(40)), np.array([t for w in wanted for t in w]), np.cumsum([0, *map(len, wanted)])[:-1], {}
    )
    exact = np.stack([dense[:, w].sum(axis=1) for w in wanted])
    for node, members in enumerate(tree.members):
        assert (tree.bound(node, items, np.zeros(80)) >= exact[:, members].max(axis=1)).all()
    leaves = [m for c, m in zip(tree.children, tree.members, strict=True) if c is None]
    assert sorted(np.concatenate(leaves)) == list(range(500))


def test_subtrees_are_left_out(spark):
    """On the given texts, trees score a part of the documents only, and still find the best."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counted = [Counter(terms(t)) for _, t in docs]
    wanted = [list(set(terms(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    vocabulary = {t: k for k, t in enumerate(sorted({t for w in wanted for t in w}))}
    df = Counter(t for c in counted for t in c)
    rows = [[(vocabulary[t], int(1000 * math.log(len(docs) / df[t]) * n / (n + 1))) for t, n in c.items() if t in vocabulary] for c in counted]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    tree = balltree.BallTree(
        starts, np.array([t for r in rows for t, _ in r]), np.array([v for r in rows for _, v in r]), len(vocabulary), leaf=4
    )
    items = balltree.Items(
        list(range(len(wanted))), np.array([vocabulary[t] for w in wanted for t in w]),
        np.cumsum([0, *map(len, wanted)])[:-1], {},
    )
    best = balltree.Best(len(wanted), 1, np.ones(len(wanted), dtype=np.int64))
    best.ids = list(range(len(rows)))
    tree.search(items, best)
    for item, heap in enumerate(best.heaps):
        scores = [sum(v for t, v in r if t in set(items.terms(item).tolist())) for r in rows]
        assert heap[0][0] == max(scores)
    assert tree.scored < len(rows) * len(wanted) / 2


def test_query_agrees_with_sql(spark):
    name = "op11_ball_tree_search"
    assert compare(spark, duck(SF), name, queries.QUERIES[name], twins.ORACLES[name], SF) is None
