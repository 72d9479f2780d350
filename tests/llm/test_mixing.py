import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import mixing
from stratapanel.sources.scratch import cut_lineage


def shares(spark, p):
    return cut_lineage(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "source string, share double"), "s")


def entropy(p, e):
    w = [x**e for x in p]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def test_exponent_meets_entropy_and_limit(spark):
    p = [0.6, 0.25, 0.1, 0.05]
    df = shares(spark, p)
    for want in (0.85, 0.95, 0.999):
        e = mixing.exponent(df, target_entropy=want)
        assert entropy(p, e) == pytest.approx(want * math.log(4), abs=1e-5)
    assert mixing.exponent(df, target_entropy=0.1) == pytest.approx(1.0, abs=1e-6)
    for limit in (1.5, 3.0):
        e = mixing.exponent(df, max_repeat=limit)
        assert (p[0] / p[-1]) ** (1 - e) == pytest.approx(limit)
    assert mixing.exponent(df, max_repeat=100.0) == 0.0
    both = mixing.exponent(df, target_entropy=0.999, max_repeat=2.0)
    assert both == pytest.approx(mixing.exponent(df, max_repeat=2.0))
    assert mixing.exponent(shares(spark, [1.0]), max_repeat=2.0) == 1.0


def test_mix_keeps_budgets_and_every_document(odd_docs, odd_rows, no_docs):
    n = {k: len([w for w in (t or "").encode().split()]) for k, (_, t) in enumerate(odd_rows)}
    source = {k: f"src{k % 3}" if k % 5 else None for k in n}
    total = defaultdict(int)
    for k in n:
        total[source[k]] += max(n[k], 1)
    got = mixing.mix(odd_docs, mixing.text_tokens(F.col("text")), max_repeat=1.7, carry=odd_docs.columns).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    top = max(total.values())
    for s, rows in by.items():
        used, budget = sum(r.tokens for r in rows), rows[0].repeats * total[s]
        longest = max(r.tokens for r in rows)
        assert budget <= used < budget + longest
        first = Counter((r.doc_id, r.text) for r in rows if r.pass_no == 0)
        assert first == Counter((odd_rows[k][0], odd_rows[k][1]) for k in n if source[k] == s)
        for p in {r.pass_no for r in rows}:  # token offsets of a pass have no gaps
            at = 0
            for before, tokens in sorted((r.tokens_before, r.tokens) for r in rows if r.pass_no == p):
                assert before == p * total[s] + at
                at += tokens
    assert sum({r.source: r.weight for r in got}.values()) == pytest.approx(1.0)
    assert max(r.repeats for r in got) == pytest.approx(1.7, abs=1e-6)
    assert {r.repeats for r in by[next(s for s in total if total[s] == top)]} == {1.0}
    assert mixing.mix(no_docs, mixing.text_tokens(F.col("text")), max_repeat=2.0).collect() == []


def test_passes_differ_and_runs_agree(spark):
    docs = spark.createDataFrame([(i, "a" if i % 9 else "b", "w " * 5) for i in range(900)], "doc_id long, source string, text string")
    runs = [
        [(r.doc_id, r.pass_no) for r in mixing.mix(docs, F.lit(5), max_repeat=3.0).orderBy("position", "doc_id").collect()]
        for _ in range(2)
    ]
    assert runs[0] == runs[1]
    small = [[d for d, p in runs[0] if p == k and d % 9 == 0] for k in range(3)]
    assert all(len(s) == 100 for s in small) and small[0] != small[1]
    # any stretch of the mix has its sources in proportion
    part = runs[0][: len(runs[0]) // 4]
    share = sum(d % 9 == 0 for d, _ in part) / len(part)
    assert share == pytest.approx(300 / 1100, abs=0.03)


def test_blocks_and_passes_against_brute_force(spark, odd_docs):
    limit, rng = 2.5, range(400)
    more = spark.createDataFrame([(50_000 + i, "hot" if i % 4 else "rare", "w " * (1 + i % 7)) for i in rng], "doc_id long, source string, text string")
    docs = odd_docs.select("doc_id", "source", "text").unionByName(more)
    ident = F.xxhash64("doc_id", "text")
    facts = [r.asDict() for r in docs.select("doc_id", "source", "text", ident.alias("ident")).collect()]
    for f in facts:
        f["tokens"] = max(len((f["text"] or "").encode().split()), 1)
    total, count = Counter(), Counter(f["source"] for f in facts)
    for f in facts:
        total[f["source"]] += f["tokens"]
    high, low = max(total.values()), min(total.values())
    e = max(0.0, 1 - math.log(limit) / math.log(high / low))
    raised = {s: (t / sum(total.values())) ** e for s, t in total.items()}
    per = {s: x / total[s] for s, x in raised.items()}
    repeats = {s: per[s] / min(per.values()) for s in per}
    shown = [(f["ident"], p) for f in facts for p in range(math.ceil(round(repeats[f["source"]], 6)))]
    hashes = spark.createDataFrame(sorted(set(shown)), "ident long, p int").select(
        "ident", "p", F.xxhash64("ident", "p", F.lit("block")).alias("b"), F.xxhash64("ident", "p", F.lit("turn")).alias("t")
    )
    deal = {(r.ident, r.p): (r.b, r.t) for r in hashes.collect()}
    want = Counter()
    for s in total:
        for p in range(math.ceil(round(repeats[s], 6))):
            # below 4096 rows a block stands for one row on average
            mine = [(deal[f["ident"], p][0] % count[s], deal[f["ident"], p][1], f["doc_id"] is not None, f["doc_id"] or 0, f["tokens"], f["doc_id"]) for f in facts if f["source"] == s]
            at = p * total[s]
            for block, *_, tokens, doc in sorted(mine):
                if at < round(repeats[s], 6) * total[s]:
                    want[s, p, block, at, tokens, doc] += 1
                at += tokens
    got = mixing.mix(docs, mixing.text_tokens(F.col("text")), max_repeat=limit).collect()
    assert Counter((r.source, r.pass_no, r.block, r.tokens_before, r.tokens, r.doc_id) for r in got) == want
    weight = {s: x / sum(raised.values()) for s, x in raised.items()}
    assert all(r.weight == pytest.approx(weight[r.source], rel=1e-6) for r in got)
    assert all(r.position == pytest.approx(r.tokens_before / repeats[r.source] / total[r.source], rel=1e-6, abs=1e-9) for r in got)


def test_names_of_the_operators_own_columns_in_the_input(odd_docs):
    names = ("tokens", "weight", "position", "block", "pass_no", "repeats", "docs", "ident", "turn", "w_tokens")
    clash = odd_docs.withColumns({c: F.lit(c) for c in names})
    plain, other = (
        mixing.mix(d, mixing.text_tokens(F.col("text")), max_repeat=1.7).collect() for d in (odd_docs, clash)
    )
    assert sorted(map(repr, plain)) == sorted(map(repr, other))
    carried = mixing.mix(clash, mixing.text_tokens(F.col("text")), max_repeat=1.7, carry=clash.columns).select(*clash.columns)
    rows = carried.collect()
    assert len(rows) == len(plain) and all(r[n] == n for r in rows for n in names)
