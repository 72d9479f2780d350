import re
import statistics
from collections import Counter

import duckdb

from stratapanel.llm import rules, twins


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dups, len(covered))


def test_measures_against_brute_force(odd_rows):
    for _, t in odd_rows:
        assert rules.measure((t or "").encode()) == brute(t or "")


def brute_fails(text):
    n, chars, symbols, lines, dups, rep = brute(text)
    return (n < 50, 2 * rep > n, 10 * symbols > n, 10 * dups > 3 * lines, chars < 2 * n or chars > 15 * n)


def brute_kept(rows):
    """Which of (text, host) rows stay."""
    fails = [brute_fails(t or "") for t, _ in rows]
    by = {}
    for f, (_, h) in zip(fails, rows):
        by.setdefault(h, []).append(f)
    bad = set()
    for r in range(5):
        rates = [sum(f[r] for f in fs) / len(fs) for fs in by.values()]
        m, v = statistics.fmean(rates), statistics.pvariance(rates)
        c = max(m * (1 - m) / v - 1, 0) if v > 0 else None  # none: the hosts do not differ
        for h, fs in by.items():
            rate = (sum(f[r] for f in fs) + c * m) / (len(fs) + c) if c is not None else m
            if rate > 0.5:
                bad.add(h)
    return [not (f[0] or f[1] or h in bad and any(f)) for f, (_, h) in zip(fails, rows)], bad


def test_verdicts_and_columns(odd_docs, odd_rows, no_docs):
    kept = rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    stays, bad = brute_kept([(t, f"src{k % 3}" if k % 5 else None) for k, (_, t) in enumerate(odd_rows)])
    assert bad  # the fixture has a host that is distrusted
    assert got == sorted((i is None, i or 0, t or "") for s, (i, t) in zip(stays, odd_rows) if s)
    assert rules.keep_good(no_docs).collect() == []


def test_a_bad_host_is_distrusted_and_clean_documents_stay(spark):
    good = " ".join(f"word{i} runs" for i in range(60))
    noisy = good + " ||| ### $$$ %%% " * 10
    rows = [(i, good, f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, noisy, "bad") for i in range(60)] + [(2000, good, "bad"), (2001, noisy, "h1"), (2002, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = rules.with_measures(docs, keep=["doc_id", "source"]).persist()
    verdicts = {r.host: r.distrusted for r in rules.host_verdicts(measured).collect()}
    assert verdicts.pop("bad") and not any(verdicts.values()) and None in verdicts
    kept = {r.doc_id for r in rules.judge(measured).filter("kept").collect()}
    assert kept == {*range(400), 2000, 2001, 2002}
    measured.unpersist()


def test_small_hosts_shrink_to_the_mean(spark):
    good = " ".join(f"word{i} runs" for i in range(60))
    noisy = good + " ||| ### $$$ %%% " * 10
    rows = [(i, noisy if i % 10 == 0 else good, f"h{i % 19}") for i in range(1900)] + [(5000, noisy, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = rules.with_measures(docs, keep=["doc_id", "source"]).persist()
    rate = {r.host: r.rate_symbols for r in rules.host_verdicts(measured).collect()}
    assert 0.1 < rate["tiny"] < 1.0
    measured.unpersist()


def verdicts(spark, rows):
    measured = rules.with_measures(spark.createDataFrame(rows, "text string, source string"), keep=["source"])
    return {r.host: r.distrusted for r in rules.host_verdicts(measured).collect()}


def test_hosts_that_fail_always_or_never_keep_their_own_rate(spark):
    good = " ".join(f"word{i} runs" for i in range(60))
    noisy = good + " ||| ### $$$ %%% " * 10
    two = [(good, "clean")] * 10 + [(noisy, "bad")] * 10
    assert verdicts(spark, two) == {"clean": False, "bad": True}
    assert verdicts(spark, two + [(noisy, "bad too")] * 10) == {"clean": False, "bad": True, "bad too": True}


def test_sql_twin_and_brute_force_on_extreme_hosts(spark):
    """Hosts that always or never fail, and hosts that do not differ: all three say the same."""
    good = " ".join(f"word{i} runs" for i in range(60))
    noisy = good + " ||| ### $$$ %%% " * 10
    for rows in (
        [(good, "clean")] * 10 + [(noisy, "bad")] * 10, [(noisy, "a")] * 3 + [(noisy, "b")] * 4,
        [(good, None)] * 3 + [(noisy, "b")] * 4 + [(noisy, "c"), (good, "c")],
    ):
        numbered = [(i, t, h) for i, (t, h) in enumerate(rows)]
        docs = spark.createDataFrame(numbered, "doc_id long, text string, source string")
        got = {r.doc_id: (r.host_distrusted, r.kept) for r in rules.judge(rules.with_measures(docs)).collect()}
        con = duckdb.connect()
        con.register("frame", docs.toPandas())
        con.execute("CREATE VIEW documents AS SELECT * FROM frame")
        sql = {r[0]: r[1:] for r in con.execute(
            f"SELECT doc_id, host_distrusted, kept FROM ({twins.ORACLES['op7_host_rules']})").fetchall()}
        stays, bad = brute_kept(rows)
        assert got == sql == {i: (h in bad, k) for (i, _, h), k in zip(numbered, stays)}
