import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratapanel.llm import neardup, rules
from stratapanel.llm.queries import QUERIES
from tests.llm.test_alike import brute_first
from tests.llm.test_rules import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = docs.collect()
    rows = {r.doc_id: r.text for r in every}
    ruled = cp.quality_rules(spark, docs, SF)
    kept = {r.doc_id: r.text for r in ruled.collect()}
    stays, _ = brute_kept([(r.text, r.source) for r in every])
    assert set(kept) == {r.doc_id for s, r in zip(stays, every) if s} and ruled.schema == docs.schema
    classed = cp.quality_classifier(spark, ruled, SF)
    good = {r.doc_id for r in classed.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in kept if quality.get(i) == 1]
    assert sum(i in good for i in clean) / len(clean) > 0.9 and classed.schema == docs.schema
    single = cp.near_duplicates(spark, classed, SF)
    groups = brute_first(sorted((i, rows[i] or "") for i in good))
    ones = [r.doc_id for r in single.collect()]
    assert sorted(ones) == sorted(set(groups.values())) and single.schema == docs.schema
    mixed = cp.mix_sources(spark, single, SF)
    assert {r.doc_id for r in mixed.collect()} == set(ones) and mixed.schema == docs.schema
    packed = cp.pack_sequences(spark, mixed, SF)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(r.n == r.d * times[r.doc_id] for r in sums) and len(sums) == len(times)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    got = cp.run(spark, SF)
    order = ["doc_id", "start", "sequence_id"]
    assert got.columns == docs.columns
    assert got.drop("ids").orderBy(order).collect() == docs.drop("ids").orderBy(order).collect()


def test_working_tables_of_former_stages_go(spark):
    from stratapanel.sources import scratch

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = scratch.cut_lineage(docs, "not-ours")
    cp.quality_rules(spark, docs, SF)
    first = list(cp._left)
    assert first and set(first) <= set(scratch.made())
    written = scratch.cut_lineage(docs, "written")
    cp.mix_sources(spark, written, SF).count()
    assert not set(first) & set(scratch.made())
    assert other.count() == written.count() == docs.count()


def test_stages_take_empty_tables_and_extra_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        frame = docs
        for _, stage in cp.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs.columns
        cp.STAGES[-1][1](spark, frame, SF).collect()


def test_stages_take_the_operators_own_names(spark, odd_docs):
    names = ("tokens", "weight", "position", "size", "ids", "curve", "kept", "quality_score", "component_id", "source_weight")
    clash = odd_docs.withColumns({c: F.lit(c) for c in names})
    for _, stage in cp.STAGES[:-1]:
        plain, other = stage(spark, odd_docs, SF).collect(), stage(spark, clash, SF).collect()
        assert sorted(map(repr, plain)) == sorted(repr(type(plain[0])(**{c: r[c] for c in odd_docs.columns})) for r in other)
        assert all(r[c] == c for r in other for c in names)
    keys = ("doc_id", "start", "sequence_id", "offset", "ids_crc32")
    plain, other = (cp.pack_sequences(spark, d, SF).select(*keys).collect() for d in (odd_docs, clash))
    assert sorted(map(repr, plain)) == sorted(map(repr, other))


def test_without_labels_and_with_one_source(spark, odd_docs, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("false")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scored = cp.quality_classifier(spark, odd_docs, str(tmp_path))  # no labels: every score is 0.5, nothing goes
    assert scored.count() == odd_docs.count()
    single = odd_docs.withColumn("source", F.lit("only"))
    mixed = cp.mix_sources(spark, single, SF)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, single.collect()))


def test_every_query_runs(spark):
    for name, query in QUERIES.items():
        assert query(spark, SF).count() > 0, name


def test_the_rest_of_the_library_does_not_need_this_package(tmp_path):
    """With the package hidden, the entry module imports and offers the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        "import sys; sys.modules['stratapanel.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100\n"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_rules_and_groups_are_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_query = {r.doc_id: r.kept for r in QUERIES["op7_host_rules"](spark, SF).collect()}
    assert {i for i, k in by_query.items() if k} == {r.doc_id for r in rules.keep_good(docs).collect()}
    groups = {r.doc_id: r.component_id for r in QUERIES["op10_simhash_groups"](spark, SF).collect()}
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == set(groups.values())
