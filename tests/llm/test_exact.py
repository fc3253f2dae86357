import hashlib
from collections import defaultdict

import pytest

from orrery.llm import exact, queries

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _brute(rows, keep):
    """Groups of (id, text) rows by whole normalised text."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(str.maketrans(UPPER, LOWER))].append(key)
    out = []
    for norm, keys in groups.items():
        known = [k for k in keys if k is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out += [(k, best, len(keys), hashlib.sha256(norm.encode()).hexdigest()) for k in keys]
    return sorted(out, key=repr)


CASES = [(1, "Same text"), (2, "same TEXT"), (3, "ÄB"), (4, "äb"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (9, "x" * 199_999 + "y"),
         (10, "same text "), (11, "a\nb"), (12, "A\nB"), (11, "a\nb"), (None, "lone"), (None, "same text"), (None, "pair"), (None, "Pair")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot", [0, 600])
def test_groups_equal_brute_force(spark, keep, hot):
    """With many copies the group is dealt over shares, and united again."""
    rows = CASES + [(100 + k, "Hot" if k % 2 else "hot") for k in range(hot)] + [(10_000 + k, f"{'license ' * 20}{k}") for k in range(hot // 2)]
    found = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep=keep).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == _brute(rows, keep)
    kept = defaultdict(list)
    for r in found:
        if r.kept:
            kept[r.text_sha256].append(r)
    assert set(kept) == {r.text_sha256 for r in found}
    assert all(len(rs) == 1 and rs[0].doc_id == rs[0].keep_id for rs in kept.values())


def test_hot_text_is_dealt_over_shares_and_ranges(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('text ', id) END AS text")
    found = exact.exact_groups(rows, keep="largest")
    assert found.where("text = 'Hot'").select("keep_id", "group_size").distinct().collect() == [(3999, 1334)]
    assert found.where("kept").count() == 4000 - 1333


def test_one_sort_and_one_exchange(spark):
    """The range partitioning serves the window; texts are shuffled once."""
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = docs.withColumn("head", F.substring("text", 1, 4)).repartitionByRange("head").withColumn("n", F.lower("text"))
    plan = ranged.withColumn("k", F.row_number().over(Window.partitionBy("head", "n").orderBy("doc_id")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort") == 1


def test_names_types_and_empty(spark):
    docs = spark.createDataFrame([(1, "A", 7, "x"), (2, "a", 8, "y")], "doc_id long, text string, share int, KEEP_ID string").withColumnRenamed("share", "norm")
    found = exact.exact_groups(docs)
    assert found.columns == ["doc_id", "text", "norm", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.norm, r.keep_id, r.kept) for r in found.collect()) == [(1, 7, 1, True), (2, 8, 1, False)]
    assert exact.exact_groups(docs.limit(0)).count() == 0
    assert "text" not in exact.exact_groups(docs, with_text=False).columns


def test_query_over_the_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_exact_dedup(spark, small).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == _brute([tuple(r) for r in docs], "largest")
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
