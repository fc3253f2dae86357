"""Laws of the weighted metrics, and the values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import metrics as M

SCHEMA = "dataset_name string, label int, predicted int, probs array<double>, correct boolean, inference_time_ms double, status string, aug_pass boolean, w double"
ROWS = [(1, 1, 0.9, 3.0), (0, 0, 0.2, 1.0), (1, 0, 0.4, 2.0), (0, 1, 0.7, 1.0), (1, 1, 0.6, 4.0)]


def _frame(spark, rows, name="public-a"):
    return spark.createDataFrame([(name, y, p, [1 - q, q], y == p, 5.0, "ok", None, w) for y, p, q, w in rows], SCHEMA)


def _pack(frame, weight=None):
    return M.metric_pack(frame, weight).drop("n", "avg_ms", "p95_ms").first().asDict()


def test_balanced_matrix_has_no_correlation(spark):
    pack = _pack(_frame(spark, ROWS[:4]))
    assert pack["mcc"] == 0 and pack["brier"] == pytest.approx((0.01 + 0.04 + 0.36 + 0.49) / 4)


def test_weight_means_copies(spark):
    copies = [r for r in ROWS for _ in range(int(r[3]))]
    assert _pack(_frame(spark, ROWS), F.col("w")) == pytest.approx(_pack(_frame(spark, copies)))


def test_scale_of_weights_is_free(spark):
    frame = _frame(spark, ROWS[:3])
    assert _pack(frame, F.lit(7.5)) == pytest.approx(_pack(frame))


def test_nothing_gives_defaults(spark):
    row = M.metric_pack(_frame(spark, []).limit(0)).first()
    assert (row.n, row.accuracy, row.brier, row.score) == (0, 0, 0.25, 0)


def _mixed(spark):
    right = spark.createDataFrame([("public-x", 1, 1, [0.1, 0.9], True, 1.0, "ok", False, 1.0)] * 8, SCHEMA)
    return right.union(spark.createDataFrame([("real-image-holdout-1", 1, 0, [0.9, 0.1], False, 1.0, "ok", False, 1.0)] * 2, SCHEMA))


def test_composition(spark):
    rows = _mixed(spark)
    weights = M.provenance_weights(rows, {"public": 0.5, "holdout": 0.5})
    assert {r.provenance: r.weight for r in weights.collect()} == pytest.approx({"public": 0.625, "holdout": 2.5})
    pack = _pack(rows)
    assert pack["accuracy"] == pytest.approx(0.8) and pack["brier"] == pytest.approx((8 * 0.01 + 2 * 0.81) / 10)
    assert _pack(M.weighted(rows, weights), F.col("weight"))["accuracy"] == pytest.approx(0.5)
    legacy = _pack(rows, F.lit(1.0))
    assert rows.agg(M.accuracy(F.when(F.contains("dataset_name", F.lit("-holdout-")), 4.0).otherwise(1.0))).first()[0] < legacy["accuracy"]


def test_weights_hit_target_shares(spark):
    names = ["public-a"] * 80 + ["x-holdout-1"] * 15 + ["rolling-1"] * 5
    rows = spark.createDataFrame([(n,) for n in names], "dataset_name string")
    shares = {"public": 0.5, "holdout": 0.3, "rolling": 0.2}
    out = {r.provenance: r for r in M.provenance_weights(rows, shares).collect()}
    assert {c: r.weight * r.n / 100 for c, r in out.items()} == pytest.approx(shares)
    absent = {r.provenance: r.weight * r.n / 95 for r in M.provenance_weights(rows.where("dataset_name not like 'rolling%'"), shares).collect()}
    assert absent == pytest.approx({"public": 0.625, "holdout": 0.375})
    assert [r.weight for r in M.provenance_weights(rows.where("dataset_name like 'pub%'"), {"holdout": 1.0}).collect()] == [1.0]


def test_names_and_shares(spark):
    names = {"real-image-holdout-a1b2c3d4": "holdout", "rolling-image-w23": "rolling", "ROLLING-VIDEO": "rolling", "34data/pica-100k": "public", None: "public"}
    rows = spark.createDataFrame([(k,) for k in names], "n string").select("n", M.provenance(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in rows} == names
    assert M.composition({"holdout": 0.3, "rolling": 0.2})["public"] == pytest.approx(0.5)
    for bad in ({"holdout": -0.1}, {"holdout": 0.7, "rolling": 0.4}):
        with pytest.raises(ValueError):
            M.composition(bad)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_partitioning_does_not_matter(spark, parts):
    from orrery.operators import sampling as S

    rows = spark.range(500).select("id", (F.col("id") % 7).alias("g")).repartition(parts)
    got = {(r.g, r.id) for r in S.seeded_sample(rows, "g", "id", 9).collect()}
    assert got == {(r.g, r.id) for r in S.seeded_sample(rows.coalesce(1), "g", "id", 9).collect()} and len(got) == 63
    filtered = {(r.g, r.id) for r in S.seeded_sample(rows, "g", "id", 9, prefilter_above=20).collect()}
    assert filtered == got


def test_first_rows_of_a_hot_group_are_kept_before_the_shuffle(spark):
    """No partition sends more of a group than the cap, and the rows are those of a plain window; nulls and ties stand too."""
    from orrery.operators import ingest as N
    from orrery.operators import topk

    rows = spark.range(90_000, numPartitions=3).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("iso_week"),
        F.when(F.col("id") % 1000 != 5, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("idx"), F.array(F.col("id")).alias("list"))
    sent = topk.keep_first(rows, "iso_week", [F.coalesce(F.col("idx"), F.lit(0))], 2_500).groupBy("iso_week", F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sent) == 2_500 and {r.iso_week for r in sent} >= {"hot", None}
    for drop, order in (("oldest", F.desc("idx")), ("newest", F.asc("idx"))):
        from pyspark.sql import Window

        want = rows.withColumn("k", F.row_number().over(Window.partitionBy("iso_week").orderBy(order))).where("k <= 2500").groupBy("iso_week", "idx").count().collect()
        got = N.evict(rows, cap=2_500, drop=drop).groupBy("iso_week", "idx").count().collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_first_rows_with_a_cap_for_each_row(spark):
    from orrery.operators import sampling as S

    rows = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 3 * 4).alias("cap"))
    got = S.seeded_sample(rows, "g", "id", F.col("cap"))
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {1: 4, 2: 8}
    assert S.seeded_sample(rows.limit(0), "g", "id", 3).count() == 0
