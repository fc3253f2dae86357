"""Queries over run records: metrics, weights, breakdowns, robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import EVT, REC, REG, TILE, records, registry, rolling
from ..functions import scores
from ..operators import breakdowns as B
from ..operators import metrics as M
from .common import Book, r6

book = Book()
SHARES = {"public": 0.5, "holdout": 0.3, "rolling": 0.2}
_OK = " ok AS (SELECT * FROM rec WHERE status = 'ok' AND NOT coalesce(aug_pass, false)), aug AS (SELECT * FROM rec WHERE status = 'ok' AND aug_pass)"
_PROV = "CASE WHEN contains(lower(coalesce(dataset_name, '')), '-holdout-') THEN 'holdout' WHEN contains(lower(coalesce(dataset_name, '')), 'rolling') THEN 'rolling' ELSE 'public' END"


def _pack_sql(source: str, weight: str = "1.0", by: str = "", agg: str = "geomean") -> str:
    """Metric pack over ``source`` in SQL."""
    group, key = (f"GROUP BY {by}", f"{by},") if by else ("", "")
    final = {"geomean": "sqrt(greatest(1e-12, m * b))", "harmmean": "2 * m * b / greatest(1e-12, m + b)", "mean": "0.5 * (m + b)"}[agg]
    return f"""
    sums AS (
      SELECT {key} count(*) AS n, coalesce(sum(CASE WHEN coalesce(len(probs), 0) = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS missing_probs,
        coalesce(sum(correct::INT * {weight}) / sum({weight}), 0.0) AS accuracy, coalesce(avg(inference_time_ms), 0.0) AS avg_ms, coalesce(quantile_cont(inference_time_ms, 0.95), 0.0) AS p95_ms,
        coalesce(sum({weight}) FILTER (label = 1 AND predicted = 1), 0.0) AS tp, coalesce(sum({weight}) FILTER (label = 0 AND predicted = 0), 0.0) AS tn,
        coalesce(sum({weight}) FILTER (label = 0 AND predicted = 1), 0.0) AS fp, coalesce(sum({weight}) FILTER (label = 1 AND predicted = 0), 0.0) AS fn,
        coalesce(sum(-{weight} * (label * ln(q) + (1 - label) * ln(1 - q))) / sum({weight}), 0.0) AS cross_entropy,
        coalesce(sum({weight} * (q - label) * (q - label)) / sum({weight}), 0.25) AS brier
      FROM (SELECT *, greatest(1e-7, least(probs[2], 1 - 1e-7)) AS q FROM {source}) {group}),
    with_mcc AS (SELECT *, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0.0 END AS mcc FROM sums),
    norms AS (SELECT *, pow(greatest(0.0, least((mcc + 1) / 2, 1.0)), 1.2) AS m, pow(greatest(0.0, (0.25 - brier) / 0.25), 1.8) AS b FROM with_mcc),
    pack AS (SELECT *, CASE WHEN n > 0 THEN greatest(0.0, least({final}, 1.0)) ELSE 0.0 END AS score FROM norms)"""


_PACK = "n, missing_probs, round(accuracy, 6) AS accuracy, round(avg_ms, 6) AS avg_ms, round(p95_ms, 6) AS p95_ms, round(cross_entropy, 6) AS cross_entropy, round(brier, 6) AS brier, round(mcc, 6) AS mcc, round(score, 6) AS score"
_R = ("accuracy", "avg_ms", "p95_ms", "cross_entropy", "brier", "mcc", "score")


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok')} SELECT {_PACK} FROM pack")
def a11_metric_pack(spark, sf_dir):
    return M.metric_pack(M.ok_rows(records(spark, sf_dir))).withColumns(r6(*_R))


@book.add(f"WITH {REC}, nothing AS (SELECT * FROM rec WHERE status = 'none'), {_pack_sql('nothing')} SELECT {_PACK} FROM pack")
def a11_metric_pack_of_nothing(spark, sf_dir):
    return M.metric_pack(records(spark, sf_dir).where("status = 'none'")).withColumns(r6(*_R))


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok', agg='harmmean')} SELECT {_PACK} FROM pack")
def a05_score_harmonic(spark, sf_dir):
    return M.metric_pack(M.ok_rows(records(spark, sf_dir)), agg="harmmean").withColumns(r6(*_R))


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok', agg='mean')} SELECT {_PACK} FROM pack")
def a05_score_mean(spark, sf_dir):
    return M.metric_pack(M.ok_rows(records(spark, sf_dir)), agg="mean").withColumns(r6(*_R))


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok', by='dataset_name')} SELECT dataset_name, {_PACK} FROM pack")
def a11_metric_pack_by_dataset(spark, sf_dir):
    return M.metric_pack(M.ok_rows(records(spark, sf_dir)), by=["dataset_name"]).withColumns(r6(*_R))


@book.add(f"""WITH {REC}, {_OK} SELECT media_type, count(*) FILTER (label = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND predicted = 0)::DOUBLE AS tn,
    count(*) FILTER (label = 0 AND predicted = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND predicted = 0)::DOUBLE AS fn FROM ok GROUP BY media_type""")
def a01_confusion(spark, sf_dir):
    return M.ok_rows(records(spark, sf_dir)).groupBy("media_type").agg(*M.confusion())


_WEIGHTS = f"""
 counts AS (SELECT {_PROV} AS provenance, count(*) AS n FROM ok GROUP BY 1),
 targets AS (SELECT *, CASE provenance WHEN 'public' THEN 0.5::DOUBLE WHEN 'holdout' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS target FROM counts),
 weights AS (SELECT provenance, n, n / sum(n) OVER () AS realized, target / sum(target) OVER () * sum(n) OVER () / n AS weight FROM targets)"""


@book.add(f"WITH {REC}, {_OK}, {_WEIGHTS} SELECT provenance, n, round(realized, 6) AS realized, round(weight, 6) AS weight FROM weights")
def a10_provenance_weights(spark, sf_dir):
    return M.provenance_weights(M.ok_rows(records(spark, sf_dir)), M.composition({"holdout": 0.3, "rolling": 0.2})).withColumns(r6("realized", "weight"))


@book.add(f"WITH {REC}, {_OK}, {_WEIGHTS}, w AS (SELECT ok.*, weight FROM ok JOIN weights ON {_PROV} = provenance), {_pack_sql('w', 'weight')} SELECT {_PACK} FROM pack")
def j03_weighted_metric_pack(spark, sf_dir):
    rows = M.ok_rows(records(spark, sf_dir))
    return M.metric_pack(M.weighted(rows, M.provenance_weights(rows, SHARES)), F.col("weight")).withColumns(r6(*_R))


@book.add(f"WITH {REC}, {_OK}, {_WEIGHTS}, w AS (SELECT aug.*, coalesce(weight, 1.0) AS weight FROM aug LEFT JOIN weights ON {_PROV} = provenance), {_pack_sql('w', 'weight')} SELECT {_PACK} FROM pack")
def a12_augmented_weighted_pack(spark, sf_dir):
    all_rows = records(spark, sf_dir)
    weights = M.provenance_weights(M.ok_rows(all_rows), SHARES)
    return M.metric_pack(M.weighted(M.ok_rows(all_rows, True), weights), F.col("weight")).withColumns(r6(*_R))


@book.add(f"""WITH {REC}, {_OK}, {_WEIGHTS} SELECT round(avg(correct::INT), 6) AS plain, round(sum(correct::INT * h) / sum(h), 6) AS holdout_weighted, round(sum(correct::INT * weight) / sum(weight), 6) AS composed
    FROM (SELECT ok.*, weight, CASE WHEN contains(dataset_name, '-holdout-') THEN 4.0 ELSE 1.0 END AS h FROM ok JOIN weights ON {_PROV} = provenance)""")
def a06_three_accuracies(spark, sf_dir):
    rows = M.ok_rows(records(spark, sf_dir))
    holdout = F.when(F.contains("dataset_name", F.lit("-holdout-")), 4.0).otherwise(1.0)
    w = M.weighted(rows, M.provenance_weights(rows, SHARES))
    return w.agg(M.accuracy().alias("plain"), M.accuracy(holdout).alias("holdout_weighted"), M.accuracy(F.col("weight")).alias("composed")).withColumns(r6("plain", "holdout_weighted", "composed"))


@book.add(f"""WITH {REC}, {_OK}, c AS (SELECT {_PROV} AS provenance, count(*) AS n FROM ok GROUP BY 1)
    SELECT k.provenance, coalesce(n, 0) AS n, round(coalesce(n / (SELECT sum(n) FROM c), 0.0), 6) AS realized FROM (VALUES ('public'), ('holdout'), ('rolling')) k(provenance) LEFT JOIN c USING (provenance)""")
def a09_realized_composition(spark, sf_dir):
    return M.realized_composition(M.ok_rows(records(spark, sf_dir)), spark).withColumns(r6("realized"))


@book.add(f"""WITH {REC}, {_OK}, d AS (SELECT b.probs[b.label + 1] - a.probs[a.label + 1] AS drop FROM ok b JOIN aug a USING (sample_id))
    SELECT count(*) AS pairs, round(avg(drop), 6) AS mean_drop, round(quantile_cont(drop, 0.95), 6) AS p95_drop FROM d WHERE drop IS NOT NULL""")
def a13_paired_degradation(spark, sf_dir):
    return M.paired_degradation(records(spark, sf_dir)).withColumns(r6("mean_drop", "p95_drop"))


@book.add(f"""WITH {REC}, {_OK} , one AS (WITH {_pack_sql('ok')} SELECT * FROM pack), two AS (WITH {_pack_sql('aug')} SELECT * FROM pack)
    SELECT round(one.score, 6) AS base_score, two.n AS aug_n, round(two.score, 6) AS aug_score, round(two.mcc, 6) AS aug_mcc, round(two.cross_entropy, 6) AS aug_cross_entropy, round(two.brier, 6) AS aug_brier,
      round(CASE WHEN one.score > 0 THEN two.score / one.score ELSE 0.0 END, 6) AS robustness, round(0.7 * one.score + 0.3 * two.score, 6) AS blended FROM one, two""")
def a14_robustness_and_blend(spark, sf_dir):
    return M.robustness(records(spark, sf_dir)).withColumns(r6("base_score", "aug_score", "aug_mcc", "aug_cross_entropy", "aug_brier", "robustness", "blended"))


@book.add(f"WITH {REC}, {_OK} SELECT media_type, round(avg(inference_time_ms), 6) AS avg_ms, round(quantile_cont(inference_time_ms, 0.95), 6) AS p95_ms FROM ok GROUP BY media_type")
def a08_latency(spark, sf_dir):
    return M.latency(M.ok_rows(records(spark, sf_dir)), ["media_type"]).withColumns(r6("avg_ms", "p95_ms"))


_PER_DATASET = "SELECT dataset_name, count(*) FILTER (correct) AS correct, count(*) AS total, count(*) FILTER (predicted = 0) AS predicted_real, count(*) FILTER (predicted = 1) AS predicted_synthetic, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM ok GROUP BY dataset_name"


@book.add(f"WITH {REC}, {_OK} {_PER_DATASET}")
def a15_per_dataset(spark, sf_dir):
    return B.per_dataset(records(spark, sf_dir)).withColumns(r6("accuracy"))


@book.add(f"WITH {REC}, {_OK} SELECT media_type, count(*) FILTER (correct) AS correct, count(*) AS total, count(DISTINCT dataset_name) AS datasets, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM ok GROUP BY media_type")
def a19_by_media_type(spark, sf_dir):
    return B.by_media_type(records(spark, sf_dir)).withColumns(r6("accuracy"))


def _datasets(spark, sf_dir):
    """A registry of the records' datasets, and one that has no results."""
    found = records(spark, sf_dir).groupBy("dataset_name").agg(F.min("media_type").alias("media_type")).select(F.col("dataset_name").alias("name"), "media_type")
    return found.union(spark.createDataFrame([("public-none", "real")], "name string, media_type string"))


_DATASETS = "ds AS (SELECT dataset_name AS name, min(media_type) AS media_type FROM rec GROUP BY 1 UNION ALL SELECT 'public-none', 'real')"


@book.add(f"""WITH {REC}, {_OK}, {_DATASETS}, per AS ({_PER_DATASET}) SELECT name, ds.media_type, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, coalesce(predicted_real, 0) AS predicted_real,
    coalesce(predicted_synthetic, 0) AS predicted_synthetic, coalesce(accuracy, 0.0) AS accuracy FROM ds LEFT JOIN per ON name = dataset_name""")
def j04_per_source(spark, sf_dir):
    return B.per_source(_datasets(spark, sf_dir), B.per_dataset(records(spark, sf_dir))).withColumns(r6("accuracy"))


@book.add(f"""WITH {REC}, {_OK}, {_DATASETS}, per AS ({_PER_DATASET}) SELECT ds.media_type, name, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct FROM ds LEFT JOIN per ON name = dataset_name""")
def a18_source_document(spark, sf_dir):
    nested = B.source_document(_datasets(spark, sf_dir), B.per_dataset(records(spark, sf_dir)))
    return nested.select("media_type", F.explode("datasets").alias("name", "r")).select("media_type", "name", "r.total", "r.correct")


@book.add(f"""WITH {REC}, {_OK}, {_DATASETS}, per AS ({_PER_DATASET}) SELECT ds.media_type, sum(total)::BIGINT AS total, round(sum(correct) / sum(total), 6) AS accuracy FROM per JOIN ds ON name = dataset_name GROUP BY 1""")
def j05_results_by_registered_media_type(spark, sf_dir):
    joined = B.per_dataset(records(spark, sf_dir)).join(_datasets(spark, sf_dir), F.col("dataset_name") == F.col("name"))
    return joined.groupBy("media_type").agg(F.sum("total").alias("total"), F.round(F.sum("correct") / F.sum("total"), 6).alias("accuracy"))


@book.add(f"WITH {EVT} SELECT generator_hotkey AS generator, count(*) AS total, count(*) FILTER (label = predicted) AS correct, round(count(*) FILTER (label = predicted) / count(*), 6) AS accuracy FROM evt WHERE generator_hotkey IS NOT NULL GROUP BY 1")
def a16_per_generator(spark, sf_dir):
    return B.per_generator(rolling(spark, sf_dir)).withColumns(r6("accuracy"))


@book.add(f"""WITH {EVT} SELECT generator_hotkey, count(*) FILTER (predicted = 0) AS fooled, count(*) FILTER (predicted = 1) AS not_fooled, min(generator_uid) AS uid
    FROM evt WHERE label = 1 AND generator_hotkey IS NOT NULL AND generator_hotkey <> 'unknown' GROUP BY 1""")
def a17_fooling(spark, sf_dir):
    return B.fooling(rolling(spark, sf_dir))


@book.add(f"WITH {EVT} SELECT event_id, generator_hotkey FROM evt WHERE label = 1 AND generator_hotkey IS NOT NULL AND generator_hotkey <> 'unknown'")
def f12_generated_rows(spark, sf_dir):
    return rolling(spark, sf_dir).where(B.is_generated()).select("event_id", "generator_hotkey")


@book.add(f"""WITH {REC} SELECT dataset_name, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ok' AND correct) AS correct, count(*) FILTER (status = 'skipped') AS skipped
    FROM rec WHERE NOT coalesce(aug_pass, false) GROUP BY 1""")
def a20_counters(spark, sf_dir):
    return B.counters(records(spark, sf_dir))


@book.add(f"""WITH {REC} SELECT count(*) AS records, count(*) FILTER (status = 'ok') AS ok_all_passes, count(*) FILTER (status = 'ok' AND correct) AS correct_all_passes,
    count(*) FILTER (status = 'ok' AND NOT coalesce(aug_pass, false)) AS ok_base FROM rec""")
def a21_totals(spark, sf_dir):
    return B.totals(records(spark, sf_dir))


@book.add(f"WITH {REC}, {_OK} SELECT sample_id, label FROM ok")
def f08_ok_base_rows(spark, sf_dir):
    return M.ok_rows(records(spark, sf_dir)).select("sample_id", "label")


@book.add(f"WITH {REC}, {_OK} SELECT b.sample_id, round(b.probs[b.label + 1], 6) AS base, round(a.probs[a.label + 1], 6) AS aug FROM ok b JOIN aug a USING (sample_id)")
def j02_base_with_augmented(spark, sf_dir):
    p = scores.correct_probability()
    both = records(spark, sf_dir)
    return M.ok_rows(both).select("sample_id", F.round(p, 6).alias("base")).join(M.ok_rows(both, True).select("sample_id", F.round(p, 6).alias("aug")), "sample_id").dropna(subset=["base", "aug"])


@book.add(f"WITH {REC} SELECT sample_id, aug_pass, {_PROV} AS provenance FROM rec")
def p06_provenance(spark, sf_dir):
    return records(spark, sf_dir).select("sample_id", "aug_pass", M.provenance(F.col("dataset_name")).alias("provenance"))


@book.add(f"""WITH {REC} SELECT row_key, aug_pass, CASE media_type WHEN 'real' THEN 0 ELSE 1 END AS label, round(probs[2], 6) AS positive, round(probs[label + 1], 6) AS right_class,
    CASE WHEN probs IS NOT NULL THEN round(greatest(1e-7, least(probs[2], 1 - 1e-7)), 7) END AS clipped, predicted = label AS correct FROM rec""")
def p01_label_and_probabilities(spark, sf_dir):
    p = scores.positive("probs")
    return records(spark, sf_dir).select("row_key", "aug_pass", scores.label(F.col("media_type")).alias("label"), F.round(p, 6).alias("positive"), F.round(scores.correct_probability(), 6).alias("right_class"),
                                         F.round(F.when(p.isNotNull(), scores.clip(p)), 7).alias("clipped"), (F.col("predicted") == F.col("label")).alias("correct"))


def _by_dataset(spark, sf_dir, *names):
    return M.metric_pack(M.ok_rows(records(spark, sf_dir)), by=["dataset_name"]).select("dataset_name", *[F.round(n, 6).alias(n) for n in names])


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok', by='dataset_name')} SELECT dataset_name, round(mcc, 6) AS mcc FROM pack")
def a02_mcc(spark, sf_dir):
    return _by_dataset(spark, sf_dir, "mcc")


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok', by='dataset_name')} SELECT dataset_name, round(cross_entropy, 6) AS cross_entropy FROM pack")
def a03_cross_entropy(spark, sf_dir):
    return _by_dataset(spark, sf_dir, "cross_entropy")


@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok', by='dataset_name')} SELECT dataset_name, round(brier, 6) AS brier FROM pack")
def a04_brier(spark, sf_dir):
    return _by_dataset(spark, sf_dir, "brier")


@book.add(f"WITH {REC}, {_OK} SELECT dataset_name, round(avg(inference_time_ms), 6) AS avg_ms FROM ok GROUP BY 1")
def a07_mean_latency(spark, sf_dir):
    return _by_dataset(spark, sf_dir, "avg_ms")


@book.add(f"WITH {REC}, holed AS (SELECT sample_id, aug_pass, CASE WHEN group_key % 4 <> 0 THEN probs END AS probs FROM rec WHERE status = 'ok') SELECT b.sample_id FROM holed b JOIN holed a USING (sample_id) WHERE NOT b.aug_pass AND a.aug_pass AND b.probs IS NOT NULL AND a.probs IS NOT NULL")
def f11_paired_rows(spark, sf_dir):
    """Pairs of which either side has no probabilities are dropped."""
    holed = records(spark, sf_dir).where("status = 'ok'").withColumn("probs", F.when(F.col("group_key") % 4 != 0, F.col("probs")))
    side = lambda aug, name: holed.where(F.col("aug_pass") == aug).select("sample_id", F.col("probs").alias(name))
    return side(False, "base").join(side(True, "aug"), "sample_id").dropna(subset=["base", "aug"]).select("sample_id")


@book.add(f"WITH {REC} SELECT sample_id, aug_pass, round(probs[label + 1], 6) AS right_class, round(CASE label WHEN 1 THEN probs[2] ELSE 1 - probs[2] END, 6) AS right_class_binary FROM rec WHERE status = 'ok'")
def p10_right_class(spark, sf_dir):
    """By place in the list, and by P(synthetic)."""
    ok = records(spark, sf_dir).where("status = 'ok'")
    return ok.select("sample_id", "aug_pass", F.round(scores.correct_probability(), 6).alias("right_class"), F.round(scores.correct_probability(True), 6).alias("right_class_binary"))


@book.add(f"WITH {REC} SELECT aug_pass, dataset_name, media_type, status, inference_time_ms, group_key, row_key, sample_id, label, predicted, correct FROM rec")
def p25_without_heavy_columns(spark, sf_dir):
    """Records with lists, structs, bytes and maps beside them, all of which go."""
    from ..sources.tables import without_heavy

    rows = records(spark, sf_dir).withColumns({"media": F.col("row_key").cast("binary"), "place": F.struct("dataset_name"), "notes": F.create_map("sample_id", "status")})
    return without_heavy(rows)


@book.add(f"""WITH {TILE}, z AS (SELECT sample_id, label, list_sum(list_transform(range(1, 65), lambda i: vec[i] * (i % 5 - 2))) AS z FROM tile)
    SELECT sample_id, true AS shared, (z > 0)::INT = label AS correct, CASE WHEN z > 0 THEN substr(repeat('failed at ' || sample_id || ' ', 20), 1, 160) END AS short FROM z""")
def p27_batch_shares(spark, sf_dir):
    """Scored in batches: a row's time is its batch's over the batch's size; the correct flag (p28) and the inner error text (p29)."""
    import numpy as np

    from ..adapters import tiles
    from ..functions.identity import error_text
    from ..operators import scoring

    weights = np.arange(1, 65) % 5 - 2
    rows = scoring.as_records(scoring.score(tiles(spark, sf_dir), lambda x: x @ weights))
    share = F.abs(F.col("inference_time_ms") * F.col("batch_size") - F.col("batch_inference_time_ms")) < 1e-6
    message = F.when(F.col("predicted") == 1, F.repeat(F.concat(F.lit("failed at "), F.col("sample_id").cast("string"), F.lit(" ")), 20))
    return rows.select("sample_id", (share & (F.col("batch_size") > 0)).alias("shared"), "correct", error_text(message, 160).alias("short"))



@book.add(f"WITH {REC}, {_OK}, {_pack_sql('ok')} SELECT {_PACK} FROM pack")
def s16_rescored_records(spark, sf_dir):
    """Written records scored again from their file."""
    from ..sources.tables import new_folder, read_records, write_records

    path = new_folder(spark)
    write_records(records(spark, sf_dir).withColumn("run_id", F.lit("run-1")), path)
    return M.metric_pack(M.ok_rows(read_records(spark, path))).withColumns(r6(*_R))
