"""Weighted evaluation metrics over run records, as aggregate expressions.

Rows are records with label, predicted, probs, correct and inference_time_ms; a row of weight w counts as w copies. One
aggregation gives the sums, with bounds for the percentile wanted, and the metrics are expressions over them; it is written, a row
for a group, and one more scan counts the values between the bounds for the exact percentile.
An empty input still gives its row of defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..schemas import HOLDOUT_PATTERN, PROVENANCE, ROLLING_PATTERN


def ok_rows(records: DataFrame, aug: bool | None = False) -> DataFrame:
    """Scored rows of the base pass (aug False), of the augmented pass (True), or of both (None)."""
    ok = records.where("status = 'ok'")
    return ok if aug is None else ok.where(F.coalesce("aug_pass", F.lit(False)) == aug)


def confusion(weight: Column | None = None) -> list[Column]:
    """Weighted counts tp, tn, fp, fn."""
    w = F.lit(1.0) if weight is None else weight
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return [F.coalesce(F.sum(F.when((F.col("label") == y) & (F.col("predicted") == p), w)), F.lit(0.0)).alias(n) for n, (y, p) in cells.items()]


def mcc() -> Column:
    """From tp, tn, fp, fn; each factor has its own root, so that counts cannot overflow; 0 if a factor is 0."""
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    below = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(0.0)


def losses(weight: Column | None = None) -> list[Column]:
    """Weighted cross_entropy (0 if there is nothing) and brier (0.25 then), over rows that have probabilities."""
    raw = scores.positive("probs")
    p, y = scores.clip(raw), F.col("label")
    w = F.when(raw.isNotNull(), F.lit(1.0) if weight is None else weight)
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    mean = lambda x, default: F.coalesce(F.try_divide(F.sum(w * x), F.sum(w)), F.lit(default))
    return [mean(loss, 0.0).alias("cross_entropy"), mean((p - y) * (p - y), 0.25).alias("brier")]


def score(agg: str = "geomean", alpha: float = 1.2, beta: float = 1.8) -> Column:
    """The composite score in [0, 1] from mcc and brier."""
    m = F.pow(F.greatest(F.lit(0.0), F.least((F.col("mcc") + 1) / 2, F.lit(1.0))), F.lit(alpha))
    b = F.pow(F.greatest(F.lit(0.0), (F.lit(0.25) - F.col("brier")) / 0.25), F.lit(beta))
    final = {"geomean": F.sqrt(F.greatest(F.lit(1e-12), m * b)), "harmmean": 2 * m * b / F.greatest(F.lit(1e-12), m + b), "mean": 0.5 * (m + b)}[agg]
    return F.greatest(F.lit(0.0), F.least(final, F.lit(1.0)))


def accuracy(weight: Column | None = None) -> Column:
    w = F.lit(1.0) if weight is None else weight
    return F.coalesce(F.try_divide(F.sum(F.col("correct").cast("double") * w), F.sum(w)), F.lit(0.0)).alias("accuracy")


#: Up to so many rows of a group, a quantile takes all its values; beyond, only those near the rank wanted.
SMALL_GROUP, NEAR = 10_000, 1e-4


def _range(value: str, q: float) -> Column:
    """(n, low, high) of a group: bounds that the values next to the quantile lie between."""
    # the approximation is off by at most n / 100,000 ranks, a tenth of NEAR
    near = F.percentile_approx(value, F.array(F.lit(max(0.0, q - NEAR)), F.lit(min(1.0, q + NEAR))), 100_000)
    small = F.count(value) <= SMALL_GROUP
    return F.struct(F.count(value).alias("n"), F.when(small, F.min(value)).otherwise(near[0]).alias("low"), F.when(small, F.max(value)).otherwise(near[1]).alias("high"))


def quantile(rows: DataFrame, value: str, q: float, by: list[str] | None = None, name: str = "quantile", bounds: DataFrame | None = None) -> DataFrame:
    """The exact, linearly interpolated quantile of each group of ``by`` (null where a group has no values), as (by, name).

    Values are counted, those below the range of the rank wanted as one; the ordered window sees only the counts within
    it, so no task holds a group's values. ``bounds``, with a column ``_r`` of ``_range``, saves the scan for them."""
    by = by or []
    bounds = rows.groupBy(*by).agg(_range(value, q).alias("_r")) if bounds is None else bounds
    bounds = bounds.select(*[F.col(c).alias(f"_{c}") for c in by], "_r")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    near = rows.join(bounds if by else F.broadcast(bounds), same).where(F.col(value) <= F.col("_r.high"))  # one row of bounds, or Spark's choice
    counts = near.groupBy(*by, "_r", F.when(F.col(value) >= F.col("_r.low"), F.col(value)).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()))
    at = F.lit(q) * (F.col("_r.n") - 1)
    first, second = [F.min(F.when(F.col("_upto") > F.floor(at) + k, F.col("_v"))) for k in (0, 1)]
    picked = counts.withColumn("_upto", upto).groupBy(*by).agg(first.alias("_a"), second.alias("_b"), F.max(at - F.floor(at)).alias("_f"))
    return picked.select(*by, (F.col("_a") + F.when(F.col("_f") > 0, F.col("_f") * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias(name))


def _with_quantile(sums: list[Column], rows: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """The aggregates ``sums`` of each group with the 95th percentile of ``value`` beside them, null where there is none: two scans of ``rows``."""
    from ..sources.tables import kept

    done = kept(rows.groupBy(*(by or [])).agg(*sums, _range(value, 0.95).alias("_r")))
    found = quantile(rows, value, 0.95, by, name, done)
    if not by:
        return done.drop("_r").join(F.broadcast(found.agg(F.max(name).alias(name))), F.lit(True))  # a row each
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return done.drop("_r").join(found.select(*[F.col(c).alias(f"_{c}") for c in by], name), same, "left").drop(*[f"_{c}" for c in by])


def latency(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and 95th percentile (interpolated) of inference_time_ms, 0 where there is none."""
    means = F.coalesce(F.avg("inference_time_ms"), F.lit(0.0)).alias("avg_ms")
    return _with_quantile([means], rows, "inference_time_ms", "p95_ms", by).withColumn("p95_ms", F.coalesce("p95_ms", F.lit(0.0)))


def metric_pack(rows: DataFrame, weight: Column | None = None, by: list[str] | None = None, agg: str = "geomean") -> DataFrame:
    """n, accuracy, latencies, mcc, cross_entropy, brier and score; one row, or one for each group of ``by``."""
    sums = [F.count("*").alias("n"), F.sum(F.when(F.coalesce(F.size("probs"), F.lit(0)) <= 0, 1).otherwise(0)).alias("missing_probs"), accuracy(weight), F.coalesce(F.avg("inference_time_ms"), F.lit(0.0)).alias("avg_ms"), *confusion(weight), *losses(weight)]
    sums = _with_quantile(sums, rows, "inference_time_ms", "p95_ms", by).withColumn("p95_ms", F.coalesce("p95_ms", F.lit(0.0)))
    out = sums.withColumn("mcc", mcc()).withColumn("score", F.when(F.col("n") > 0, score(agg)).otherwise(0.0))
    return out.drop("tp", "tn", "fp", "fn").withColumn("missing_probs", F.coalesce("missing_probs", F.lit(0)).cast("long"))


def provenance(name: Column, rolling: str = ROLLING_PATTERN, holdout: str = HOLDOUT_PATTERN) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.contains(low, F.lit(holdout)), "holdout").when(F.contains(low, F.lit(rolling)), "rolling").otherwise("public")


def composition(shares: dict[str, float]) -> dict[str, float]:
    """Target shares from holdout and rolling shares; the rest is public. Negative shares, or over 1 in sum, are refused."""
    if any(v < 0 for v in shares.values()) or sum(shares.values()) > 1 + 1e-9:
        raise ValueError("shares must not be negative nor exceed 1 together")
    return {"public": 1 - sum(shares.values()), **shares}


def provenance_weights(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(provenance, n, realized, weight) of the classes present: share over present classes x all rows / rows of the class."""
    counts = rows.groupBy(provenance(F.col("dataset_name")).alias("provenance")).agg(F.count("*").alias("n"))
    target = F.coalesce(*[F.when(F.col("provenance") == c, F.lit(max(0.0, float(v)))) for c, v in shares.items()], F.lit(0.0))
    total = counts.withColumn("target", target)
    sums = total.agg(F.sum("n").alias("all_n"), F.sum("target").alias("all_target"))  # three rows at most below this
    joined = total.join(F.broadcast(sums), F.lit(True))
    weight = F.when(F.col("all_target") > 0, F.col("target") / F.col("all_target") * F.col("all_n") / F.col("n")).otherwise(1.0)
    return joined.select("provenance", "n", (F.col("n") / F.col("all_n")).alias("realized"), weight.alias("weight"))


def weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with the weight of their provenance class (1 where the class has none)."""
    keyed = rows.withColumn("provenance", provenance(F.col("dataset_name")))
    return keyed.join(F.broadcast(weights.select("provenance", "weight")), "provenance", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def realized_composition(rows: DataFrame, spark) -> DataFrame:
    """(provenance, n, realized) for all three classes, zero where absent."""
    counts = rows.groupBy(provenance(F.col("dataset_name")).alias("provenance")).agg(F.count("*").alias("n"))
    classes = spark.createDataFrame([(c,) for c in PROVENANCE], "provenance string")
    filled = classes.join(counts, "provenance", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return filled.join(F.broadcast(total), F.lit(True)).select("provenance", "n", F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)).alias("realized"))


def paired_degradation(records: DataFrame, binary: bool = False) -> DataFrame:
    """Base and augmented rows of one sample: pairs, mean and 95th percentile of the drop of P(correct class)."""
    from ..sources.tables import kept

    p = scores.correct_probability(binary)
    base = ok_rows(records).select("sample_id", p.alias("base"))
    augmented = ok_rows(records, True).select("sample_id", p.alias("aug"))
    drops = base.join(augmented, "sample_id").where("base is not null and aug is not null").select((F.col("base") - F.col("aug")).alias("drop"))
    drops = kept(drops)  # a number for each pair: the join is made once
    return _with_quantile([F.count("*").alias("pairs"), F.avg("drop").alias("mean_drop")], drops, "drop", "p95_drop")


def robustness(records: DataFrame, aug_weight: float = 0.3) -> DataFrame:
    """Base and augmented score, their ratio (0 if base is 0), the other augmented metrics, and the blended score."""
    base = metric_pack(ok_rows(records)).select(F.col("score").alias("base_score"))
    aug = metric_pack(ok_rows(records, True)).select(F.col("n").alias("aug_n"), F.col("score").alias("aug_score"), F.col("mcc").alias("aug_mcc"), F.col("cross_entropy").alias("aug_cross_entropy"), F.col("brier").alias("aug_brier"))
    both = base.join(F.broadcast(aug), F.lit(True))  # a row each
    return both.withColumn("robustness", F.when(F.col("base_score") > 0, F.col("aug_score") / F.col("base_score")).otherwise(0.0)).withColumn(
        "blended", F.when(F.col("aug_n") > 0, (1 - aug_weight) * F.col("base_score") + aug_weight * F.col("aug_score")).otherwise(F.col("base_score")))
