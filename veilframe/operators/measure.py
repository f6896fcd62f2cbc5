"""Evaluation against truth, calibration, drift and differential privacy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- evaluation ------------------------------------------------------------------------------------------------------

def align(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, t_start, t_end, t_type, p_start, p_end, p_type) by one-to-one alignment: predictions by start take the
    unmatched truth of the best overlap ratio. A fold within one document; unmatched sides are null."""
    def fold(key, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        free = list(t[["start", "end", "type"]].itertuples(index=False))
        rows = []
        for x in p.sort_values(["start", "end", "type"])[["start", "end", "type"]].itertuples(index=False):
            best, at = 0.0, -1
            for i, y in enumerate(free):
                inter = min(x.end, y.end) - max(x.start, y.start)
                if inter > 0 and (r := inter / (max(x.end, y.end) - min(x.start, y.start))) > best:
                    best, at = r, i
            y = free.pop(at) if at >= 0 else None
            rows.append((key[0], *(y or (None, None, None)), *x))
        rows += [(key[0], *y, None, None, None) for y in free]
        out = pd.DataFrame(rows, columns=["doc_id", "t_start", "t_end", "t_type", "p_start", "p_end", "p_type"])
        return out.astype({"t_start": "Int64", "t_end": "Int64", "p_start": "Int64", "p_end": "Int64"})

    cols = ["doc_id", "start", "end", "type"]
    return predicted.select(*cols).groupBy("doc_id").cogroup(truth.select(*cols).groupBy("doc_id")).applyInPandas(fold, "doc_id long, t_start long, t_end long, t_type string, p_start long, p_end long, p_type string")


def mode_counts(aligned: DataFrame) -> DataFrame:
    """tp, fp, fn by type for strict, exact, type and partial matching (partial counts a half)."""
    both = F.col("t_type").isNotNull() & F.col("p_type").isNotNull()
    place = both & (F.col("t_start") == F.col("p_start")) & (F.col("t_end") == F.col("p_end"))
    kind = both & (F.col("t_type") == F.col("p_type"))
    modes = {"strict": (place & kind).cast("double"), "exact": place.cast("double"), "type": kind.cast("double"), "partial": F.when(place, 1.0).when(both, 0.5).otherwise(0.0)}
    rows = aligned.select(F.coalesce("t_type", "p_type").alias("type"), F.col("t_type").isNotNull().alias("has_t"), F.col("p_type").isNotNull().alias("has_p"), F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(v, F.lit(0.0)).alias("hit")) for m, v in modes.items()])).alias("m"))
    return rows.groupBy("type", "m.mode").agg(F.sum("m.hit").alias("tp"), (F.sum(F.col("has_p").cast("double")) - F.sum("m.hit")).alias("fp"), (F.sum(F.col("has_t").cast("double")) - F.sum("m.hit")).alias("fn"))


def strict_counts(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn by type, matching (doc_id, start, end, type)."""
    key = ["doc_id", "start", "end", "type"]
    p, t = predicted.select(*key).distinct().withColumn("p", F.lit(1)), truth.select(*key).distinct().withColumn("t", F.lit(1))
    j = p.join(t, key, "full")
    return j.groupBy("type").agg(F.sum((F.col("p") + F.col("t") == 2).cast("long")).alias("_tp"), F.count("p").alias("_p"), F.count("t").alias("_t")).select("type", F.coalesce("_tp", F.lit(0)).cast("long").alias("tp"), (F.col("_p") - F.coalesce("_tp", F.lit(0))).alias("fp"), (F.col("_t") - F.coalesce("_tp", F.lit(0))).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return counts.withColumn("precision", F.round(p, 6)).withColumn("sensitivity", F.round(r, 6)).withColumn("f1", F.round(F.when(F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0)) > 0, 2 * p * r / (p + r)), 6)).withColumn("risk", F.when(r >= 0.99, "LOW").when(r >= 0.97, "MEDIUM").when(r >= 0.95, "HIGH").otherwise("CRITICAL"))


def leaks(redacted: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth values that a redacted text still holds."""
    return truth.select("doc_id", "type", "text").join(redacted.select("doc_id", "redacted"), "doc_id").where(F.contains("redacted", F.col("text")))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(a_right, b_right): discordant counts and the statistic with continuity correction."""
    g = pairs.agg(F.sum((F.col("a_right") & ~F.col("b_right")).cast("long")).alias("b"), F.sum((~F.col("a_right") & F.col("b_right")).cast("long")).alias("c"))
    return g.withColumn("chi2", F.when(F.col("b") + F.col("c") > 0, F.round(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / (F.col("b") + F.col("c")), 6)).otherwise(0.0))


def bootstrap(values: DataFrame, column: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean by Poisson weights, which need no resampling of rows: every row meets every round once, and sums are map-side."""
    w = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.struct(F.lit(0).alias("k"), F.lit(math.exp(-1)).alias("p"), F.lit(math.exp(-1)).alias("c")), lambda a, _: F.when(F.col("_u") > a["c"], F.struct((a["k"] + 1).alias("k"), (a["p"] / (a["k"] + 1)).alias("p"), (a["c"] + a["p"] / (a["k"] + 1)).alias("c"))).otherwise(a))["k"]
    rows = values.select(F.col(column).cast("double").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("_u", F.rand(seed)).withColumn("w", w)
    means = rows.groupBy("r").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.avg("m").alias("mean"), F.percentile("m", F.lit(0.975)).alias("high"))


# ---- calibration -----------------------------------------------------------------------------------------------------

def reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """(confidence, label) to bins of count, mean confidence and accuracy."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins))
    return points.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("label").cast("double")), 6).alias("accuracy"))


def calibration_errors(points: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins))
    g = points.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("label").cast("double")).alias("a"), F.sum(F.pow(F.col("confidence") - F.col("label"), F.lit(2))).alias("sq"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"), F.round(F.max(F.abs(F.col("c") - F.col("a"))), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def roc_sweep(points: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision and F1 at thresholds .10 to .95 by .05; scores are first counted by value, so the sweep is over few rows."""
    by_score = points.groupBy("confidence").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    t = by_score.select("confidence", "pos", "neg", F.explode(F.sequence(F.lit(2), F.lit(19))).alias("k")).withColumn("threshold", F.col("k") / F.lit(20.0))
    hit = F.col("confidence") >= F.col("threshold")
    g = t.groupBy("threshold").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return g.select("threshold", "tp", "fp", "fn", "tn", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"), ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids over the distinct scores."""
    g = points.groupBy("confidence").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    w = Window.orderBy(F.col("confidence").desc())
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = g.withColumn("tp", F.sum("pos").over(w)).withColumn("tp0", F.col("tp") - F.col("pos")).withColumn("p", F.sum("pos").over(total)).withColumn("n", F.sum("neg").over(total))
    return up.agg(F.round(F.sum(F.col("neg") * (F.col("tp") + F.col("tp0")) / 2.0) / F.max(F.col("p") * F.col("n")), 6).alias("auc"))


def isotonic_model(points: DataFrame):
    """Spark's own isotonic regression of label on confidence; equal confidences are averaged first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = points.groupBy("confidence").agg(F.avg(F.col("label").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(weightCol="weight").fit(VectorAssembler(inputCols=["confidence"], outputCol="features").transform(rows))


def isotonic(points: DataFrame) -> DataFrame:
    """(confidence, calibrated) at each confidence seen."""
    from pyspark.ml.feature import VectorAssembler

    seen = VectorAssembler(inputCols=["confidence"], outputCol="features").transform(points.select("confidence").distinct())
    return isotonic_model(points).transform(seen).select("confidence", F.round("prediction", 6).alias("calibrated"))


#: A calibrator is fitted from so many points on.
LEAST_POINTS = 20


def _counted(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confidences to six digits, their positives and their points. Points are counted by Spark, so what reaches the driver has at most
    1,000,001 rows whatever the input; confidences outside 0 to 1 are moved to its ends, null ones take no part."""
    c = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), 6)
    rows = points.where("confidence is not null and label is not null and not isnan(confidence)").groupBy(c.alias("x")).agg(F.sum((F.col("label") == 1).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n")).orderBy("x").collect()
    return tuple(np.array([r[k] for r in rows], float) for k in ("x", "pos", "n"))


def _fitted(points: DataFrame, names: tuple[str, ...], values: tuple[float, ...] | None, n: float) -> DataFrame:
    rows = [(int(n), *(round(float(v), 6) for v in values))] if n >= LEAST_POINTS else []
    return points.sparkSession.createDataFrame(rows, "n long, " + ", ".join(f"{x} double" for x in names))


def platt(points: DataFrame, rounds: int = 100, rate: float = 0.01) -> DataFrame:
    """One row (n, a, b) of sigmoid(a * confidence + b) by gradient descent from zero; none for fewer than ``LEAST_POINTS``."""
    x, pos, n = _counted(points)
    a = b = 0.0
    for _ in range(rounds if n.sum() >= LEAST_POINTS else 0):
        e = n / (1 + np.exp(-(a * x + b))) - pos
        a, b = a - rate * (e * x).sum() / n.sum(), b - rate * e.sum() / n.sum()
    return _fitted(points, ("a", "b"), (a, b), n.sum())


def beta(points: DataFrame, rounds: int = 100, rate: float = 0.01) -> DataFrame:
    """One row (n, a, b, c) of a * confidence ** b + c by gradient descent on squared error; a and b stay in .1 to 10, c within .5 of 0."""
    x, pos, n = _counted(points)
    x = np.clip(x, 0.001, 0.999)
    a, b, c = 1.0, 1.0, 0.0
    for _ in range(rounds if n.sum() >= LEAST_POINTS else 0):
        power = x**b
        e = n * np.clip(a * power + c, 0.001, 0.999) - pos
        step = rate * np.array([(e * power).sum(), (e * a * power * np.log(x)).sum(), e.sum()]) / n.sum()
        a, b, c = np.clip([a - step[0], b - step[1], c - step[2]], [0.1, 0.1, -0.5], [10, 10, 0.5])
    return _fitted(points, ("a", "b", "c"), (a, b, c), n.sum())


def temperature(points: DataFrame) -> DataFrame:
    """One row (n, temperature): of .1 to 5 by .1 the one of least log loss, the smallest at a tie; it divides the log-odds."""
    x, pos, n = _counted(points)
    odds = np.log(np.clip(x, 0.001, 0.999) / (1 - np.clip(x, 0.001, 0.999)))
    t = np.arange(1, 51) / 10
    p = np.clip(1 / (1 + np.exp(-odds[None] / t[:, None])), 0.001, 0.999)
    loss = np.round((-pos * np.log(p) - (n - pos) * np.log(1 - p)).sum(1), 9)
    return _fitted(points, ("temperature",), (t[loss.argmin()],), n.sum())


def calibrated(confidence: Column, method: str, **fit: float) -> Column:
    """A confidence by a fitted calibrator: platt (a, b), beta (a, b, c) or temperature (temperature)."""
    s = F.greatest(F.lit(0.001), F.least(F.lit(0.999), confidence))
    if method == "platt":
        out = 1 / (1 + F.exp(-(fit["a"] * confidence + fit["b"])))
    elif method == "beta":
        out = fit["a"] * F.pow(s, F.lit(fit["b"])) + fit["c"]
    elif method == "temperature":
        out = 1 / (1 + F.exp(-F.ln(s / (1 - s)) / fit["temperature"]))
    else:
        raise ValueError(f"unknown calibrator {method!r}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


# ---- drift -----------------------------------------------------------------------------------------------------------

def windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type, over event time."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def hellinger(counts: DataFrame, baseline: Column) -> DataFrame:
    """Distance of each window's mix of types from that of the windows where ``baseline`` holds."""
    base = counts.where(baseline).groupBy("event_type").agg(F.sum("n").alias("b"))
    base = base.withColumn("q", F.col("b") / F.sum("b").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select("event_type", "q")
    later = counts.where(~baseline)
    total = later.groupBy("start").agg(F.sum("n").alias("all"))
    grid = total.select("start", "all").join(F.broadcast(base.select(F.collect_list(F.struct("event_type", "q")).alias("base"))), how="cross")
    grid = grid.select("start", "all", F.explode("base").alias("b")).select("start", "all", F.col("b.event_type").alias("event_type"), F.col("b.q").alias("q"))
    j = grid.join(later, ["start", "event_type"], "full")
    p = F.coalesce(F.col("n") / F.sum("n").over(Window.partitionBy("start")), F.lit(0.0))
    d = j.withColumn("sq", F.pow(F.sqrt(p) - F.sqrt(F.coalesce("q", F.lit(0.0))), F.lit(2)))
    return d.groupBy("start").agg(F.round(F.sqrt(F.sum("sq") / 2), 6).alias("distance")).withColumn("alert", F.when(F.col("distance") > 0.3, "CRITICAL").when(F.col("distance") > 0.2, "HIGH").when(F.col("distance") > 0.1, "MEDIUM").otherwise("NONE"))


def volume_change(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Each window's number of events against the one before; alert beyond 30 %."""
    g = events.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    before = F.lag("n").over(Window.orderBy("start"))
    return g.withColumn("change", F.round((F.col("n") - before) / before, 6)).withColumn("alert", F.coalesce(F.abs("change") > 0.3, F.lit(False)))


# ---- differential privacy --------------------------------------------------------------------------------------------

def laplace(value: Column, u: Column, sensitivity: float, epsilon: float) -> Column:
    """``value`` plus Laplace noise by the inverse distribution at a uniform u in (-.5, .5)."""
    b = sensitivity / epsilon
    return value - F.lit(b) * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def bounded_contributions(rows: DataFrame, unit: str, most: int) -> DataFrame:
    """At most ``most`` rows of each unit, by hash, so that a count has that sensitivity."""
    w = Window.partitionBy(unit).orderBy(F.xxhash64(*rows.columns), *rows.columns)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def randomized_response(counts: DataFrame, k: int, epsilon: float) -> DataFrame:
    """(item, observed) to the unbiased estimate (observed - n q) / (p - q), with p and q of k-ary randomised response."""
    p = math.exp(epsilon) / (math.exp(epsilon) + k - 1)
    q = 1 / (math.exp(epsilon) + k - 1)
    n = F.sum("observed").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select("item", "observed", F.round((F.col("observed") - n * q) / (p - q), 4).alias("estimate"))


def budget(queries: DataFrame, total: float) -> DataFrame:
    """(user_id, ts, epsilon) with the running sum of each user and whether it is within ``total``."""
    w = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return queries.withColumn("spent", F.round(F.sum("epsilon").over(w), 6)).withColumn("allowed", F.col("spent") <= total)


def advanced_composition(epsilon: float, k: int, slack: float) -> float:
    """The epsilon that k queries of ``epsilon`` each spend together, but for a chance of ``slack``."""
    return epsilon * math.sqrt(2 * k * math.log(1 / slack)) + k * epsilon * (math.exp(epsilon) - 1)


def weight_grid(examples: DataFrame, weights: list[float], thresholds: list[float]) -> DataFrame:
    """F1 of w * pattern + (1 - w) * context at each weight and threshold; ``examples`` has pattern, context and truth.

    The grid is a literal array in each row, aggregated before the shuffle, so what moves is one row a cell and task.
    """
    grid = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(float(t)).alias("threshold")) for w in weights for t in thresholds))
    cells = examples.select("truth", "pattern", "context", F.explode(grid).alias("g")).select("g.*", "truth", (F.round(F.col("g.w") * F.col("pattern") + (1 - F.col("g.w")) * F.col("context"), 9) >= F.col("g.threshold")).alias("said"))
    n = lambda c: F.count(F.when(c, 1))
    said, truth = F.coalesce("said", F.lit(False)), F.coalesce("truth", F.lit(False))
    counts = cells.groupBy("w", "threshold").agg(n(said & truth).alias("tp"), n(said & ~truth).alias("fp"), n(~said & truth).alias("fn"))
    return counts.withColumn("f1", F.round(F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6))
