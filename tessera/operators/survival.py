"""Balance, weights, matching and survival, as grouped and ordered aggregates; models iterate on small sums only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Propensity bounds, balance threshold.
PS_LOW, PS_HIGH, BALANCED = 0.01, 0.99, 0.1


def iptw(ps: Column, treatment: Column, marginal: Column | None = None) -> Column:
    """1 / ps for treated, 1 / (1 - ps) for others, ps clipped; stabilised by the share of treated if given."""
    p = F.least(F.greatest(ps, F.lit(PS_LOW)), F.lit(PS_HIGH))
    w = F.when(treatment == 1, 1 / p).otherwise(1 / (1 - p))
    return w if marginal is None else w * F.when(treatment == 1, marginal).otherwise(1 - marginal)


def trimmed(weights: DataFrame, column: str = "weight", at: float = 0.99) -> DataFrame:
    """Weights cut at a percentile (linear interpolation)."""
    cap = weights.agg(F.percentile(column, at).alias("_cap"))  # one row
    return weights.crossJoin(F.broadcast(cap)).withColumn(column, F.least(column, "_cap")).drop("_cap")


def smd(long: DataFrame) -> DataFrame:
    """covariate, smd of rows (treatment, covariate, value): |difference of means| / root of the mean sample variance; 0 for under two rows an arm or no spread."""
    t = {a: F.when(F.col("treatment") == a, F.col("value")) for a in (0, 1)}
    g = long.groupBy("covariate").agg(*(f(t[a]).alias(f"{n}{a}") for a in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return g.select("covariate", F.when((F.col("n0") >= 2) & (F.col("n1") >= 2) & (sd > 0), F.abs(F.col("m1") - F.col("m0")) / sd).otherwise(0.0).alias("smd"))


def weighted_smd(long: DataFrame) -> DataFrame:
    """covariate, smd with weights: variances by reliability weights. One pass: sums of w, w2, wx, wxx of values about the covariate's mean."""
    c = long.groupBy("covariate").agg(F.avg("value").alias("c"))
    x = long.join(c, "covariate").withColumn("x", F.col("value") - F.col("c"))
    on = {a: F.col("treatment") == a for a in (0, 1)}
    sums = [F.sum(F.when(on[a], e)).alias(f"{n}{a}") for a in (0, 1) for n, e in (("w", F.col("weight")), ("ww", F.col("weight") * F.col("weight")), ("wx", F.col("weight") * F.col("x")), ("wxx", F.col("weight") * F.col("x") * F.col("x")))]
    g = x.groupBy("covariate").agg(*sums)
    for a in (0, 1):
        g = g.withColumn(f"m{a}", F.col(f"wx{a}") / F.col(f"w{a}"))
        left = F.col(f"w{a}") - F.col(f"ww{a}") / F.col(f"w{a}")
        g = g.withColumn(f"v{a}", F.when(left > 0, F.greatest((F.col(f"wxx{a}") - F.col(f"w{a}") * F.col(f"m{a}") * F.col(f"m{a}")) / left, F.lit(0.0))).otherwise(0.0))
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return g.select("covariate", F.when(sd > 0, F.abs(F.col("m1") - F.col("m0")) / sd).otherwise(0.0).alias("smd"))


def balance_summary(balance: DataFrame) -> DataFrame:
    return balance.agg(F.count("*").alias("n_covariates"), F.count_if(F.col("smd") < BALANCED).alias("n_balanced"), F.max("smd").alias("max_smd"), F.avg("smd").alias("mean_smd"))


def balance_change(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumnRenamed("smd", "smd_before").join(after.withColumnRenamed("smd", "smd_after"), "covariate", "full")


def life_table(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, time, n_events, n_left, at_risk: a row for each distinct time. The number of times bounds the window, not persons."""
    t = rows.groupBy(*keys, "time").agg(F.sum("event").alias("n_events"), F.count("*").alias("n_left"))
    later = Window.partitionBy(*keys).orderBy(F.col("time").desc())
    return t.withColumn("at_risk", F.sum("n_left").over(later))


def kaplan_meier(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, time, at_risk, n_events, survival, std_error (Greenwood) at each time with an event. Survival is exactly 0 once all at risk have had theirs."""
    t = life_table(rows, *keys).where("n_events > 0")
    w = Window.partitionBy(*keys).orderBy("time")
    all_gone = F.max((F.col("n_events") >= F.col("at_risk")).cast("int")).over(w) == 1
    step = F.when(F.col("n_events") < F.col("at_risk"), F.log(1 - F.col("n_events") / F.col("at_risk"))).otherwise(0.0)
    s = F.when(all_gone, 0.0).otherwise(F.exp(F.sum(step).over(w)))
    green = F.sum(F.when(F.col("n_events") < F.col("at_risk"), F.col("n_events") / (F.col("at_risk") * (F.col("at_risk") - F.col("n_events")))).otherwise(0.0)).over(w)
    return t.select(*keys, "time", "at_risk", "n_events", s.alias("survival"), (s * F.sqrt(green)).alias("std_error"))


def with_interval(curve: DataFrame, z: float = 1.959964) -> DataFrame:
    """The curve with low and high: the interval of log(-log survival), so within 0 and 1; null where survival is 0 or 1."""
    s = F.col("survival")
    width = z * F.col("std_error") / (s * F.log(s))
    inside = (s > 0) & (s < 1)
    at = lambda sign: F.when(inside, F.pow(s, F.exp(sign * width)))
    return curve.withColumns({"low": F.least(at(1), at(-1)), "high": F.greatest(at(1), at(-1))})


def median_survival(curve: DataFrame, *keys: str) -> DataFrame:
    hit = curve.where("survival <= 0.5")
    return hit.groupBy(*keys).agg(F.min("time").alias("median")) if keys else hit.agg(F.min("time").alias("median"))


def logrank(rows: DataFrame) -> DataFrame:
    """One row: observed and expected events of arm 1, variance, chi-square (one degree), p-value."""
    t = rows.groupBy("time").agg(F.sum("event").alias("d"), F.count("*").alias("c"), F.sum(F.when(F.col("treatment") == 1, F.col("event")).otherwise(0)).alias("d1"), F.count_if(F.col("treatment") == 1).alias("c1"))
    w = Window.orderBy(F.col("time").desc())  # as many rows as distinct days of follow-up
    t = t.withColumn("n", F.sum("c").over(w)).withColumn("n1", F.sum("c1").over(w)).where("d > 0")
    share = F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    one = t.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(v).alias("variance"))
    chi = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance")).otherwise(0.0)
    return one.withColumn("chi_square", chi)


def chi_square_tail(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def propensity(frame: DataFrame, covariates: list[str], c: float = 1.0) -> DataFrame:
    """frame with ps: standardised covariates, ridge logistic regression of treatment (penalty 1 / c on the summed loss)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    frame = staged(frame, "propensity")  # counted, scaled, fitted and scored
    n = frame.count()
    rows = VectorAssembler(inputCols=covariates, outputCol="_x").transform(frame)
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(rows).transform(rows)
    model = LogisticRegression(featuresCol="_z", labelCol="treatment", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(scaled)
    return model.transform(scaled).withColumn("ps", vector_to_array("_p")[1]).drop("_x", "_z", "_p", "_r", "_y")


def cox(rows: DataFrame, covariates: list[str], penalty: float = 0.01, weight: str | None = None, rounds: int = 25) -> dict[str, dict[str, float]]:
    """Hazard ratios by Breslow's partial likelihood, ridge penalty n * penalty / 2 * |b|^2: log hr, hr, 95 % interval, p.

    With a weight the interval is that of the robust variance. A Newton round is one aggregation by event time (sums of r, rx, rxx) and running sums over the times; p x p numbers
    for each distinct time, which follow-up days bound, come to the driver.
    """
    p = len(covariates)
    w = F.col(weight) if weight else F.lit(1.0)
    base = rows.select(F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), w.alias("w"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)))
    base = staged(base, "cox")  # read in every round
    n, beta = base.count(), np.zeros(p)
    for _ in range(rounds):
        r = F.col("w") * F.exp(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
        sums = [F.sum("r").alias("s")] + [F.sum(F.col("r") * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)] + [F.sum(F.col("r") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
        died = [F.sum(F.col("w") * F.col("event")).alias("d")] + [F.sum(F.col("w") * F.col("event") * F.col(f"x{i}")).alias(f"d{i}") for i in range(p)]
        t = base.withColumn("r", r).groupBy("time").agg(*sums, *died).toPandas().sort_values("time", ascending=False)
        s0 = t["s"].cumsum().to_numpy()
        s1 = np.array([t[f"s{i}"].cumsum() for i in range(p)])
        d, gradient, hessian = t["d"].to_numpy(), np.array([t[f"d{i}"].sum() for i in range(p)]), np.zeros((p, p))
        mean = s1 / s0
        gradient = gradient - (mean * d).sum(1) - n * penalty * beta
        for i in range(p):
            for j in range(i, p):
                hessian[i, j] = hessian[j, i] = ((t[f"s{i}_{j}"].cumsum().to_numpy() / s0 - mean[i] * mean[j]) * d).sum()
        hessian += n * penalty * np.eye(p)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    variance = np.linalg.inv(hessian)
    if weight:  # weights make the model's own variance too small: the sandwich of the persons' score residuals instead
        variance = variance @ residual_products(base, beta, t["time"].to_numpy(), s0, mean, d) @ variance
    se = np.sqrt(np.diag(variance))
    return {c: {"log_hr": float(b), "hr": math.exp(b), "low": math.exp(b - 1.959964 * s), "high": math.exp(b + 1.959964 * s), "p": math.erfc(abs(b / s) / math.sqrt(2))} for c, b, s in zip(covariates, beta, se)}


def residual_products(base: DataFrame, beta: np.ndarray, times: np.ndarray, s0: np.ndarray, mean: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum of outer products of weighted score residuals. times fall; s0, mean, d: risk, its mean covariates and events at each.

    A residual needs, of the times up to a person's own, only two running sums; they are a table of one row a day.
    """
    p = len(beta)
    up = np.argsort(times)
    hazard, drift = np.cumsum((d / s0)[up]), np.cumsum((mean * d / s0)[:, up], axis=1)
    rows = [(float(times[i]), float(hazard[k]), *(float(drift[j, k]) for j in range(p)), *(float(mean[j, i]) for j in range(p))) for k, i in enumerate(up.tolist())]
    columns = ["time double", "h double", *(f"a{j} double" for j in range(p)), *(f"m{j} double" for j in range(p))]
    table = base.sparkSession.createDataFrame(rows, ", ".join(columns))
    risk = F.exp(sum((F.lit(float(b)) * F.col(f"x{j}") for j, b in enumerate(beta)), F.lit(0.0)))
    u = [F.col("w") * (F.col("event") * (F.col(f"x{j}") - F.col(f"m{j}")) - risk * (F.col(f"x{j}") * F.col("h") - F.col(f"a{j}"))) for j in range(p)]
    one = base.join(F.broadcast(table), "time").agg(*(F.sum(u[i] * u[j]).alias(f"b{i}_{j}") for i in range(p) for j in range(i, p))).first()
    return np.array([[one[f"b{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])


def concordance(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: concordant, tied, comparable pairs and c_index of rows (risk, time, event).

    A pair is comparable if one had its event and the other was still at risk later, or censored the same day; concordant if who had it
    first has the higher risk, tied if the risks are equal. No comparable pair: c_index null. Null risk, time or event: left out.

    Equal rows are counted first. Range partitions by risk (no more than `buckets`, equal risks together) are compared by their counts a day, a small table;
    inside a partition pairs are counted by sorting, each pair of risks where their ranks first differ.
    """
    spark = rows.sparkSession
    known = rows.where("risk IS NOT NULL AND time IS NOT NULL AND event IS NOT NULL")
    same = known.groupBy(F.col("risk").cast("double").alias("risk"), F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event")).agg(F.count("*").alias("n"))
    n = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = staged(same.repartitionByRange(n, "risk").withColumn("part", F.spark_partition_id()), "concordance")
    inside = parts.groupBy("part").applyInPandas(_pairs_inside, "concordant double, tied double, comparable double")
    # between partitions: a row for each partition, day and outcome
    daily = parts.groupBy("part", "time", "event").agg(F.sum("n").alias("n")).toPandas()
    lower, higher = _pairs_between(daily)
    between = spark.createDataFrame([(lower, 0.0, lower + higher)], "concordant double, tied double, comparable double")
    total = inside.unionByName(between).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).cast("long").alias(c) for c in ("concordant", "tied", "comparable")))
    return total.withColumn("c_index", F.when(F.col("comparable") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("comparable")))


def _pairs_between(daily) -> tuple[float, float]:
    """Of persons with an event, how many later ones stand in partitions of lower and of higher risk."""
    if not len(daily):
        return 0.0, 0.0
    times, part = np.unique(daily["time"], return_inverse=True), daily["part"].to_numpy()
    died, gone = np.zeros((part.max() + 1, len(times[0]))), np.zeros((part.max() + 1, len(times[0])))
    for table, flag in ((died, 1), (gone, 0)):
        here = (daily["event"] == flag).to_numpy()
        np.add.at(table, (part[here], times[1][here]), daily["n"].to_numpy(float)[here])
    after = (died + gone)[:, ::-1].cumsum(1)[:, ::-1] - died  # later, or censored the same day
    below = after.cumsum(0) - after
    return float((died * below).sum()), float((died * (after.sum(0) - below - after)).sum())


def _pairs_inside(rows):
    """Pairs within one partition: by risk rank, bit by bit from the highest, each half against the other; equal ranks by time alone."""
    import pandas as pd

    rank = np.unique(rows["risk"].to_numpy(), return_inverse=True)[1]
    day = np.unique(rows["time"].to_numpy(), return_inverse=True)[1] * 2 + (rows["event"].to_numpy() == 0)
    n, event = rows["n"].to_numpy(float), rows["event"].to_numpy() == 1
    lower, tied, higher = 0.0, _later(rank, day, n, event, None)[0], 0.0
    for bit in range(int(rank.max()).bit_length()):
        below, above = _later(rank >> (bit + 1), day, n, event, (rank >> bit) & 1)
        lower, higher = lower + below, higher + above
    return pd.DataFrame({"concordant": [lower], "tied": [tied], "comparable": [lower + tied + higher]})


def _later(group, day, n, event, half) -> tuple[float, float]:
    """In each group, events times later rows: all of them (half None), or those of the upper half against the lower half's rows, and the other way round."""
    order = np.lexsort((day, group))
    g, d, n, e = group[order], day[order], n[order], event[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    last = np.concatenate((np.flatnonzero(new)[1:], [len(g)]))[np.cumsum(new) - 1]  # behind the rows of the same group and day
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    end = np.concatenate((start[1:], [len(g)]))[np.cumsum(np.concatenate(([True], g[1:] != g[:-1]))) - 1]
    out = []
    for of, among in ((None, None),) if half is None else ((1, 0), (0, 1)):
        h = None if half is None else half[order]
        held = np.concatenate(([0.0], np.cumsum(n if among is None else np.where(h == among, n, 0))))
        after = held[end] - held[last]
        out.append(float((n * after)[e if of is None else e & (h == of)].sum()))
    return (out[0], 0.0) if half is None else (out[0], out[1])
