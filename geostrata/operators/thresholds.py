"""Thresholds and accuracy: Otsu, ROC, confusion matrices, log-log regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.scale import cumulative

BINS = 256


def histogram(df: DataFrame, by: list[str], value: Column, bins: int = BINS) -> DataFrame:
    """(by..., bin, n): counts of a share of 0 to 1 in equal bins, the empty ones with 0."""
    found = df.where(value.isNotNull()).groupBy(*by, F.least(F.greatest(F.floor(value * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # one row a group and bin
    dense = found.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def otsu(df: DataFrame, by: list[str], value: Column, bins: int = BINS) -> DataFrame:
    """(by..., threshold): the middle of the bins whose cut has the greatest variance between classes."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    sums = histogram(df, by, value, bins).select(
        *by, "bin", F.sum("n").over(w).alias("below"), F.sum("n").over(whole).alias("all"),
        F.sum(F.col("n") * F.col("bin")).over(w).alias("below_sum"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("all_sum"),
    )
    above = F.col("all") - F.col("below")
    apart = F.try_divide(F.col("below_sum"), F.col("below")) - F.try_divide(F.col("all_sum") - F.col("below_sum"), above)
    scored = sums.select(*by, "bin", F.coalesce(F.col("below").cast("double") * above * apart * apart, F.lit(0.0)).alias("between"))
    # equal variances in exact arithmetic may differ by rounding
    best = scored.withColumn("between", F.round("between", 3)).withColumn("best", F.max("between").over(whole)).where("between = best")
    return best.groupBy(*by).agg(((F.min("bin") + F.max("bin")) / 2 / (bins - 1)).alias("threshold"))


def roc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """(by..., score, sensitivity, specificity) at each distinct score, positive being called at the score or above.

    Rows are counted by score first, so that windows run over distinct scores.
    """
    counts = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    ranked = cumulative(counts, by, F.col(score).desc(), ["p", "n"])
    totals = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")) if by else counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    known = ranked.join(totals, by) if by else ranked.join(F.broadcast(totals))  # one row
    return known.select(*by, score, F.try_divide(F.col("p_before") + F.col("p"), F.col("all_p")).alias("sensitivity"), (1 - F.try_divide(F.col("n_before") + F.col("n"), F.col("all_n"))).alias("specificity"))


def youden(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """The score with the greatest sum of sensitivity and specificity; of ties the least."""
    curve = roc(df, by, score, positive)
    best = F.max_by(F.struct(score, "sensitivity", "specificity"), F.struct(F.round(F.col("sensitivity") + F.col("specificity"), 9).alias("sum"), (-F.col(score)).alias("least"))).alias("best_")
    aggregated = curve.groupBy(*by).agg(best) if by else curve.agg(best)
    return aggregated.select(*by, "best_.*")


def auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the curve by pairs of which the positive has the higher score, ties counting a half."""
    counts = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    won = cumulative(counts, by, F.col(score), ["n"]).withColumn("won", F.col("p") * (F.col("n_before") + F.col("n") / 2))
    area = F.try_divide(F.sum("won"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc")
    return won.groupBy(*by).agg(area) if by else won.agg(area)


def auc_interval(df: DataFrame, by: list[str], score: str, positive: Column, z: float = 1.959963984540054) -> DataFrame:
    """(by..., auc, low, high): the area and its interval by DeLong, DeLong and Clarke-Pearson (1988), cut to 0 to 1; null with fewer than two of a class."""
    counts = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    ranked = cumulative(counts, by, F.col(score), ["p", "n"])
    # of each positive the negatives below it, and of each negative the positives above it, ties counting a half
    below = F.col("n_before") + F.col("n") / 2
    to_here = F.col("p_before") + F.col("p") / 2
    sums = (F.sum("p").alias("ps"), F.sum("n").alias("ns"), F.sum(F.col("p") * below).alias("w"), F.sum(F.col("p") * below * below).alias("ww"), F.sum(F.col("n") * to_here).alias("u"), F.sum(F.col("n") * to_here * to_here).alias("uu"))
    s = ranked.groupBy(*by).agg(*sums) if by else ranked.agg(*sums)
    ps, ns, w, ww, u, uu = (F.col(c).cast("double") for c in ("ps", "ns", "w", "ww", "u", "uu"))
    area = F.try_divide(w, ps * ns)
    spread = F.try_divide(ww - w * w / ps, (ps - 1) * ns * ns * ps) + F.try_divide(uu - u * u / ns, (ns - 1) * ps * ps * ns)
    error = z * F.sqrt(F.when((ps > 1) & (ns > 1), F.greatest(spread, F.lit(0.0))))
    both = s.select(*by, area.alias("auc"), error.alias("error"))
    return both.select(*by, "auc", F.when(F.col("error").isNotNull(), F.greatest(F.col("auc") - F.col("error"), F.lit(0.0))).alias("low"), F.when(F.col("error").isNotNull(), F.least(F.col("auc") + F.col("error"), F.lit(1.0))).alias("high"))


def confusion(df: DataFrame, by: list[str], actual: Column, predicted: Column) -> DataFrame:
    """Counts tp, fp, fn, tn and accuracy, kappa, producers (recall) and users (precision) of the positive class."""
    counts = (F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"))
    found = df.groupBy(*by).agg(*counts) if by else df.agg(*counts)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agreed, chance = F.try_divide(tp + tn, n), F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return found.withColumns({"accuracy": agreed, "kappa": F.try_divide(agreed - chance, 1 - chance), "producers": F.try_divide(tp, tp + fn), "users": F.try_divide(tp, tp + fp)})


def regression(df: DataFrame, by: list[str], y: Column, *x: Column) -> DataFrame:
    """Least squares of y on one or two predictors: (by..., intercept, slope1[, slope2], r2), over rows where all are known."""
    if not 1 <= len(x) <= 2:
        raise ValueError("one or two predictors")
    rows = df.select(*by, y.alias("y"), *[c.alias(f"x{k}") for k, c in enumerate(x)]).na.drop(subset=["y", *[f"x{k}" for k in range(len(x))]])
    names = ["y", *[f"x{k}" for k in range(len(x))]]
    found = [F.avg(c).alias(f"m_{c}") for c in names] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    m = rows.groupBy(*by).agg(*found) if by else rows.agg(*found)
    c = F.col
    if len(x) == 1:
        slopes = [F.try_divide(c("c_y_x0"), c("c_x0_x0"))]
    else:
        det = c("c_x0_x0") * c("c_x1_x1") - c("c_x0_x1") * c("c_x0_x1")
        slopes = [F.try_divide(c("c_y_x0") * c("c_x1_x1") - c("c_y_x1") * c("c_x0_x1"), det), F.try_divide(c("c_y_x1") * c("c_x0_x0") - c("c_y_x0") * c("c_x0_x1"), det)]
    intercept, explained = c("m_y"), F.lit(0.0)
    for k, s in enumerate(slopes):
        intercept, explained = intercept - s * c(f"m_x{k}"), explained + s * c(f"c_y_x{k}")
    return m.select(*by, intercept.alias("intercept"), *[s.alias(f"slope{k + 1}") for k, s in enumerate(slopes)], F.try_divide(explained, c("c_y_y")).alias("r2"))
