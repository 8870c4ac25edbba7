"""Descriptive statistics, exact quantiles, densities and regression, with state that doesn't grow with a group."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylume.operators.storage import frozen, thaw

QUARTILES = (0.25, 0.5, 0.75)
#: Groups, and brackets, of up to so many values are sorted; larger ones are refined in so many bins a round.
SORTED, BINS = 4096, 1024
#: Bins of a density, and points of its curve.
FINE, POINTS = 8192, 200
_SMALL = 10_000  # groups whose facts are sent to every task


def _with_facts(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the facts (a row a group) of their group; a null key is a group too."""
    few = facts.limit(_SMALL + 1).count() <= _SMALL  # facts are frozen, or cheap
    other = facts.withColumnsRenamed({c: f"_{c}_" for c in by})
    if not by:
        return rows.crossJoin(F.broadcast(other))  # one row
    met = rows.join(F.broadcast(other) if few else other, functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by]))
    return met.drop(*[f"_{c}_" for c in by])


def _order(x: Column) -> Column:
    """Grows with x as the logarithm of its size does; 0 for the smallest numbers."""
    return F.signum(x) * F.greatest(F.lit(0.0), F.coalesce(F.ln(F.abs(x)), F.lit(-800.0)) + 690)


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: tuple[float, ...] = QUARTILES) -> DataFrame:
    """A row a group: ``by``, q (the linearly interpolated quantiles, an array). Nulls don't count; a group without values has
    no row. Exact, by refinement: the rank that a quantile needs is bracketed by a histogram of its group, whose bin is the
    next bracket, from its least to its largest value; when a bracket has few values, or one, they are sorted. A pass only
    keeps rows in brackets, and its state is a count a bin."""
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    sizes = frozen(v.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b")), "quantile-sizes")
    most = sizes.agg(F.max("_n")).first()[0] or 0
    plain = lambda rows: rows.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, probabilities))).alias("q"))
    if most <= SORTED:
        thaw(sizes)
        return plain(v).where("q is not null")
    small = plain(_with_facts(v, sizes.where(F.col("_n") <= SORTED).select(*by), by)).where("q is not null")
    # an ask is a rank of a group: between a and b lie n values, below a there are low
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = [F.struct(F.lit(2 * i + j).alias("i"), f(place(p)).cast("long").alias("rank")) for i, p in enumerate(probabilities) for j, f in enumerate((F.floor, F.ceil))]
    asks = frozen(sizes.where(F.col("_n") > SORTED).select(*by, F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_n").alias("n"), F.lit(0).cast("long").alias("low"), F.explode(F.array(*ranks)).alias("x")).select(*by, "a", "b", "n", "low", "x.*"), "quantile-asks")
    inside = lambda some: _with_facts(v, some.groupBy(*by).agg(F.collect_list(F.struct("i", "a", "b", "n", "low", "rank")).alias("_asks")), by).select(*by, "_v", F.explode(F.filter("_asks", lambda x: (F.col("_v") >= x["a"]) & (F.col("_v") <= x["b"]))).alias("x")).select(*by, "_v", "x.*")
    unsure = lambda: asks.where((F.col("n") > SORTED) & (F.col("a") < F.col("b")))
    while not unsure().isEmpty():
        # bins are equally wide, by logarithm where the bracket's ends are of different orders; halves keep widths finite
        a, b, x = F.col("a"), F.col("b"), F.col("_v")
        wide = _order(b) - _order(a) > 7
        share = F.when(wide, (_order(x) - _order(a)) / (_order(b) - _order(a))).otherwise((x / 2 - a / 2) / (b / 2 - a / 2))
        step = F.least(F.floor(share * BINS), F.lit(BINS - 1))  # the share of b is 1
        keys = [*by, "i", "rank", "low"]
        bins = inside(unsure()).groupBy(*keys, step.alias("_bin")).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count("*").alias("_m"))
        held = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "_least", "_most", "_m"))).alias("_bins"))  # at most BINS
        before = F.transform("_bins", lambda x, k: F.aggregate(F.slice("_bins", 1, k), F.col("low"), lambda s, y: s + y["_m"]))
        found = F.filter(F.zip_with("_bins", before, lambda x, low: F.struct(x["_least"].alias("a"), x["_most"].alias("b"), x["_m"].alias("n"), low.alias("low"))), lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["low"] + x["n"]))[0]
        sure = asks.where((F.col("n") <= SORTED) | (F.col("a") >= F.col("b"))).select(*by, "a", "b", "n", "low", "i", "rank")
        nxt = frozen(sure.unionByName(held.withColumn("_f", found).select(*by, "_f.*", "i", "rank")), "quantile-asks")
        thaw(asks)
        asks = nxt
    same = asks.where("a = b").select(*by, "i", F.col("a").alias("x"))
    few = asks.where("a < b")
    picked = inside(few).groupBy(*by, "i", "rank", "low").agg(F.array_sort(F.collect_list("_v")).alias("_vs")).select(*by, "i", F.get("_vs", (F.col("rank") - F.col("low")).cast("int")).alias("x"))
    held = _with_facts(same.unionByName(picked), sizes.select(*by, "_n"), by).groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("_x"))
    at = lambda i, p: F.col("_x")[2 * i] + (place(p) - F.floor(place(p))) * (F.col("_x")[2 * i + 1] - F.col("_x")[2 * i])
    return small.unionByName(held.select(*by, F.array(*[at(i, p) for i, p in enumerate(probabilities)]).alias("q")))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sample deviation, least, linearly interpolated quartiles, most."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = quantiles(df, by, value).withColumnsRenamed({c: f"_{c}_" for c in by})
    met = out.join(q, functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by]), "left")
    return met.select(*by, "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", *[F.round(F.col("q")[i], 4).alias(f"q{25 * (i + 1)}") for i in range(3)], "most")


def box(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """What a box plot shows of each group: ``by``, q25, q50, q75, the least and largest values within 1.5 times the
    interquartile range of the box (whiskers), and the number of values beyond."""
    q = frozen(quantiles(df, by, value), "box-quartiles")
    v = _with_facts(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null"), q, by)
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    within = F.col("_v").between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    out = v.groupBy(*by, "q").agg(F.min(F.when(within, F.col("_v"))).alias("low"), F.max(F.when(within, F.col("_v"))).alias("high"), F.count_if(~within).alias("n_outliers"))
    return out.select(*by, *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "low", "high", "n_outliers")


def density(df: DataFrame, by: list[str], value: str, points: int = POINTS, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density curves: ``by``, i, x, density, for ``points`` places from ``cut`` bandwidths below the least
    value to as many above the largest. The bandwidth is Scott's: n ** -0.2 sample deviations. Groups whose values don't
    differ have no curve.

    Values are summed up in FINE bins of their group, each with its number, and the sums of the distances from its middle
    and of their squares; a bin's kernel is expanded by them, which leaves an error of the third order in the width of
    a bin. One pass for the moments and one for the bins; a curve is made from its bins in one task."""
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    facts = frozen(v.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_samp("_v").alias("_s"), F.min("_v").alias("_a"), F.max("_v").alias("_b")).where("_b > _a"), "density-moments")
    step = (F.col("_b") - F.col("_a")) / FINE
    binned = _with_facts(v, facts, by).withColumn("_bin", F.least(F.floor((F.col("_v") - F.col("_a")) / step), F.lit(FINE - 1)))
    off = F.col("_v") - (F.col("_a") + (F.col("_bin") + 0.5) * step)
    bins = binned.groupBy(*by, "_n", "_s", "_a", "_b", "_bin").agg(F.count("*").alias("_m"), F.sum(off).alias("_d"), F.sum(off * off).alias("_dd"))

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, a, b = (float(pdf[c].iloc[0]) for c in ("_n", "_s", "_a", "_b"))
        h = s * n**-0.2
        x = np.linspace(a - cut * h, b + cut * h, points)
        middle = a + (pdf["_bin"].to_numpy() + 0.5) * (b - a) / FINE
        m, d, dd = (pdf[c].to_numpy() / scale for c, scale in (("_m", 1.0), ("_d", h), ("_dd", h * h)))
        z = (x[:, None] - middle) / h
        total = (np.exp(-0.5 * z * z) * (m + z * d + 0.5 * (z * z - 1) * dd)).sum(axis=1)
        out = pd.DataFrame({"i": np.arange(points, dtype=np.int64), "x": x, "density": total / (n * h * math.sqrt(2 * math.pi))})
        for c in reversed(by):
            out.insert(0, c, [pdf[c].iloc[0]] * points)
        return out

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return bins.groupBy(*by).applyInPandas(curve, f"{kinds}i long, x double, density double")


def fit(y: str, x: str) -> list[Column]:
    """Slope, intercept, correlation and count of an ordinary least squares line."""
    return [F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.corr(y, x), 6).alias("r"), F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).alias("n")]


def fitted(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope, intercept, r, n, and the two-sided p-value of r."""
    one = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).alias("n"))
    p = F.udf(lambda r, n: None if r is None else p_value(r, n), "double")  # of one row
    return one.select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")], "n", F.round(p("r", "n"), 6).alias("p"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation over n points, by Student's t distribution."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    a, b, x = df / 2, 0.5, df / (df + t2)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b
