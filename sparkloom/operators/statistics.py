"""Statistics: shapes, correlation, agreement, resampling, regression, tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import map_arrow
from .ranking import average_rank, counted, cumulated, quantiles, with_average_rank, with_demeaned


def histogram(df: DataFrame, value: str, low: float, high: float, step: float) -> DataFrame:
    """(bin, n) over fixed edges; the last bin is closed."""
    last = int((high - low) / step) - 1
    place = F.least(F.floor((F.col(value) - low) / step), F.lit(last)).cast("long")
    return df.where(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def cosine(x: str, y: str) -> Column:
    """Of two array<double> columns."""

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)

    return dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))


def bimodality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sarle's coefficient with sample-corrected skewness and kurtosis; null under four rows."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("__m"))
    d = df.join(mean, by).withColumn("__d", F.col(value) - F.col("__m"))
    n = F.col("n")
    k = d.groupBy(*by).agg(F.count(value).cast("double").alias("n"), *[F.avg(F.pow("__d", F.lit(p))).alias(f"m{p}") for p in (2, 3, 4)]).where(n > 3)
    g1 = F.col("m3") / F.pow("m2", F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.col("m4") / F.pow("m2", F.lit(2)) - 3) + 6)
    return k.select(*by, ((g1 * g1 + 1) / (g2 + 3 * F.pow(n - 1, F.lit(2)) / ((n - 2) * (n - 3)))).alias("bimodality"))


# --- correlation and agreement ---


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's coefficient of average ranks, over rows with both values."""
    by = by or []
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__u"), F.col(y).alias("__v"))
    ranked = with_average_rank(with_average_rank(pairs, "__u", by, "__x"), "__v", by, "__y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] * w[j] over i < j with y[i] > y[j]: two such values part at one bit of their ranks, so each bit adds, in groups that agree in
    the bits above, the weight of ones before each zero."""
    ranks = np.unique(y, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length()):
        order = np.argsort(ranks >> (bit + 1), kind="stable")
        group, one, weight = ranks[order] >> (bit + 1), (ranks[order] >> bit) & 1, w[order]
        ones = np.cumsum(weight * one)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        before = np.repeat(ones[first] - (weight * one)[first], np.diff(np.append(first, len(order))))
        total += int((weight * (1 - one) * (ones - before)).sum())
    return total


#: Distinct pairs of values that a range of Kendall's tau is made for, and the greatest number of ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 1_000


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, tau): tau-b over rows with both values, in n log n.

    Equal pairs of values become one with a weight. Both values are cut into ordered ranges (equal values in one). Pairs of rows in different ranges of both are
    counted from the grid of ranges, at most MOST_RANGES squared sums; those in one range of x are inversions there; those in one range of y but
    different ones of x are inversions of y's range, in order of x's. No pair of rows is made."""
    import pandas as pd

    from ..session import ship

    spark = df.sparkSession
    ship(spark)
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("w"))
    parts = min(MOST_RANGES, max(1, cells.count() // RANGE_ROWS))
    probs = [i / parts for i in range(1, parts)] or [0.5]
    cuts = cells.agg(F.percentile_approx("x", probs, 10_000).alias("qx"), F.percentile_approx("y", probs, 10_000).alias("qy"))
    place = lambda q, v: F.size(F.filter(q, lambda c: c < F.col(v))).cast("int")
    placed = cells.crossJoin(F.broadcast(cuts)).select("x", "y", "w", place("qx", "x").alias("px"), place("qy", "y").alias("py"))  # one row of cuts

    def within_x(f):
        f = f.sort_values(["x", "y"])
        return pd.DataFrame({"d": [inversions(f["y"].to_numpy(), f["w"].to_numpy())]})

    def across_x(f):
        # rows of one range of x are in order of y, so they are no inversions of each other
        f = f.sort_values(["px", "y"])
        return pd.DataFrame({"d": [inversions(f["y"].to_numpy(), f["w"].to_numpy())]})

    near = placed.groupBy("px").applyInPandas(within_x, "d long").unionAll(placed.groupBy("py").applyInPandas(across_x, "d long")).agg(F.coalesce(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(0)).alias("near"))
    # cells of the grid with a lower range of x and a higher one of y
    grid = placed.groupBy("px", "py").agg(F.sum("w").alias("w"))
    counts = np.zeros((len(probs) + 1,) * 2)
    for r in grid.collect():
        counts[r["px"], r["py"]] = r["w"]
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts  # of the same range of x, higher ranges of y
    far = sum(int(v) for v in (counts[1:] * np.cumsum(above, 0)[:-1]).ravel())
    pairs = lambda c: F.sum(c.cast("decimal(38,0)") * (c - 1)) / 2
    ties = lambda *by: cells.groupBy(*by).agg(F.sum("w").alias("c")).agg(pairs(F.col("c")).alias("t" + "".join(by)))
    out = cells.agg(F.sum("w").alias("n")).crossJoin(near).crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(ties("x", "y"))
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    number = lambda c: F.col(c).cast("double")
    apart = number("near") + F.lit(float(far))
    top = n0 - number("tx") - number("ty") + number("txy") - 2 * apart
    scale = F.sqrt((n0 - number("tx")) * (n0 - number("ty")))
    return out.select("n", F.when(scale > 0, top / scale).alias("tau"))


def qwk_moments(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Quadratic weighted kappa on a grid, by moments; null where it isn't defined."""
    u, v = F.rint(a), F.rint(b)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*(by or []), u.alias("u"), v.alias("v"))
    denominator = F.var_pop("u") + F.var_pop("v") + F.pow(F.avg("u") - F.avg("v"), F.lit(2))
    kappa = F.when(denominator > 0, 1 - F.avg(F.pow(F.col("u") - F.col("v"), F.lit(2))) / denominator)
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), kappa.alias("kappa"))


def grid(score: Column, step: float = 10, top: int = 10) -> Column:
    """A score's level among 0 .. top."""
    return F.least(F.greatest(F.rint(score / step), F.lit(0.0)), F.lit(float(top)))


def qwk_matrix(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """The same from the matrix of counts and its margins."""
    by = by or []
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.rint(a).alias("u"), F.rint(b).alias("v")).agg(F.count("*").alias("c"))
    on = [*by, "one"]
    cells = cells.withColumn("one", F.lit(0))
    rows = cells.groupBy(*on, "u").agg(F.sum("c").alias("cu"))
    cols = cells.groupBy(*on, "v").agg(F.sum("c").alias("cv"))
    seen = cells.groupBy(*on).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.pow(F.col("u") - F.col("v"), F.lit(2))).alias("o"))
    expected = rows.join(cols, on).groupBy(*on).agg(F.sum(F.col("cu") * F.col("cv") * F.pow(F.col("u") - F.col("v"), F.lit(2))).alias("e"))
    return seen.join(expected, on).select(*by, "n", F.when(F.col("e") > 0, 1 - F.col("o") * F.col("n") / F.col("e")).alias("kappa"))


# --- resampling: draws are fixed by md5, so any engine can repeat them ---


def draw(seed: int, n: Column, *parts: Column) -> Column:
    """A number in [0, n) fixed by the seed and parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") % n).cast("long")


#: Parts into which replicates are dealt.
BLOCKS = 32


def replicated(rows: DataFrame, replicates: int) -> DataFrame:
    """rows once for each replicate `rep`, dealt into BLOCKS parts of replicates, however few the rows are."""
    blocks = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).repartition(BLOCKS, "__b")
    size = -(-replicates // BLOCKS)
    return blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("rep", F.col("rep") + F.col("__b") * size).where(F.col("rep") < replicates).drop("__b")


def bootstrap_se(df: DataFrame, by: list[str], key: str, value: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(by, n, se): population deviation of the means of resampled rows.

    A draw is a row number, looked up in the group's numbered values where it is made (these are broadcast while they are few, after
    counting), so what is shuffled is a sum a replicate."""
    w = Window.partitionBy(*by)
    numbered = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"), (F.row_number().over(w.orderBy(key)) - 1).alias("__i"), F.count("*").over(w).alias("__n"))
    group = F.concat_ws(",", *[F.col(c).cast("string") for c in by])
    drawn = replicated(numbered.select(*by, "__i", "__n"), replicates).withColumn("__j", draw(seed, F.col("__n"), group, F.col("rep"), F.col("__i")))
    values = numbered.select(*by, F.col("__i").alias("__j"), "__v")
    means = drawn.join(counted(values), [*by, "__j"]).groupBy(*by, "rep").agg(F.avg("__v").alias("m"), F.first("__n").alias("n"))
    return means.groupBy(*by).agg(F.first("n").alias("n"), F.stddev_pop("m").alias("se"))


def closed_form_se(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """What the bootstrap tends to."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sqrt(F.var_pop(value) / F.count(value)).alias("se"))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """df with its rows' places by a distinct number (__i, from 1) and their number (__n), in ordered parts, not in one task."""
    return with_average_rank(df, key, [], "__i", total="__n").withColumn("__i", F.col("__i").cast("long"))


def corr_interval(df: DataFrame, key: str, x: str, y: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(low, high): percentile interval of Pearson's r, pairs resampled together; replicates with fewer
    than three distinct x don't count."""
    rows = _numbered(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), key).select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col("__i") - 1).alias("i"), F.col("__n").alias("n"))
    drawn = replicated(rows.select("i", "n"), replicates).select("rep", draw(seed, F.col("n"), F.col("rep"), F.col("i")).alias("i")).join(counted(rows.select("i", "x", "y")), "i")
    # a third value lies between the least and the greatest; sums tell, without sets of values
    low, high, n = F.min("x"), F.max("x"), F.count("*")
    between = (low + high) * F.sum("x") - F.sum(F.col("x") * F.col("x")) - n * low * high
    each = drawn.groupBy("rep").agg(F.corr("x", "y").alias("r"), (between > 1e-9 * n * (high - low) * (high - low)).alias("three")).where("three")
    return each.agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))


def cluster_interval(df: DataFrame, cluster: str, value: Column, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(low, high) of the mean of a value when whole clusters are resampled: a cluster is its sum and count, so rows aren't drawn."""
    sums = df.groupBy(F.col(cluster).alias("__c")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("k"))
    names = with_average_rank(sums, "__c", [], "__i", total="n").select((F.col("__i") - 1).cast("long").alias("i"), "n", "s", "k")
    drawn = replicated(names.select("i", "n"), replicates).select("rep", draw(seed, F.col("n"), F.col("rep"), F.col("i")).alias("i")).join(counted(names.select("i", "s", "k")), "i")
    each = drawn.groupBy("rep").agg((F.sum("s") / F.sum("k")).alias("s"))
    return each.agg(F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high"))


#: Steps of a permutation, and the prime that its coins are drawn with.
STEPS, PRIME = 16, 2**31 - 1


def with_permuted(df: DataFrame, place: str, n: str, seed: int, name: str) -> DataFrame:
    """df (with a column rep) with the place, from 0 and below n, to which permutation `rep` sends a place: computed, not sorted, whatever n.

    A step mirrors all places at a number drawn for it (p to key - p, modulo n) and tosses a coin for each pair of mirror images, by the greater of the two, whether they
    change places. That is a bijection on any n, and so is a chain of steps; a place stays unmoved in all of them with a chance of 2^-STEPS. Keys are md5 of seed, rep and
    step, kept while a task runs: two times STEPS numbers a permutation."""
    import hashlib

    import pyarrow as pa

    def drawn(rep: int) -> list:
        h = [hashlib.md5(f"{seed}|{rep}|{t}".encode()).hexdigest() for t in range(STEPS)]
        return [[int(x[:8], 16) for x in h], [1 + int(x[8:16], 16) % (PRIME - 1) for x in h]]

    def batches(it):
        known: dict[int, list] = {}
        for b in it:
            reps, which = np.unique(b.column("rep").to_numpy(zero_copy_only=False), return_inverse=True)
            known |= {r: drawn(r) for r in reps.tolist() if r not in known}
            keys = np.array([known[r] for r in reps.tolist()], np.int64).reshape(-1, 2, STEPS)
            p, size = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (place, n))
            for t in range(STEPS):
                q = (keys[which, 0, t] % size - p) % size
                coin = (np.maximum(p, q) + 1) % PRIME * keys[which, 1, t] % PRIME * 2 >= PRIME
                p = np.where(coin, q, p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.transform(map_arrow, batches, f"{kinds}, `{name}` long")


def permutation_p(df: DataFrame, key: str, x: str, y: str, rounds: int = 200, seed: int = 7, two_sided: bool = True) -> DataFrame:
    """(r, p): share of permutations of y with an r at least as far out, the seen one counted. Each row computes whose y it gets and looks that up
    where it is, so nothing is sorted and what is shuffled is sums a permutation."""
    rows = _numbered(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), key).select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col("__i") - 1).alias("i"), F.col("__n").cast("long").alias("n"))
    drawn = with_permuted(replicated(rows.select("i", "n", "x"), rounds), "i", "n", seed, "j").select("rep", "x", F.col("j").alias("i"))
    each = drawn.join(counted(rows.select("i", "y")), "i").groupBy("rep").agg(F.corr("x", "y").alias("rp"))
    seen = rows.agg(F.corr("x", "y").alias("r"))
    side = (lambda c: F.abs(c)) if two_sided else (lambda c: c)
    far = F.sum((side(F.col("rp")) >= side(F.col("r")) - 1e-12).cast("int"))
    return each.crossJoin(F.broadcast(seen)).groupBy("r").agg(((far + 1) / F.lit(rounds + 1)).alias("p"))


# --- regression ---


def slope(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(n, slope, intercept, se, r): ordinary least squares on one predictor."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*")
    se = F.sqrt((F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / (n - 2) / F.regr_sxx(y, x))
    return pairs.groupBy(*(by or [])).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), se.alias("se"), F.corr(x, y).alias("r"))


def clustered_slope(df: DataFrame, x: str, y: str, within: list[str], cluster: str, params: int = 1) -> DataFrame:
    """(n, clusters, slope, se): slope of values less the means of `within`, with errors clustered
    and scaled by G/(G-1) * (n-1)/(n-k)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*within, F.col(cluster).alias("c"), F.col(x).alias("x"), F.col(y).alias("y"))
    d = with_demeaned(d, ["x", "y"], within).select("c", "x", "y")
    sums = d.agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"))
    each = d.crossJoin(F.broadcast(sums)).groupBy("c", "n", "xx", "slope").agg(F.sum(F.col("x") * (F.col("y") - F.col("slope") * F.col("x"))).alias("u"))
    g, n = F.count("*"), F.col("n")
    out = each.groupBy("n", "xx", "slope").agg(g.alias("clusters"), F.sum(F.col("u") * F.col("u")).alias("meat"))
    scale = F.col("clusters") / (F.col("clusters") - 1) * (n - 1) / (n - params)
    return out.select("n", "clusters", "slope", (F.sqrt(F.col("meat") * scale) / F.col("xx")).alias("se"))


def hc1_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, se): with errors robust to unequal variance, scaled by n/(n-2)."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    fit = pairs.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"))
    e = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    d = F.col("x") - F.col("mx")
    each = pairs.crossJoin(F.broadcast(fit)).groupBy("n", "slope", "intercept", "sxx").agg(F.sum(d * d * e * e).alias("meat"))
    return each.select("n", "slope", "intercept", (F.sqrt(F.col("meat") * F.col("n") / (F.col("n") - 2)) / F.col("sxx")).alias("se"))


def r_squared(df: DataFrame, y: str, xs: list[str]) -> float | None:
    """Of a regression on several predictors: sums of products in one pass, a small system on the driver."""
    import numpy as np

    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    full = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*xs, y]))
    k = len(cols)
    row = full.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    n, total = m[0, 0], m[-1, -1] - m[0, -1] ** 2 / max(m[0, 0], 1)
    if n <= k or total <= 0:
        return None
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return float(1 - (m[-1, -1] - 2 * beta @ m[:-1, -1] + beta @ m[:-1, :-1] @ beta) / total)


# --- tests: the tail of t and of the normal, on the driver or as columns of a few rows ---


def t_tail(t: float | None, df: int | None) -> float | None:
    """Two-sided p of Student's t, by the regularised incomplete beta function."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    x = df / (df + t * t)
    return _beta(df / 2, 0.5, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def corr_p(r: float | None, n: int) -> float | None:
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def paired(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(n, delta, sem, t, big): mean difference, its error, and whether it is over twice that."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__d", F.col(a) - F.col(b))
    out = d.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("__d").alias("delta"), (F.stddev_samp("__d") / F.sqrt(F.count("*"))).alias("sem"))
    return out.withColumn("t", F.when(F.col("sem") > 0, F.col("delta") / F.col("sem"))).withColumn("big", F.abs("delta") > 2 * F.col("sem"))


def signed_rank(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, w_plus, w_minus, z): Wilcoxon's sums over non-zero differences, ties at mean ranks."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__d", F.col(a) - F.col(b)).where("__d <> 0").withColumn("__a", F.abs("__d"))
    k = d.withColumn("__r", average_rank("__a", by))
    out = k.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("__d") < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n")
    return out.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


# --- judge bias ---


def debias(panel: DataFrame, effect: DataFrame, judge: str = "judge", score: str = "score", points: int = 100) -> DataFrame:
    """Scores moved in the space of each judge's percentiles: a score's average percent rank less the
    row's effect (columns of `effect` with judge and gen; missing is 0), clipped to (0.01, 100), read back by
    linear interpolation between the judge's percentiles. Rows without effect keep their score."""
    grid_ = [i / points for i in range(points + 1)]
    q = quantiles(panel, [judge], score, grid_, "__q")
    keys = [c for c in effect.columns if c != "effect"]
    ranked = with_average_rank(panel, score, [judge], "__r", total="__n").withColumn("__p", F.col("__r") / F.col("__n") * 100).join(counted(effect), keys, "left").join(counted(q), judge)

    def read(p: Column) -> Column:
        at = p / 100 * points
        i = F.least(F.floor(at), F.lit(points - 1)).cast("int")
        low, high = F.element_at("__q", i + 1), F.element_at("__q", i + 2)
        return low + (high - low) * (at - i)

    clip = lambda p: F.least(F.greatest(p, F.lit(0.01)), F.lit(100.0))
    e = F.coalesce("effect", F.lit(0.0))
    moved = F.when(e == 0, F.col(score)).otherwise(F.col(score) + read(clip(F.col("__p") - e)) - read(clip(F.col("__p"))))
    return ranked.withColumn("debiased", moved).select(*panel.columns, "debiased")


def out_of_sample(scores: DataFrame, stored: DataFrame, score: str, value: str, effect: float) -> DataFrame:
    """Each score's mean-kind percentile among stored values, less the effect, read back linearly. Scores and values are merged in
    one order: a score counts nothing itself, so what lies below it and up to it are the stored values' running counts."""
    merged = scores.select(F.col(score).cast("double").alias("v"), F.lit(0).alias("w"))
    merged = merged.unionByName(stored.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("w")))
    ranks = cumulated(merged, [], "v", F.col("w"))
    asked = scores.select(F.col(score).cast("double").alias("v")).distinct()
    q = quantiles(stored, [], value, [i / 100 for i in range(101)])
    p = F.least(F.greatest((2 * F.col("before") + F.col("n")) / (2 * F.col("total")) * 100 - effect, F.lit(0.01)), F.lit(100.0))
    i = F.least(F.floor("p"), F.lit(99)).cast("int")
    out = ranks.join(asked, "v", "left_semi").withColumn("p", p).crossJoin(F.broadcast(q))  # one row
    return out.select(F.col("v").alias(score), F.col("p").alias("percentile"), (F.element_at("q", i + 1) + (F.element_at("q", i + 2) - F.element_at("q", i + 1)) * (F.col("p") - i)).alias("moved"))


def bootstrap_se_seeded(df: DataFrame, by: list[str], value: str, replicates: int = 10_000, seed: int = 0, ddof: int = 0, shared: bool = False) -> DataFrame:
    """(by, n, se) with a seeded generator: repeatable, but for no SQL engine. The groups are models: a few hundred values
    each, drawn from in blocks, so memory stays bounded. The generator is seeded anew for each group; or it is
    `shared`: then it runs on from group to group in their order, so that one task takes all groups, one at a time, and a
    group of fewer than two values has no error and draws nothing."""
    import numpy as np
    import pandas as pd

    from ..session import ship

    ship(df.sparkSession)

    def error(x, rng):
        means, block = [], max(1, 2_000_000 // max(1, len(x)))
        for at in range(0, replicates if len(x) >= (2 if shared else 1) else 0, block):
            means.append(x[rng.integers(0, len(x), (min(block, replicates - at), len(x)))].mean(1))
        return float(np.concatenate(means).std(ddof=ddof)) if means else None

    def one(key, f):
        x = f[value].dropna().to_numpy(float)
        return pd.DataFrame([(*key, len(x), error(x, np.random.default_rng(seed)))], columns=[*by, "n", "se"])

    def in_order(frames):
        rng, key, held = np.random.default_rng(seed), None, []

        def close():
            x = np.array(held, float)
            return pd.DataFrame([(*key, len(x), error(x, rng))], columns=[*by, "n", "se"])

        for f in frames:
            for *k, x in f[[*by, value]].itertuples(index=False):
                if k != key:
                    if key is not None:
                        yield close()
                    key, held = k, []
                if x == x and x is not None:
                    held.append(x)
        if key is not None:
            yield close()

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + ", n long, se double"
    if shared:
        return df.select(*by, value).repartition(1).sortWithinPartitions(*by, value).mapInPandas(in_order, kinds)
    return df.select(*by, value).groupBy(*by).applyInPandas(one, kinds)
