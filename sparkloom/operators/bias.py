"""Judge bias: a spline in consensus with a judge's own slopes, clustered errors, label permutation.

The design is small (tens of columns). Sums of products are aggregated by Spark, per cluster where
errors are clustered; only those sums reach the driver."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import leave_one_out, with_average_rank


def b_splines(x: Column, knots: list[float], low: float, high: float, degree: int = 3) -> list[Column]:
    """The basis of a spline by the recursion on degrees, as column expressions; without the first
    function, which the constant stands for."""
    t = [low] * (degree + 1) + list(knots) + [high] * (degree + 1)
    x = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    last = len(t) - degree - 2
    basis: list[Column] = []
    for i in range(len(t) - 1):
        inside = (x >= t[i]) & (x < t[i + 1]) if t[i] < t[i + 1] else F.lit(False)
        if i == last:
            inside = (x >= t[i]) & (x <= t[i + 1])
        basis.append(inside.cast("double"))
    for d in range(1, degree + 1):
        up = []
        for i in range(len(t) - 1 - d):
            a = (x - t[i]) / (t[i + d] - t[i]) * basis[i] if t[i + d] > t[i] else F.lit(0.0)
            b = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] if t[i + d + 1] > t[i + 1] else F.lit(0.0)
            up.append(a + b)
        basis = up
    return basis[1:]


def least_squares(df: DataFrame, y: str, xs: list[str], cluster: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(weights, errors, rows, clusters): errors clustered, scaled by G/(G-1) * (n-1)/(n-k)."""
    v = F.array(*[F.col(c).cast("double") for c in [*xs, y]])
    k = len(xs)
    # one row a cluster: X'X and X'y of its rows, as one flat array
    outer = F.flatten(F.transform(v, lambda a: F.transform(v, lambda b: a * b)))
    sums = df.select(F.col(cluster).alias("c"), outer.alias("o")).groupBy("c").agg(*[F.sum(F.element_at("o", i * (k + 1) + j + 1)).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)], F.count("*").alias("n"))
    rows = sums.collect()  # clusters are cases or models, with a fixed number of sums each
    each = np.zeros((len(rows), k + 1, k + 1))
    for g, row in enumerate(rows):
        for i in range(k + 1):
            for j in range(i, k + 1):
                each[g, i, j] = each[g, j, i] = row[f"s{i}_{j}"]
    total, n, g = each.sum(0), sum(row["n"] for row in rows), len(rows)
    inverse = np.linalg.pinv(total[:k, :k])
    beta = inverse @ total[:k, k]
    scores = each[:, :k, k] - each[:, :k, :k] @ beta
    rank = int(np.linalg.matrix_rank(total[:k, :k]))
    scale = g / max(1, g - 1) * (n - 1) / max(1, n - rank)
    cov = inverse @ (scores.T @ scores) @ inverse * scale
    return beta, np.sqrt(np.maximum(np.diag(cov), 0)), n, g


def _prepared(panel: DataFrame) -> DataFrame:
    q = with_average_rank(panel, "score", ["judge"], "q", total="n").withColumn("q", F.col("q") / F.col("n") * 100).drop("n")
    q = q.withColumn("cons", leave_one_out("q", ["gen", "case_id"])).where("cons IS NOT NULL")
    tier = F.when(F.col("gen") % 5 == F.length("judge") % 5, "self").when(F.col("gen") % 3 == F.length("judge") % 3, "family").otherwise("unrelated")
    return q.withColumn("tier", tier)


def spline_bias(panel: DataFrame) -> DataFrame:
    """(tier, coef, se, n, clusters): what a judge gives related generators beyond what the others' scores
    and its own scale (a spline of the consensus for each judge) tell."""
    d = _prepared(panel)
    names = sorted(r[0] for r in d.select("judge").distinct().collect())
    basis = b_splines(F.col("cons"), [33.3, 66.7], 0.0, 100.0)
    tiers = ["self", "family"]
    cols = {f"t_{x}": (F.col("tier") == x).cast("double") for x in tiers}
    for i, j in enumerate(names):
        own = (F.col("judge") == j).cast("double")
        cols |= {f"j{i}": own} | {f"j{i}_{b}": own * c for b, c in enumerate(basis)}
    design = d.select("q", "case_id", *[c.alias(n) for n, c in cols.items()])
    beta, se, n, g = least_squares(design, "q", list(cols), "case_id")
    return panel.sparkSession.createDataFrame([(x, float(beta[i]), float(se[i]), n, g) for i, x in enumerate(tiers)], "tier string, coef double, se double, n long, clusters long")


def permutation_effect(panel: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(effect, p): mean residual of related cells less that of the others, against permutations of the
    generators' labels. Residuals are taken once, per judge and generator; permuting moves labels over them."""
    d = _prepared(panel).withColumn("e", F.col("q") - F.col("cons"))
    cells = d.groupBy("judge", "gen").agg(F.sum("e").alias("s"), F.count("*").alias("n"))
    gens = cells.select("gen").distinct()
    from pyspark.sql.window import Window

    every = Window.partitionBy(F.lit(0)).orderBy("gen")
    order = Window.partitionBy("rep").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("gen").cast("string"))))
    reps = gens.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    mixed = reps.withColumn("i", F.row_number().over(order)).withColumnRenamed("gen", "label")
    place = gens.withColumn("i", F.row_number().over(every))
    labels = mixed.join(place, "i").select("rep", "gen", "label").union(gens.select(F.lit(-1).alias("rep"), "gen", F.col("gen").alias("label")))
    related = F.col("label") % 5 == F.length("judge") % 5
    both = cells.join(labels, "gen").groupBy("rep").agg(
        (F.sum(F.when(related, F.col("s"))) / F.sum(F.when(related, F.col("n"))) - F.sum(F.when(~related, F.col("s"))) / F.sum(F.when(~related, F.col("n")))).alias("effect")
    )
    seen = both.where("rep = -1").select(F.col("effect").alias("seen"))
    far = F.count_if(F.abs("effect") >= F.abs("seen") - 1e-12)
    return both.where("rep >= 0").crossJoin(F.broadcast(seen)).groupBy("seen").agg(((far + 1) / F.lit(rounds + 1)).alias("p")).withColumnRenamed("seen", "effect")


