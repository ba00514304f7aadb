"""Correlation, agreement, resampling, regression and bias queries over the judge panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import ranking as R
from ..operators import statistics as S
from .aggregates import JUDGES, MEDS, PANEL, meds, panel, r
from .registry import query

WIDE = PANEL + ", wide AS (SELECT gen, case_id, " + ", ".join(f"max(score) FILTER (judge = '{j}') AS {j}" for j in JUDGES) + " FROM panel GROUP BY ALL)"
BY_GEN = WIDE + ", g AS (SELECT gen, avg(view) AS view, avg(error) AS error, avg(click) AS click FROM wide GROUP BY gen)"
#: As many resamples and permutations as the reference takes, and fewer of generators' labels.
REPS, LABEL_REPS, SEED = 10_000, 2_000, 7


def wide(t):
    return P.wide_panel(panel(t), JUDGES)


def by_gen(t):
    return wide(t).groupBy("gen").agg(*[F.avg(c).alias(c) for c in ("view", "error", "click")])


def hexdraw(parts: str, n: str) -> str:
    return f"(('0x' || substr(md5('{SEED}|' || {parts}), 1, 8))::BIGINT % {n})"


@query(
    "m01_bootstrap_se",
    f"WITH {MEDS}, x AS (SELECT gen, med, row_number() OVER (PARTITION BY gen ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY gen) AS n FROM meds), "
    f"d AS (SELECT gen, rep, n, {hexdraw(chr(39).join(['gen || ', '|', ' || rep || ', '|', ' || i']), 'n')} AS i FROM x, range({REPS}) t(rep)), "
    "m AS (SELECT d.gen, rep, avg(med) AS m, any_value(d.n) AS n FROM d JOIN x ON x.gen = d.gen AND x.i = d.i GROUP BY ALL) SELECT gen, any_value(n) AS n, round(stddev_pop(m), 9) AS se FROM m GROUP BY gen",
)
def m01(t):
    return S.bootstrap_se(meds(t), ["gen"], "case_id", "med", REPS, SEED).select("gen", "n", r("se").alias("se"))


@query("m01_closed_form", f"WITH {MEDS} SELECT gen, count(med) AS n, round(sqrt(var_pop(med) / count(med)), 9) AS se FROM meds GROUP BY gen")
def m01_closed(t):
    return S.closed_form_se(meds(t), ["gen"], "med").select("gen", "n", r("se").alias("se"))


ROWS = "x AS (SELECT gen * 100 + case_id AS cell, view AS x, error AS y, row_number() OVER (ORDER BY gen * 100 + case_id) - 1 AS i, count(*) OVER () AS n FROM wide WHERE view IS NOT NULL AND error IS NOT NULL)"


def cells(t):
    return wide(t).withColumn("cell", F.col("gen") * 100 + F.col("case_id"))


@query(
    "m02_correlation_interval",
    f"WITH {WIDE}, {ROWS}, d AS (SELECT rep, {hexdraw(chr(39).join(['rep || ', '|', ' || i']), 'n')} AS i FROM x, range({REPS}) t(rep)), e AS (SELECT rep, corr(x, y) AS r, count(DISTINCT x) AS k FROM d JOIN x USING (i) GROUP BY rep) "
    "SELECT round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high FROM e WHERE k > 2",
)
def m02(t):
    return S.corr_interval(cells(t), "cell", "view", "error", REPS, SEED).select(r("low").alias("low"), r("high").alias("high"))


@query(
    "m03_cluster_interval",
    f"WITH {WIDE}, c AS (SELECT gen, row_number() OVER (ORDER BY gen) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT gen FROM wide)), d AS (SELECT rep, {hexdraw(chr(39).join(['rep || ', '|', ' || i']), 'n')} AS i FROM c, range({REPS}) t(rep)), "
    "e AS (SELECT rep, avg(view - error) AS s FROM d JOIN c USING (i) JOIN wide USING (gen) GROUP BY rep) SELECT round(quantile_cont(s, 0.025), 9) AS low, round(quantile_cont(s, 0.975), 9) AS high FROM e",
)
def m03(t):
    return S.cluster_interval(wide(t), "gen", F.col("view") - F.col("error"), REPS, SEED).select(r("low").alias("low"), r("high").alias("high"))


RANKS = "k AS (SELECT rank() OVER (ORDER BY view) + (count(*) OVER (PARTITION BY view) - 1) / 2.0 AS x, rank() OVER (ORDER BY error) + (count(*) OVER (PARTITION BY error) - 1) / 2.0 AS y FROM wide WHERE view IS NOT NULL AND error IS NOT NULL)"


@query("m04_spearman", f"WITH {WIDE}, {RANKS} SELECT count(*) AS n, round(corr(x, y), 9) AS rho FROM k")
def m04(t):
    return S.spearman(wide(t), "view", "error").select("n", r("rho").alias("rho"))


@query("m04_pearson", f"WITH {WIDE} SELECT gen, count(*) AS n, round(corr(view, error), 9) AS r FROM wide WHERE view IS NOT NULL AND error IS NOT NULL GROUP BY gen")
def m04_pearson(t):
    return S.pearson(wide(t), "view", "error", ["gen"]).select("gen", "n", r("r").alias("r"))


@query(
    "m05_p_values",
    # the density of Student's t, by Simpson's rule between 0 and |t|
    f"WITH {BY_GEN}, c AS (SELECT count(*) AS n, corr(view, error) AS r FROM g), t AS (SELECT n, r, n - 2 AS df, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c), "
    "f AS (SELECT CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * k / 4000.0) ** 2 / df, -(df + 1) / 2.0) AS y FROM t, range(4001) u(k)) "
    "SELECT n, round(r, 9) AS r, round(1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * (SELECT sum(y) FROM f) * t / 12000.0, 9) AS p FROM t",
)
def m05(t):
    row = S.pearson(by_gen(t), "view", "error").first()
    return t.spark.createDataFrame([(row["n"], round(row["r"], 9), round(S.corr_p(row["r"], row["n"]), 9))], "n long, r double, p double")


@query(
    "m06_kendall",
    f"WITH {BY_GEN}, p AS (SELECT sign(a.view - b.view) AS sx, sign(a.error - b.error) AS sy FROM g a JOIN g b ON a.gen < b.gen) SELECT round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 9) AS tau FROM p",
)
def m06(t):
    return S.kendall(by_gen(t), "view", "error").select(r("tau").alias("tau"))


@query(
    "m06_kendall_rows",
    "WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS w FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY ALL), "
    "p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) * a.w * b.w AS s, abs(sign(a.x - b.x)) * a.w * b.w AS sx, abs(sign(a.y - b.y)) * a.w * b.w AS sy FROM c a, c b) "
    "SELECT (SELECT sum(w) FROM c)::BIGINT AS n, round(sum(s) / sqrt(sum(sx) * sum(sy)), 9) AS tau FROM p",
)
def m06_rows(t):
    """Over every line item."""
    return S.kendall(t.lineitem, "l_quantity", "l_discount").select("n", r("tau").alias("tau"))


RINT = "u AS (SELECT gen, round_even(view / 10, 0) AS u, round_even(error / 10, 0) AS v FROM wide WHERE view IS NOT NULL AND error IS NOT NULL)"


def _levels(t):
    return wide(t).select("gen", (F.col("view") / 10).alias("view"), (F.col("error") / 10).alias("error"))


@query("m07_kappa_moments", f"WITH {WIDE}, {RINT} SELECT gen, count(*) AS n, round(CASE WHEN var_pop(u) + var_pop(v) + (avg(u) - avg(v)) ** 2 > 0 THEN 1 - avg((u - v) ** 2) / (var_pop(u) + var_pop(v) + (avg(u) - avg(v)) ** 2) END, 9) AS kappa FROM u GROUP BY gen")
def m07(t):
    return S.qwk_moments(_levels(t), "view", "error", ["gen"]).select("gen", "n", r("kappa").alias("kappa"))


@query("m08_kappa_matrix", f"WITH {WIDE}, {RINT} SELECT gen, count(*)::BIGINT AS n, round(1 - avg((u - v) ** 2) / (var_pop(u) + var_pop(v) + (avg(u) - avg(v)) ** 2), 9) AS kappa FROM u GROUP BY gen")
def m08(t):
    return S.qwk_matrix(_levels(t), "view", "error", ["gen"]).select("gen", F.col("n").cast("long").alias("n"), r("kappa").alias("kappa"))


@query("m08_labels_kappa", "WITH u AS (SELECT quality::DOUBLE AS u, toxic::DOUBLE AS v FROM labels) SELECT count(*) AS n, round(1 - avg((u - v) ** 2) / (var_pop(u) + var_pop(v) + (avg(u) - avg(v)) ** 2), 9) AS kappa FROM u")
def m08_labels(t):
    return S.qwk_moments(t.labels, "quality", "toxic").select("n", r("kappa").alias("kappa"))


def permuted_sql() -> str:
    """Tables keys, s0, s1, …: a permutation's numbers, and places after each step of every permutation."""
    number = lambda t, at: f"('0x' || substr(md5('{SEED}|' || rep || '|{t}'), {at}, 8))::BIGINT"
    steps = range(S.STEPS)
    out = [f"keys AS MATERIALIZED (SELECT rep, {', '.join(f'{number(t, 1)} AS h{t}, 1 + {number(t, 9)} % {S.PRIME - 1} AS a{t}' for t in steps)} FROM range({REPS}) t(rep))", "s0 AS (SELECT keys.*, x, n, i AS p FROM x, keys)"]
    for t in steps:
        coin = f"(greatest(p, q) + 1) % {S.PRIME} * a{t} % {S.PRIME} * 2 >= {S.PRIME}"
        out.append(f"s{t + 1} AS (SELECT * EXCLUDE (p, q), CASE WHEN {coin} THEN q ELSE p END AS p FROM (SELECT *, (h{t} % n - p + n) % n AS q FROM s{t}))")
    return ", ".join(out)


@query(
    "m09_permutation_p",
    f"WITH {WIDE}, {ROWS}, {permuted_sql()}, "
    f"e AS (SELECT rep, corr(s.x, z.y) AS rp FROM s{S.STEPS} s JOIN x z ON z.i = s.p GROUP BY rep), o AS (SELECT corr(x, y) AS r FROM x) SELECT round(r, 9) AS r, round((sum((abs(rp) >= abs(r) - 1e-12)::INT) + 1) / {REPS + 1}.0, 9) AS p FROM e, o GROUP BY r",
)
def m09(t):
    return S.permutation_p(cells(t), "cell", "view", "error", REPS, SEED).select(r("r").alias("r"), r("p").alias("p"))


@query(
    "m10_agreement_table",
    f"WITH {PANEL}, p AS (SELECT a.judge AS a, b.judge AS b, a.score AS x, b.score AS y FROM panel a JOIN panel b USING (gen, case_id) WHERE a.judge < b.judge), "
    "k AS (SELECT a, b, x, y, round_even(x / 10, 0) AS u, round_even(y / 10, 0) AS v, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p), "
    "g AS (SELECT a, b, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho, avg(abs(x - y)) AS apart, 1 - avg((u - v) ** 2) / (var_pop(u) + var_pop(v) + (avg(u) - avg(v)) ** 2) AS kappa FROM k GROUP BY ALL), "
    "t AS (SELECT *, n - 2 AS df, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM g), "
    # the density of Student's t, by Simpson's rule between 0 and |t|
    "f AS (SELECT a, b, sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * k / 4000.0) ** 2 / df, -(df + 1) / 2.0)) AS y FROM t, range(4001) u(k) GROUP BY a, b) "
    "SELECT a, b, n, round(r, 9) AS pearson, round(1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * y * t / 12000.0, 7) AS p, round(rho, 9) AS spearman, round(kappa, 9) AS kappa, round(apart, 9) AS apart FROM t JOIN f USING (a, b)",
)
def m10(t):
    """Every pair of judges: correlations, the p-value of Pearson's, quadratic kappa on the grid, mean distance. The p-values are
    taken on the driver, of one row a pair."""
    p = panel(t)
    a, b = (p.select("gen", "case_id", F.col("judge").alias(c), F.col("score").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    pairs = a.join(b, ["gen", "case_id"]).where("a < b")
    k = pairs.select("a", "b", "x", "y", R.average_rank("x", ["a", "b"]).alias("rx"), R.average_rank("y", ["a", "b"]).alias("ry"))
    g = k.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), r(F.corr("rx", "ry")).alias("spearman"), r(F.avg(F.abs(F.col("x") - F.col("y")))).alias("apart"))
    kappa = S.qwk_moments(k.withColumns({"x": F.col("x") / 10, "y": F.col("y") / 10}), "x", "y", ["a", "b"]).select("a", "b", r("kappa").alias("kappa"))
    rows = g.join(kappa, ["a", "b"]).collect()
    out = [(x["a"], x["b"], x["n"], round(x["pearson"], 9), round(S.corr_p(x["pearson"], x["n"]), 7), x["spearman"], x["kappa"], x["apart"]) for x in rows if x["pearson"] is not None]
    return t.spark.createDataFrame(out, "a string, b string, n long, pearson double, p double, spearman double, kappa double, apart double")


@query(
    "m11_clustered_slope",
    f"WITH {WIDE}, d AS (SELECT case_id, view - avg(view) OVER (PARTITION BY gen) AS x, error - avg(error) OVER (PARTITION BY gen) AS y FROM wide WHERE view IS NOT NULL AND error IS NOT NULL), "
    "s AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x * y) / sum(x * x) AS slope FROM d), u AS (SELECT case_id, sum(x * (y - slope * x)) AS u FROM d, s GROUP BY case_id) "
    "SELECT n, (SELECT count(*) FROM u) AS clusters, round(slope, 9) AS slope, round(sqrt((SELECT sum(u * u) FROM u) * (SELECT count(*) FROM u) / ((SELECT count(*) FROM u) - 1) * (n - 1) / (n - 1)) / xx, 9) AS se FROM s",
)
def m11(t):
    return S.clustered_slope(wide(t), "view", "error", ["gen"], "case_id").select("n", "clusters", r("slope").alias("slope"), r("se").alias("se"))


@query(
    "m12_robust_slope",
    f"WITH {WIDE}, d AS (SELECT view AS x, error AS y FROM wide WHERE view IS NOT NULL AND error IS NOT NULL), f AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM d) "
    "SELECT n, round(b, 9) AS slope, round(a, 9) AS intercept, round(sqrt(sum((x - mx) ** 2 * (y - a - b * x) ** 2) * n / (n - 2)) / sxx, 9) AS se FROM d, f GROUP BY n, b, a, sxx",
)
def m12(t):
    return S.hc1_slope(wide(t), "view", "error").select("n", r("slope").alias("slope"), r("intercept").alias("intercept"), r("se").alias("se"))


@query(
    "m13_simple_slope",
    f"WITH {WIDE} SELECT gen, count(*) AS n, round(regr_slope(error, view), 9) AS slope, round(sqrt((regr_syy(error, view) - regr_slope(error, view) * regr_sxy(error, view)) / (count(*) - 2) / regr_sxx(error, view)), 9) AS se, round(corr(view, error), 9) AS r, round(corr(view, error) / sqrt(0.26), 9) AS attenuated FROM wide WHERE view IS NOT NULL AND error IS NOT NULL GROUP BY gen",
)
def m13(t):
    s = S.slope(wide(t), "view", "error", ["gen"])
    return s.select("gen", "n", r("slope").alias("slope"), r("se").alias("se"), r("r").alias("r"), r(F.col("r") / F.sqrt(F.lit(0.26))).alias("attenuated"))


@query("m14_multiple_r2", f"WITH {WIDE} SELECT round(regr_r2(error, view), 9) AS r2 FROM wide WHERE view IS NOT NULL AND error IS NOT NULL")
def m14(t):
    # one predictor twice: the same fit as with it once, which SQL can state
    two = wide(t).withColumn("twice", F.col("view") * 2)
    return t.spark.createDataFrame([(round(S.r_squared(two, "error", ["view", "twice"]), 9),)], "r2 double")


@query("m15_spline_fit")
def m15(t):
    from ..operators.bias import spline_bias

    return spline_bias(panel(t))


@query("m16_label_permutation")
def m16(t):
    from ..operators.bias import permutation_effect

    return permutation_effect(panel(t), rounds=LABEL_REPS)


def debiased_sql(effect: str) -> str:
    """effect: a CASE over judge and gen; makes `moved` (gen, case_id, judge, score, debiased)."""
    read = lambda p: f"(q[least(floor({p}), 99)::INT + 1] + (q[least(floor({p}), 99)::INT + 2] - q[least(floor({p}), 99)::INT + 1]) * ({p} - least(floor({p}), 99)))"
    return (
        f"{PANEL}, q AS (SELECT judge, quantile_cont(score, {[i / 100 for i in range(101)]}) AS q FROM panel GROUP BY judge), "
        "k AS (SELECT *, CASE WHEN score IS NOT NULL THEN (rank() OVER (PARTITION BY judge ORDER BY score) + (count(*) OVER (PARTITION BY judge, score) - 1) / 2.0) / count(score) OVER (PARTITION BY judge) * 100 END AS p FROM panel), "
        f"e AS (SELECT k.*, q, ({effect})::DOUBLE AS e FROM k JOIN q USING (judge)), m AS (SELECT *, least(greatest(p - e, 0.01), 100.0)::DOUBLE AS pa, least(greatest(p, 0.01), 100.0)::DOUBLE AS pb FROM e), "
        f"moved AS (SELECT gen, case_id, judge, score, CASE WHEN e = 0 THEN score ELSE score + {read('pa')} - {read('pb')} END AS debiased FROM m)"
    )


_TWO = "CASE WHEN judge = 'view' AND gen = 1 THEN 5 WHEN judge = 'error' AND gen = 2 THEN -3 ELSE 0 END"


@query("m17_debias", f"WITH {debiased_sql(_TWO)} SELECT gen, case_id, judge, round(score, 9) AS score, round(debiased, 9) AS debiased FROM moved")
def m17(t):
    effect = t.spark.createDataFrame([("view", 1, 5.0), ("error", 2, -3.0)], "judge string, gen long, effect double")
    return S.debias(panel(t), effect).select("gen", "case_id", "judge", r("score").alias("score"), r("debiased").alias("debiased"))


@query("m17_debias_identity", f"WITH {PANEL} SELECT count(*) AS n, 0::BIGINT AS moved FROM panel WHERE NOT (judge = 'view' AND gen = 1)")
def m17_identity(t):
    effect = t.spark.createDataFrame([("view", 1, 5.0)], "judge string, gen long, effect double")
    out = S.debias(panel(t), effect).where("NOT (judge = 'view' AND gen = 1)")
    return out.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("debiased") - F.col("score")) > 1e-9).alias("moved"))


@query(
    "m18_leaderboard",
    f"WITH {PANEL}, a AS (SELECT gen, case_id, median(score) AS med, median(CASE WHEN judge = 'view' THEN score - 2 ELSE score END) AS deb FROM panel GROUP BY ALL), g AS (SELECT gen, round(avg(med), 9) AS score, round(avg(deb), 9) AS moved FROM a GROUP BY gen) "
    "SELECT gen, score, moved, rank() OVER (ORDER BY score DESC) AS place, rank() OVER (ORDER BY moved DESC) AS place_moved FROM g",
)
def m18(t):
    from pyspark.sql.window import Window

    p = panel(t).withColumn("d", F.when(F.col("judge") == "view", F.col("score") - 2).otherwise(F.col("score")))
    a = p.groupBy("gen", "case_id").agg(F.percentile("score", 0.5).alias("med"), F.percentile("d", 0.5).alias("deb"))
    g = a.groupBy("gen").agg(r(F.avg("med")).alias("score"), r(F.avg("deb")).alias("moved"))
    place = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c)))
    return g.select("gen", "score", "moved", place("score").alias("place"), place("moved").alias("place_moved"))


@query(
    "m19_reproducibility",
    f"WITH {WIDE} SELECT count(*) AS n, round(avg(view - error), 9) AS mean, round(stddev_samp(view - error), 9) AS sd, round(avg(abs(view - error)), 9) AS mean_abs, round(avg((view = error)::DOUBLE) * 100, 9) AS identical, round(avg((abs(view - error) <= 10)::DOUBLE) * 100, 9) AS within_10 FROM wide WHERE view IS NOT NULL AND error IS NOT NULL",
)
def m19(t):
    d = wide(t).where("view IS NOT NULL AND error IS NOT NULL").select((F.col("view") - F.col("error")).alias("d"))
    share = lambda c: r(F.avg(c.cast("double")) * 100)
    return d.agg(F.count("*").alias("n"), r(F.avg("d")).alias("mean"), r(F.stddev_samp("d")).alias("sd"), r(F.avg(F.abs("d"))).alias("mean_abs"), share(F.col("d") == 0).alias("identical"), share(F.abs("d") <= 10).alias("within_10"))


@query(
    "m20_cases_needed",
    f"WITH {MEDS}, f AS (SELECT gen, avg(med) AS full_mean FROM meds GROUP BY gen), s AS (SELECT gen, rep, med, row_number() OVER (PARTITION BY gen, rep ORDER BY md5('3|' || rep || '|' || case_id)) AS k FROM meds, range(20) t(rep)), "
    "d AS (SELECT n, gen, rep, abs(avg(med) - any_value(full_mean)) AS d FROM s JOIN f USING (gen), (SELECT unnest([5, 10, 20]) AS n) WHERE k <= n GROUP BY ALL) SELECT n, round(avg(d), 9) AS mean_abs, round(quantile_cont(d, 0.95), 9) AS p95 FROM d GROUP BY n",
)
def m20(t):
    m = meds(t)
    full = m.groupBy("gen").agg(F.avg("med").alias("full"))
    reps = m.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    s = R.top_k(reps, ["gen", "rep"], 20, R.hash_order(3, "rep", "case_id"), rank="k").join(full, "gen").withColumn("n", F.explode(F.array(*map(F.lit, (5, 10, 20))))).where("k <= n")
    d = s.groupBy("n", "gen", "rep").agg(F.abs(F.avg("med") - F.first("full")).alias("d"))
    return d.groupBy("n").agg(r(F.avg("d")).alias("mean_abs"), r(F.percentile("d", 0.95)).alias("p95"))


PAIRED = f"WITH {WIDE} SELECT gen, count(*) AS n, round(avg(view - error), 9) AS delta, round(stddev_samp(view - error) / sqrt(count(*)), 9) AS sem, "


@query("m21_paired_delta", PAIRED + "abs(avg(view - error)) > 2 * stddev_samp(view - error) / sqrt(count(*)) AS big FROM wide WHERE view IS NOT NULL AND error IS NOT NULL GROUP BY gen")
def m21(t):
    return S.paired(wide(t), "view", "error", ["gen"]).select("gen", "n", r("delta").alias("delta"), r("sem").alias("sem"), "big")


@query("m22_paired_t", PAIRED + "round(avg(view - error) / (stddev_samp(view - error) / sqrt(count(*))), 9) AS t FROM wide WHERE view IS NOT NULL AND error IS NOT NULL GROUP BY gen")
def m22(t):
    return S.paired(wide(t), "view", "error", ["gen"]).select("gen", "n", r("delta").alias("delta"), r("sem").alias("sem"), r("t").alias("t"))


@query("m23_regime_check", f"WITH {WIDE} SELECT round(avg(view - error), 9) AS delta, abs(avg(view - error)) <= 2 * stddev_samp(view - error) / sqrt(count(*)) AS same FROM wide WHERE view IS NOT NULL AND error IS NOT NULL")
def m23(t):
    return S.paired(wide(t), "view", "error").select(r("delta").alias("delta"), (~F.col("big")).alias("same"))


@query("m24_self_check", f"WITH {MEDS} SELECT count(*) AS n, 0::BIGINT AS off FROM meds")
def m24(t):
    two = meds(t).join(wide(t), ["gen", "case_id"]).withColumn("again", P.row_median([F.col(j) for j in JUDGES]))
    return two.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("again") - F.col("med")) > 1e-9).alias("off"))


@query(
    "m25_signed_rank",
    f"WITH {WIDE}, d AS (SELECT gen, view - error AS d FROM wide WHERE view IS NOT NULL AND error IS NOT NULL AND view <> error), k AS (SELECT gen, d, rank() OVER (PARTITION BY gen ORDER BY abs(d)) + (count(*) OVER (PARTITION BY gen, abs(d)) - 1) / 2.0 AS r FROM d) "
    "SELECT gen, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus FROM k GROUP BY gen",
)
def m25(t):
    return S.signed_rank(wide(t), "view", "error", ["gen"]).select("gen", "n", "w_plus", "w_minus")


@query("m26_panel_spearman", f"WITH {BY_GEN}, k AS (SELECT rank() OVER (ORDER BY view) AS x, rank() OVER (ORDER BY click) AS y FROM g) SELECT count(*) AS n, round(corr(x, y), 9) AS rho FROM k HAVING count(*) >= 3 AND count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2")
def m26(t):
    g = by_gen(t)
    ok = g.agg((F.count("*") >= 3).alias("a"), (F.countDistinct("view") >= 2).alias("b"), (F.countDistinct("click") >= 2).alias("c")).where("a AND b AND c")
    return S.spearman(g, "view", "click").crossJoin(ok).select("n", r("rho").alias("rho"))


@query("m28_out_of_sample", f"WITH {PANEL}, s AS (SELECT score FROM panel WHERE judge = 'view'), q AS (SELECT DISTINCT round(score, 0) AS s FROM s WHERE score < 40) SELECT q.s, round((count(*) FILTER (x.score < q.s) + count(*) FILTER (x.score <= q.s)) / (2.0 * count(*)) * 100, 9) AS percentile FROM q, s x GROUP BY q.s")
def m28(t):
    stored = panel(t).where("judge = 'view'")
    asked = stored.where("score < 40").select(F.round("score", 0).alias("s")).distinct()
    return S.out_of_sample(asked, stored, "s", "score", 0.0).select("s", r(F.when(F.col("percentile") <= 0.01, 0.0).otherwise(F.col("percentile"))).alias("percentile"))


@query("m27_scale_search", "WITH s AS (SELECT 0.2 + i * 0.001::DOUBLE AS s FROM range(29801) t(i)), f AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM s WHERE round(least(1.0, 10.0::DOUBLE / s), 2) = 0.5 AND round(least(1.0, 20.0::DOUBLE / s), 2) = 1.0) SELECT round(s, 3) AS scale FROM f WHERE i = n // 2")
def m27(t):
    from ..plans.render import fit_scale

    shown = [(10.0, 0.5), (20.0, 1.0)]
    return t.spark.createDataFrame([(fit_scale(shown),)], "scale double")


@query("m01b_seeded_bootstrap")
def m01b(t):
    return S.bootstrap_se_seeded(meds(t), ["gen"], "med", REPS, 20260909, 1, True)
