"""Composite reports over the panel: summaries, tables, contrasts. The scale of a score is in its name."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as Y
from ..operators import panel as P
from ..operators import ranking as R
from ..operators import statistics as S
from .aggregates import JUDGES, MEDS, PANEL, meds, panel, r
from .registry import query
from .statistics import BY_GEN, WIDE, by_gen, debiased_sql, wide
from .texts import SPAN_WORDS, spans_sql, with_cases

def one():
    return Window.partitionBy(F.lit(0))


@query(
    "q01_essay_summary",
    f"WITH {MEDS} SELECT gen, round(avg(med), 9) AS score_median, count(med) AS n, round(avg(n_seats), 9) AS seats, round(stddev_samp(med) / sqrt(count(*)), 9) AS sem FROM meds GROUP BY gen ORDER BY score_median DESC",
)
def q01(t):
    g = meds(t).groupBy("gen")
    out = g.agg(r(F.avg("med")).alias("score_median"), F.count("med").alias("n"), r(F.avg("n_seats")).alias("seats"), r(F.stddev_samp("med") / F.sqrt(F.count("*"))).alias("sem"))
    return out.orderBy(F.desc("score_median"))


@query(
    "q02_recitation_summary",
    f"WITH {PANEL}, d AS (SELECT gen, CASE WHEN case_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, score FROM panel) SELECT gen, dataset, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS sd, count(*) AS n FROM d GROUP BY ALL",
)
def q02(t):
    d = panel(t).withColumn("dataset", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))
    out = d.groupBy("gen", "dataset").agg(r(F.avg("score")).alias("mean"), r(F.stddev_samp("score")).alias("sd"), F.count("*").alias("n"))
    lead = F.max(F.when(F.col("dataset") == "even", F.col("mean"))).over(Window.partitionBy("gen"))
    return out.withColumn("__l", lead).orderBy(F.desc("__l"), "gen", "dataset").drop("__l")


PREDICTORS = ["error", "click"]


@query(
    "q03_metric_correlations",
    f"WITH {BY_GEN}, p AS (SELECT 'error' AS predictor, view AS y, error AS x FROM g UNION ALL SELECT 'click', view, click FROM g), k AS (SELECT predictor, x, y, rank() OVER (PARTITION BY predictor ORDER BY x) AS rx, rank() OVER (PARTITION BY predictor ORDER BY y) AS ry FROM p) SELECT predictor, count(*) AS n, round(corr(rx, ry), 9) AS spearman, round(corr(x, y), 9) AS pearson FROM k GROUP BY predictor ORDER BY abs(round(corr(rx, ry), 9)) DESC",
)
def q03(t):
    long = by_gen(t).unpivot(["gen", "view"], PREDICTORS, "predictor", "x")
    k = long.select("predictor", "x", F.col("view").alias("y"), R.average_rank("x", ["predictor"]).alias("rx"), R.average_rank("view", ["predictor"]).alias("ry"))
    out = k.groupBy("predictor").agg(F.count("*").alias("n"), r(F.corr("rx", "ry")).alias("spearman"), r(F.corr("x", "y")).alias("pearson"))
    return out.orderBy(F.abs("spearman").desc_nulls_last())


@query(
    "q04_agreement_levels",
    f"WITH {WIDE}, m AS (SELECT gen, avg(view) AS view, avg(error) AS error FROM wide GROUP BY gen) SELECT 'essay' AS level, count(*) AS n, round(corr(view, error), 9) AS pearson FROM wide WHERE view IS NOT NULL AND error IS NOT NULL UNION ALL SELECT 'model', count(*), round(corr(view, error), 9) FROM m",
)
def q04(t):
    essay = S.pearson(wide(t), "view", "error").withColumn("level", F.lit("essay"))
    model = S.pearson(by_gen(t), "view", "error").withColumn("level", F.lit("model"))
    return essay.union(model).select("level", "n", r("r").alias("pearson"))


@query(
    "q05_bias_leaderboard",
    f"WITH {debiased_sql('CASE WHEN gen = 3 THEN 2.5 ELSE 0 END')}, c AS (SELECT gen, case_id, median(score) AS a, median(debiased) AS b FROM moved GROUP BY ALL), g AS (SELECT gen, round(avg(a), 9) AS score, round(avg(b), 9) AS debiased FROM c GROUP BY gen) "
    "SELECT gen, score, debiased, rank() OVER (ORDER BY score DESC) AS place, rank() OVER (ORDER BY debiased DESC) AS place_debiased FROM g",
)
def q05(t):
    effect = t.spark.createDataFrame([(j, 3, 2.5) for j in JUDGES], "judge string, gen long, effect double")
    d = S.debias(panel(t), effect)
    g = d.groupBy("gen", "case_id").agg(F.percentile("score", 0.5).alias("a"), F.percentile("debiased", 0.5).alias("b")).groupBy("gen").agg(r(F.avg("a")).alias("score"), r(F.avg("b")).alias("debiased"))
    place = lambda c: F.rank().over(one().orderBy(F.desc(c)))
    return g.select("gen", "score", "debiased", place("score").alias("place"), place("debiased").alias("place_debiased"))


@query(
    "q06_main_table",
    f"WITH {WIDE}, m AS (SELECT gen, case_id, median(score) AS med FROM panel GROUP BY ALL), a AS (SELECT gen, avg(med) AS essay, stddev_samp(med) / sqrt(count(*)) AS sem FROM m GROUP BY gen), b AS (SELECT gen, avg(view) AS view, avg(error) AS error FROM wide GROUP BY gen), c AS (SELECT user_id % 15 AS gen, sum(value) / 1e6 AS cost FROM events GROUP BY 1) "
    "SELECT gen, round(essay, 9) AS essay, round(sem, 9) AS sem, round(view, 9) AS view, round(error, 9) AS error, round(cost, 9) AS cost FROM a JOIN b USING (gen) LEFT JOIN c USING (gen)",
)
def q06(t):
    a = meds(t).groupBy("gen").agg(r(F.avg("med")).alias("essay"), r(F.stddev_samp("med") / F.sqrt(F.count("*"))).alias("sem"))
    b = wide(t).groupBy("gen").agg(r(F.avg("view")).alias("view"), r(F.avg("error")).alias("error"))
    c = t.events.groupBy((F.col("user_id") % 15).alias("gen")).agg(r(F.sum("value") / 1e6).alias("cost"))
    return a.join(b, "gen").join(c, "gen", "left")


@query(
    "q07_merged_table",
    f"WITH {MEDS}, g AS (SELECT gen, avg(med) AS essay FROM meds GROUP BY gen) SELECT gen, round(essay, 9) AS essay, CASE gen WHEN 1 THEN 2.0 ELSE 0 END::DOUBLE AS delta, CASE gen WHEN 1 THEN 'self' ELSE '' END AS relation, dense_rank() OVER (ORDER BY round_even(essay, 1) DESC) AS mark FROM g",
)
def q07(t):
    g = meds(t).groupBy("gen").agg(F.avg("med").alias("essay"))
    bias = t.spark.createDataFrame([(1, 2.0, "self")], "gen long, delta double, relation string")
    j = g.join(F.broadcast(bias), "gen", "left").withColumn("one", F.lit(0))
    return j.select("gen", r("essay").alias("essay"), F.coalesce("delta", F.lit(0.0)).alias("delta"), F.coalesce("relation", F.lit("")).alias("relation"), R.marks("essay", 1, ["one"]).alias("mark"))


@query("q08_rejudged", f"WITH {WIDE} SELECT gen, case_id, round(coalesce(error, view), 9) AS score, CASE WHEN error IS NULL THEN 'kept' ELSE 'new' END AS origin FROM wide WHERE error IS NOT NULL OR view IS NOT NULL")
def q08(t):
    w = wide(t)
    new = w.where("error IS NOT NULL").select("gen", "case_id", F.col("error").alias("score"), F.lit("new").alias("origin"))
    old = w.where("view IS NOT NULL").select("gen", "case_id", F.col("view").alias("score")).join(new.select("gen", "case_id"), ["gen", "case_id"], "left_anti")
    return new.unionByName(old.withColumn("origin", F.lit("kept")), allowMissingColumns=True).withColumn("score", r("score"))


ARMS = f"WITH {WIDE}, arms AS (SELECT gen, case_id, 'base' AS arm, view AS s FROM wide UNION ALL SELECT gen, case_id, 'a', error FROM wide UNION ALL SELECT gen, case_id, 'b', click FROM wide), p AS (SELECT x.gen, x.arm, x.s - y.s AS d, x.s AS level FROM arms x JOIN arms y ON x.gen = y.gen AND x.case_id = y.case_id AND y.arm = 'base' WHERE x.arm <> 'base' AND x.s IS NOT NULL AND y.s IS NOT NULL) "


def arms(t):
    w = wide(t).select("gen", "case_id", F.col("view").alias("base"), F.col("error").alias("a"), F.col("click").alias("b"))
    return w.unpivot(["gen", "case_id", "base"], ["a", "b"], "arm", "s").where("s IS NOT NULL AND base IS NOT NULL")


@query("q09_ladder", ARMS + "SELECT gen, arm, round(avg(level), 9) AS level, round(avg(d), 9) AS delta, abs(avg(d)) > 2 * stddev_samp(d) / sqrt(count(*)) AS big FROM p GROUP BY ALL")
def q09(t):
    d = S.paired(arms(t), "s", "base", ["gen", "arm"])
    level = arms(t).groupBy("gen", "arm").agg(r(F.avg("s")).alias("level"))
    return level.join(d, ["gen", "arm"]).select("gen", "arm", "level", r("delta").alias("delta"), "big")


@query("q10_ablation", ARMS + "SELECT arm, count(*) AS n, round(avg(d), 9) AS delta, round(stddev_samp(d) / sqrt(count(*)) * 2, 9) AS sem2 FROM p GROUP BY arm")
def q10(t):
    return S.paired(arms(t), "s", "base", ["arm"]).select("arm", "n", r("delta").alias("delta"), r(F.col("sem") * 2).alias("sem2"))


@query("q11_citation_counts", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS distinct_norms, round(avg((l_returnflag = 'R')::DOUBLE), 9) AS state_share FROM lineitem GROUP BY 1")
def q11(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("distinct_norms"), r(F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("state_share"))


@query("q12_diagnostics", "WITH b AS (SELECT p_brand, CASE WHEN p_size > 40 THEN 'absent' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'retrieved' ELSE 'missed' END AS bucket FROM part) SELECT p_brand, round(count(*) FILTER (bucket = 'absent') / count(*), 9) AS absent, round(count(*) FILTER (bucket = 'missed') / count(*), 9) AS missed, round(count(*) FILTER (bucket = 'retrieved') / count(*), 9) AS retrieved FROM b GROUP BY 1")
def q12(t):
    got = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("g")).distinct()
    b = t.part.join(got, F.col("g") == F.col("p_partkey"), "left").select("p_brand", F.when(F.col("p_size") > 40, "absent").when(F.col("g").isNotNull(), "retrieved").otherwise("missed").alias("bucket"))
    kinds = ["absent", "missed", "retrieved"]
    w = b.groupBy("p_brand").pivot("bucket", kinds).count().na.fill(0, kinds)
    return w.select("p_brand", *[r(F.col(k) / (F.col("absent") + F.col("missed") + F.col("retrieved"))).alias(k) for k in kinds])


@query("q13_coverage", "WITH g AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT c, p, p % 3 = 0 AS there FROM g) SELECT 'distinct' AS kind, round(avg(there::DOUBLE), 9) AS pct FROM (SELECT DISTINCT p, there FROM k) UNION ALL SELECT 'per_case', round(avg(s), 9) FROM (SELECT avg(there::DOUBLE) AS s FROM k GROUP BY c)")
def q13(t):
    g = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p")).distinct().withColumn("there", (F.col("p") % 3 == 0).cast("double"))
    once = g.select("p", "there").distinct().agg(r(F.avg("there")).alias("pct")).select(F.lit("distinct").alias("kind"), "pct")
    per = g.groupBy("c").agg(F.avg("there").alias("s")).agg(r(F.avg("s")).alias("pct")).select(F.lit("per_case").alias("kind"), "pct")
    return once.union(per)


#: Controls of a text: cases at these distances from its own.
CONTROLS = (7, 19, 31, 43)
_CONTROLS = f"SELECT doc_id AS id, c FROM (SELECT DISTINCT doc_id, (doc_id + d) % n AS c, n FROM documents, (SELECT unnest({[0, *CONTROLS]}) AS d), (SELECT max(n) AS n FROM cases)) JOIN cases USING (c)"


@query(
    "q14_leakage",
    f"WITH {spans_sql(_CONTROLS)}, words AS (SELECT doc_id AS id, len({SPAN_WORDS.format('text')}) AS words, doc_id % (SELECT max(n) FROM cases) AS own FROM documents) "
    "SELECT id AS doc_id, words, max(span) FILTER (c = own) AS own, max(span) FILTER (c <> own) AS control, max(span) FILTER (c = own) - max(span) FILTER (c <> own) AS excess FROM spans JOIN words USING (id) WHERE words >= 50 GROUP BY id, words",
)
def q14(t):
    """How far each text of 50 words and more runs on in its case's item, and the furthest in other cases' items."""
    docs, items, n = with_cases(t)
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_§]+"), F.lit(0)))
    asked = docs.select("doc_id", "text", words.alias("words"), F.col("c").alias("own")).where("words >= 50")
    cases = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (0, *CONTROLS)]), lambda d: (F.col("doc_id") + d) % max(1, n)))
    spans = Y.with_longest_span(asked.withColumn("c", F.explode(cases)).join(items, "c"), "text", "b")
    mine = F.col("c") == F.col("own")
    out = spans.groupBy("doc_id", "words").agg(F.max(F.when(mine, F.col("span"))).alias("own"), F.max(F.when(~mine, F.col("span"))).alias("control"))
    return out.withColumn("excess", F.col("own") - F.col("control"))


@query("q15_within_knowledge", "WITH g AS (SELECT l_suppkey AS m, o_custkey % 50 AS c, avg(l_quantity) AS x, avg(l_extendedprice) AS y, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT x - avg(x) OVER (PARTITION BY c) - avg(x) OVER (PARTITION BY m) + avg(x) OVER () AS x, y - avg(y) OVER (PARTITION BY c) - avg(y) OVER (PARTITION BY m) + avg(y) OVER () AS y FROM g) SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM d")
def q15(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    g = j.groupBy(F.col("l_suppkey").alias("m"), (F.col("o_custkey") % 50).alias("c")).agg(F.avg("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y"), F.count("*").alias("n")).where("n >= 3")
    d = R.with_demeaned(g, ["x", "y"], ["c"], ["m"])
    return d.agg(F.count("*").alias("n"), r(F.corr("x", "y"), 6).alias("r"))


@query("q16_price_performance", f"WITH {MEDS}, s AS (SELECT gen, round(avg(med), 9) AS score FROM meds GROUP BY gen), c AS (SELECT user_id % 15 AS gen, round(sum(value), 6) AS cost FROM events GROUP BY 1), j AS (SELECT gen, score, cost, max(score) OVER (ORDER BY cost, score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s JOIN c USING (gen)) SELECT gen, score, cost, best IS NULL OR score > best AS on_front FROM j")
def q16(t):
    s = meds(t).groupBy("gen").agg(r(F.avg("med")).alias("score"))
    c = t.events.groupBy((F.col("user_id") % 15).alias("gen")).agg(r(F.sum("value"), 6).alias("cost"))
    j = s.join(c, "gen")
    front = R.pareto(j, "cost", "score").select("gen", F.lit(True).alias("f"))
    return j.join(front, "gen", "left").select("gen", "score", "cost", F.coalesce("f", F.lit(False)).alias("on_front"))


@query("q17_difficulty_profile", f"WITH {MEDS}, c AS (SELECT case_id, row_number() OVER (ORDER BY round(avg(med), 9), case_id) AS place FROM meds GROUP BY case_id) SELECT gen, case_id, place, round(CASE WHEN count(*) OVER w >= 5 THEN avg(med) OVER w END, 9) AS smooth FROM meds JOIN c USING (case_id) WINDOW w AS (PARTITION BY gen ORDER BY place ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def q17(t):
    m = meds(t)
    c = m.groupBy("case_id").agg(F.round(F.avg("med"), 9).alias("m"))
    place = c.select("case_id", F.row_number().over(one().orderBy("m", "case_id")).alias("place"))
    return m.join(place, "case_id").select("gen", "case_id", "place", r(R.rolling_mean("med", ["gen"], ["place"])).alias("smooth"))


@query("q18_dual_ranks", f"WITH {BY_GEN}, k AS (SELECT gen, view AS published, error AS dual FROM g WHERE gen <> 4) SELECT gen, round(published, 9) AS published, round(dual, 9) AS dual, round(dual - published, 9) AS delta, rank() OVER (ORDER BY published DESC) AS rank_pub, rank() OVER (ORDER BY dual DESC) AS rank_dual FROM k")
def q18(t):
    k = by_gen(t).where("gen <> 4").withColumn("one", F.lit(0))
    place = lambda c: F.floor(R.average_rank(c, ["one"], True)).cast("int")
    return k.select("gen", r("view").alias("published"), r("error").alias("dual"), r(F.col("error") - F.col("view")).alias("delta"), place("view").alias("rank_pub"), place("error").alias("rank_dual"))


@query("q20_reproducibility_by_model", f"WITH {BY_GEN} SELECT count(*) AS n, round(avg(abs(view - error)), 9) AS mean_abs, round(corr(view, error), 9) AS r FROM g")
def q20(t):
    return by_gen(t).agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("view") - F.col("error")))).alias("mean_abs"), r(F.corr("view", "error")).alias("r"))


@query("q21_score_shape", f"WITH {MEDS} SELECT gen, count(*) AS n, round(avg(med), 9) AS mean, round(avg((med >= 60)::DOUBLE) * 100, 9) AS hi, round(avg((med <= 40)::DOUBLE) * 100, 9) AS lo FROM meds GROUP BY gen")
def q21(t):
    share = lambda c: r(F.avg(c.cast("double")) * 100)
    return meds(t).groupBy("gen").agg(F.count("*").alias("n"), r(F.avg("med")).alias("mean"), share(F.col("med") >= 60).alias("hi"), share(F.col("med") <= 40).alias("lo"))


@query("q22_recall_slopes", f"WITH {WIDE} SELECT 'view' AS judge, count(*) AS n, round(regr_slope(view, click), 9) AS slope FROM wide WHERE view IS NOT NULL AND click IS NOT NULL UNION ALL SELECT 'error', count(*), round(regr_slope(error, click), 9) FROM wide WHERE error IS NOT NULL AND click IS NOT NULL")
def q22(t):
    long = wide(t).unpivot(["click"], ["view", "error"], "judge", "s")
    return S.slope(long, "click", "s", ["judge"]).select("judge", "n", r("slope").alias("slope"))


@query("q23_index_scatter", f"WITH {MEDS}, g AS (SELECT gen, avg(med) AS score FROM meds GROUP BY gen) SELECT gen, round(score, 9) AS score, r_name AS index_name FROM g JOIN region ON r_regionkey = gen")
def q23(t):
    g = meds(t).groupBy("gen").agg(r(F.avg("med")).alias("score"))
    return g.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("gen")).select("gen", "score", F.col("r_name").alias("index_name"))


@query("q24_seat_assembly", f"WITH {WIDE} SELECT gen, case_id, round(view, 9) AS view, round(error, 9) AS error, round(click, 9) AS click, round(list_sort([view, error, click])[2], 9) AS median FROM wide WHERE view IS NOT NULL AND error IS NOT NULL AND click IS NOT NULL")
def q24(t):
    full = wide(t).where("view IS NOT NULL AND error IS NOT NULL AND click IS NOT NULL")
    return full.select("gen", "case_id", *[r(c).alias(c) for c in ("view", "error", "click")], r(P.row_median([F.col(c) for c in ("view", "error", "click")])).alias("median"))


@query("q25_comparison", f"WITH {WIDE} SELECT gen, round(avg(view), 9) AS mean_a, round(stddev_samp(view), 9) AS sd_a, round(avg(error), 9) AS mean_b, round(stddev_samp(error), 9) AS sd_b FROM wide GROUP BY gen")
def q25(t):
    return wide(t).groupBy("gen").agg(r(F.avg("view")).alias("mean_a"), r(F.stddev_samp("view")).alias("sd_a"), r(F.avg("error")).alias("mean_b"), r(F.stddev_samp("error")).alias("sd_b"))


@query("q27_dataset_build", "SELECT p_brand, p_partkey, n FROM (SELECT p_brand, p_partkey, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_partkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, p_partkey) WHERE k <= 20")
def q27(t):
    n = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_partkey").agg(F.count("*").alias("n"))
    return R.top_k(n, ["p_brand"], 20, F.desc("n"), F.asc("p_partkey")).select("p_brand", "p_partkey", "n")


@query("q28_condition_tables", ARMS + "SELECT gen, arm, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 9) AS t FROM p GROUP BY ALL")
def q28(t):
    return S.paired(arms(t), "s", "base", ["gen", "arm"]).select("gen", "arm", "n", r("t").alias("t"))


@query("q29_corpus_contrast", f"WITH {WIDE}, m AS (SELECT gen, case_id, (view + error) / 2 AS two FROM wide WHERE view IS NOT NULL AND error IS NOT NULL) SELECT gen, count(*) AS n, round(avg(two), 9) AS score_two_seats, round(stddev_samp(two) / sqrt(count(*)), 9) AS sem FROM m GROUP BY gen")
def q29(t):
    m = wide(t).where("view IS NOT NULL AND error IS NOT NULL").select("gen", P.row_median([F.col("view"), F.col("error")]).alias("two"))
    return m.groupBy("gen").agg(F.count("*").alias("n"), r(F.avg("two")).alias("score_two_seats"), r(F.stddev_samp("two") / F.sqrt(F.count("*"))).alias("sem"))


@query("q30_arm_summary", ARMS + "SELECT gen, round(avg(d) FILTER (arm = 'a'), 9) AS a, round(avg(d) FILTER (arm = 'b'), 9) AS b FROM p GROUP BY gen")
def q30(t):
    d = arms(t).withColumn("d", F.col("s") - F.col("base"))
    w = d.groupBy("gen").pivot("arm", ["a", "b"]).avg("d")
    return w.select("gen", r("a").alias("a"), r("b").alias("b"))


@query("q31_predictor_panels", f"WITH {BY_GEN} SELECT count(*) AS n, round(min(view), 9) AS low, round(max(view), 9) AS high, round(regr_slope(view, error), 9) AS slope FROM g WHERE error > 0")
def q31(t):
    g = by_gen(t).where("error > 0")
    return g.agg(F.count("*").alias("n"), r(F.min("view")).alias("low"), r(F.max("view")).alias("high"), r(F.regr_slope("view", "error")).alias("slope"))


@query("q33_swapped_seat", f"WITH {WIDE}, s AS (SELECT gen, case_id, CASE WHEN gen = 2 THEN click ELSE error END AS seat, view FROM wide), d AS (SELECT gen, seat - view AS d, seat FROM s WHERE seat IS NOT NULL AND view IS NOT NULL) SELECT gen, round(avg(seat), 9) AS level, round(avg(d), 9) AS delta, round(2 * stddev_samp(d) / sqrt(count(*)), 9) AS sem2 FROM d GROUP BY gen")
def q33(t):
    side = wide(t).where("gen = 2").select("gen", "case_id", F.col("click").alias("new"))
    s = wide(t).join(side, ["gen", "case_id"], "left").withColumn("seat", F.when(F.col("gen") == 2, F.col("new")).otherwise(F.col("error")))
    both = s.where("seat IS NOT NULL AND view IS NOT NULL")
    d = S.paired(both, "seat", "view", ["gen"])
    return both.groupBy("gen").agg(r(F.avg("seat")).alias("level")).join(d, "gen").select("gen", "level", r("delta").alias("delta"), r(F.col("sem") * 2).alias("sem2"))


@query("q34_rebuild_check", f"WITH {MEDS} SELECT gen, round(avg(med), 9) AS score, true AS same FROM meds GROUP BY gen")
def q34(t):
    a = meds(t).groupBy("gen").agg(r(F.avg("med")).alias("score"))
    w = wide(t).withColumn("m", P.row_median([F.col(j) for j in JUDGES])).groupBy("gen").agg(F.avg("m").alias("again"))
    return a.join(w, "gen").select("gen", "score", (F.abs(F.col("again") - F.col("score")) < 1e-6).alias("same"))


@query("q19_dual_citation", "WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS a FROM orders WHERE o_totalprice < 150000 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS b FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT count(*) AS n, round(avg(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))), 9) AS jaccard, round(avg(len(list_intersect(a, b)) / len(b)), 9) AS recall FROM a JOIN b USING (k)")
def q19(t):
    from ..functions.text import jaccard, precision_recall

    s = lambda cond, n: t.orders.where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias(n))
    j = s("o_totalprice < 150000", "a").join(s("o_totalprice > 100000", "b"), "k")
    return j.agg(F.count("*").alias("n"), r(F.avg(jaccard(F.col("a"), F.col("b"), None))).alias("jaccard"), r(F.avg(precision_recall(F.col("a"), F.col("b"))[1])).alias("recall"))


@query("q32_probe", f"WITH {WIDE}, s AS (SELECT gen, case_id, view, error, row_number() OVER (PARTITION BY gen ORDER BY md5('4|' || gen || '|' || case_id)) AS k FROM wide WHERE view IS NOT NULL AND error IS NOT NULL) SELECT gen, count(*) AS n, round(avg(abs(view - error)), 9) AS noise FROM s WHERE k <= 10 GROUP BY gen")
def q32(t):
    both = wide(t).where("view IS NOT NULL AND error IS NOT NULL")
    s = R.top_k(both, ["gen"], 10, R.hash_order(4, "gen", "case_id"))
    return s.groupBy("gen").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("view") - F.col("error")))).alias("noise"))
