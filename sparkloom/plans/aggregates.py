"""Aggregations and windows over the judge panel (events) and the orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import panel as P
from ..operators import ranking as R
from ..operators import statistics as S
from .registry import query

JUDGES = ["click", "error", "purchase", "signup", "view"]

#: The panel, and its per-essay medians, in SQL.
PANEL = "panel AS (SELECT user_id % 15 AS gen, day(ts) AS case_id, event_type AS judge, avg(value) AS score FROM events GROUP BY ALL)"
MEDS = PANEL + ", meds AS (SELECT gen, case_id, median(score) AS med, count(score) AS n_seats FROM panel GROUP BY ALL)"


def panel(t):
    return P.long_panel(t.events)


def meds(t):
    return P.essay_median(panel(t))


def r(c, n=9):
    return F.round(c, n)


@query("a01_row_median", f"WITH {MEDS} SELECT gen, case_id, round(med, 9) AS med, n_seats FROM meds")
def a01(t):
    return meds(t).select("gen", "case_id", r("med").alias("med"), "n_seats")


WIDE = ", ".join(f"max(score) FILTER (judge = '{j}') AS {j}" for j in JUDGES)


@query("a01_row_median_wide", f"WITH {MEDS} SELECT gen, case_id, round(med, 9) AS med FROM meds")
def a01_wide(t):
    wide = P.wide_panel(panel(t), JUDGES)
    return wide.select("gen", "case_id", r(P.row_median([F.col(j) for j in JUDGES])).alias("med"))


@query("a02_group_mean", f"WITH {MEDS} SELECT gen, round(avg(med), 9) AS score FROM meds GROUP BY gen ORDER BY score DESC")
def a02(t):
    return meds(t).groupBy("gen").agg(r(F.avg("med")).alias("score")).orderBy(F.desc("score"))


@query("a03_mean_std", f"WITH {MEDS} SELECT gen, round(avg(med), 9) AS mean, round(stddev_samp(med), 9) AS sd FROM meds GROUP BY gen")
def a03(t):
    return meds(t).groupBy("gen").agg(r(F.avg("med")).alias("mean"), r(F.stddev_samp("med")).alias("sd"))


@query(
    "a04_sem_two_ways",
    f"WITH {PANEL}, w AS (SELECT gen, case_id, max(score) FILTER (judge = 'error') AS s FROM panel GROUP BY ALL) "
    "SELECT gen, round(stddev_samp(s) / sqrt(count(*)), 9) AS sem_rows, round(stddev_samp(s) / sqrt(count(s)), 9) AS sem_filled FROM w GROUP BY gen",
)
def a04(t):
    wide = P.wide_panel(panel(t), JUDGES)
    sd = F.stddev_samp("error")
    return wide.groupBy("gen").agg(r(sd / F.sqrt(F.count("*"))).alias("sem_rows"), r(sd / F.sqrt(F.count("error"))).alias("sem_filled"))


COST = "CASE WHEN event_type IN ('purchase', 'signup') THEN value END"


@query("a05_null_aware_sum", f"SELECT user_id, round(sum({COST}), 9) AS spend FROM events GROUP BY user_id")
def a05(t):
    return t.events.groupBy("user_id").agg(r(F.sum(F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")))).alias("spend"))


@query("a06_panel_sum", f"WITH {PANEL} SELECT gen, case_id, round(sum(CASE WHEN judge <> 'view' THEN score END), 9) AS total FROM panel GROUP BY ALL")
def a06(t):
    return panel(t).groupBy("gen", "case_id").agg(r(F.sum(F.when(F.col("judge") != "view", F.col("score")))).alias("total"))


HOLES = "CASE WHEN judge <> 'view' AND case_id % 7 <> 0 THEN score / 100 END"


@query("a07_ensemble_min", f"WITH {PANEL} SELECT gen, case_id, round(CASE WHEN count({HOLES}) > 0 THEN min(coalesce({HOLES}, 1)) END, 9) AS score FROM panel GROUP BY ALL")
def a07(t):
    holes = F.when((F.col("judge") != "view") & (F.col("case_id") % 7 != 0), F.col("score") / 100)
    return panel(t).groupBy("gen", "case_id").agg(r(P.ensemble_min(holes)).alias("score"))


@query("a08_distinct_counts", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_returnflag)) AS pairs FROM lineitem GROUP BY l_suppkey")
def a08(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_partkey", "l_returnflag").alias("pairs"))


@query("a09_share", f"WITH {MEDS} SELECT gen, round(avg((med > 50)::DOUBLE), 9) AS share FROM meds GROUP BY gen")
def a09(t):
    return meds(t).groupBy("gen").agg(r(F.avg((F.col("med") > 50).cast("double")), 9).alias("share"))


@query(
    "a10_mode",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1",
)
def a10(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.keep_one(n, ["user_id"], F.desc("n"), F.asc("event_type"))


@query("a11_value_counts", "SELECT lang, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang")
def a11(t):
    n = t.documents.groupBy("lang").count()
    return n.select("lang", r(F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))), 9).alias("share"))


LANGS = ["de", "en", "es", "fr"]


@query("a12_crosstab", "SELECT source, " + ", ".join(f"round(count(*) FILTER (lang = '{g}') / count(*), 9) AS {g}" for g in LANGS) + " FROM documents GROUP BY source")
def a12(t):
    wide = t.documents.groupBy("source").pivot("lang", LANGS).count().na.fill(0, LANGS)
    total = sum((F.col(g) for g in LANGS[1:]), F.col(LANGS[0]))
    return wide.select("source", *[r(F.col(g) / total, 9).alias(g) for g in LANGS])


@query("a13_pivot_mean", "WITH " + PANEL + " SELECT gen, " + ", ".join(f"round(avg(score) FILTER (judge = '{j}'), 9) AS {j}" for j in JUDGES) + " FROM panel GROUP BY gen")
def a13(t):
    wide = panel(t).groupBy("gen").pivot("judge", JUDGES).avg("score")
    return wide.select("gen", *[r(j).alias(j) for j in JUDGES])


@query("a14_unpivot", f"WITH {PANEL} SELECT gen, case_id, judge, round(score, 9) AS score FROM panel")
def a14(t):
    long = P.wide_panel(panel(t), JUDGES).unpivot(["gen", "case_id"], JUDGES, "judge", "score").where("score IS NOT NULL")
    return long.select("gen", "case_id", "judge", r("score").alias("score"))


@query(
    "a15_scale_summary",
    f"WITH {PANEL} SELECT judge, count(score) AS n, round(avg(score), 9) AS mean, round(median(score), 9) AS med, round(stddev_samp(score), 9) AS sd, round(min(score), 9) AS low, round(max(score), 9) AS high FROM panel GROUP BY judge",
)
def a15(t):
    return panel(t).groupBy("judge").agg(
        F.count("score").alias("n"), r(F.avg("score")).alias("mean"), r(F.percentile("score", 0.5)).alias("med"), r(F.stddev_samp("score")).alias("sd"), r(F.min("score")).alias("low"), r(F.max("score")).alias("high")
    )


@query("a16_percentiles", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_quantity, {p / 100}), 9) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM lineitem GROUP BY l_returnflag")
def a16(t):
    q = R.quantiles(t.lineitem, ["l_returnflag"], "l_quantity", [p / 100 for p in (5, 25, 50, 75, 95)], "p")
    return q.select("l_returnflag", *[r(F.col("p")[i]).alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))])


@query(
    "a18_grouping_sets",
    "SELECT coalesce(lang, 'all') AS lang, count(*) AS docs, round(avg((n_chars > 1500)::DOUBLE), 9) AS share FROM documents GROUP BY GROUPING SETS ((lang), ()) "
    "UNION ALL SELECT 'nonen', count(*), round(avg((n_chars > 1500)::DOUBLE), 9) FROM documents WHERE lang <> 'en'",
)
def a18(t):
    share = r(F.avg((F.col("n_chars") > 1500).cast("double")), 9).alias("share")
    both = t.documents.rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("docs"), share).select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("lang"), "docs", "share")
    rest = t.documents.where("lang <> 'en'").agg(F.count("*").alias("docs"), share).select(F.lit("nonen").alias("lang"), "docs", "share")
    return both.union(rest)


@query("a19_any_positive", "SELECT event_id, max((value > 99.5)::INT) OVER (PARTITION BY user_id) = 1 AS billed FROM events")
def a19(t):
    return t.events.select("event_id", (F.max((F.col("value") > 99.5).cast("int")).over(Window.partitionBy("user_id")) == 1).alias("billed"))


@query("a20_extrapolate", f"WITH {MEDS} SELECT gen, round(avg(med) * 81, 9) AS total, count(*) < 30 AS is_short FROM meds GROUP BY gen")
def a20(t):
    return meds(t).groupBy("gen").agg(r(F.avg("med") * 81).alias("total"), (F.count("*") < 30).alias("is_short"))


@query(
    "a21_top_cited",
    "SELECT l_partkey, n, p_name FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN part ON p_partkey = l_partkey ORDER BY n DESC, l_partkey LIMIT 25",
)
def a21(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).orderBy(F.desc("n"), "l_partkey").limit(25).select("l_partkey", "n", "p_name")


@query("a22_in_degree", "SELECT l_partkey AS vertex, count(*) AS in_degree FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def a22(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("vertex")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "vertex").limit(100)


@query("a23_histogram", f"WITH {MEDS} SELECT least(floor((med + 5) / 10), 10)::BIGINT AS bin, count(*) AS n FROM meds WHERE med BETWEEN -5 AND 105 GROUP BY 1")
def a23(t):
    return S.histogram(meds(t), "med", -5, 105, 10)


@query("a24_string_set", f"WITH {PANEL} SELECT gen, string_agg(DISTINCT judge, '+' ORDER BY judge) AS judges FROM panel WHERE score > 60 GROUP BY gen")
def a24(t):
    return panel(t).where("score > 60").groupBy("gen").agg(F.concat_ws("+", F.array_sort(F.collect_set("judge"))).alias("judges"))


@query("a25_first_filled", "SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'purchase') AS value FROM events GROUP BY user_id")
def a25(t):
    return t.events.groupBy("user_id").agg(F.min_by("value", F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("value"))


@query("a26_missing_seats", f"WITH {PANEL}, w AS (SELECT gen, case_id, count(*) AS n FROM panel GROUP BY ALL) SELECT count(*) FILTER (n < 5) AS missing, count(*) AS n FROM w")
def a26(t):
    wide = P.wide_panel(panel(t), JUDGES)
    lacking = F.greatest(*[F.col(j).isNull().cast("int") for j in JUDGES])
    return wide.agg(F.sum(lacking).alias("missing"), F.count("*").alias("n"))


Z = "(SELECT gen, count(*)::DOUBLE AS n, avg(med) AS m FROM meds GROUP BY gen)"
BIMODAL = (
    f"WITH {MEDS}, c AS (SELECT gen, n, med - m AS d FROM meds JOIN {Z} USING (gen)), "
    "k AS (SELECT gen, any_value(n) AS n, sum(d * d) / any_value(n) AS m2, sum(d ** 3) / any_value(n) AS m3, sum(d ** 4) / any_value(n) AS m4 FROM c GROUP BY gen), "
    "g AS (SELECT gen, n, m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) AS g1, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) AS g2 FROM k) "
    "SELECT gen, round((g1 * g1 + 1) / (g2 + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))), 9) AS bimodality FROM g"
)


@query("a27_bimodality", BIMODAL)
def a27(t):
    return S.bimodality(meds(t), ["gen"], "med").select("gen", r("bimodality").alias("bimodality"))


@query("a28_ragged", f"WITH {PANEL}, n AS (SELECT gen, judge, count(DISTINCT case_id) AS n FROM panel GROUP BY ALL) SELECT gen, judge, n, (SELECT max(n) FROM n) AS most FROM n WHERE n < (SELECT max(n) FROM n)")
def a28(t):
    return P.ragged(panel(t))


@query(
    "a29_vector_difference",
    "WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), "
    "d AS (SELECT vec_id, list_dot_product(x::DOUBLE[], y::DOUBLE[]) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) / sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])) AS cosine, "
    "list_max(list_transform(list_zip(x, y), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS diff FROM p) SELECT round(median(cosine), 9) AS med_cosine, round(min(cosine), 9) AS min_cosine, round(median(diff), 9) AS med_diff, round(max(diff), 9) AS max_diff FROM d",
)
def a29(t):
    x = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    d = x.join(y, "vec_id").select(S.cosine("x", "y").alias("cosine"), F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))).alias("diff"))
    return d.agg(r(F.percentile("cosine", 0.5)).alias("med_cosine"), r(F.min("cosine")).alias("min_cosine"), r(F.percentile("diff", 0.5)).alias("med_diff"), r(F.max("diff")).alias("max_diff"))


# --- windows ---


@query("w01_percent_rank", f"WITH {PANEL} SELECT gen, case_id, judge, round((rank() OVER (PARTITION BY judge ORDER BY score) + (count(*) OVER (PARTITION BY judge, score) - 1) / 2.0) / count(*) OVER (PARTITION BY judge) * 100, 9) AS pct FROM panel")
def w01(t):
    ranked = R.with_average_rank(panel(t), "score", ["judge"], total="n")
    return ranked.select("gen", "case_id", "judge", r(F.col("rank") / F.col("n") * 100).alias("pct"))


@query("w02_min_rank", f"WITH {MEDS}, g AS (SELECT gen, round(avg(med)) AS s FROM meds GROUP BY gen) SELECT gen, rank() OVER (ORDER BY s DESC) AS place FROM g")
def w02(t):
    g = meds(t).groupBy("gen").agg(F.round(F.avg("med")).alias("s"))
    return g.select("gen", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"))).alias("place"))


SHIFT = (
    f"WITH {PANEL}, g AS (SELECT gen, avg(score) FILTER (judge = 'view') AS a, avg(score) FILTER (judge = 'error') AS b FROM panel GROUP BY gen), "
    "k AS (SELECT gen, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM g) "
)


def _two_ranks(t):
    g = panel(t).groupBy("gen").pivot("judge", ["view", "error"]).avg("score").withColumn("one", F.lit(0))
    return g.select("gen", R.average_rank("view", ["one"], True).alias("ra"), R.average_rank("error", ["one"], True).alias("rb"))


@query("w03_rank_shift", SHIFT + "SELECT gen, ra::DOUBLE AS ra, rb::DOUBLE AS rb, abs(ra - rb)::DOUBLE AS shift FROM k")
def w03(t):
    return _two_ranks(t).withColumn("shift", F.abs(F.col("ra") - F.col("rb")))


@query("w04_truncated_rank", SHIFT + "SELECT gen, floor(ra)::BIGINT AS ra, floor(rb)::BIGINT AS rb, (floor(ra) - floor(rb))::BIGINT AS move FROM k")
def w04(t):
    k = _two_ranks(t).select("gen", F.floor("ra").alias("ra"), F.floor("rb").alias("rb"))
    return k.withColumn("move", F.col("ra") - F.col("rb"))


@query("w05_demean", f"WITH {MEDS} SELECT gen, case_id, round(med - avg(med) OVER (PARTITION BY case_id), 9) AS one_way, round(med - avg(med) OVER (PARTITION BY case_id) - avg(med) OVER (PARTITION BY gen) + avg(med) OVER (), 9) AS two_way FROM meds")
def w05(t):
    both = R.with_demeaned(meds(t).select("gen", "case_id", "med", F.col("med").alias("one")), ["one"], ["case_id"])
    both = R.with_demeaned(both, ["med"], ["case_id"], ["gen"])
    return both.select("gen", "case_id", r("one").alias("one_way"), r("med").alias("two_way"))


@query("w06_leave_one_out", f"WITH {PANEL} SELECT gen, case_id, judge, round(CASE WHEN count(*) OVER w > 1 THEN (sum(score) OVER w - score) / (count(*) OVER w - 1) END, 9) AS others FROM panel WINDOW w AS (PARTITION BY gen, case_id)")
def w06(t):
    return panel(t).select("gen", "case_id", "judge", r(R.leave_one_out("score", ["gen", "case_id"])).alias("others"))


@query("w07_rolling_mean", f"WITH {MEDS} SELECT gen, case_id, round(CASE WHEN count(*) OVER w >= 5 THEN avg(med) OVER w END, 9) AS smooth FROM meds WINDOW w AS (PARTITION BY gen ORDER BY case_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def w07(t):
    return meds(t).select("gen", "case_id", r(R.rolling_mean("med", ["gen"], ["case_id"])).alias("smooth"))


@query("w08_difficulty_order", f"WITH {MEDS} SELECT case_id, row_number() OVER (ORDER BY round(avg(med), 9), case_id) AS place FROM meds GROUP BY case_id")
def w08(t):
    c = meds(t).groupBy("case_id").agg(F.round(F.avg("med"), 9).alias("m"))
    return c.select("case_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m", "case_id")).alias("place"))


@query("w09_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def w09(t):
    return R.keep_one(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.asc("event_id"))


@query("w10_longest_wins", "SELECT doc_id, k FROM (SELECT doc_id, left(text, 20) AS k, row_number() OVER (PARTITION BY left(text, 20) ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def w10(t):
    d = t.documents.select("doc_id", F.substring("text", 1, 20).alias("k"), "n_chars")
    return R.keep_one(d, ["k"], F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "k")


@query(
    "w11_pareto",
    "WITH p AS (SELECT p_brand, p_partkey, p_retailprice AS cost, p_size AS score FROM part), q AS (SELECT *, max(score) OVER (PARTITION BY p_brand ORDER BY cost, score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) "
    "SELECT p_brand, cost, score FROM q WHERE best IS NULL OR score > best",
)
def w11(t):
    p = t.part.select("p_brand", F.col("p_retailprice").alias("cost"), F.col("p_size").alias("score"))
    return R.pareto(p, "cost", "score", ["p_brand"])


@query("w12_marks", f"WITH {PANEL}, g AS (SELECT judge, gen, round_even(avg(score), 0) AS v FROM panel GROUP BY ALL) SELECT judge, gen, dense_rank() OVER (PARTITION BY judge ORDER BY v DESC) AS mark FROM g")
def w12(t):
    g = panel(t).groupBy("judge", "gen").agg(F.avg("score").alias("v"))
    return g.select("judge", "gen", R.marks("v", 0, ["judge"]).alias("mark"))


@query(
    "w13_budget_batches",
    "WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), "
    "b AS (SELECT source, doc_id, k, 0::BIGINT AS batch, n_chars AS used, 1 AS n FROM o WHERE k = 1 UNION ALL "
    "SELECT o.source, o.doc_id, o.k, CASE WHEN used + n_chars > 20000 OR n >= 8 THEN batch + 1 ELSE batch END, CASE WHEN used + n_chars > 20000 OR n >= 8 THEN n_chars ELSE used + n_chars END, "
    "CASE WHEN used + n_chars > 20000 OR n >= 8 THEN 1 ELSE n + 1 END FROM b JOIN o ON o.source = b.source AND o.k = b.k + 1) SELECT source, doc_id, batch FROM b",
)
def w13(t):
    from ..sources import sinks as K

    return R.budget_batches(t.documents, "source", "doc_id", "n_chars", 20000, 8, lambda name: K.scratch(t.spark, name))


@query("w14_arg_extremes", "SELECT l_returnflag, l_linestatus, arg_max(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) AS dearest, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS cheapest FROM lineitem GROUP BY ALL")
def w14(t):
    big = F.struct(F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.max_by("l_orderkey", big).alias("dearest"), F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("cheapest"))
