"""Joins, sorts, set operations, predicates and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions import text as X
from ..operators import panel as P
from ..operators import ranking as R
from .aggregates import JUDGES, MEDS, PANEL, meds, panel, r
from .registry import query

SEATS = "a AS (SELECT gen, case_id, score AS view FROM panel WHERE judge = 'view'), b AS (SELECT gen, case_id, score AS error FROM panel WHERE judge = 'error')"


def seat(t, judge):
    return panel(t).where(F.col("judge") == judge).select("gen", "case_id", F.col("score").alias(judge))


@query("j01_inner_two_keys", f"WITH {PANEL}, {SEATS} SELECT gen, case_id, round(view, 9) AS view, round(error, 9) AS error FROM a JOIN b USING (gen, case_id)")
def j01(t):
    return seat(t, "view").join(seat(t, "error"), ["gen", "case_id"]).select("gen", "case_id", r("view").alias("view"), r("error").alias("error"))


@query("j02_left", f"WITH {PANEL}, {SEATS}, k AS (SELECT DISTINCT gen, case_id FROM panel) SELECT gen, case_id, round(error, 9) AS error FROM k LEFT JOIN b USING (gen, case_id)")
def j02(t):
    return panel(t).select("gen", "case_id").distinct().join(seat(t, "error"), ["gen", "case_id"], "left").select("gen", "case_id", r("error").alias("error"))


@query("j03_left_default", "SELECT c_custkey, coalesce(round(sum(o_totalprice), 6), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def j03(t):
    o = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(r(F.sum("o_totalprice"), 6).alias("total"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"))


@query(
    "j04_full_outer",
    "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS m FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b ON a.k = b.k",
)
def j04(t):
    a = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    b = t.lineitem.where("l_discount > 0.08").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("m"))
    return a.join(b, "k", "full_outer").na.fill(0, ["n", "m"])


KEYED = "WITH a AS (SELECT DISTINCT replace(lower(p_brand), '#', '-') AS k FROM part WHERE p_size < 10), b AS (SELECT replace(lower(p_brand), '#', '-') AS k, count(*) AS n FROM part WHERE p_retailprice > 1500 GROUP BY 1) "


def _keyed(t):
    k = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")).alias("k")
    return t.part.where("p_size < 10").select(k).distinct(), t.part.where("p_retailprice > 1500").groupBy(k).agg(F.count("*").alias("n"))


@query("j05_normalised_key", KEYED + "SELECT a.k, n FROM a JOIN b ON a.k = b.k")
def j05(t):
    a, b = _keyed(t)
    return a.join(b, "k")


@query("j05_unmatched", KEYED + "SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def j05_report(t):
    a, b = _keyed(t)
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("left")).union(b.join(a, "k", "left_anti").select("k", F.lit("right").alias("side")))


@query("j06_many_to_many", "SELECT l_returnflag, o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def j06(t):
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"))


@query("j07_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j07(t):
    o = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j08_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j08(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j09_map_lookup", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def j09(t):
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("j10_first_row_lookup", "WITH f AS (SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1) SELECT p_brand, p_partkey, p_name FROM f JOIN part USING (p_brand, p_partkey)")
def j10(t):
    return R.keep_one(t.part.select("p_brand", "p_partkey", "p_name"), ["p_brand"], F.asc("p_partkey"))


@query("j11_alignment", f"WITH {MEDS} SELECT gen, case_id, round(med, 9) AS med, CASE WHEN (SELECT count(*) FROM meds x WHERE x.gen = m.gen) = 30 THEN 'complete' ELSE 'short' END AS state FROM meds m")
def j11(t):
    n = F.count("*").over(Window.partitionBy("gen"))
    return meds(t).select("gen", "case_id", r("med").alias("med"), F.when(n == 30, "complete").otherwise("short").alias("state"))


@query(
    "j12_set_overlap",
    "WITH a AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_tax < 0.03), b AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_tax > 0.05) "
    "SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both_sides, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS a_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS b_only, (SELECT count(*) FROM (FROM a UNION FROM b)) AS either",
)
def j12(t):
    a = t.lineitem.where("l_tax < 0.03").select("l_partkey", "l_returnflag").distinct().withColumn("a", F.lit(1))
    b = t.lineitem.where("l_tax > 0.05").select("l_partkey", "l_returnflag").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["l_partkey", "l_returnflag"], "full_outer")
    n = lambda c: F.count_if(c)
    return both.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), n(F.col("b").isNull()).alias("a_only"), n(F.col("a").isNull()).alias("b_only"), F.count("*").alias("either"))


@query("j13_paired_difference", f"WITH {MEDS} SELECT m.gen, m.case_id, round(m.med - b.med, 9) AS delta FROM meds m JOIN meds b ON b.case_id = m.case_id AND b.gen = 0 WHERE m.gen <> 0")
def j13(t):
    m = meds(t)
    return m.where("gen <> 0").join(m.where("gen = 0").select("case_id", F.col("med").alias("base")), "case_id").select("gen", "case_id", r(F.col("med") - F.col("base")).alias("delta"))


@query("j14_judge_pairs", f"WITH {PANEL} SELECT a.judge AS a, b.judge AS b, count(*) AS n, round(avg(abs(a.score - b.score)), 9) AS apart FROM panel a JOIN panel b USING (gen, case_id) WHERE a.judge < b.judge GROUP BY ALL")
def j14(t):
    p = panel(t)
    a, b = (p.select("gen", "case_id", F.col("judge").alias(x), F.col("score").alias(f"s_{x}")) for x in "ab")
    return a.join(b, ["gen", "case_id"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("s_a") - F.col("s_b")))).alias("apart"))


@query("j16_patch_rows", "SELECT c_custkey, round(CASE WHEN c_nationkey = 7 THEN c_custkey * 1.5 ELSE c_acctbal END, 9) AS bal FROM customer")
def j16(t):
    patch = t.customer.where("c_nationkey = 7").select("c_custkey", (F.col("c_custkey") * 1.5).alias("new"))
    return t.customer.join(patch, "c_custkey", "left").select("c_custkey", r(F.coalesce("new", "c_acctbal")).alias("bal"))


FOUR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("j17_composite_key", "SELECT count(*) AS reused, 0::BIGINT AS lost FROM lineitem WHERE l_shipdate < DATE '1996-01-01'")
def j17(t):
    old = t.lineitem.where("l_shipdate < DATE '1996-01-01'").select(*FOUR, "l_quantity")
    both = old.select(*FOUR).join(t.lineitem.select(*FOUR, "l_quantity"), FOUR)
    lost = old.exceptAll(both.select(*FOUR, "l_quantity")).agg(F.count("*").alias("lost"))
    return both.agg(F.count("*").alias("reused")).crossJoin(lost)


@query("j18_graft", f"WITH {PANEL}, {SEATS} SELECT a.gen, a.case_id, round(coalesce(b.error, a.view), 9) AS score FROM a LEFT JOIN b ON a.gen = b.gen AND a.case_id = b.case_id AND b.error > 60")
def j18(t):
    landed = seat(t, "error").where("error > 60")
    return seat(t, "view").join(landed, ["gen", "case_id"], "left").select("gen", "case_id", r(F.coalesce("error", "view")).alias("score"))


@query("j19_cross_minus_done", f"WITH {PANEL}, g AS (SELECT DISTINCT gen FROM panel), c AS (SELECT DISTINCT case_id FROM panel), j AS (SELECT DISTINCT judge FROM panel) SELECT gen, case_id, judge FROM g, c, j WHERE (gen, case_id, judge) NOT IN (SELECT (gen, case_id, judge) FROM panel)")
def j19(t):
    p = panel(t)
    cells = p.select("gen").distinct().crossJoin(p.select("case_id").distinct()).crossJoin(p.select("judge").distinct())
    return P.worklist(cells, p, ["gen", "case_id", "judge"])


# --- sorts, limits, sets ---


@query("t02_top_k", "SELECT source, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def t02(t):
    return R.top_k(t.documents.select("source", "doc_id", "n_chars"), ["source"], 5, F.desc("n_chars"), F.asc("doc_id"))


@query("t01_stable_sort", "SELECT user_id, n, row_number() OVER (ORDER BY n DESC, seen) AS place FROM (SELECT user_id, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1)")
def t01(t):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return g.select("user_id", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "seen")).alias("place"))


@query("t03_k_sweep", "SELECT k, count(*) AS rows_in, round(avg(n_chars), 6) AS mean_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), (SELECT unnest([5, 10, 20, 50, 100]) AS k) WHERE rank <= k GROUP BY k")
def t03(t):
    top = R.top_k(t.documents.select("source", "doc_id", "n_chars"), ["source"], 100, F.desc("n_chars"), F.asc("doc_id"))
    return top.withColumn("k", F.explode(F.array(*map(F.lit, (5, 10, 20, 50, 100))))).where("rank <= k").groupBy("k").agg(F.count("*").alias("rows_in"), r(F.avg("n_chars"), 6).alias("mean_chars"))


@query("t05_head", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def t05(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query("t04_abs_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 5000) DESC NULLS LAST, c_custkey LIMIT 20")
def t04(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.abs(F.col("c_acctbal") - 5000).desc_nulls_last(), "c_custkey").limit(20)


@query("t06_baseline_order", f"WITH {PANEL} SELECT gen, row_number() OVER (ORDER BY round(avg(score) FILTER (judge = 'view'), 9) DESC, gen) AS place FROM panel GROUP BY gen")
def t06(t):
    g = panel(t).groupBy("gen").agg(F.round(F.avg(F.when(F.col("judge") == "view", F.col("score"))), 9).alias("base"))
    return g.select("gen", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("base"), "gen")).alias("place"))


@query("t07_length_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS place FROM documents")
def t07(t):
    return t.documents.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text"), "doc_id")).alias("place"))


@query("t08_union_by_name", "SELECT doc_id, lang, NULL::INT AS quality FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, NULL, quality FROM labels")
def t08(t):
    return t.documents.where("lang = 'de'").select("doc_id", "lang").unionByName(t.labels.select("doc_id", "quality"), allowMissingColumns=True)


@query("t09_sets", "(SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr') UNION (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')")
def t09(t):
    f = lambda c: t.documents.where(F.col("lang") == c).select("doc_id")
    return t.labels.where("quality = 1").select("doc_id").intersect(f("fr")).union(t.labels.where("toxic = 1").select("doc_id").subtract(f("en"))).distinct()


@query("t10_multiset_equal", "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra")
def t10(t):
    a, b = t.lineitem.select("l_orderkey", "l_quantity"), t.lineitem.orderBy("l_partkey").select("l_orderkey", "l_quantity")
    return a.exceptAll(b).agg(F.count("*").alias("missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("extra")))


@query("t11_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def t11(t):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return t.events.groupBy("user_id").agg(F.array_join(F.array_distinct(seq), ",").alias("kinds"))


@query("t12_seeded_permutation", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('5|' || source || '|' || doc_id)) AS place FROM documents")
def t12(t):
    return t.documents.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(R.hash_order(5, "source", "doc_id"))).alias("place"))


@query("t13_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('9|' || doc_id) LIMIT 50")
def t13(t):
    return t.documents.select("doc_id").orderBy(R.hash_order(9, "doc_id")).limit(50)


@query("t14_last_wins", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def t14(t):
    return R.keep_one(t.events.select("user_id", "event_id", "event_type"), ["user_id"], F.desc("event_id")).where("event_type <> 'error'").select("user_id", "event_id")


@query("t15_first_wins", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def t15(t):
    return R.keep_one(t.events.select("user_id", "event_id"), ["user_id"], F.asc("event_id"))


# --- projections and predicates ---


@query("p01_short_name", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def p01(t):
    return t.pages.select("page_id", X.short_name(F.col("url")).alias("name"))


@query("p02_alias", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM documents")
def p02(t):
    return t.documents.select("doc_id", X.alias(F.col("lang"), {"en": "english", "de": "german"}).alias("lang"))


@query("p03_model_key", "SELECT p_partkey, replace(regexp_replace(replace(lower(string_split('x/' || p_brand || '_A-FP8-block', '/')[-1]), '_', '-'), '-fp8(-[a-z]+)?$', ''), '-a3b', '') AS k FROM part")
def p03(t):
    return t.part.select("p_partkey", X.model_key(F.concat(F.lit("x/"), "p_brand", F.lit("_A-FP8-block"))).alias("k"))


@query("p04_judge_name", f"WITH {PANEL} SELECT DISTINCT judge FROM panel")
def p04(t):
    return panel(t).select(X.judge_name(F.concat(F.lit("score_Judge ("), "judge", F.lit(")"))).alias("judge")).distinct()


@query("p05_columns_like", "SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice AS total FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)")
def p05(t):
    cols = P.columns_like(t.lineitem, "^l_(quantity|extendedprice)$")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col(cols[0]) + F.col(cols[1])).alias("total"))


@query("p06_coalesce_seats", f"WITH {PANEL} SELECT gen, case_id, round(CASE WHEN max(score) FILTER (judge = 'view') > 50 THEN max(score) FILTER (judge = 'view') ELSE 50 END, 9) AS seat FROM panel GROUP BY ALL HAVING count(*) FILTER (judge = 'view') > 0")
def p06(t):
    v = seat(t, "view").select("gen", "case_id", F.when(F.col("view") > 50, F.col("view")).alias("old"), F.when(~(F.col("view") > 50), F.lit(50.0)).alias("new"))
    return P.coalesce_seats(v, {"seat": ["old", "new"]}).select("gen", "case_id", r("seat").alias("seat"))


@query("p07_seat_alias", f"WITH {PANEL} SELECT judge, count(*) AS n FROM panel WHERE judge = 'error' GROUP BY judge")
def p07(t):
    wide = P.wide_panel(panel(t), JUDGES).withColumn("empty", F.lit(None).cast("double"))
    name = P.seat_column(wide, ["absent", "empty", "error", "view"])
    return wide.agg(F.count(name).alias("n")).select(F.lit(name).alias("judge"), "n")


@query("p08_number", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS DOUBLE) AS v FROM events")
def p08(t):
    return t.events.select("event_id", P.to_number(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))).alias("v"))


@query("p09_structural", "SELECT p_partkey, regexp_matches(p_name, '(?i)(eingangsformel|schlussformel|inhaltsübersicht|inhaltsverzeichnis|^anlage|^anhang)') AS structural FROM part")
def p09(t):
    return t.part.select("p_partkey", X.structural(F.col("p_name")).alias("structural"))


@query("p10_validated_names", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def p10(t):
    return P.validated(t.documents, "lang", ["de", "fr"]).select("doc_id")


@query("p11_exclude_any_case", "SELECT doc_id FROM documents WHERE lower(lang) NOT IN ('en')")
def p11(t):
    return t.documents.where(~F.lower("lang").isin("en")).select("doc_id")


@query("p12_retired", f"WITH {MEDS} SELECT gen, count(*) AS n FROM meds WHERE gen NOT IN (3, 4) GROUP BY gen")
def p12(t):
    retired = t.spark.createDataFrame([(3,), (4,)], "gen long")
    return meds(t).join(R.counted(retired), "gen", "left_anti").groupBy("gen").agg(F.count("*").alias("n"))


@query("p13_whitelist", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src5')")
def p13(t):
    return t.documents.where(F.col("source").isin("src1", "src2", "src5")).select("doc_id")


@query("p16_missing_answer", "SELECT count(*) FILTER (text IS NULL OR trim(text) = '' OR lower(trim(text)) = 'nan') AS missing, count(*) AS n FROM conversations")
def p16(t):
    return t.conversations.agg(F.count_if(X.missing_answer(F.col("text"))).alias("missing"), F.count("*").alias("n"))


@query("p17_refusal", "SELECT conv_id, turn FROM conversations WHERE length(text) < 3000 AND (contains(lower(left(text, 400)), 'sorry') OR contains(lower(left(text, 400)), 'the '))")
def p17(t):
    return t.conversations.where(X.refusal(F.col("text"), ["sorry", "the "])).select("conv_id", "turn")


@query("p18_finite", "SELECT count(*) AS n FROM events WHERE isfinite(value)")
def p18(t):
    return t.events.where(F.col("value").isNotNull() & (F.abs("value") != float("inf"))).agg(F.count("*").alias("n"))


@query("p19_support", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def p19(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).where("n >= 3")


@query("p20_jurisdiction", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'state' WHEN 3 THEN 'unknown' ELSE 'federal' END AS jurisdiction FROM part")
def p20(t):
    """A state book, two known ones, an unknown one and one that only the corpus knows."""
    books = F.array(*map(F.lit, ("BayBO", "VwGO", "StVO", "XYZ", "Foo")))
    named = t.part.select("p_partkey", F.element_at(books, (F.col("p_partkey") % 5 + 1).cast("int")).alias("book"))
    corpus = t.spark.createDataFrame([("foo",)], "k string")
    joined = named.join(R.counted(corpus), C.corpus_key_column(F.col("book")) == F.col("k"), "left")
    return joined.select("p_partkey", C.jurisdiction(F.col("book"), F.col("k").isNotNull()).alias("jurisdiction"))


@query("p21_relatedness", f"WITH {PANEL} SELECT gen, judge, CASE WHEN gen % 5 = length(judge) % 5 THEN 'self' WHEN gen % 3 = length(judge) % 3 THEN 'family' WHEN gen % 2 = length(judge) % 2 THEN 'vendor' ELSE 'unrelated' END AS tier FROM panel GROUP BY ALL")
def p21(t):
    n = F.length("judge")
    tier = F.when(F.col("gen") % 5 == n % 5, "self").when(F.col("gen") % 3 == n % 3, "family").when(F.col("gen") % 2 == n % 2, "vendor").otherwise("unrelated")
    return panel(t).select("gen", "judge", tier.alias("tier")).distinct()


@query("p22_bucket", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'not in corpus' WHEN l_partkey IS NULL THEN 'in corpus, missed' ELSE 'retrieved' END AS bucket FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48) ON l_partkey = p_partkey")
def p22(t):
    corpus = t.part.where("p_size <= 40").select(F.col("p_partkey").alias("c"))
    got = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("g")).distinct()
    j = t.part.join(corpus, F.col("c") == F.col("p_partkey"), "left").join(got, F.col("g") == F.col("p_partkey"), "left")
    return j.select("p_partkey", F.when(F.col("c").isNull(), "not in corpus").when(F.col("g").isNull(), "in corpus, missed").otherwise("retrieved").alias("bucket"))


@query("p24_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS q FROM lineitem")
def p24(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).alias("q"))


@query("p25_transcript_audit", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS sequence, bool_or(contains(text, 'http')) AS forbidden FROM conversations GROUP BY conv_id")
def p25(t):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(seq, ">").alias("sequence"), F.max(F.contains(F.col("text"), F.lit("http"))).alias("forbidden"))


@query("p26_prefix_split", "SELECT CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS scheme, count(*) AS n FROM pages GROUP BY 1")
def p26(t):
    return t.pages.groupBy(F.when(F.startswith(F.col("url"), F.lit("https")), "secure").otherwise("plain").alias("scheme")).agg(F.count("*").alias("n"))


@query("p27_seat_complete", f"WITH {PANEL}, k AS (SELECT DISTINCT gen, case_id FROM panel) SELECT j.judge, count(*) FILTER (p.score IS NULL) AS holes, count(*) FILTER (p.score IS NULL) = 0 AS complete FROM k CROSS JOIN (SELECT DISTINCT judge FROM panel) j LEFT JOIN panel p ON p.gen = k.gen AND p.case_id = k.case_id AND p.judge = j.judge GROUP BY j.judge")
def p27(t):
    p = panel(t)
    live = p.select("gen", "case_id").distinct().crossJoin(p.select("judge").distinct())
    g = live.join(p, ["gen", "case_id", "judge"], "left").groupBy("judge").agg(F.count_if(F.col("score").isNull()).alias("holes"))
    return g.withColumn("complete", F.col("holes") == 0)


@query("p14_tier_prefix", "SELECT doc_id, turn FROM (SELECT conv_id AS doc_id, turn FROM conversations) WHERE turn < 2")
def p14(t):
    return t.conversations.where("turn < 2").select(F.col("conv_id").alias("doc_id"), "turn")


@query("p15_kind_filter", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de') GROUP BY 1")
def p15(t):
    return t.documents.where(F.col("lang").isin("de")).groupBy("lang").agg(F.count("*").alias("n"))


@query("p23_provenance", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'amtlich' WHEN 3 THEN 'unmarked' ELSE 'redaktionell' END AS kind FROM documents")
def p23(t):
    """Texts that end in a mark, by doc_id: official, editorial, a span marked as editorial, none."""
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, " (amtlicher Leitsatz)").when(k == 1, " (redaktioneller Leitsatz)").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), mark)
    return t.documents.select("doc_id", C.provenance(text, k == 2).alias("kind"))

