"""Hand-worked cases of operators whose results depend on order or on missing values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import citations as C
from sparkloom.functions import similarity as Y
from sparkloom.functions import text as X
from sparkloom.operators import panel as P
from sparkloom.operators import ranking as R
from sparkloom.operators import search as S
from sparkloom.operators import statistics as M
from sparkloom.plans import jobs as U
from sparkloom.plans import render
from sparkloom.sources import scans, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def lists(spark, *ranked):
    rows = [(1, k, n, i) for n, keys in enumerate(ranked) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "query int, key string, list_no int, rank int")


def order(df):
    return [r["key"] for r in df.orderBy("rank").collect()]


def test_rrf_ties(spark):
    assert order(S.rrf(lists(spark, "ABC", "BAD"), 9)) == list("ABCD")
    assert order(S.rrf(lists(spark, "AA", "B"), 9)) == ["A", "B"]


def test_round_robin(spark):
    assert order(S.round_robin(lists(spark, "ABC", "BD"), 3)) == ["A", "B", "D"]


def test_weighted(spark):
    got = S.weighted_rrf(lists(spark, "AB", "B"), 0.75, 9).orderBy("rank").collect()
    assert [(r["key"], round(r["score"], 6)) for r in got] == [("B", 0.016462), ("A", 0.0125)]


@pytest.mark.parametrize("k, share, want", [(4, 0.4, ["s1", "s2", "f1", "f2"]), (5, 0.5, ["s1", "s2", "f1", "f2", "f3"])])
def test_route(spark, k, share, want):
    ranked = spark.createDataFrame([(1, x, i) for i, x in enumerate(["f1", "s1", "f2", "s2", "s3", "f3"], 1)], "query int, key string, rank int")
    assert order(S.route(ranked, F.col("key").startswith("s"), k, share)) == want


@pytest.mark.parametrize("most", [1, 7, 39])
def test_dense_in_blocks(spark, most):
    """More queries than a block holds, a repeated one and a null vector among them: the same as in one block."""
    vectors = [(i, [math.sin(i * j + j) for j in range(1, 6)]) for i in range(60)] + [(60, None)]
    corpus = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = spark.createDataFrame([*vectors[:37], vectors[3], vectors[60], (3, vectors[4][1])], "id long, v array<double>")
    got = S.dense(corpus, asked, "id", "id", "v", 4, most=most)
    assert got.columns == ["query", "key", "score", "rank"]
    whole = S.dense(corpus, asked, "id", "id", "v", 4).collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, whole)) and len(whole) == 4 * 38
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    best = sorted((-round(cosine(vectors[9][1], v), 9), i) for i, v in vectors[:60] if i != 9)[:4]
    assert [r["key"] for r in sorted((r for r in whole if r["query"] == 9), key=lambda r: r["rank"])] == [i for _, i in best]


def test_recall_of_whole_ranking_is_the_ceiling(spark):
    gold = spark.createDataFrame([(1, "A"), (1, "Z"), (2, "B")], "query int, key string")
    r = S.recall_at(S.rrf(lists(spark, "ABC"), 9), gold, [1, 3]).orderBy("k").collect()
    assert [(x["hits"], x["gold"]) for x in r] == [(1, 3), (1, 3)]


def test_ensemble_min(spark):
    rows = [(1, 0.5), (1, None), (1, 0.7), (2, None), (2, 0.9), (3, None), (3, None)]
    d = spark.createDataFrame(rows, "k int, s double")
    assert {r[0]: r[1] for r in d.groupBy("k").agg(P.ensemble_min(F.col("s"))).collect()} == {1: 0.5, 2: 0.9, 3: None}


def test_scores_and_missing(spark):
    f = lambda s: one(spark, X.last_score(F.lit(s)))
    assert f("[[0.3]] … [[0,8]]") == 0.8 and f("[0.8]") is None
    for s in (None, "", " nan ", "NaN"):
        assert one(spark, X.missing_answer(F.lit(s).cast("string")))
    assert not one(spark, X.missing_answer(F.lit("x")))


def test_jaccard_empty(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, X.jaccard(a(), a())) == 1.0 and one(spark, X.jaccard(a("a"), a())) == 0.0
    assert one(spark, X.jaccard(a(), a(), None)) is None
    assert one(spark, X.jaccard(a("a", "b"), a("b", "c"))) == pytest.approx(1 / 3)


def test_percent_rank_and_others(spark):
    d = spark.createDataFrame([(v,) for v in (10.0, 20.0, 20.0, 30.0)], "v double").withColumn("j", F.lit(0))
    assert sorted(r[0] for r in d.select(R.percent_rank_average("v", ["j"])).collect()) == [25, 62.5, 62.5, 100]
    d = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 60.0), (2, 5.0)], "k int, v double")
    got = {(r[0], r[1]): r[2] for r in d.select("k", "v", R.leave_one_out("v", ["k"])).collect()}
    assert got == {(1, 10.0): 40, (1, 20.0): 35, (1, 60.0): 15, (2, 5.0): None}


@pytest.mark.parametrize("pairs, want", [([(0, 100), (100, 0)], -1), ([(0, 0), (3, 3)], 1), ([(5, 5), (5, 5)], None)])
def test_kappa(spark, pairs, want):
    d = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    assert M.qwk_moments(d, "a", "b").first()["kappa"] == want
    if want is not None:
        assert M.qwk_matrix(d, "a", "b").first()["kappa"] == pytest.approx(want)


@pytest.mark.parametrize("lengths, want", [((100, 1000, 600), [1101, 600]), ((700, 1000), [1701]), ((1400, 150), [1551])])
def test_packer(lengths, want):
    assert [len(c[0]) for c in Y.pack([(None, "x" * n) for n in lengths])] == want


def test_packer_keeps_all_text_and_numbers():
    paras = [(i, f"Absatz {i}. " * 30) for i in range(40)]
    chunks = Y.pack(paras)
    assert "".join(c[0] for c in chunks).replace("\n", "") == "".join(t for _, t in paras).replace("\n", "")
    assert chunks[0][1] == 0 and chunks[-1][2] == 39


@pytest.mark.parametrize("name", ["f16_split_long", "f17_packer", "f27_citation_similarity", "f04_norm_chain"])
def test_results_are_objects_for_few_rows_at_once(spark, monkeypatch, name):
    """Results leave a task as Arrow by the slice; a batch never becomes pandas."""
    from sparkloom import session
    from sparkloom.plans import QUERIES

    seen = []
    real = session.row_function
    monkeypatch.setattr(session, "row_function", lambda *a: seen.append(a[2]) or real(*a))
    d = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen and "pythonUDF" in d._jdf.queryExecution().executedPlan().toString()
    one = real(spark, lambda x: [str(x)] * (x or 0), "array<string>", __import__("pyarrow").list_(__import__("pyarrow").string()))
    got = spark.range(0, 300, 1, 1).select("id", one(F.when(F.col("id") % 7 > 0, F.col("id") % 5)).alias("x")).collect()
    assert all(r["x"] == [str(r["id"] % 5)] * (r["id"] % 5 if r["id"] % 7 else 0) for r in got)


def test_entries_of_chains_are_parsed_once():
    from sparkloom.functions import citations as C

    C._entry.cache_clear()
    assert C.chain(["VwGO § 42 Abs. 1, § 43", "GG Art. 3"]) == C.chain(["VwGO § 42 Abs. 1, § 43", "GG Art. 3"]) == [("vwgo", "42"), ("vwgo", "43"), ("gg", "3")]
    assert C._entry.cache_info().hits == 2


def test_citations():
    pairs = lambda t: [(c.book, c.section) for c in C.extract(t)]
    assert pairs("§§ 80, 80a VwGO") == [("VwGO", "80"), ("VwGO", "80a")]
    assert pairs("Art. 101 i. V. mit Art. 100 BV") == [("BV", "101"), ("BV", "100")]
    assert pairs("Art. 2 I GG in Verbindung mit dem") == [("GG", "2")]
    assert ("GG", "10") in pairs("Art. 10 oder Art. 11 GG")
    assert C.chain(["BayDG Art. 6 Abs. 1, Art. 11 Abs. 1, Art. 14"]) == [("baydg", "6"), ("baydg", "11"), ("baydg", "14")]
    assert [C.corpus_key(b) for b in ("StVO 2013", "BauGB", "BayPAG")] == ["stvo", "bbaug", "pag"]
    c = [C.Citation(b, "1", "Art", "", 0) for b in ("GG", "GG9", "Kosten-")]
    assert [x.book for x in C.canonicalise(c)] == ["GG", "GG"]
    assert C.extract(None) == [] and C.extract("§ " * 500) == []


def test_citations_are_linear():
    import time

    t = time.time()
    C.extract("BauNVO §§ 1 III, V, VI, VII, IX, X, 2, 6 II, III, 7 II Nr. 2, 9, 13 | " * 200)
    assert time.time() - t < 5


def test_unwrap_and_names(spark):
    assert one(spark, X.unwrap(F.lit("kreisange-\nhörigen"))) == "kreisangehörigen"
    assert one(spark, X.unwrap(F.lit("Nach-\nBar"))) == "Nach-Bar"
    assert one(spark, X.model_key(F.lit("Qwen/Qwen3.6-35B-A3B-FP8"))) == "qwen3.6-35b"


def test_page_headers(spark):
    pages = lambda *p: F.array(*[F.array(*map(F.lit, q)) for q in p])
    assert one(spark, scans.without_headers(pages(("same", "a"), ("same", "b")))) == [["same", "a"], ["same", "b"]]
    assert one(spark, scans.without_headers(pages(("1", "Kopfzeile", "a"), ("2", "Kopfzeile", "b")))) == [["a"], ["b"]]


def test_seats_guard(spark):
    d = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert sorted(r[0] for r in P.coalesce_seats(d, {"s": ["a", "b"]}).collect()) == [1.0, 2.0]
    with pytest.raises(Exception, match="more than one seat"):
        P.coalesce_seats(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), {"s": ["a", "b"]}).collect()
    with pytest.raises(KeyError):
        P.validated(d.withColumn("n", F.lit("x")), "n", ["x", "y"])


def test_debias_leaves_unrelated_alone(spark):
    rows = [(g, c, j, float((g * 7 + c * 3 + len(j)) % 50)) for g in range(4) for c in range(6) for j in ("a", "bb")]
    p = spark.createDataFrame(rows, "gen long, case_id int, judge string, score double")
    e = spark.createDataFrame([("a", 1, 10.0)], "judge string, gen long, effect double")
    for r in M.debias(p, e).collect():
        if (r["judge"], r["gen"]) == ("a", 1):
            assert r["debiased"] <= r["score"]
        else:
            assert r["debiased"] == r["score"]


def test_tails():
    assert M.t_tail(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert M.t_tail(0.0, 5) == pytest.approx(1.0) and M.corr_p(1.0, 5) == 0.0 and M.corr_p(0.5, 2) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_spans_and_rouge(a, b):
    x, y = " ".join(a), " ".join(b)
    best = max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if any(a[i : i + k] == b[j : j + k] for j in range(len(b)))), default=0)
    assert Y.longest_span(x, y) == best
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if p == q else max(lcs[i][j + 1], lcs[i + 1][j])
    want = 2 * lcs[-1][-1] / (len(a) + len(b)) if a and b else 0.0
    assert Y.rouge_l(x, y) == pytest.approx(want)


def test_retry():
    slept = []
    calls = iter([U.RateLimited(5), ValueError("x"), U.Response("ok", 1, 1)])

    def fn():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    r, error = U.Retry(attempts=2).call(fn, slept.append)
    assert r.text == "ok" and error is None and slept == [5, 1.0]
    assert U.Retry().call(lambda: (_ for _ in ()).throw(U.BadRequest("no")), slept.append)[0] is None
    assert U.Retry(attempts=2).call(lambda: U.Response("", 1, 0), slept.append)[0] is None


def test_resume_is_a_no_op_when_done(spark, tmp_path):
    work = spark.createDataFrame([(i, f"frage {i}") for i in range(10)], "k int, p string")
    path = f"file://{tmp_path}/job"
    assert U.run_resumable(work.where("k < 4"), ["k"], "p", path) == 0
    assert U.run_resumable(work, ["k"], "p", path) == 0
    n = spark.read.parquet(path).count()
    assert U.run_resumable(work, ["k"], "p", path) == 0 and spark.read.parquet(path).count() == n == 10


def test_failed_rows_run_again(spark, tmp_path):
    def flaky(p):
        if "3" in p:
            raise U.BadRequest("no")
        return U.stub(p)

    work = spark.createDataFrame([(i, f"frage {i}") for i in range(5)], "k int, p string")
    path = f"file://{tmp_path}/job"
    assert U.run_resumable(work, ["k"], "p", path, flaky) == 1
    assert U.run_resumable(work, ["k"], "p", path) == 0


def test_replace_and_widen(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.append_widening(spark.range(2), path)
    sinks.append_widening(spark.range(2, 3).withColumn("x", F.lit("a")), path)
    assert sorted((r["id"], r["x"]) for r in sinks.widened(spark, path).collect()) == [(0, None), (1, None), (2, "a")]
    path = f"file://{tmp_path}/versions"
    for n in (2, 3, 4):
        sinks.replace(spark.range(n), path)
        seen = sinks.current(spark, path)
        assert spark.read.parquet(seen).count() == n
    assert len([p for p in (tmp_path / "versions").iterdir() if p.name.startswith("v-")]) == 2  # the one before stays
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"file://{tmp_path}/none")


def test_verified_merge_notices_a_difference(spark, tmp_path):
    a, b = spark.range(3).select("id"), spark.createDataFrame([(1, None), (1, "x")], "id long, s string")
    sinks.merge_verified([a, b], f"file://{tmp_path}/m")
    whole = a.unionByName(b, allowMissingColumns=True)
    assert sinks._fingerprint(whole) == sinks._fingerprint(whole.repartition(3))
    assert sinks._fingerprint(whole) != sinks._fingerprint(whole.union(whole.limit(1)))
    assert sinks._fingerprint(b) != sinks._fingerprint(b.fillna("y"))


def test_untrained_rerankers_are_refused(spark):
    import logging

    def untrained():
        logging.getLogger("some.library").warning("Some weights were newly initialized: ['score.weight']")
        return lambda pairs: [0.0] * len(pairs)

    with pytest.raises(S.Untrained):
        S.checked(untrained)
    assert S.checked(S.lexical_model)([("a b", "b c"), ("", "x")]) == [0.5, 0.0]
    pool = spark.createDataFrame([(1, 7, "a b", None, "b" * 1300), (1, 8, None, "t", None)], "query long, key long, q string, t string, d string")
    assert sorted(r["s"] for r in S.with_scores(pool, S.lexical_model, "q", "t", "d", "s").collect()) == [0.0, 0.0]


def test_shared_generator_runs_on(spark):
    import numpy as np

    groups = {1: [1.0, 2.0, 4.0], 2: [3.0], 3: [5.0, 5.5, 7.0, 9.0], 4: [2.0, float("nan"), 8.0]}
    d = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g long, x double")
    got = {r["g"]: (r["n"], r["se"]) for r in M.bootstrap_se_seeded(d.repartition(4), ["g"], "x", 50, 9, 1, True).collect()}
    rng = np.random.default_rng(9)
    for g, v in groups.items():
        x = np.array([y for y in v if y == y])
        want = float(x[rng.integers(0, len(x), (50, len(x)))].mean(1).std(ddof=1)) if len(x) > 1 else None
        assert got[g] == (len(x), want if want is None else pytest.approx(want))


def test_sweep_rejects_unknown_entries():
    from sparkloom.operators import search as S

    with pytest.raises(ValueError):
        S.configuration("odd", {"mergee": "rrf"}, 20)
    assert S.configuration("s", {"state_share": 0.125}, 20)[-1] == 2  # half to even


def test_zip_with_broken_directory():
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<a/>" * 50)
        z.writestr("b.xml", "<b/>")
    whole = b.getvalue()
    cut = whole[: whole.index(b"PK\x01\x02")]
    assert scans.unzip(whole) == scans.unzip(cut) == [("a.xml", b"<a/>" * 50), ("b.xml", b"<b/>")]


def test_render():
    assert render.mean_cell(12.34, 0.5) == "12.3$_{\\pm 0.5}$" and render.p_value(0.0001) == "<0.001"
    assert render.escape("a_b%") == r"a\_b\%" and math.isclose(render.rms_anchor([3.0, 4.0]), math.sqrt(12.5))
    assert r"\toprule" in render.table([{"a": "x", "b": 1.0}], [("a", "A"), ("b", "B")])
    with pytest.raises(ValueError):
        render.unique_short(["a/x", "b/x"])


def test_pareto_and_marks(spark):
    d = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 7.0), (3.0, 6.0)], "c double, s double")
    assert sorted(map(tuple, R.pareto(d, "c", "s").collect())) == [(1.0, 5.0), (3.0, 7.0)]


@pytest.mark.parametrize("parts", [2, 5, 64])
def test_ranks_in_parts(spark, parts):
    import random

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *map(float, range(12))]), i) for i in range(400)]
    d = spark.createDataFrame(rows, "j string, v double, i int")
    for desc in (False, True):
        got = {r["i"]: (r["rank"], r["n"]) for r in R.with_average_rank(d, "v", ["j"], descending=desc, total="n", parts=parts).collect()}
        for j, v, i in rows:
            if v is None:
                assert got[i][0] is None
                continue
            same = [x[1] for x in rows if x[0] == j and x[1] is not None]
            below = sum(x > v if desc else x < v for x in same)
            assert got[i] == (below + (sum(x == v for x in same) + 1) / 2, len(same))
    assert R.with_average_rank(d.limit(0), "v", []).count() == 0


def test_filters_reach_the_scan(spark):
    d = scans.read_table(spark, "/root/testdata/sf0.01/documents.parquet").where("lang = 'de'").select("doc_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,de)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_cells_of_clustered_vectors(spark, tmp_path):
    """The index gives what comparing all pairs gives, and reads few cells where vectors lie in clusters."""
    import numpy as np

    from sparkloom.operators import vectors as V

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    x = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.1
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    index = V.CellIndex(d, "id", "v", str(tmp_path / "cells"))
    got = index.search(d.where("id % 50 = 0"), "id", "v", 5, lambda name: str(tmp_path / name)).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 600, 50):
        scores = sorted((-round(float(u[q] @ u[i]), 9), i) for i in range(600) if i != q)[:5]
        want |= {(q, i, rank + 1) for rank, (_, i) in enumerate(scores)}
    assert {(r["query"], r["key"], r["rank"]) for r in got} == want
    assert max(r["cells_read"] for r in got) < len(index.numbers)
    empty = d.limit(0)
    assert V.CellIndex(empty, "id", "v", str(tmp_path / "none")).search(d, "id", "v", 5, lambda name: str(tmp_path / f"n-{name}")).count() == 0


def test_running_counts_and_quantiles(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from sparkloom.operators import ranking as R
    from sparkloom.operators import statistics as S

    rng = np.random.default_rng(4)
    values = {"hot": rng.integers(0, 50, 3000).astype(float), None: rng.normal(size=70), "one": np.array([2.5])}
    d = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), ("none", None)], "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r["g"]: r["q"] for r in R.quantiles(d, ["g"], "v", probs).collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12)
    for r in R.cumulated(d, ["g"], "v").collect():
        assert r["before"] == (values[r["g"]] < r["v"]).sum() and r["n"] == (values[r["g"]] == r["v"]).sum() and r["total"] == len(values[r["g"]])
    asked = [-1.0, 0.0, 7.0, 7.5, 60.0]
    out = S.out_of_sample(spark.createDataFrame([(a,) for a in asked], "s double"), d.where("g = 'hot'"), "s", "v", 0.0).collect()
    hot = values["hot"]
    assert {r["s"]: round(r["percentile"], 9) for r in out} == {a: round(max(0.01, ((hot < a).mean() + (hot <= a).mean()) * 50), 9) for a in asked}


@pytest.mark.parametrize("size", [50_000, 40])
def test_kendall_in_ranges(spark, monkeypatch, size):
    import numpy as np

    from sparkloom.operators import statistics as S

    monkeypatch.setattr(S, "RANGE_ROWS", size)
    rng = np.random.default_rng(5)
    x = np.append(rng.normal(size=400), np.full(200, 0.5))
    y = np.round(x + rng.normal(size=600), 1)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)]
    got = S.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert got["n"] == 600 and got["tau"] == pytest.approx((sx * sy).sum() / np.sqrt(np.abs(sx).sum() * np.abs(sy).sum()), rel=1e-12)


@pytest.mark.parametrize("block, turns", [(4, (1, 3)), (64, (2, 16))])
def test_blocks_of_postings(spark, tmp_path, block, turns):
    """Block-max search gives what scoring every document gives, ties included, and leaves blocks of long documents unread."""
    import random

    from sparkloom.operators import blocks as BL
    from sparkloom.operators import search as S

    g = random.Random(5)
    draw = lambda n: " ".join(f"w{min(int(g.expovariate(0.15)), 40)}" for _ in range(n))
    rows = [(i, draw(g.choice([4, 8, 90, 200])), g.choice("ab") if i % 7 else None) for i in range(240)]
    rows += [(500 + i, "w1 w2 w3", "a") for i in range(30)] + [(600, None, "a"), (601, "", "b"), (602, "...", None), (603, "rare " * 3000, "b")]
    d = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    asked = [(1, "w1 w2 w3"), (2, "w30 w31 w2"), (3, "rare w1"), (4, "absent"), (5, None), (6, ""), (7, "w7 w7 W7"), (8, draw(30))]
    q = spark.createDataFrame(asked, "q long, text string")
    BL.write_blocks(d, "id", "text", str(tmp_path / "index"), ["lang"], block)
    index = BL.BlockIndex(spark, str(tmp_path / "index"))
    assert index.blocks.where(F.size("postings") > block).count() == 0
    got = index.search(q, "q", "text", 5, lambda name: str(tmp_path / name), turns).collect()
    want = S.bm25(S.Index(d, "id", "text"), q, "q", "text", 5).collect()
    assert {(x["query"], x["rank"], x["key"], f"{x['score']:.7g}") for x in got} == {(x["query"], x["rank"], x["key"], f"{x['score']:.7g}") for x in want}
    reads = {x["query"]: (x["blocks_read"], x["blocks"]) for x in got}
    assert all(0 < a <= b for a, b in reads.values()) and set(reads) == {1, 2, 3, 7, 8}
    if block == 4:
        assert sum(a for a, _ in reads.values()) < 0.8 * sum(b for _, b in reads.values())


def test_no_blocks(spark, tmp_path):
    from sparkloom.operators import blocks as BL

    none = spark.createDataFrame([], "id string, text string")
    q = spark.createDataFrame([(1, "w1")], "q long, text string")
    for at, d in [("a", none), ("b", spark.createDataFrame([("x", None), ("y", ""), (None, "w1")], none.schema))]:
        BL.write_blocks(d, "id", "text", str(tmp_path / at))
        assert BL.BlockIndex(spark, str(tmp_path / at)).search(q, "q", "text", 3, lambda name: str(tmp_path / at / name)).count() == 0


@pytest.mark.parametrize("chunk, fan", [(3, 5), (7, 30), (64, 256)])
def test_batches_of_a_hot_key(spark, tmp_path, chunk, fan):
    """Chunks of a key, solved apart, give what one pass over the key gives."""
    import random
    import uuid

    g = random.Random(chunk)
    rows = [("hot", i * 3, g.choice([0, 1, 5, 9, 40])) for i in range(300)] + [(k, i, g.randint(0, 12)) for k in ("a", "b", None) for i in range(g.randint(1, 20))] + [("n", 1, None), ("n", 2, 21), ("n", 3, None)]
    d = spark.createDataFrame(g.sample(rows, len(rows)), "g string, at long, size int")
    want = {}
    for k in {x[0] for x in rows}:
        batch, used, n = 0, 0, 0
        for _, at, s in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            if n and (used + (s or 0) > 20 or n >= 3):
                batch, used, n = batch + 1, 0, 0
            used, n = used + (s or 0), n + 1
            want[k, at] = batch
    got = R.budget_batches(d, "g", "at", "size", 20, 3, lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"), chunk, fan).collect()
    assert len(got) == len(want) and {(x["g"], x["at"]): x["batch"] for x in got} == want


def test_batches_of_nothing(spark, tmp_path):
    import uuid

    d = spark.createDataFrame([], "g string, at long, size int")
    assert R.budget_batches(d, "g", "at", "size", 20, 3, lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}")).count() == 0


def test_computed_permutations(spark):
    """Bijections on any number of places, each permutation of four about equally often, and as one step after the other in plain Python."""
    import hashlib
    from collections import Counter

    def plain(rep, n, p, seed=7):
        for t in range(M.STEPS):
            h = hashlib.md5(f"{seed}|{rep}|{t}".encode()).hexdigest()
            q = (int(h[:8], 16) % n - p) % n
            p = q if (max(p, q) + 1) % M.PRIME * (1 + int(h[8:16], 16) % (M.PRIME - 1)) % M.PRIME * 2 >= M.PRIME else p
        return p

    for n, reps in ((1, 3), (2, 50), (97, 40), (4, 4800)):
        d = spark.range(n).withColumn("n", F.lit(n).cast("long")).crossJoin(spark.range(reps).withColumnRenamed("id", "rep"))
        got = {}
        for x in M.with_permuted(d, "id", "n", 7, "to").select("rep", "id", "to").collect():
            got.setdefault(x["rep"], {})[x["id"]] = x["to"]
        assert len(got) == reps and all(sorted(g.values()) == list(range(n)) for g in got.values())
        assert all(got[0][i] == plain(0, n, i) for i in range(n))
        if n == 4:
            seen = Counter(tuple(g[i] for i in range(4)) for g in got.values())
            assert len(seen) == 24 and sum((v - 200) ** 2 / 200 for v in seen.values()) < 50  # 23 degrees of freedom: beyond 49.7 once in a thousand


def test_permutation_p(spark):
    """Near what numpy's permutations give, one-sided and two-sided; without a sort of permuted rows."""
    import numpy as np

    g = np.random.default_rng(4)
    x = g.normal(size=60)
    y = 0.25 * x + g.normal(size=60)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(90, None, 1.0), (91, 1.0, None)], "k long, x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    rs = np.array([np.corrcoef(x, g.permutation(y))[0, 1] for _ in range(4000)])
    for two, want in ((True, np.mean(np.abs(rs) >= abs(r))), (False, np.mean(rs >= r))):
        got = M.permutation_p(d, "k", "x", "y", 2000, 7, two)
        row = got.first()
        assert row["r"] == pytest.approx(r) and abs(row["p"] - want) < 5 * math.sqrt(max(want, 0.01) / 2000)
    assert "rep" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x)


def test_singular_values_and_vectors(spark, tmp_path):
    """Against numpy: all values where the width covers the rank, whatever the blocks; the leading ones of a larger matrix; repeated, null and zero entries."""
    import numpy as np

    from sparkloom.operators import factors as L

    rng = np.random.default_rng(5)
    dense = np.where(rng.random((40, 9)) < 0.4, rng.integers(1, 9, (40, 9)), 0).astype(float)
    dense[3], dense[7] = 0, dense[8]  # an empty row, two equal ones
    rows = [(i, f"t{j}", float(dense[i, j]) / 2) for i in range(40) for j in range(9)] * 2 + [(None, "t1", 1.0), (1, None, 1.0), (2, "t2", None)]
    entries = spark.createDataFrame(rows, "row long, col string, w double")
    want = np.linalg.svd(dense, compute_uv=False)
    for name, block, pair in (("one", 100, 10_000), ("many", 4, 20)):
        m = L.SparseMatrix(entries, str(tmp_path / name), block, pair)
        assert name == "one" or (m.cols > 2 and m.rows > 2)
        values, vectors = L.decompose(m, 6, lambda x: str(tmp_path / f"{name}-{x}"))
        assert values == pytest.approx(want[:6], rel=1e-9)
        v = {r["at"]: np.array(r["x"]) for r in vectors.collect()}
        v = np.array([v[f"t{j}"] for j in range(9)])
        assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
        assert np.allclose(np.abs(np.diag(np.linalg.svd(dense, full_matrices=False)[2][:6] @ v)), 1, atol=1e-9)
        u = {r["at"]: r["x"] for r in m.times(vectors).collect()}
        assert 3 not in u and np.allclose([u.get(i, [0] * 6) for i in range(40)], dense @ v)
    empty = L.SparseMatrix(entries.limit(0), str(tmp_path / "none"))
    values, vectors = L.decompose(empty, 2, lambda x: str(tmp_path / f"none-{x}"))
    assert list(values) == [0, 0] and vectors.count() == 0


def test_products_move_what_blocks_hold(spark, tmp_path):
    """A product's rows are whole where they are made, and by columns there is one part for each column of a block, however many blocks of columns."""
    from sparkloom.operators import factors as L

    entries = spark.createDataFrame([(i, f"t{(i * k) % 50}", 1.0) for i in range(60) for k in (1, 2, 3)], "row long, col string, w double")
    m = L.SparseMatrix(entries, str(tmp_path / "m"), 4, 20)
    assert m.cols > 5 and m.rows > 5
    assert "Aggregate" not in m.times(L.signs(m.columns, 3))._jdf.queryExecution().toString()
    blocks = entries.select(m._block("row").alias("b"), "col").distinct().count()
    assert m.held.count() == blocks < m.rows * 50


def test_block_index_counts_where_texts_are(spark, tmp_path):
    """Terms of a text with repeats, null and empty texts: counts as they are, made before rows are shuffled."""
    from sparkloom.operators import blocks as BL

    d = spark.createDataFrame([(1, 5, 7, ["b", "a", "b", "b"]), (2, 3, 7, ["a"]), (3, 0, 8, []), (4, None, 8, None)], "key long, dl int, range long, t array<string>")
    tf = BL._frequencies(d)
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tf.collect())) == [("a", 7, 1, 5, 1), ("a", 7, 2, 3, 1), ("b", 7, 1, 5, 3)]


def test_latent_space(spark, tmp_path):
    """Vectors of texts against numpy's; a text given anew has its document's vector, texts without terms have none."""
    import collections

    import numpy as np

    from sparkloom.operators import factors as L

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{g}{i}" for i in range(6)], rng.integers(3, 12))) for g in "abc" for _ in range(12)] + ["", None, "wa1 wa1 wb2"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    space = L.LatentSpace(d, "id", S.terms(F.col("text")), 3, lambda x: str(tmp_path / x), rounds=6)
    words = sorted({w for t in texts if t for w in t.split()})
    tf = np.array([[collections.Counter((t or "").split())[w] for w in words] for t in texts], float)
    held = tf.sum(1) > 0
    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (1 + np.log((held.sum() + 1) / ((tf > 0).sum(0) + 1)))
    w[held] /= np.linalg.norm(w[held], axis=1)[:, None]
    _, s, vt = np.linalg.svd(w, full_matrices=False)
    assert space.values == pytest.approx(s[:3], rel=1e-6)
    got = {r["key"]: np.array(r["vector"]) for r in space.documents().collect()}
    assert sorted(got) == [i for i in range(len(texts)) if held[i]]
    mine, real = np.array([got[i] for i in sorted(got)]), (w @ vt[:3].T)[held]
    assert np.allclose(mine @ mine.T, real @ real.T, atol=1e-4)  # signs are free
    again = {r["key"]: np.array(r["vector"]) for r in space.embed(spark.createDataFrame([(1, texts[0]), (2, "unknown"), (3, None)], "q long, text string"), "q", S.terms(F.col("text"))).collect()}
    assert list(again) == [1] and np.allclose(again[1], got[0])


LAW = """<dokumente><norm><metadaten><jurabk>VwGO</jurabk><enbez>§ 42</enbez><titel>Anfechtung</titel></metadaten><textdaten><P>Durch Klage kann begehrt werden.</P></textdaten></norm>
<norm><metadaten><jurabk>VwGO</jurabk></metadaten><textdaten></textdaten></norm><norm><metadaten></metadaten><textdaten><P>Ohne Namen</P></textdaten></norm></dokumente>"""


def test_statute_and_decision_files(spark, tmp_path):
    import json

    for f in ("b/2.xml", "a/1.xml"):
        (tmp_path / f).parent.mkdir()
        (tmp_path / f).write_text(LAW)
    laws = scans.parse_laws(spark, str(tmp_path))
    assert laws.count() == 4
    got = sorted(tuple(r) for r in scans.first_snapshot(laws).select("text", "title", "filename", "law_book", "paragraph").collect())
    assert got == [("Durch Klage kann begehrt werden.", "VwGO § 42: Anfechtung", "1.xml", "VwGO", "§ 42"), ("Ohne Namen", "", "1.xml", "unknown", "unknown")]
    row = {"id": "d1", "court": "VG", "date": "03.02.2021", "file_number": "M 1 K 20.1", "paragraphs": [{"rd": 1, "text": "Eins"}, {"rd": None, "text": "Zwei"}]}
    (tmp_path / "d.json").write_text(json.dumps(row))
    d = scans.parse_decisions(spark, str(tmp_path / "d.json")).first()
    assert (d["date"], d["az_key"], d["norm_chain"], d["text"]) == ("2021-02-03", "m1k201", [], "Eins\nZwei")


def test_page_headers(spark):
    pages = [(1, [["x", "Kopfzeile", "a"], ["y", "Kopfzeile", "b"]]), (2, [["same", "a"], ["same", "b"]]), (3, [["x", "Kopfzeile"]])]
    d = spark.createDataFrame(pages, "id int, pages array<array<string>>")
    got = {r["id"]: r["p"] for r in d.select("id", scans.without_headers(F.col("pages")).alias("p")).collect()}
    assert got == {1: [["a"], ["b"]], 2: [["same", "a"], ["same", "b"]], 3: [["x", "Kopfzeile"]]}


def test_streamed_lines():
    lines = ['data: {"choices": [{"delta": {"content": "Hallo "}}]}', "", "data: {torn", 'data: {"choices": [{"delta": {"content": "Welt"}}]}', "data: [DONE]", 'data: {"choices": [{"delta": {"content": "!"}}]}']
    assert U.reassemble(lines) == "Hallo Welt"


def brute_span(a: str, b: str) -> int:
    """Every run of a tried at every place of b."""
    x, y = a.lower().split(), b.lower().split()
    return max((n for i in range(len(x)) for n in range(1, len(x) - i + 1) if any(y[j : j + n] == x[i : i + n] for j in range(len(y) - n + 1))), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abC"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 20))
def test_longest_span_of_all_runs(a, b, most):
    a, b = " ".join(a), " ".join(b)
    assert Y.longest_span(a, b, most) == min(brute_span(a, b), most)


def test_longest_span_in_batches(spark):
    """Nulls, empty and repeated texts; a word repeated 30,000 times on both sides takes linear time."""
    texts = [(0, "a b c", "x A B"), (1, None, "a"), (2, "a", None), (3, "", ""), (4, "a b c", "x A B"), (5, "q b c", "b c q"), (6, "w " * 30_000, "w " * 30_000), (7, "w " * 300 + "v", "w " * 30_000)]
    d = spark.createDataFrame(texts, "id int, p string, q string")
    got = {r["id"]: r["span"] for r in Y.with_longest_span(d, "p", "q", most=100_000).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0, 4: 2, 5: 2, 6: 30_000, 7: 300}


def test_shared_pools(spark):
    """Configurations that differ in what they do to a pool share it; searches are counted once."""
    named = {"a": {}, "b": {"rerank": "x"}, "c": {"pool": 5}, "d": {"state_share": 0.5}, "e": {"mode": "fts"}, "f": {"cite": "only"}, "g": {"two_hop": "first", "query": "facts"}, "h": {"ls_context": 3, "drop_norms": True, "two_hop": "first"}}
    configs = spark.createDataFrame([S.configuration(n, c, 10) for n, c in named.items()], S.CONFIG_SCHEMA)
    got = {r["pool_no"]: (sorted(m["config"] for m in r["members"]), sorted((n["channel"], n["need_kind"]) for n in r["needs"])) for r in S.pools(configs).collect()}
    q = "rewriter"
    assert got == {
        "a": (["a", "b", "c", "d"], [("fts", q), ("vector", q)]), "e": (["e"], [("fts", q)]), "f": (["f"], [("cite", "")]),
        "g": (["g"], [("fts", "facts"), ("hop", "facts"), ("vector", "facts")]), "h": (["h"], [("ls", q)]),
    }
    assert tuple(S.shared_work(configs).first()) == (8, 5, 7, 14)
    plan = S.sweep(spark.createDataFrame([], "query long, key long, channel string, query_kind string, list_no int, rank int, state boolean, structural boolean, official boolean"), spark.createDataFrame([], "query long, key long, scores map<string,double>"), configs, 5)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 0


def test_hit_lists_decisions_and_seats(spark, tmp_path):
    html = '<a href="?doc.id=AB1">x</a><a href="?doc.id=AB1"></a><a href="?doc.id=C2">'
    assert one(spark, scans.hit_list(F.lit(html))) == ["AB1", "C2"]
    xml = "<d><gertyp>VGH</gertyp><entsch-datum>2020-01-02</entsch-datum><aktenzeichen>1 B 2</aktenzeichen><norm>VwGO § 1</norm><absatz>Eins</absatz><absatz>Zwei</absatz></d>"
    got = spark.createDataFrame([(xml,)], "xml string").select(*[c.alias(n) for n, c in scans.decision_xml(F.col("xml")).items()]).first().asDict()
    assert got == {"court": "VGH", "date": "2020-01-02", "file_number": "1 B 2", "norms": ["VwGO § 1"], "paragraphs": ["Eins", "Zwei"]}
    (tmp_path / "seat.jsonl").write_text('{"index": 1, "model": "a", "score": 0.5}\n\n{"index": 2, "model": "a", "sco\n{"index": 3, "model": "a", "error": "x"}\n')
    rows = scans.read_seat(spark, str(tmp_path), ["index", "score", "error"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 0.5, None), (3, None, "x")]


@pytest.mark.parametrize("mode, rows", [("complete", 4), ("append", 4)])
def test_drained_streams_are_files(spark, tmp_path, mode, rows):
    """Results lie in files, not in the driver's memory, and the session's state store stays as it was."""
    from sparkloom.streaming import panel_stream as E

    events = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, CAST(id * id AS INT)) AS ts, id % 2 AS user_id, 'a' AS event_type, 1D AS value, '' AS props FROM (SELECT explode(array(0L, 0L, 1L, 2L, 3L)) AS id)")
    events.write.parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = E.drain(E.sessions(stream, "3 hours") if mode == "complete" else E.first_wins(stream), f"t_{mode}", mode, str(tmp_path / "cp"))
    assert got.inputFiles() and got.count() == rows
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


@pytest.mark.parametrize("cells", [1, 50, 2_000_000])
def test_bm25_by_document_equals_the_join(spark, tmp_path, cells, monkeypatch):
    """Few queries score documents whole, without a row for each of a document's shares; the same as the join of any number, with ties, null
    texts, null keys of queries, a repeated query and a query without terms, from texts and from a stored index."""
    monkeypatch.setattr(S, "CELLS", cells)
    texts = [(i, " ".join(f"w{(i * j * j) % 11}" for j in range(i % 7))) for i in range(40)] + [(90, None), (91, ""), (92, "w1 w2"), (93, "w1 w2")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4"), (2, "w4 w5"), (3, "none"), (4, None), (None, "w1")], "q int, text string")
    asked = q.select(F.col("q").alias("query"), F.explode(F.array_distinct(S.terms(F.col("text")))).alias("term"))
    rows = lambda d: sorted(map(str, d.select("query", "key", F.round("score", 8), "rank").collect()))
    index = S.Index(docs, "id", "text")
    want = rows(S.joined(index, asked, 4))
    sinks.write_index(index, str(tmp_path / "i"))
    got = S.bm25(index, q, "q", "text", 4)
    assert rows(got) == want and rows(S.bm25(S.StoredIndex(spark, str(tmp_path / "i")), q, "q", "text", 4)) == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString() and len(want) == 12
    assert rows(S.joined(S.StoredIndex(spark, str(tmp_path / "i")), asked, 4)) == want


@pytest.mark.parametrize("piece, product", [(3, 2), (16_384, 4_000_000)])
def test_cells_give_their_best_only(spark, tmp_path, piece, product, monkeypatch):
    """A cell's piece gives k rows a query, not one for each pair, with copies among the vectors, and the search equals comparing all pairs."""
    import uuid

    from sparkloom.operators import vectors as V

    monkeypatch.setattr(V, "PIECE", piece)
    monkeypatch.setattr(V, "PRODUCT", product)
    rows = [(i, [math.sin(i % 30 * j + j) for j in range(1, 6)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    asked = d.where("id % 7 = 0")
    index = V.CellIndex(d, "id", "v", str(tmp_path / "c"), 2)
    visits = V.units(asked, "id", "v").select(F.col("key").alias("query"), F.col("v").alias("qv"), F.lit(int(index.numbers[0])).alias("cell"))
    size = int(index.sizes[0])
    most = 4 * (-(-size // piece) if size > piece else 1)
    assert max(r["count"] for r in index._nearest(visits, 4, True).groupBy("query").count().collect()) <= min(most, size)
    for others in (True, False):
        got = index.search(asked, "id", "v", 4, lambda n: str(tmp_path / f"{n}-{uuid.uuid4().hex}"), others)
        want = S.dense(d, asked, "id", "id", "v", 4, others=others)
        say = lambda x: sorted((r["query"], r["rank"], r["key"], round(r["score"], 8)) for r in x.collect())
        assert say(got) == say(want)


def test_sweep_is_combined_by_hash(spark):
    """Lists meet pools without sorting what is only added up; a configuration that finds nothing still has its rows."""
    hits = spark.createDataFrame([(1, 10, "vector", "rewriter", 0, 0, False, False, True), (1, 11, "fts", "rewriter", 0, 0, False, False, True)], "query int, key int, channel string, query_kind string, list_no int, rank int, state boolean, structural boolean, official boolean")
    scores = spark.createDataFrame([(1, 11, {"bge": 1.0})], "query int, key int, scores map<string,double>")
    named = {"base": {}, "bge": {"merge": "rrf", "rerank": "bge"}, "none": {"cite": "only"}}
    configs = spark.createDataFrame([S.configuration(n, c, 5) for n, c in named.items()], S.CONFIG_SCHEMA)
    ranked = S.sweep(hits, scores, configs, 5)
    assert "SortAggregate(key=[pool_no" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["config"], r["rank"], r["key"]) for r in ranked.collect()) == [("base", 1, 10), ("base", 2, 11), ("bge", 1, 11), ("bge", 2, 10)]
    gold = spark.createDataFrame([(1, 11), (2, 5)], "query int, key int")
    got = sorted((r["config"], r["k"], r["hits"], r["gold"], r["cases_with_hit"]) for r in S.recall_of_configs(ranked, gold, configs, [1, 5]).collect())
    assert got == [("base", 1, 0, 2, 0), ("base", 5, 1, 2, 1), ("bge", 1, 1, 2, 1), ("bge", 5, 1, 2, 1), ("none", 1, 0, 2, 0), ("none", 5, 0, 2, 0)]


def test_decisions_are_read_once(spark):
    """One reading for all fields, whatever the nesting; a text isn't cut where a CDATA section begins."""
    from sparkloom.sources import scans

    xml = "<d><m><gertyp> V<i>G</i>H</gertyp><gertyp>zwei</gertyp></m><norm>a &amp; b<b>c</b>d</norm><norm/><absatz>x<![CDATA[ <roh> ]]>y</absatz><absatz>eins<!-- c -->zwei</absatz></d>"
    got = spark.createDataFrame([(1, xml), (2, None), (3, ""), (4, "<d/>")], "k int, xml string").select("k", *[c.alias(n) for n, c in scans.decision_xml(F.col("xml")).items()])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("run(") == 1
    assert [tuple(r)[1:] for r in got.orderBy("k").collect()] == [
        ("VGH", None, None, ["a & b", "d"], ["x <roh> y", "eins", "zwei"]), (None,) * 5, (None,) * 5, (None, None, None, [], []),
    ]


def test_oracle_context_takes_tasks_by_the_number_of_lines(spark, monkeypatch):
    """Four times the lines are four times the tasks, in both steps, and a query's keys meet whatever their parts."""
    from sparkloom.operators import ranking
    from sparkloom.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, QUERIES["r13_oracle_context"](spark, folder).collect()))
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    for tasks in (10, 40):
        monkeypatch.setattr(ranking, "TASK_ROWS", -(-lines // tasks))
        got = QUERIES["r13_oracle_context"](spark, folder)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2 and plan.count("Exchange") == 2
        assert sorted(map(tuple, got.collect())) == plain


def test_oracle_context_ties_go_by_key(spark, tmp_path, monkeypatch):
    """Keys as frequent and first seen at one place come by key, however lines are dealt."""
    from sparkloom.operators import ranking
    from sparkloom.plans import QUERIES

    lines = spark.createDataFrame([(7, 1, 1, k) for k in range(40, 0, -1)] + [(8, 2, 1, k) for k in (5, 3)] + [(8, 3, 1, 5)], "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    want = [(7, k, k) for k in range(1, 11)] + [(8, 3, 2), (8, 5, 1)]
    for rows in (1 << 20, 5):
        monkeypatch.setattr(ranking, "TASK_ROWS", rows)
        assert sorted(map(tuple, QUERIES["r13_oracle_context"](spark, str(tmp_path)).select("query", "key", "rank").collect())) == want


def test_latent_factors_are_fitted_on_all_documents(spark, tmp_path, monkeypatch):
    """However many documents a corpus says it has, what is decomposed is the matrix of all of them."""
    from sparkloom.operators import factors as L

    seen, real = [], L.decompose
    monkeypatch.setattr(L, "decompose", lambda matrix, *a: seen.append(matrix) or real(matrix, *a))
    d = spark.createDataFrame([(i, f"a{i % 3} b{i % 5} c{i % 7}") for i in range(60)], "id long, text string")
    monkeypatch.setattr(type(d), "count", lambda self: 3_000_000)
    space = L.LatentSpace(d, "id", S.terms(F.col("text")), 3, lambda x: str(tmp_path / x))
    assert seen == [space.matrix] and len(seen[0].lists.select("row").distinct().collect()) == 60


@pytest.mark.parametrize("hot", [1 << 18, 600, 0])
def test_sweep_of_line_items_is_shuffled_once(spark, tmp_path, monkeypatch, hot):
    """Lists are cut, merged, re-ranked and compared where a query's lines lie; queries of many lines are cut by parts before, with the same rows as the SQL."""
    import duckdb

    from sparkloom.plans import ORACLES, QUERIES, searching

    monkeypatch.setattr(searching, "HOT", hot, raising=False)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey % 2 = 0").withColumn("l_suppkey", F.expr("CASE WHEN l_suppkey < 4 THEN 3 ELSE l_suppkey END"))
    lines = lines.union(lines.limit(5).withColumn("l_partkey", F.lit(None).cast("long"))).withColumn("l_extendedprice", F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got, length = QUERIES["r19_presets"](spark, str(tmp_path)), spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 24)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", length)
    by_query = [x for x in plan.splitlines() if "Exchange hashpartitioning(query" in x or "Exchange hashpartitioning(l_suppkey" in x]
    assert len(by_query) == (2 if hot > 600 else 4), by_query  # one is of the wanted keys, two more are of hot queries
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(f"SELECT config, k, hits, gold, cases_with_hit FROM ({ORACLES['r19_presets']})").fetchall()
    assert sorted(map(tuple, got.select("config", "k", "hits", "gold", "cases_with_hit").collect())) == sorted(want)


@pytest.mark.parametrize("starts, few", [(65_536, 50_000), (3, 5)])
def test_blocks_are_made_by_stretches(spark, tmp_path, monkeypatch, starts, few):
    """Documents go once to their stretch of ranges, nothing else is kept of postings, and the result is that of scoring all, whether visits are broadcast or merged."""
    from sparkloom.operators import blocks as BL
    from sparkloom.operators import ranking

    for module, name, value in ((BL, "STRETCH", 2), (BL, "STARTS", starts), (BL, "VISITS", few), (ranking, "BROADCAST_ROWS", few)):
        monkeypatch.setattr(module, name, value, raising=False)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 3 + i % 40)), "ab"[i % 2] if i % 9 else None) for i in range(150)] + [(900, None, "a"), (901, "", None), (902, "", "b")]
    d, q = spark.createDataFrame(rows, "id long, text string, lang string"), spark.createDataFrame([(1, "w1 w2 w3"), (2, "w7 w22"), (3, "nothing")], "q long, text string")
    BL.write_blocks(d, "id", "text", str(tmp_path / "index"), ["lang"], 4)
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"sizes", "documents", "totals", "blocks", "terms"}
    index = BL.BlockIndex(spark, str(tmp_path / "index"))
    ranges = {r["key"]: r["range"] for r in spark.read.parquet(str(tmp_path / "index/documents")).select("key", "range").collect()}
    assert all(ranges[p["key"]] == b["range"] for b in index.blocks.collect() for p in b["postings"])
    assert index.blocks.count() == index.blocks.select("term", "range").distinct().count()
    say = lambda x: sorted((r["query"], r["rank"], r["key"], f"{r['score']:.7g}") for r in x.collect())
    assert say(index.search(q, "q", "text", 5, lambda name: str(tmp_path / name), (1, 2))) == say(S.bm25(S.Index(d, "id", "text"), q, "q", "text", 5))
