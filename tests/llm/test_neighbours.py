"""Near-duplicates of documents and vectors, and components, against brute force."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import minmax, pivots
from sparkloom.llm.common import by_group, components

from .helpers import documents, odd_rows, text, union_find, untouched


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (None, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(i, (i * 7) % 91) for i in range(90)]])
def test_components(spark, edges):
    d = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    roots = union_find(max(nodes, default=0) + 1, real)
    got = {r["node"]: r["component"] for r in components(d).collect()}
    assert got == {x: roots[x] for x in nodes}


def test_groups_across_batches():
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size]}) for i in range(0, len(keys), size)]
        assert [t["k"].to_pylist() for t in by_group(iter(batches), 1)] == [[1, 1, 1], [2], [3, 3, 3, 3], [4]]


def sets_of(rows, words):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        k = min(words, len(w))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    return out


def brute(rows, words, percent):
    """component of each id; ids that repeat are one document with several texts"""
    sets = sets_of(rows, words)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    at = {k: i for i, k in enumerate(ids)}
    full = [(at[r[0]], s) for r, s in zip(rows, sets) if r[0] is not None and s]
    links = []
    for i, (a, s) in enumerate(full):
        for b, u in full[:i]:
            if a != b and 100 * len(s & u) >= percent * len(s | u):
                links.append((a, b))
    roots = union_find(len(ids), links)
    return {k: ids[roots[i]] for k, i in at.items()}


def edited(seed, n, edits):
    rnd = random.Random(seed)
    w = text(n, 120).split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_documents(spark, words, percent):
    rows = odd_rows() + [(100 + i, edited(i, i % 6, i % 9), "en", "a", 1) for i in range(240)]
    rows += [(900 + i, text(3, 60).upper() if i % 2 else text(3, 60), "en", "a", 1) for i in range(30)]
    got = minmax.groups(documents(spark, rows), words, percent).collect()
    assert len(got) == len(rows)
    want, sizes = brute(rows, words, percent), sorted((r[0] is None, r[0] or 0, len(s)) for r, s in zip(rows, sets_of(rows, words)))
    assert sorted((r["id"] is None, r["id"] or 0, r["n_shingles"]) for r in got) == sizes
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["id"]] and r["kept"] == (want[r["id"]] == r["id"])
    left = minmax.dedup(documents(spark, rows), words, percent)
    assert left.columns == documents(spark, []).columns and untouched(left)
    assert sorted({r["doc_id"] for r in left.collect() if r["doc_id"] is not None}) == sorted(k for k, v in want.items() if k == v)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group whose members don't all link to the centre, over several chunks."""
    monkeypatch.setattr(minmax, "CHUNK_BYTES", 20_000)
    rows = [(i, edited(i, 1, 2 + i % 5), "en", "a", 1) for i in range(150)]
    want = brute(rows, 3, 85)
    got = {r["id"]: r["component_id"] for r in minmax.groups(documents(spark, rows), 3, 85).collect()}
    assert got == want


def test_min_max_estimates_similarity():
    a, b = minmax.shingles(text(5, 900), 3), None
    b = np.concatenate([a[: len(a) * 8 // 10], minmax.shingles(text(77, 300), 3)])
    b = np.unique(b)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    k = 1500
    x, y = minmax.signature(a, k), minmax.signature(b, k)
    assert abs((x == y).mean() - true) < 0.05


def test_no_documents(spark):
    d = documents(spark, [])
    assert minmax.groups(d).count() == 0 and minmax.dedup(d).count() == 0


# --- vectors ---


def vector_rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = [base[i % 20] + rng.normal(size=16) * 0.08 for i in range(200)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    rows += [(1000, base[0].tolist()), (1001, base[0].tolist()), (1002, (base[1] * 3).tolist())]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [0.0] * 15), (2005, [None] * 16), (2006, [1.0, 2.0]), (None, base[0].tolist())]
    return rows


def test_vectors(spark):
    rows = vector_rows()
    d = spark.createDataFrame([(k, v, 1, None) for k, v in rows], "vec_id long, embedding array<double>, label int, pivots string")
    got = {r["id"]: r for r in pivots.groups(d).collect()}
    good = [(k, np.array(v)) for k, v in rows if k is not None and k < 2000]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    assert [got[k]["n_links"] for k, _ in good] == linked.sum(1).tolist()
    roots = union_find(len(good), list(zip(*np.nonzero(linked))))
    assert [got[k]["component_id"] for k, _ in good] == [good[r][0] for r in roots]
    for k in range(2000, 2007):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 64)
    monkeypatch.setattr(pivots, "_TILE", 16)
    rng = np.random.default_rng(1)
    v = np.ones(8) + rng.normal(size=(400, 8)) * 0.05
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = pivots.groups(d).collect()
    assert all(r["component_id"] == 0 for r in got) and all(r["n_links"] == 399 for r in got)


def test_lists_cut_by_a_second_reference_point(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 16)
    monkeypatch.setattr(pivots, "_TILE", 8)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 8))
    v = np.concatenate([base, base[:150] + rng.normal(size=(150, 8)) * 0.1, np.repeat(base[:1], 40, 0)])
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    chosen = pivots.describe(d.selectExpr("vec_id AS id", "1L AS weight", "embedding AS vector"), pivots.choose_pivots(d.selectExpr("vec_id AS id", "embedding AS vector"), len(v)))
    near = {r["id"]: set(r["pivots"]) for r in chosen.collect()}
    blocks = pivots._lists(chosen, 2)
    assert blocks.where("second >= 0").count() > 0
    # whatever shares two meets in a block
    met = {(a, b) for r in blocks.groupBy("pivot", "second", "__i", "__j").agg({"id": "collect_list"}).collect() for a in r[4] for b in r[4] if a < b}
    assert {(a, b) for a in near for b in near if a < b and len(near[a] & near[b]) >= 2} <= met
    x = v / np.linalg.norm(v, axis=1)[:, None]
    linked = np.einsum("ik,jk->ij", x, x) >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["id"]: r["n_links"] for r in pivots.groups(d).collect()}
    assert sum(got.values()) >= 0.999 * linked.sum() and all(got[i] <= n for i, n in enumerate(linked.sum(1)))


def test_shared_counts_are_exact():
    """Also of reference points whose numbers agree in their last bits."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    near = np.array([rng.choice(200, 12, replace=False) for _ in range(60)])
    both = pivots._counts(near[:25], near[25:])
    assert both.tolist() == [[len(set(a) & set(b)) for b in near[25:].tolist()] for a in near[:25].tolist()]
    lists = [sorted([5, 69, *range(100, 110)]), sorted([5, 69, *range(110, 120)])]
    vectors = [[1.0, 0.0], [1.0, 0.01]]
    table = pa.table({"pivot": [5, 5], "second": [-1, -1], "__i": [0, 0], "__j": [0, 0], "id": [7, 9], "weight": [1, 3], "vector": vectors, "pivots": lists, "k": [0, 0]})
    ids, links, roots = pivots._block(table, 0.9, 2)
    assert (ids.tolist(), links.tolist(), roots.tolist()) == ([7, 9], [3, 1], [7, 7])


def test_an_id_with_two_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["id"], r["n_links"], r["component_id"]) for r in pivots.groups(d).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)} and pivots.groups(d).count() == 6


def test_no_vectors(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.groups(d).count() == 0
    d = spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivots.groups(d).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
