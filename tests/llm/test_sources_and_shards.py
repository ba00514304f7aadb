"""Mixing and sharding: against plain Python, with odd rows and hot keys."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, sharding

from .helpers import documents, odd_rows, text, untouched


def fill(sizes: dict, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= most * sizes[s]}
        if not above:
            return out | share
        out |= {s: most * sizes[s] for s in above}
        open_ -= above
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 5, None: 1}, {"a": 5, "b": 0, "c": 7}, {"x": 3}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, sizes):
    d = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(d).collect()}
    want = fill(sizes)
    for s, n in sizes.items():
        assert got[s]["target"] == pytest.approx(want[s]) and got[s]["target"] <= 3 * n + 1e-9
    assert sum(r["target"] for r in got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_odd_rows(spark):
    rows = odd_rows() + [(100 + i, text(i, 5 + i % 50), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(600)]
    d = documents(spark, rows)
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = fill(dict(sizes))
    for p in plan:
        rate = want[p["source"]] / sizes[p["source"]] if sizes[p["source"]] else 0
        assert p["n_copies"] in (int(rate), int(rate + 1e-9), int(rate) + 1) and p["n_copies"] <= 3
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and untouched(mixed)
    taken = Counter((r["doc_id"], r["source"], r["text"]) for r in mixed.collect())
    expect = Counter()
    by = defaultdict(list)
    for p in plan:
        by[p["doc_id"], p["source"], p["size"]].append(p["n_copies"])
    for r in rows:
        n = by[r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))].pop()
        if n:
            expect[r[0], r[3], r[1]] += n
    assert taken == expect
    assert Counter(mixing.mix(d.repartition(7)).select("doc_id", "text").collect()) == Counter(mixed.select("doc_id", "text").collect())


def test_mix_comes_near_targets(spark):
    rows = [(i, text(i, 20 + i % 17), "en", f"s{i % 4}" if i % 3 else "hot", 1) for i in range(6000)]
    got = mixing.mix_plan(documents(spark, rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 0.06 * r["target"] for r in got)


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.common.BROADCAST_ROWS", 2)
    rows = [(i, text(i, 9), "en", None if i % 5 == 0 else f"s{i % 7}", 1) for i in range(200)]
    d = documents(spark, rows)
    assert mixing.mix_plan(d).count() == 200


def shard_of(key, n_bits):
    return int(hashlib.md5(("k%d" % key if key is not None else "null").encode()).hexdigest()[:15], 16) >> (60 - n_bits)


def test_shards_fit(spark):
    rows = [(i, text(i, 10 + i % 30), "en", "a", 1) for i in range(800)]
    d = documents(spark, rows)
    limit = 20_000
    out = sharding.assign_shards(d, limit=limit, carry=["doc_id"]).collect()
    assert len(out) == 800
    sums, members = Counter(), defaultdict(set)
    for r in out:
        sums[r["shard"]] += r["n_bytes"]
        members[r["shard"]].add(r["doc_id"])
    for r in out:
        depth, prefix = map(int, r["shard"].split(":"))
        assert r["shard_bytes"] == sums[r["shard"]] <= limit
        assert shard_of(r["doc_id"], depth) == prefix
        if depth:  # the bucket above was too large, or it wouldn't have been split
            assert sum(x["n_bytes"] for x in out if shard_of(x["doc_id"], depth - 1) == prefix >> 1) > limit


def test_hot_key_and_giant_document(spark):
    rows = [(1, text(7, 50), "en", "a", 1)] * 300 + [(2, text(3, 40_000), "en", "a", 1)] + odd_rows()
    d = documents(spark, rows)
    out = sharding.assign_shards(d, limit=20_000, carry=["doc_id"])
    got = out.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert all(r["b"] <= 20_000 or r["n"] == 1 for r in got) and len(got) > 5


def test_shards_keep_clashing_columns(spark, tmp_path):
    d = documents(spark, odd_rows())
    out = sharding.assign_shards(d, limit=1000)
    assert out.columns[: len(d.columns)] == d.columns and out.count() == len(odd_rows())
    sharding.write_shards(documents(spark, odd_rows(), clash=False), f"file://{tmp_path}/s", limit=1000)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(odd_rows())


def test_empty(spark):
    d = documents(spark, [])
    assert mixing.mix(d).count() == 0 and mixing.mix_plan(d).count() == 0
    assert sharding.assign_shards(d).count() == 0
