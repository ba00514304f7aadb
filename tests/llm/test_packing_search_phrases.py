"""Packing, ranked search and phrases against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing, queries

from .helpers import documents, odd_rows, text


def some_rows():
    return [(100 + i, text(i, 1 + i * 37 % 900), ("en", "de", None)[i % 3], "a", 1) for i in range(60)] + [(200 + i, "Alpha beta, gamma delta;\tepsilon alpha beta gamma" + " !" * (i % 2), None, "b", 1) for i in range(40)] + odd_rows()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    documents(spark, some_rows()).write.parquet(f"{at}/documents.parquet")
    items = [(i, text(i, 12)) for i in range(40)] + [(50, None), (51, ""), (52, "one"), (52, "ONE! one"), (53, "日本語 zzz"), (None, text(3, 20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


# --- packing ---


def check_plan(histogram, width):
    plan = packing.Plan(packing.shortest_pack_first(histogram, width), width)
    held = {}
    for length, n in histogram.items():
        many, start, upto, sequence, offset = plan.find(np.full(n, length), np.arange(n))
        first = np.cumsum(many) - many
        for i in range(n):
            at = 0
            for k in range(first[i], first[i] + many[i]):
                assert start[k] == at
                at = upto[k]
            assert at == length
        for a, b, s, o in zip(start.tolist(), upto.tolist(), sequence.tolist(), offset.tolist()):
            held.setdefault(s, []).append((o, b - a))
    assert sorted(held) == list(range(plan.sequences))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert width - packing.SLACK <= at <= width or at & (at - 1) == 0


def test_plans_of_random_histograms():
    r = random.Random(1)
    for _ in range(150):
        width = r.choice([4, 16, 64, 1024])
        check_plan({r.randint(1, width - 1): r.choice([1, 2, 5, 40, 1000]) for _ in range(r.choice([0, 1, 3, 30, 200]))}, width)


def test_plans_do_not_grow_with_counts():
    few = packing.Plan(packing.shortest_pack_first({n: 1 + n % 9 for n in range(1, 1024)}))
    many = packing.Plan(packing.shortest_pack_first({n: (1 + n % 9) * 10**9 for n in range(1, 1024)}))
    assert len(many.rows) < 2 * len(few.rows) + 1024 and len(many.runs) < 4096


def test_op11(spark, folder):
    got = queries.QUERIES["op11_packing"](spark, folder)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    hf = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {}
    for k, t, *_ in some_rows():
        want.setdefault(k, []).append(hf.encode(t or "", add_special_tokens=False).ids + [0])
    rows, sequences = got.collect(), {}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == want.keys()
    for k, lists in want.items():
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sum(r["length"] for r in by_doc[k]) == sum(map(len, lists))
        for r in by_doc[k]:
            fits = [x for x in lists if len(x) == r["doc_tokens"]]
            assert r["ids_crc32"] in {crc(x[r["start"] : r["start"] + r["length"]]) for x in fits}
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[k], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert 1024 - packing.SLACK <= at <= 1024 or at & (at - 1) == 0


def test_sequences_hold_the_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = packing.pack(docs, width=64)
    whole = packing.sequences(packed, width=64).collect()
    assert all(len(r["ids"]) == 64 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in whole)
    by_id = {r["sequence_id"]: r for r in whole}
    for r in packed.collect():
        assert by_id[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(docs.limit(0)).count() == 0


# --- search and phrases: the SQL over odd tables and over sf0.01 ---


def by_sql(folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet" + ("/*.parquet')" if folder.startswith("/tmp") else "')"))
    cur = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    return names, sorted(str([r[i] for i in at]) for r in cur.fetchall())


@pytest.mark.parametrize("where", ["odd", "sf0.01"])
def test_op12(spark, folder, where):
    at = folder.removeprefix("file://") if where == "odd" else f"/root/testdata/{where}"
    got = queries.QUERIES["op12_tput"](spark, at)
    names, want = by_sql(at, "op12_tput")
    assert sorted(got.columns) == names
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == want and len(want) > 100


def test_search_without_asked_terms_and_on_empty_tables(spark, folder, monkeypatch):
    from sparkloom.llm import tput

    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = sorted(map(str, tput.best(docs, items, 5).collect()))
    monkeypatch.setattr(tput, "ASKED_BYTES", 0)
    monkeypatch.setattr(tput, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(tput, "HEAD", 3)
    assert sorted(map(str, tput.best(docs, items, 5).collect())) == plain
    assert tput.best(docs.limit(0), items).count() == 0 == tput.best(docs, items.limit(0)).count()


@pytest.mark.parametrize("where", ["odd", "sf0.01"])
def test_op13(spark, folder, where):
    at = folder.removeprefix("file://") if where == "odd" else f"/root/testdata/{where}"
    got = queries.QUERIES["op13_phrases"](spark, at)
    names, want = by_sql(at, "op13_phrases")
    assert sorted(got.columns) == names
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == want and (len(want) > 20 or where == "odd")


def test_phrases_by_hashes_and_in_parts(spark, folder, monkeypatch):
    from sparkloom.llm import phrases

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = sorted(map(str, phrases.collocations(docs, least=5).collect()))
    for name, value in (("LIMIT", 40), ("CHUNK", 500), ("VOCABULARY_BYTES", 0)):
        monkeypatch.setattr(phrases, name, value)
        assert sorted(map(str, phrases.collocations(docs, least=5).collect())) == plain
    assert len(plain) > 15 and phrases.collocations(docs.limit(0)).count() == 0


def test_rare_pairs_of_hot_words_stay_where_they_are_counted(spark, monkeypatch):
    """Only pairs of two hot words leave their tasks as parts, not every pair that begins with a hot word."""
    from sparkloom.llm import phrases

    docs = spark.createDataFrame([(i, f"hot rare{i} hot hot other{i % 7} hot warm{i % 300} rare{i}", "en") for i in range(1000)], "doc_id long, text string, lang string")
    plain = sorted(map(str, phrases.mine(docs, 3)[0].collect()))
    made, real = [], phrases.map_arrow

    def spied(df, batches, schema):
        out = real(df, batches, schema)
        made.extend([out] * schema.startswith("lang string, codes"))
        return out

    monkeypatch.setattr(phrases, "map_arrow", spied)
    monkeypatch.setattr(phrases, "LIMIT", 900)
    for size in (phrases.VOCABULARY_BYTES, 0):
        monkeypatch.setattr(phrases, "VOCABULARY_BYTES", size)
        assert sorted(map(str, phrases.mine(docs, 3)[0].collect())) == plain
        codes = [tuple(r["codes"]) for r in made.pop().collect()]
        assert len(set(codes)) == sum("words=1" not in x for x in plain) and len(codes) < len(set(codes)) + 8
