"""Every query against its SQL statement on the small tables."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.8g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.8g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.8g}" if abs(v) < 10**7 else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    cur = tables.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(str([plain(w[i]) for i in at]) for w in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["m01_bootstrap_se", "m02_correlation_interval", "m03_cluster_interval", "m09_permutation_p"])
def test_resamples_of_the_reference(name):
    assert "range(10000)" in ORACLES[name]


def test_resamples_without_sql(spark):
    """Against plain numpy with the reference's 10,000 draws; label permutations are 2,000."""
    import numpy as np

    from sparkloom.operators import statistics as S
    from sparkloom.plans import statistics as plan

    seen = {}
    real, S.bootstrap_se_seeded = S.bootstrap_se_seeded, lambda *a: seen.update(args=a) or real(*a)
    try:
        QUERIES["m01b_seeded_bootstrap"](spark, DATA)
    finally:
        S.bootstrap_se_seeded = real
    assert seen["args"][3] == plan.REPS == 10_000
    x = [float(i * i % 17) for i in range(12)]
    got = real(spark.createDataFrame([("a", v) for v in x], "g string, v double").coalesce(1), ["g"], "v", plan.REPS, 3).first()["se"]
    want = np.array(x)[np.random.default_rng(3).integers(0, 12, (10_000, 12))].mean(1).std()
    assert got == pytest.approx(want, rel=1e-9)
    p = QUERIES["m16_label_permutation"](spark, DATA).first()["p"]
    assert abs(p * 2001 - round(p * 2001)) < 1e-9


def test_without_the_optional_subpackage(tmp_path):
    """The library imports nothing of it."""
    import subprocess
    import sys

    code = (
        "import sys\nclass No:\n def find_spec(self, n, *a):\n  if n.startswith(('sparkloom.llm', 'corpus_pipeline')): raise ImportError(n)\n"
        "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\nprint(len(e.queries()))"
    )
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) == len(QUERIES)
