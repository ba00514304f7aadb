"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution. On a cluster pass that cluster's master;
    the shuffle partitions are a starting point that adaptive execution merges."""
    b = SparkSession.builder.master(master).appName("sparkloom")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # the driver keeps plans and metrics of past queries even without its pages; a hundred exchanges a query fill it
        "spark.sql.ui.retainedExecutions": "20",
        "spark.ui.retainedJobs": "100",
        "spark.ui.retainedStages": "200",
        "spark.ui.retainedTasks": "5000",
        "spark.sql.maxPlanStringLength": "20000",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run."""
    import shutil
    import tempfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="sparkloom-"))
    shutil.copytree(root, at / "zip" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(at / root.name), "zip", at / "zip"))


#: Bytes of rows that go to a Python worker at once: texts may be long, and a batch is held there
#: several times over while it is worked on.
BATCH_BYTES = 16 << 20


#: Rows whose results are Python objects at once.
SLICE = 64


def map_arrow(df, batches, schema):
    """df.mapInArrow, with this package at hand in the workers and batches of bounded size (unless
    the session bounds them more tightly); for DataFrame.transform."""
    bounded(df.sparkSession)
    return df.mapInArrow(_tidy(batches), schema)


def bounded(spark: SparkSession) -> None:
    """This package in the workers, and batches of at most BATCH_BYTES unless the session has its own value."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":  # the default
        spark.conf.set(name, f"{BATCH_BYTES}b")


def row_function(spark: SparkSession, one, kind: str, arrow):
    """A function of a column by one(value), of a Spark and an Arrow type. Values and results are Python objects for SLICE rows at a
    time, and Arrow otherwise, so that a worker's memory goes by a batch's bytes, not by what its results are made of."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    bounded(spark)

    def rows(it):
        for b in it:
            parts = [pa.array([one(x) for x in b.slice(a, SLICE).to_pylist()], arrow) for a in range(0, len(b), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _tidy(rows)(it)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def _tidy(batches):
    """batches, after which a worker, which lives on, gives back the memory it no longer uses."""

    def run(it):
        import ctypes

        import pyarrow

        yield from batches(it)
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return run
