"""Sinks: whole or not at all, by Spark's commit protocol or a new version to which a pointer moves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: that of spark.checkpoint.dir, or a
    temporary one where that is unset and all runs on this machine, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write a new version of a table beside the others, then move the pointer to it in one atomic rename: readers
    (`current`) see the old table or the new one. The version before stays for readers that are at it; older ones go."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(f"{path}/{name}")
    jvm = spark._jvm
    before = _pointer(spark, path)
    fs, new = _fs(spark, f"{path}/CURRENT.{name}")
    out = fs.create(new)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    target = _fs(spark, f"{path}/CURRENT")[1]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(new, target, over)
    for f in fs.listStatus(_fs(spark, path)[1]):
        if f.getPath().getName().startswith("v-") and f.getPath().getName() not in (name, before):
            fs.delete(f.getPath(), True)


def _pointer(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str:
    """The folder of the present version of a table that `replace` wrote."""
    name = _pointer(spark, path)
    if name is None:
        raise FileNotFoundError(path)
    return f"{path}/{name}"


def append_lines(df: DataFrame, path: str, by: str = "model") -> None:
    df.write.mode("append").partitionBy(by).json(path)


def append_widening(df: DataFrame, path: str) -> None:
    """Append rows whose columns may be new. Nothing is written again: `widened` merges the schemas when it reads."""
    df.write.mode("append").parquet(path)


def widened(spark: SparkSession, path: str) -> DataFrame:
    """All rows of such a table, with nulls where a row was written without a column."""
    return spark.read.option("mergeSchema", True).parquet(path)


def side_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def write_index(index, path: str) -> None:
    """A search index as tables: postings, and documents by term, in folders by a hash of the term, so that a StoredIndex reads its terms'
    folders. Postings are shuffled once."""
    from ..operators.search import part_of

    postings = index.tf.withColumn("part", part_of(F.col("term")))
    postings.repartition("part", F.xxhash64("key") % 4).write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    terms = index.tokens.sparkSession.read.parquet(f"{path}/postings").groupBy("part", "term").agg(F.count("*").alias("df"))
    terms.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def export(df: DataFrame, path: str, drop: tuple[str, ...] = ("vector", "embedding")) -> None:
    """A corpus without its vectors."""
    df.drop(*drop).write.mode("overwrite").parquet(path)


def _fingerprint(df: DataFrame) -> tuple:
    """Number of rows and sums of two hashes of each, whatever their order: one pass without a shuffle of rows."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    row = F.concat_ws("\1", *cells)
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)"))).first())


def merge_verified(parts: list[DataFrame], path: str) -> None:
    """Many tables as one JSON table, read back and compared as multisets of rows before it counts."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    replace(whole, path, "json", ignoreNullFields="false")
    spark = whole.sparkSession
    if _fingerprint(spark.read.schema(whole.schema).json(current(spark, path))) != _fingerprint(whole):
        raise ValueError("what was written differs from what was given")
