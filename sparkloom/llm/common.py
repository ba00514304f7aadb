"""Shared helpers: the cluster's shared folder, lineage cuts, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast. The callers' rows are a few numbers and one short string,
#: so a broadcast stays under about 10 MB.
BROADCAST_ROWS = 50_000

#: Parts into which a key of the other side of a salted join is copied.
SALT = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (only where
    that is unset and all runs on this machine, as in tests) a temporary folder that becomes the checkpoint folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='loom-')}")
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors re-read it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns as c0, c1, ..., so that columns added within an operator clash with none."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def hex_long(text: Column, start: int = 1, digits: int = 8) -> Column:
    """The number that some hex digits of md5(text) spell; every SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) fixed by the text."""
    return hex_long(text) / F.lit(4294967296.0)


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a null-safe key whose values may be very unevenly dealt in `big` and are unique in
    `small`. `small` must be cheap to count (cut or tiny). Up to BROADCAST_ROWS rows it is
    broadcast; beyond that both sides are salted, so that a hot key is shared by SALT tasks."""
    names = [c for c in small.columns if c != key]
    if len(small.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS:
        right = F.broadcast(small.withColumnRenamed(key, "__key"))
        return big.join(right, big[key].eqNullSafe(right["__key"]), how).select(*[big[c] for c in big.columns], *names)
    left = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    right = small.withColumnRenamed(key, "__key").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    on = left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__part"])
    return left.join(right, on, how).select(*[left[c] for c in big.columns], *names)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    edges: columns a and b (long). Large-star and small-star steps in turn (Kiveris et al., 2014)
    until the set of edges stays the same; each step keeps at most as many edges as before, is a
    combinable minimum per node and an equi-join that adaptive execution may split, and ends in a
    checkpoint. Nothing but one count and checksum a round comes to the driver.
    Nulls and self-edges are ignored; an empty table gives an empty result."""
    now = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def least(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low.withColumnRenamed("u", "__u"), F.col("u") == F.col("__u")).select("u", "v", "m")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        star = least(both).withColumn("m", F.least("u", "m")).where("v > u")
        large = star.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        star = least(down)
        small = star.select(F.col("v").alias("a"), F.col("m").alias("b")).union(star.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    low = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return low.union(roots.join(low.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_anti"))


def by_group(batches, n_keys: int):
    """Tables of consecutive rows that agree in the first n_keys columns, of batches so sorted.
    One group at a time is held; groups must be bounded by their maker."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in b.columns[:n_keys]:
            x = c.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        first = tuple(c[0].as_py() for c in b.columns[:n_keys])
        new[0] = first != last
        last = tuple(c[b.num_rows - 1].as_py() for c in b.columns[:n_keys])
        cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
        if cuts[0]:
            held.append(b.slice(0, cuts[0]))
        for a, z in zip(cuts, cuts[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [b.slice(a, z - a)]
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0 .. n-1 whose roots are least members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def triangle(df: DataFrame, chunk: Column, chunks: Column) -> DataFrame:
    """Each row once for every pair of chunks (i <= j) with its own in it, as columns __i, __j: the
    blocks in which all pairs of rows of a large group meet, without a group in one task."""
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    return df.withColumn("__k", chunk).withColumn("__o", other).select(*df.columns, F.least("__k", "__o").cast("int").alias("__i"), F.greatest("__k", "__o").cast("int").alias("__j"))
