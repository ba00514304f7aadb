"""Sharding by extendible hashing, with DataFrame functions only.

A directory over hash-prefix bits: a bucket is split on its next bit only while it holds more than
`limit` bytes, so the shards are the shortest prefixes that fit. Sizes are summed per cell (a fixed
number of next bits) before anything else, so the directory is built from sums, not from documents.
Cells that are still too large take further bits in a next round, alone. Rows whose hashes agree in
all bits (one key that holds more than a shard) are split in the same way on a hash of their place
in the materialised table. A single document above the limit is a shard of its own.

Null keys hash as one key of their own, null texts are 0 bytes. Repeated rows are kept, each with
its shard. An empty table gives an empty result. Extra columns may bear any name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, hex_long

LIMIT = 64 << 20
#: Shards that the registered query wants at least: its limit is the bytes of all texts by this number.
SHARDS = 64
#: Bits of a hash: 15 hex digits of md5.
BITS = 60
STEP = 20


def _directory(rows: DataFrame, used: int, width: int, limit: int) -> DataFrame:
    """(__base, __cell, __depth, __size): for each cell of `width` bits after `used` the least number
    of further bits at which its bucket fits; null if none does."""
    cells = rows.groupBy("__base", _bits(used, width).alias("__cell")).agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"))
    cells = cut(cells)
    paths = cells.select("__base", "__cell", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("d"))
    paths = paths.withColumn("p", F.expr(f"shiftright(__cell, {width} - d)"))
    sizes = paths.groupBy("__base", "d", "p").agg(F.sum("b").alias("size"), F.sum("n").alias("rows"))
    fits = sizes.where((F.col("size") <= limit) | (F.col("rows") == 1))
    best = paths.join(fits, ["__base", "d", "p"]).groupBy("__base", "__cell").agg(F.min(F.struct("d", "size")).alias("fit"))
    return cells.join(best, ["__base", "__cell"], "left").select("__base", "__cell", F.col("fit.d").alias("__depth"), F.col("fit.size").alias("__size"))


def _bits(used: int, width: int) -> Column:
    return F.shiftright("__hash", BITS - used - width).bitwiseAND(F.lit((1 << width) - 1))


def assign_shards(docs: DataFrame, limit: int | None = LIMIT, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in `carry` (all, if None) with shard, shard_bytes and n_bytes. A limit of None stands for
    the bytes of all texts by SHARDS, rounded up.

    shard is depth:prefix, all bits' number and their value in decimal, however many rounds it took; a slash stands only where
    all bits of a hash are used up and a new hash begins.
    What is carried is kept once in the shared folder, so every row stays the same row in a retry."""
    carry = list(docs.columns) if carry is None else carry
    keep = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    keyed = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    rows = cut(
        docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"), hex_long(keyed, 1, 15).alias("__hash"))
        .withColumn("__uid", F.monotonically_increasing_id())
        .withColumns({"__base": F.lit(""), "__done": F.lit("")})
    )
    out, used, total = None, 0, rows.agg(F.sum("__bytes")).first()[0] or 0
    limit = limit or max(1, -(-total // SHARDS))
    width = min(STEP, max(4, math.ceil(math.log2(max(1, total / limit))) + 3))
    while True:
        width = min(width, BITS - used)
        table = cut(_directory(rows, used, width, limit))
        n = table.count()
        joined = rows.withColumn("__cell", _bits(used, width)).join(F.broadcast(table) if n <= BROADCAST_ROWS else table, ["__base", "__cell"])
        label = F.concat("__done", F.col("__depth") + used, F.lit(":"), F.expr(f"shiftright(__hash, CAST({BITS - used} - __depth AS INT))"))
        done = joined.where("__depth IS NOT NULL").select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], label.alias("__shard"), F.col("__size").alias("__shard_bytes"), F.col("__bytes").alias("__n_bytes")
        )
        out = done if out is None else out.union(done)
        if not table.where("__depth IS NULL").limit(1).count():
            break
        base = F.concat("__base", F.lit(f"/{width}:"), F.col("__cell"))
        rows = joined.where("__depth IS NULL").withColumn("__base", base).select(*[f"c{i}" for i in range(len(carry))], "__bytes", "__hash", "__uid", "__base", "__done")
        used, width = used + width, STEP
        if used >= BITS:  # one key, or a clash of all bits: go on with the rows' own hashes
            rows = rows.withColumn("__done", F.concat("__done", F.lit(f"{BITS}:"), F.col("__hash"), F.lit("/")))
            rows, used = rows.withColumn("__hash", hex_long(F.concat("__base", F.lit("|"), F.col("__uid")), 1, 15)), 0
        rows = cut(rows)
    names = {"__shard": "shard", "__shard_bytes": "shard_bytes", "__n_bytes": "n_bytes"}
    clash = {c.lower() for c in carry}
    return out.select(*[F.col(c) for c in carry], *[F.col(a).alias(b if b not in clash else a) for a, b in names.items()])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write docs as Parquet, one folder a shard; a shard fits one task by construction."""
    assign_shards(docs, limit, key, text).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


ORACLE = f"""
WITH rows AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
paths AS (SELECT r.*, d, h >> ({BITS} - d) AS p FROM rows r, (SELECT unnest(range(0, {BITS} + 1))::INTEGER AS d)),
buckets AS (SELECT d, p, sum(n_bytes)::BIGINT AS size, count(*) AS n FROM paths GROUP BY d, p),
capped AS (SELECT greatest(1, (sum(n_bytes) + {SHARDS} - 1) // {SHARDS})::BIGINT AS most FROM rows),
fits AS (SELECT doc_id, n_bytes, x.d, x.p, size, row_number() OVER (PARTITION BY doc_id ORDER BY x.d) AS k
  FROM paths x JOIN buckets b ON x.d = b.d AND x.p = b.p CROSS JOIN capped WHERE size <= most OR n = 1)
SELECT doc_id, n_bytes, d::VARCHAR || ':' || p::VARCHAR AS shard, size AS shard_bytes FROM fits WHERE k = 1
"""
