"""Near-duplicate vectors through a pivot-permutation index.

A bounded sample of the vectors serves as reference points. Each vector is described by its
`prefix` nearest reference points in order; they are its postings in the inverted
lists. Two vectors that share at least `shared` reference points are candidates, and their cosine
is computed in double precision. The number of reference points grows with the root of the number of vectors
(the sample is at most MAX_PIVOTS rows), so lists grow with the root too.

Reference points are numbered from the rarest to the most frequent. Vectors that share `shared` of them share one that isn't
among the last shared - 1 of either, so those get no posting, and a pair belongs to the list of the first reference point it
shares. A list longer than CHUNK is cut up by the second one, where the counts of such pairs say that this saves work.
What is longer still (a dense region) is worked on in blocks: pairs of chunks of at most CHUNK rows, shared by many
tasks. A block counts the shared reference points of all its pairs exactly, verifies those with enough, and puts out, for
each vector, the weight of its links and one link of a spanning forest, never pairs.

Equal vectors are one class with a weight, told by a SHA-256 of their bytes; a class is counted over salted parts, so that
no vector, however common, meets in one task.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
numbers link with nothing; they are rows of the result with no links. A null id takes no part (its component
is null, and it is kept). Rows that repeat an id are one vector with several values: any link counts, and n_links adds
up over them. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import SALT, Forest, by_group, components, cut, triangle

COSINE = 0.9
PREFIX, SHARED = 12, 2
#: Least and greatest number of reference points; the latter is reached at 268 million vectors.
MIN_PIVOTS, MAX_PIVOTS = 64, 65536
#: Greatest cosine of two reference points.
APART = 0.8
CHUNK = 2048
_TILE = 512


def _valid(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of a sample fixed by a hash of the ids, at most MAX_PIVOTS rows; their number depends on
    the root of the number of vectors. A vector close to one taken before is passed over: within a dense
    region the order of many near reference points would be chance, so a region has few."""
    n = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(4 * math.sqrt(count))))
    part = min(1.0, 4 * n / max(1, count))  # more than is taken below; the rest needn't be sorted
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.lit(int(part * (1 << 30))))
    table = some.select("vector").orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, 2 * n)).toArrow()
    x = _unit(_matrix(table["vector"])) if len(table) else np.zeros((0, 1))
    taken = np.zeros_like(x)
    k = 0
    for v in x:
        if k < n and (not k or (taken[:k] @ v).max() < APART):
            taken[k] = v
            k += 1
    return taken[:k]


def describe(vectors: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """vectors (id, weight, vector) with pivots: the nearest reference points in order."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS rows

    def batches(it):
        for b in it:
            if not b.num_rows:
                continue
            near = []
            x = _unit(_matrix(b.column(2)))
            for a in range(0, len(x), 1024):
                c = x[a : a + 1024] @ sent.value.T
                k = min(prefix, c.shape[1])
                top = np.argpartition(-c, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(c, top, 1), axis=1, kind="stable")
                near.append(np.take_along_axis(top, order, 1).astype(np.int32))
            near = np.concatenate(near)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "weight", "vector", "pivots"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.transform(map_arrow, batches, f"id long, weight long, vector {kind}, pivots array<int>")


def _counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many reference points each row of a shares with each row of b: a product of 0/1 matrices over those that
    occur on both sides."""
    names = np.intersect1d(a, b)

    def marked(near: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, near), len(names) - 1)
        out = np.zeros((len(near), len(names) + 1), np.float32)
        np.put_along_axis(out, np.where(names[at] == near, at, len(names)), 1, 1)
        return out[:, :-1]

    return marked(a) @ marked(b).T if len(names) else np.zeros((len(a), len(b)), np.float32)


def _block(table: pa.Table, cosine: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's vectors: id, weight of the links that belong here, root in a spanning forest."""
    pivot, second, i, j = (table[c][0].as_py() for c in ("pivot", "second", "__i", "__j"))
    ids, weight, mine = table["id"].to_numpy(), table["weight"].to_numpy(), table["k"].to_numpy()
    near, x = _matrix(table["pivots"]).astype(np.int64), _unit(_matrix(table["vector"]))
    order = np.argsort(ids, kind="stable")
    ids, weight, mine, near, x = ids[order], weight[order], mine[order], near[order], x[order]
    links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    rows, cols = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    for r in range(0, len(rows), _TILE):
        a = rows[r : r + _TILE]
        for c in range(0, len(cols), _TILE):
            b = cols[c : c + _TILE]
            if i == j and c + _TILE <= r:
                continue  # all of these pairs are met the other way round
            candidates = _counts(near[a], near[b]) >= shared
            near_enough = candidates & (ids[a][:, None] != ids[b][None, :]) & (x[a] @ x[b].T >= cosine - 1e-9)
            p, q = np.nonzero(near_enough)
            p, q = a[p], b[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 65536):
                u, v = p[s : s + 65536], q[s : s + 65536]
                good = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                u, v = u[good], v[good]
                meet = (near[u][:, :, None] == near[v][:, None, :]).any(2)
                common = np.sort(np.where(meet, near[u], np.iinfo(np.int64).max), axis=1)
                own = common[:, 0] == pivot
                if second >= 0:
                    own &= common[:, 1] == second
                u, v = u[own], v[own]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                for y, z in zip(u.tolist(), v.tolist()):
                    forest.join(y, z)
    keep = np.flatnonzero(links)
    roots = np.array([forest.root(y) for y in keep.tolist()], np.int64)
    return ids[keep], links[keep], ids[roots] if len(roots) else keep


def _digests(rows: DataFrame) -> DataFrame:
    """(id, digest, salt, vector) of rows (id, vector): a name for the vector, and a part of 0 .. SALT - 1 by the id."""
    kind = rows.schema["vector"].dataType.simpleString()

    def batches(it):
        for b in it:
            if b.num_rows:
                x = _matrix(b.column(1)) + 0.0  # -0 is 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(r.tobytes()).digest() for r in x], pa.binary()), b.column(1)], ["id", "digest", "vector"])

    named = rows.transform(map_arrow, batches, f"id long, digest binary, vector {kind}")
    return named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))


def _lists(described: DataFrame, shared: int) -> DataFrame:
    """(pivot, second, __i, __j, id, weight, vector, pivots, k): the blocks' rows; pivots are numbered by their frequency."""
    lengths = described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()  # at most MAX_PIVOTS rows
    rank = {r["pivot"]: i for i, r in enumerate(sorted(lengths, key=lambda r: (r["count"], r["pivot"])))}
    sent = described.sparkSession.sparkContext.broadcast(np.array([rank.get(p, 0) for p in range(max(rank, default=0) + 1)], np.int32))

    def renumber(it):
        for b in it:
            if b.num_rows:
                near = np.sort(sent.value[_matrix(b.column(3)).astype(np.int64)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["id", "weight", "vector", "pivots"])

    kind = described.schema["vector"].dataType.simpleString()
    ranked = described.transform(map_arrow, renumber, f"id long, weight long, vector {kind}, pivots array<int>")
    last = F.size("pivots") - (shared - 1)
    keys = ranked.select("id", "pivots", F.posexplode(F.slice("pivots", F.lit(1), last)).alias("at", "pivot"))
    sizes = cut(keys.groupBy("pivot").agg(F.count("*").alias("n")))
    whole = sizes.where("n > 1").select("pivot", F.lit(-1).alias("second"), "n")
    if shared > 1 and sizes.where(F.col("n") > CHUNK).limit(1).count():
        # pairs of reference points of the long lists, and what they would cost
        long = F.broadcast(sizes.where(F.col("n") > CHUNK).select(F.col("pivot").alias("__p"), F.col("n").alias("whole")))  # at most MAX_PIVOTS rows
        after = keys.join(long, F.col("pivot") == F.col("__p")).select("pivot", "whole", F.explode(F.slice("pivots", F.col("at") + 2, F.size("pivots"))).alias("second"))
        pairs = cut(after.groupBy("pivot", "second").agg(F.count("*").alias("n"), F.max("whole").alias("whole")))
        cost = lambda n: n * n + n * F.lit(CHUNK)  # noqa: E731  pairs, and rows to be moved
        split = cut(pairs.groupBy("pivot").agg(F.sum(cost(F.col("n"))).alias("cost"), F.max("whole").alias("whole")).where(F.col("cost") < cost(F.col("whole"))).select("pivot"))
        whole = whole.join(F.broadcast(split), "pivot", "left_anti").union(pairs.join(F.broadcast(split), "pivot", "left_semi").where("n > 1").select("pivot", "second", "n"))
        whole = cut(whole)
    else:
        split = None
    posted = ranked.select("*", F.posexplode(F.slice("pivots", F.lit(1), last)).alias("at", "pivot"))
    if split is None:
        posted = posted.withColumn("second", F.lit(-1))
    else:
        known = F.broadcast(split.select(F.col("pivot").alias("__p")))
        seconds = F.when(F.col("__p").isNull(), F.array(F.lit(-1))).otherwise(F.slice("pivots", F.col("at") + 2, F.size("pivots")))
        posted = posted.join(known, F.col("pivot") == F.col("__p"), "left").withColumn("second", F.explode(seconds))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    names = ["pivot", "second", "id", "weight", "vector", "pivots", "k", "chunks"]
    asked = whole.withColumnRenamed("pivot", "__w").withColumnRenamed("second", "__s")
    small = split is None  # then a row a reference point
    joined = posted.join(F.broadcast(asked) if small else asked, (F.col("pivot") == F.col("__w")) & (F.col("second") == F.col("__s")))
    joined = joined.withColumn("k", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("chunks", chunks).select(*names)
    return triangle(joined, F.col("k"), F.col("chunks")).select("pivot", "second", "__i", "__j", "id", "weight", "vector", "pivots", "k")


def groups(vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of vectors."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(_valid(vector), F.col(vector)).alias("vector"))
    usual = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length, count = (usual[0], usual[1]) if usual else (0, 0)
    if not count:
        return rows.selectExpr("id", "0L AS n_links", "id AS component_id", "true AS kept")
    fits = F.coalesce(F.col("vector").isNotNull() & (F.size("vector") == length) & F.col("id").isNotNull(), F.lit(False))
    named = cut(_digests(rows.where(fits)))
    cells = cut(named.groupBy("digest", "salt").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")))
    classes = cells.groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("weight"))
    # one row of each class brings its vector
    bearer = named.join(classes.withColumnRenamed("id", "__id").withColumnRenamed("digest", "__d"), (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__d")))
    bearers = cut(bearer.groupBy("digest", "id", "weight").agg(F.first("vector").alias("vector")))

    vectors_of = bearers.select("id", "weight", "vector")
    pivots = choose_pivots(vectors_of, count)
    shared = min(shared, len(pivots))
    described = cut(describe(vectors_of, pivots, prefix))
    lists = _lists(described, shared)

    def blocks(it):
        for table in by_group(it, 4):
            found = _block(table, cosine, shared)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["id", "links", "root"])

    block = ["pivot", "second", "__i", "__j"]
    found = cut(lists.repartition(*block).sortWithinPartitions(*block).transform(map_arrow, blocks, "id long, links long, root long"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    near = bearers.select("digest", "id", "weight").join(links.withColumnRenamed("id", "__l"), F.col("id") == F.col("__l"), "left").join(joined, F.col("id") == F.col("node"), "left")
    near = near.select(F.col("digest").alias("__d"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    of_cell = cells.select("digest", "salt").join(near, F.col("digest") == F.col("__d")).select(F.col("digest").alias("__d"), F.col("salt").alias("__s"), "links", "component")
    placed = named.select("id", "digest", "salt").join(of_cell, (F.col("digest") == F.col("__d")) & (F.col("salt") == F.col("__s")))
    out = placed.select("id", "links", "component").union(rows.where(~fits).select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select("id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
