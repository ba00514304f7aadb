"""Exact nearest neighbours by a partitioned index of cells.

Vectors are dealt into cells around centres, which Lloyd rounds find on a bounded sample; every vector is indexed, with its cell. A cell knows its radius, the
greatest distance of a member from its centre, so by the triangle inequality no member is nearer to a query than the
query's distance from the centre less the radius. A query visits cells in the order of that bound, twice as many each round, until the next
cell's bound is beyond its k-th distance; queries that are done drop out. The result is that of comparing all pairs; how many cells were
read is part of it. Cells are joined by their number, so no corpus is broadcast, and a cell is read once a round for all queries that need it.

Null, zero and non-finite vectors are in no cell and ask nothing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, ship
from .ranking import counted, top_k

#: Rows that centres are fitted on, rounds, and the greatest number of cells.
SAMPLE, ROUNDS, MOST_CELLS = 65_536, 3, 4_096
#: Vectors of a cell that a task has at once, about, and numbers of a product of them with queries.
PIECE, PRODUCT = 16_384, 4_000_000
#: Room for the rounding of scores to nine places and of distances, in distance.
MARGIN = 1e-4


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors of length one."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = df.where(good).select(F.col(key).alias("key"), v.alias("w"), F.sqrt(_dot(v, v)).alias("n")).where("n > 0")
    return held.select("key", F.transform("w", lambda x: x / F.col("n")).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ centres.T + (np.einsum("ij,ij->i", centres, centres) - 1)[None, :], 0))


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with the nearest centre's number and distance."""
    import pyarrow as pa

    kind = vectors.schema["key"].dataType.simpleString()

    def batches(it):
        for b in it:
            d = _distances(_matrix(b.column("v")), centres) if b.num_rows else np.zeros((0, len(centres)))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["key", "v", "cell", "far"])

    return vectors.transform(map_arrow, batches, f"key {kind}, v array<double>, cell int, far double")


def fit(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres: the sample's means after some rounds. The first centres are sample rows; each round is an aggregate."""
    sample = vectors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    centres = np.array([r["v"] for r in sample.orderBy(F.xxhash64("key"), "key").limit(cells).select("v").collect()])
    for _ in range(ROUNDS if len(centres) else 0):
        sums = _assigned(sample, centres).select("cell", F.posexplode("v").alias("at", "x")).groupBy("cell", "at").agg(F.avg("x").alias("x"))
        rows = sums.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect()  # a row a cell
        for r in rows:
            centres[r["cell"]] = [x["x"] for x in r["v"]]
    return centres


class CellIndex:
    """Vectors at a path, by cell; centres and radii of all cells that have members."""

    def __init__(self, corpus: DataFrame, key: str, vector: str, path: str, cells: int | None = None) -> None:
        vectors = units(corpus, key, vector)
        if not cells:
            cells = min(MOST_CELLS, max(1, math.isqrt(vectors.count())))
        centres = fit(vectors, cells)
        if not len(centres):
            centres = np.zeros((1, 1))
        _assigned(vectors, centres).repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(path)
        self.table = corpus.sparkSession.read.parquet(path)
        radii = {r["cell"]: (r["far"], r["n"]) for r in self.table.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
        self.numbers = np.array(sorted(radii), np.int32)
        self.centres, self.radii = centres[self.numbers], np.array([radii[i][0] for i in self.numbers.tolist()])
        self.sizes = np.array([radii[i][1] for i in self.numbers.tolist()])

    def _ordered(self, queries: DataFrame) -> DataFrame:
        """(query, v, cells, bounds) of (key, v): all cells by the least distance that a member can have."""
        import pyarrow as pa

        kind, numbers, centres, radii = queries.schema["key"].dataType.simpleString(), self.numbers, self.centres, self.radii

        def batches(it):
            for b in it:
                if not b.num_rows:
                    continue
                bound = np.maximum(_distances(_matrix(b.column("v")), centres) - radii, 0)
                order = np.argsort(bound, axis=1, kind="stable")
                offsets = pa.array(np.arange(len(bound) + 1) * len(numbers), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (numbers[order], np.take_along_axis(bound, order, 1))]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), *lists], ["query", "qv", "cells", "bounds"])

        return queries.transform(map_arrow, batches, f"query {kind}, qv array<double>, cells array<int>, bounds array<double>")

    def _nearest(self, visits: DataFrame, k: int, others: bool) -> DataFrame:
        """(query, key, score) of (query, qv, cell): of every piece of a cell the k nearest, ties by key. A piece is about PIECE vectors and meets all
        queries that visit its cell in one product of matrices, made in blocks."""
        pieces = {int(c): int(-(-n // PIECE)) for c, n in zip(self.numbers, self.sizes) if n > PIECE}  # at most MOST_CELLS numbers
        split = F.create_map(*[F.lit(x) for p in pieces.items() for x in p]) if pieces else None
        many = F.coalesce(split[F.col("cell")], F.lit(1)) if pieces else F.lit(1)
        members = self.table.select("key", "v", "cell", F.pmod(F.xxhash64("key"), many).cast("int").alias("piece"))
        asked = visits.select("query", "qv", "cell", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))).alias("piece"))
        kinds = {"query": visits.schema["query"].dataType.simpleString(), "key": self.table.schema["key"].dataType.simpleString()}

        def best(cell, queries):
            import pyarrow as pa
            import pyarrow.compute as pc

            out = pa.table([queries["query"].slice(0, 0), cell["key"].slice(0, 0), pa.array([], pa.float64())], names=["query", "key", "score"])
            if not len(cell) or not len(queries):
                return out
            cell = cell.take(pc.sort_indices(cell, [("key", "ascending")]))
            x, keys = _matrix(cell["v"].combine_chunks()), cell["key"].combine_chunks()
            parts = [out]
            for a in range(0, len(queries), max(1, PRODUCT // len(x))):
                block = queries.slice(a, max(1, PRODUCT // len(x)))
                scores = np.round(_matrix(block["qv"].combine_chunks()) @ x.T, 9)
                # a row more, as a query may meet itself; whatever equals the last of them stays
                least = -np.partition(-scores, k, axis=1)[:, k] if len(x) > k + 1 else np.full(len(scores), -np.inf)
                q, at = np.nonzero(scores >= least[:, None])
                found = pa.table([block["query"].combine_chunks().take(pa.array(q)), keys.take(pa.array(at)), pa.array(scores[q, at])], names=["query", "key", "score"])
                if others:
                    same = pc.equal(found["query"], found["key"]).combine_chunks() if found["query"].type == found["key"].type else pc.equal(found["query"].cast(pa.string()), found["key"].cast(pa.string())).combine_chunks()
                    met = ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
                    q, at, found = q[met], at[met], found.filter(pa.array(met))
                order = np.lexsort((at, -scores[q, at], q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                parts.append(found.take(pa.array(order[place < k])))
            return pa.concat_tables(parts)

        ship(visits.sparkSession)
        grouped = members.groupBy("cell", "piece").cogroup(asked.groupBy("cell", "piece"))
        return grouped.applyInArrow(best, f"query {kinds['query']}, key {kinds['key']}, score double")

    def search(self, queries: DataFrame, qkey: str, vector: str, k: int, scratch, others: bool = True, first: int = 2) -> DataFrame:
        """(query, key, score, rank, cells_read): the k nearest by cosine, rounded to nine places, ties by key. scratch: a function of a name to a
        path of the shared folder, where each round's best are kept."""
        spark = queries.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = scratch(name)
            df.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        if not len(self.numbers):
            return self.table.select(F.col("key").alias("query"), "key", F.lit(0.0).alias("score"), F.lit(1).alias("rank"), F.lit(0).alias("cells_read"))
        todo = kept(self._ordered(units(queries, qkey, vector)).withColumn("seen", F.lit(0)), "cells-0")
        best, done, width, turn = None, [], first, 0
        while todo.limit(1).count():
            turn += 1
            visits = todo.select("query", "qv", F.explode(F.slice("cells", F.col("seen") + 1, F.lit(width))).alias("cell"))
            scored = self._nearest(visits, k, others)
            earlier = scored if best is None else scored.unionByName(best.select("query", "key", "score"))
            best = kept(top_k(earlier, ["query"], k, F.desc("score"), F.asc("key")), f"best-{turn}")
            kth = best.groupBy(F.col("query").alias("__q")).agg(F.count("*").alias("n"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).alias("reach"))
            todo = todo.withColumn("seen", F.least(F.col("seen") + width, F.size("cells"))).join(counted(kth), F.col("query") == F.col("__q"), "left")
            more = (F.col("seen") < F.size("cells")) & (F.coalesce(F.col("n") < k, F.lit(True)) | (F.element_at("bounds", F.least(F.col("seen") + 1, F.size("bounds"))) <= F.col("reach") + MARGIN))
            now = kept(todo.withColumn("more", more).drop("__q", "n", "reach"), f"cells-{turn}")
            done.append(now.where("NOT more").select("query", F.col("seen").alias("cells_read")))
            # those that are done keep their best, those that aren't go on with theirs
            finished = best.join(now.where("NOT more").select("query"), "query", "left_semi")
            done[-1] = finished.join(counted(done[-1]), "query")
            todo = now.where("more").drop("more")
            best = best.join(counted(todo.select("query")), "query", "left_semi")
            width *= 2
        if not done:
            return todo.select("query", F.col("query").alias("key"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"), F.col("seen").alias("cells_read"))
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out.select("query", "key", "score", "rank", "cells_read")
