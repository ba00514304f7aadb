"""Ranked lexical search over postings in blocks with their greatest impact: exact, reading only blocks that can matter.

Documents are numbered in an order that puts like ones together (columns of the caller's, then their length, on which impacts depend most), and every `block`
consecutive numbers are a range. A row of the stored index is one term in one range: its postings, at most `block` of them, and the greatest share
that one of them can add to a score. For a query the greatest shares of its terms add up to a bound of a range, which no document there exceeds. Bounds are read
without postings (a column of its own); then the ranges with the highest bounds are scored, and what is left is read only where its bound reaches
the k-th score so far. A document lies in one range, so its score is whole as soon as that is read, and the result equals scoring everything.

Collected are two numbers of the corpus and where stretches of ranges begin; broadcast are asked terms and visits, a row a range, while they are counted to be few. Else blocks and visits
are joined by term and range, whose rows are spread however frequent a term is.
Keys are distinct; rows without a key aren't indexed, texts that are null or without terms count as documents (null ones not in the mean length) and are never found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from .ranking import counted, top_k, with_row_number
from .search import K1, B, _counted, terms

#: Documents of a range, and how many ranges a query reads before it knows a k-th score, and before it goes on to all others that reach it.
BLOCK, TURNS = 64, (2, 16)
#: Ranges of a stretch, at least, and stretches, at most.
STRETCH, STARTS = 16, 65_536
#: Visits of queries to ranges that may be broadcast, as a list a range.
VISITS = 1 << 24
#: Room for the rounding of scores to nine places and for sums in another order.
MARGIN = 1e-6


def share(tf, dl, avgdl):
    """What a posting adds to a score, by the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def write_blocks(corpus: DataFrame, key: str, text: str, path: str, order: list[str] | None = None, block: int = BLOCK) -> None:
    """The index of a corpus as tables at `path`: documents with their ranges, the corpus's totals, blocks, and documents by term. Lengths are ordered first; what
    a stretch of ranges begins with then says where a document goes, so that its counts are shuffled once and a stretch's blocks are made in one place."""
    spark, order = corpus.sparkSession, order or []
    near = [f"__o{i}" for i in range(len(order))]
    held = corpus.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(order, near)])
    sized = held.select("key", *near, F.size(terms(F.col("text"))).alias("dl"))
    with_row_number(sized, [], [*near, "dl", "key"], "at", f"{path}/sizes").select("key", *near, "dl", F.col("at") - 1, F.floor((F.col("at") - 1) / block).cast("long").alias("range")).toDF("key", *near, "dl", "at", "range").write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/totals")
    n, avgdl = spark.read.parquet(f"{path}/totals").first()
    stretch = block * max(STRETCH, -(-n // (block * STARTS)))
    starts = sorted(_place(r) for r in documents.where((F.col("at") > 0) & (F.col("at") % stretch == 0)).select(*near, "dl", "key").collect())  # at most STARTS
    kind = sized.schema["key"].dataType.simpleString()
    kinds = "".join(f"{c} {sized.schema[c].dataType.simpleString()}, " for c in near)
    tokens = held.select(*near, "key", terms(F.col("text")).alias("t")).select(*near, F.size("t").alias("dl"), "key", "t")
    counts = tokens.transform(map_arrow, _frequencies(starts), f"stretch int, {kinds}dl int, key {kind}, terms array<string>, tfs array<int>")
    made = counts.repartition(len(starts) + 1, "stretch").groupBy("stretch").applyInArrow(_made(stretch, block, len(near), avgdl), f"term string, range long, top double, postings array<struct<key: {kind}, tf: int, dl: int>>")
    made.write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(made.schema).parquet(f"{path}/blocks")  # an index without postings has no file that says so
    blocks.groupBy("term").agg(F.sum(F.size("postings")).alias("df")).write.parquet(f"{path}/terms")


def _place(row) -> tuple:
    """A document's place in the order, as Spark sorts it: nulls first."""
    return tuple((x is not None, x) for x in row)


def _frequencies(starts: list[tuple]):
    """Documents (order, dl, key, t) with the number of their stretch, their terms and how often they have them."""

    def batches(it):
        from bisect import bisect_right

        import pyarrow as pa

        for b in it:
            flat = b.column("t").flatten().dictionary_encode()
            rows, ids, tf = _counted(b.column("t"), flat.indices.to_numpy(zero_copy_only=False), len(flat.dictionary))
            ends = pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (flat.dictionary.take(pa.array(ids)), pa.array(tf, pa.int32()))]
            own = b.columns[:-1]
            at = [bisect_right(starts, _place(r)) for r in zip(*(c.to_pylist() for c in own))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *own, *lists], ["stretch", *b.schema.names[:-1], "terms", "tfs"])

    return batches


def _made(stretch: int, block: int, near: int, avgdl: float | None):
    """A stretch's blocks of its documents (stretch, order, dl, key, terms, tfs)."""

    def make(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        columns = [table.column(i).to_pylist() for i in range(1, near + 3)]
        order = sorted(range(table.num_rows), key=lambda i: _place(c[i] for c in columns))
        table = table.take(pa.array(order)).combine_chunks()
        names = ["dl", "key", "terms", "tfs"]
        dl, key, words, tfs = (c.combine_chunks() if hasattr(c, "combine_chunks") else c for c in (table[x] for x in names))
        rows = np.repeat(np.arange(table.num_rows), pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False))
        flat = words.flatten().dictionary_encode()
        ids, tf, lengths = flat.indices.to_numpy(), tfs.flatten().to_numpy(), pc.fill_null(dl, 0).to_numpy()
        local = rows // block
        codes = ids.astype(np.int64) * (stretch // block + 1) + local
        by = np.argsort(codes, kind="stable")
        rows, tf, codes = rows[by], tf[by], codes[by]
        begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(share(tf, lengths[rows], avgdl), begins) if len(codes) else np.zeros(0)
        postings = pa.StructArray.from_arrays([key.take(pa.array(rows)), pa.array(tf, pa.int32()), pa.array(lengths[rows], pa.int32())], ["key", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(codes)], pa.int32()), postings)
        at = codes[begins] % (stretch // block + 1) + (table["stretch"][0].as_py() if table.num_rows else 0) * (stretch // block)
        return pa.table([flat.dictionary.take(pa.array(codes[begins] // (stretch // block + 1))), pa.array(at, pa.int64()), pa.array(tops), lists], ["term", "range", "top", "postings"])

    return make


class BlockIndex:
    """An index that write_blocks wrote."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        kind = spark.read.parquet(f"{path}/documents").schema["key"].dataType.simpleString()
        held = f"term string, range long, top double, postings array<struct<key: {kind}, tf: int, dl: int>>"
        self.blocks = spark.read.schema(held).parquet(f"{path}/blocks")  # an index without postings has no file that says so
        self.terms = spark.read.schema("term string, df long").parquet(f"{path}/terms")
        self.totals = spark.read.parquet(f"{path}/totals")

    def search(self, queries: DataFrame, qkey: str, qtext: str, k: int, scratch, turns: tuple[int, ...] = TURNS) -> DataFrame:
        """(query, key, score, rank, blocks, blocks_read): the k best documents as search.bm25 gives them, how many blocks the query's terms have, and how
        many of these were read. scratch: a function of a name to a path of the shared folder, where bounds and each turn's best are kept."""
        spark = queries.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            path = scratch(name)
            df.write.parquet(path)
            return spark.read.parquet(path)

        totals = F.broadcast(self.totals)  # one row
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        words = queries.select(F.col(qkey).alias("query"), F.explode(F.array_distinct(terms(F.col(qtext)))).alias("term")).distinct()
        asked = kept(self.terms.join(counted(words), "term").crossJoin(totals).select("query", "term", idf.alias("idf"), "avgdl"), "asked")
        weights = counted(asked)
        heads = self.blocks.select("term", "range", "top").join(weights, "term")
        todo = kept(heads.groupBy("query", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.count("*").alias("terms")), "bounds")
        counts = todo.groupBy("query").agg(F.sum("terms").alias("blocks"))

        def scored(visits: DataFrame) -> DataFrame:
            blocks = self.blocks.select("term", "range", "postings")
            if visits.count() <= VISITS:  # blocks stay where they are, and a document's shares are added up there
                asking = visits.groupBy("range").agg(F.collect_list("query").alias("queries"))
                met = blocks.join(F.broadcast(asking), "range").join(weights, "term").where(F.array_contains("queries", F.col("query")))
            else:  # blocks move once, beside what asks for them
                met = visits.select("query", "range").join(weights, "query").join(blocks.hint("merge"), ["term", "range"])
            each = met.select("query", "idf", "avgdl", F.explode("postings").alias("p"))
            part = F.col("idf") * share(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"))
            return each.groupBy("query", F.col("p.key").alias("key")).agg(F.round(F.sum(part), 9).alias("score"))

        best, read = None, None
        for turn, width in enumerate((*turns, None)):
            if width is None:
                visits = todo
            else:
                visits = top_k(todo, ["query"], width, F.desc("bound"), F.asc("range"), rank="place").drop("place")
            visits = kept(visits, f"visits-{turn}")
            found = scored(visits)
            whole = found if best is None else found.unionByName(best.select("query", "key", "score"))
            best = kept(top_k(whole, ["query"], k, F.desc("score"), F.asc("key")), f"best-{turn}")
            seen = visits.select("query", F.col("terms").alias("blocks_read"))
            read = seen if read is None else read.unionByName(seen)
            if width is not None:
                reach = best.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
                left = todo.join(visits.select("query", "range"), ["query", "range"], "left_anti").join(reach, "query", "left")
                todo = kept(left.where((F.coalesce(F.col("found"), F.lit(0)) < k) | (F.col("bound") >= F.col("kth") - MARGIN)).drop("found", "kth"), f"left-{turn}")
        used = counts.join(read.groupBy("query").agg(F.sum("blocks_read").alias("blocks_read")), "query")
        return best.join(used, "query").select("query", "key", "score", "rank", "blocks", "blocks_read")
