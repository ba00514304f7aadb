"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

Postings are rows (term, row, id, tf, n, impact), sorted by term and falling impact and dealt in ranges of both, so a list that
holds a third of all postings lies in many files. A document's score for a query is the sum over the query's terms of
repeats * weight * impact, all whole numbers, so a query's lists are the index's, scaled.

1. The first HEAD postings of every list give partial scores; the k-th best of a query is a lower bound.
2. All lists of a query are read down to one level of score: a document that stays below it everywhere can't reach the bound. (The level is the bound by the number
   of lists, or higher where lists end below it: their ends are added, and the others share what is left.) Partial scores give a better bound, and what a document may still get in lists where it wasn't seen an upper one;
   candidates are those whose upper bound reaches the lower.
3. The candidates' missing postings are looked up. The k best exact scores are the answer; no threshold drops one that is
   level with the k-th, so the result is that of scoring every document.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null texts have no terms, as empty
ones; queries without terms, or whose terms no document holds, give no rows. Every row of docs is a document by itself,
repeated ones too; a null id is last among equal scores. Every row of queries is a query by itself. Long texts are read whole. Other columns, whatever their names, are ignored. An
empty table of either kind gives an empty result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import map_arrow
from .common import BROADCAST_ROWS, cut, new_path

#: Postings at the head of each list that the first phase reads.
HEAD = 200
#: Bytes of asked terms up to which tasks drop other words at once; beyond, a join drops them.
ASKED_BYTES = 8 << 20

#: Letters and digits as they are, A-Z lower-cased, bytes of other characters as they are, all else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def term_counts(df: DataFrame, id_: str, text: str, asked: set[bytes] | None = None) -> DataFrame:
    """(row, id, term, tf, n): a row for each term (of those asked for), and one without term for each document that has any, by which
    documents are counted. n: the document's terms with repeats."""
    kind = df.schema[id_].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"), F.col(text).alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, names, tf, sizes = [], [], [], []
            for i, t in enumerate(b.column(2)):
                words = terms(t.as_py())
                if words:
                    found = Counter(words)
                    kept = list(found.items()) if asked is None else [(w, found[w]) for w in (found.keys() & asked)]
                    at += [i] * (len(kept) + 1)
                    names += [None, *(w for w, _ in kept)]
                    tf += [0, *(c for _, c in kept)]
                    sizes += [len(words)] * (len(kept) + 1)
                if len(at) > 1 << 17:
                    yield out(b, at, names, tf, sizes)
                    at, names, tf, sizes = [], [], [], []
            if at:
                yield out(b, at, names, tf, sizes)

    def out(b, at, names, tf, sizes) -> pa.RecordBatch:
        k = pa.array(at, pa.int64())
        term = pa.array(names, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), term, pa.array(tf, pa.int32()), pa.array(sizes, pa.int64())], ["row", "id", "term", "tf", "n"])

    return rows.transform(map_arrow, batches, f"row long, id {kind}, term string, tf int, n long")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * df + 1))).cast("long")


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What a unit of weight gets for tf occurrences among n terms."""
    length = F.lit(75) + _div(25 * n * F.lit(n_docs), F.lit(max(1, n_terms)))
    tf = tf.cast("long")
    return _div(F.lit(1_000_000_000) * tf, 1000 * tf + 12 * length)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


class Index:
    """Postings in the shared folder: `postings` (term, row, id, impact) by term and falling impact, `lists` (term, weight, most),
    the number of documents and of terms."""

    def __init__(self, docs: DataFrame, id_: str, text: str, asked: DataFrame | None = None, path: str | None = None) -> None:
        """asked: (term), distinct: other terms aren't indexed."""
        spark, held = docs.sparkSession, None
        if asked is not None:
            size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
            if size <= ASKED_BYTES:
                held = {r[0].encode() for r in asked.collect()}
        raw = new_path(spark, "term-counts")
        term_counts(docs, id_, text, held).write.parquet(raw)
        found = spark.read.parquet(raw)
        self.n_docs, self.n_terms = (x or 0 for x in found.where("term IS NULL").agg(F.count("*"), F.sum("n")).first())
        found = found.where("term IS NOT NULL")
        if asked is not None and held is None:
            found = found.join(asked, "term", "left_semi")
        scored = found.select("term", "row", "id", impact(F.col("tf"), F.col("n"), self.n_docs, self.n_terms).alias("impact"))
        self.path = path or new_path(spark, "postings")
        scored.repartitionByRange(F.col("term"), F.col("impact").desc(), F.col("row")).sortWithinPartitions(F.col("term"), F.col("impact").desc()).write.parquet(self.path)
        self.postings = spark.read.parquet(self.path)
        counted = self.postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
        self.lists = cut(counted.select("term", weight(self.n_docs, F.col("df")).alias("weight"), "most"))


def _hint(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows: the callers' rows are some numbers and a term."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(BROADCAST_ROWS + 1).collect()) <= BROADCAST_ROWS else df


def _kth(partial: DataFrame, k: int) -> DataFrame:
    """(q, bound): the k-th best partial score of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    return partial.select("q", "score", place.alias("place")).where(F.col("place") <= k).groupBy("q").agg(F.min("score").alias("bound"), F.count("*").alias("c")).where(F.col("c") >= k).select("q", "bound")


def search(index: Index, asked: DataFrame, k: int = 20) -> DataFrame:
    """(q, row, id, score, rank) of queries (q, term, repeats), each term once a query."""
    lists = asked.join(index.lists, "term").where("weight > 0").withColumn("factor", F.col("repeats") * F.col("weight"))
    lists = cut(lists.select("q", "term", "factor", "most"))
    # 1. heads
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    heads = index.postings.join(_hint(lists.select("term").distinct()), "term", "left_semi").withColumn("place", place).where(F.col("place") <= HEAD)
    seen = heads.join(_hint(lists), "term").groupBy("q", "row").agg(F.sum(F.col("factor") * F.col("impact")).alias("score"))
    bounds = cut(_kth(seen, k))
    # 2. all lists down to one level of score: where those that end below it count in full, the levels add up to the bound. `rest` is
    # the most that a posting below can give
    cap = F.col("factor") * F.col("most")
    by_cap = Window.partitionBy("q").orderBy("cap", "term")
    levels = lists.join(bounds, "q", "left").select("q", F.coalesce("bound", F.lit(0)).alias("bound"), "term", cap.alias("cap"))
    levels = levels.withColumns({
        "before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "place": F.row_number().over(by_cap), "m": F.count("*").over(Window.partitionBy("q")),
    })
    open_ = F.col("m") - F.col("place") + 1
    level = levels.where(F.col("bound") - F.col("before") <= F.col("cap") * open_).groupBy("q").agg(F.min_by(F.struct((F.col("bound") - F.col("before")).alias("part"), open_.alias("lists")), "place").alias("level"))
    by = F.col("factor") * F.col("level.lists")
    least = F.greatest(F.lit(1), _div(F.col("level.part") + by - 1, by))
    limits = lists.join(level, "q").withColumn("least", least)
    limits = cut(limits.select("q", "term", "factor", "least", (F.col("factor") * F.least(F.col("most"), F.col("least") - 1)).alias("rest"), (F.col("most") >= F.col("least")).alias("reached")))
    wanted = limits.where("reached")
    lowest = wanted.groupBy("term").agg(F.min("least").alias("lowest"))
    read = index.postings.join(_hint(lowest), "term").where("impact >= lowest").select("row", "id", "term", "impact")
    # postings meet by document before they meet the queries, so that what they give is added up where it is made
    met = read.repartition("row").join(_hint(wanted), "term").where("impact >= least")
    gain = F.col("factor") * F.col("impact")
    partial = met.groupBy("row", "q").agg(F.sum(gain).alias("score"), F.sum(gain - F.col("rest")).alias("more"), F.first("id").alias("id"))
    total = limits.groupBy("q").agg(F.sum("rest").alias("all_rest")).join(bounds, "q", "left")
    upper = F.col("more") + F.col("all_rest")
    possible = cut(partial.join(_hint(cut(total)), "q").where(F.col("bound").isNull() | (upper >= F.col("bound"))).select("q", "row", "id", "score", upper.alias("upper")))
    better = _kth(possible, k)
    candidates = possible.join(_hint(better), "q", "left").where(F.col("bound").isNull() | (F.col("upper") >= F.col("bound")))
    candidates = cut(candidates.select("q", "row", "id", "score"))
    # 3. what the candidates have below the limits
    side = _hint(candidates.select("q", "row"))
    low = index.postings.join(_hint(limits.select("term").distinct()), "term", "left_semi").select("term", "row", "impact").join(side, "row")
    missing = low.join(_hint(limits.select("q", "term", "factor", "least")), ["q", "term"]).where(F.col("impact") < F.col("least"))
    added = missing.groupBy("q", "row").agg(F.sum(F.col("factor") * F.col("impact")).alias("added"))
    exact = candidates.join(added, ["q", "row"], "left").select("q", "row", "id", (F.col("score") + F.coalesce("added", F.lit(0))).alias("score")).where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of queries with a score above 0."""
    items = cut(term_counts(queries, item_id, text).where("term IS NOT NULL").select(F.col("row").alias("q"), F.col("id").alias("item"), "term", F.col("tf").cast("long").alias("repeats")))
    index = Index(docs, doc_id, text, items.select("term").distinct())
    found = search(index, items.select("q", "term", "repeats"), k)
    named = found.join(_hint(items.select("q", "item").distinct()), "q")
    return named.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")


ORACLE = """
WITH upper AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, a, b), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents, upper),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, a, b), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark, upper),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, big_n),
qt AS (SELECT q, item_id, term, count(*)::BIGINT AS r FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT q, item_id, row, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
