"""Ranks, windows, first and last rows, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 50_000
#: Rows of a few numbers that a task sorts.
TASK_ROWS = 1 << 20


def counted(df: DataFrame) -> DataFrame:
    """df as one side of a join: broadcast if it has at most BROADCAST_ROWS rows, else merged, so that the planner doesn't broadcast the
    other side, whose rows it may underestimate (an explode's factor is unknown to it)."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(BROADCAST_ROWS + 1).collect()) <= BROADCAST_ROWS else df.hint("merge")


def tasks_for(df: DataFrame, each: int = 1) -> int:
    """So many tasks that one gets about TASK_ROWS rows of df, which must be cheap to count and whose rows become `each`, and at least the
    session's number: what a task sorts then doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * each // TASK_ROWS))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; `right` is broadcast if counted to be small."""
    renamed = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return left.join(counted(renamed), on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def cumulated(df: DataFrame, by: list[str], value: str, weight: Column | None = None, parts: int = 64) -> DataFrame:
    """(by, value, n, before, total): a group's distinct values, each with its weight (rows, by default), that of all lower ones and that
    of all. Values are counted first; a group's values are dealt into ordered parts at approximate quantiles, so that a running sum is
    the earlier parts' (at most `parts` sums a group) and the part's own: no group is in one task, and sums are exact whatever the quantiles."""
    keys = [*by, "__one"]
    base = df.where(F.col(value).isNotNull()).withColumn("__one", F.lit(0))
    distinct = base.groupBy(*keys, value).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("__q"))
    placed = join_same(distinct, cuts, keys).withColumn("__part", F.size(F.filter("__q", lambda q: q < F.col(value)))).drop("__q")
    w = Window.partitionBy(*keys)
    sums = placed.groupBy(*keys, "__part").agg(F.sum("n").alias("__s"))
    earlier = w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(earlier), F.lit(0))).withColumn("total", F.sum("__s").over(w)).drop("__s")
    within = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = join_same(placed, sums, [*keys, "__part"])
    return out.withColumn("before", F.col("__before") + F.coalesce(F.sum("n").over(within), F.lit(0))).select(*by, value, "n", "before", "total")


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], name: str = "q") -> DataFrame:
    """(by, name): exact quantiles of a value, interpolated between neighbours, in the order of `probs`. A value knows from its running
    count which of them it is next to, so that only these few rows of a group meet."""
    rows = cumulated(df, by, value)
    at = F.array(*[F.lit(float(p)) for p in probs])
    here = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    place = lambda p: p * (F.col("total") - 1)
    sides = F.transform(at, lambda p, i: F.struct(i.alias("i"), here(F.floor(place(p))).alias("low"), here(F.ceil(place(p))).alias("high"), (place(p) - F.floor(place(p))).alias("part")))
    hits = rows.select(*by, F.col(value).cast("double").alias("__v"), F.explode(F.filter(sides, lambda s: s["low"] | s["high"])).alias("s"))
    side = lambda which: F.max(F.when(F.col(f"s.{which}"), F.col("__v")))
    each = hits.groupBy(*by, F.col("s.i").alias("i")).agg((side("low") + (side("high") - side("low")) * F.max("s.part")).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))


def average_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank with ties at their mean."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def percent_rank_average(value: str, by: list[str]) -> Column:
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(*by)) * 100


def leave_one_out(value: str, by: list[str]) -> Column:
    """Mean of the others; null if there are none."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    return F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))


def with_demeaned(df: DataFrame, values: list[str], *sides: list[str]) -> DataFrame:
    """df with each value less the mean of each side, plus the grand mean once for each side beyond the first. Means are
    combined before they are shuffled and come back by plain joins; the grand ones are one row."""
    out = df
    for i, side in enumerate(sides):
        means = df.groupBy(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(side)]).agg(*[F.avg(v).alias(f"__m{i}_{v}") for v in values])
        on = F.lit(True)
        for j, k in enumerate(side):
            on = on & out[k].eqNullSafe(means[f"__k{j}"])
        out = out.join(means, on).drop(*[f"__k{j}" for j in range(len(side))])
    out = out.crossJoin(F.broadcast(df.agg(*[F.avg(v).alias(f"__g_{v}") for v in values])))
    less = lambda v: F.col(v) - sum((F.col(f"__m{i}_{v}") for i in range(len(sides))), F.lit(0.0)) + (len(sides) - 1) * F.col(f"__g_{v}")
    return out.select(*[less(c).alias(c) if c in values else c for c in df.columns])


def with_row_number(df: DataFrame, by: list[str], order: list[str], name: str, path: str) -> DataFrame:
    """df with each row's place (from 1) within its group, in an order that leaves no ties. Rows are dealt into ordered
    ranges, written at `path` with their range's number, and counted; a place is the rows of the group's earlier ranges
    and the place within the range. Only a range's first group has earlier ranges, so what is broadcast is at most a row a range."""
    dealt = df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    counts = kept.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(by)], F.col("__range").alias("__r"), F.sum("__n").over(earlier).alias("__before")).where("__before > 0")
    on = F.col("__range") == F.col("__r")
    for j, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    return kept.join(F.broadcast(before), on, "left").withColumn(name, (F.coalesce(F.col("__before"), F.lit(0)) + within).cast("long")).select(*df.columns, name)


def rolling_mean(value: str, by: list[str], order: list[str], width: int = 15, least: int = 5) -> Column:
    """Centred mean over width rows; null where fewer than least are there."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must leave no ties."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their places. Spark cuts each task to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def pareto(df: DataFrame, cost: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Rows that beat every cheaper row."""
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(cost), F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(score).over(earlier)
    return df.withColumn("__b", best).where(F.col("__b").isNull() | (F.col(score) > F.col("__b"))).drop("__b")


def marks(value: str, digits: int, by: list[str]) -> Column:
    """Place among distinct rounded values, the best first; ties share it."""
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(F.bround(value, digits).desc()))


def hash_order(seed: int, *cols: str) -> Column:
    """A repeatable shuffle: sort by this."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


#: Rows of a chunk in budget_batches, and chunks of a group of them.
CHUNK, FAN = 4096, 256


def _breaks(sizes, budget: float, rows: int):
    """Where the batch that begins at each place ends."""
    import numpy as np

    sums = np.concatenate([np.zeros(1, sizes.dtype), np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return np.maximum(at + 1, np.minimum(at + rows, np.searchsorted(sums, sums[:-1] + budget, "right") - 1))


def _starts(maps: DataFrame, fan: int, scratch) -> DataFrame:
    """(k, c, entry, batch): the first place of each chunk where a batch begins, and that batch's number. maps: (k, c, exits, counts), for
    each place where one may enter a chunk, where one enters the next and how many batches begin between. Maps compose, so groups of chunks have
    maps as well; these are solved first, in the same way, and then looked into: a group holds at most `fan` maps."""
    import numpy as np
    import pandas as pd

    grouped = maps.groupBy("k", F.floor(F.col("c") / fan).cast("long").alias("g")).agg(F.array_sort(F.collect_list(F.struct("c", "exits", "counts"))).alias("m"))
    grouped.write.parquet(path := scratch("maps"))
    kind, grouped = maps.schema["k"].dataType.simpleString(), maps.sparkSession.read.parquet(path)

    def composed(frames):
        for f in frames:
            exits, counts = [], []
            for m in f["m"]:
                e, n = np.arange(len(m[0]["exits"])), 0
                for x in m:
                    e, n = np.asarray(x["exits"])[e], n + np.asarray(x["counts"])[e]
                exits.append(e)
                counts.append(n)
            yield pd.DataFrame({"k": f["k"], "c": f["g"], "exits": exits, "counts": counts})

    def replayed(frames):
        for f in frames:
            out = []
            for k, m, e, n in zip(f["k"], f["m"], f["entry"], f["batch"]):
                for x in m:
                    out.append((k, x["c"], e, n))
                    e, n = x["exits"][e], n + x["counts"][e]
            yield pd.DataFrame(out, columns=["k", "c", "entry", "batch"])

    if grouped.where("g > 0").limit(1).count():
        first = _starts(grouped.mapInPandas(composed, f"k {kind}, c long, exits array<int>, counts array<long>"), fan, scratch).withColumnRenamed("c", "g")
        known = join_same(grouped, first, ["k", "g"])
    else:
        known = grouped.withColumns({"entry": F.lit(0), "batch": F.lit(0).cast("long")})
    return known.select("k", "m", "entry", "batch").mapInPandas(replayed, f"k {kind}, c long, entry int, batch long")


def budget_batches(df: DataFrame, by: str, order: str, size: str, budget: int, rows: int, scratch, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(by, order, batch): consecutive rows of a key in batches of at most `budget` in all and `rows` rows; a row beyond the budget is a batch of its own.
    Orders are distinct within a key; sizes aren't negative, null ones are 0.

    A key is cut into chunks of `chunk` rows (at least `rows`), so a hot one is worked on in as many tasks. A batch enters the next chunk at one of its first `rows` places, so
    a chunk is a map of entries, made without knowing where it is entered; the maps give every chunk's entry, from which its batches are numbered.
    scratch: a function of a name to a path of the shared folder."""
    import numpy as np
    import pandas as pd

    from ..session import ship

    spark, chunk = df.sparkSession, max(chunk, rows)
    ship(spark)
    named = df.select(F.col(by).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).alias("s"))
    placed = with_row_number(named, ["k"], ["o", "s"], "at", scratch("places")).withColumns({"c": F.floor((F.col("at") - 1) / chunk).cast("long"), "p": ((F.col("at") - 1) % chunk).cast("int")})
    # a chunk also sees the rows of the next one that its last batch may hold
    twice = F.when((F.col("p") < rows) & (F.col("c") > 0), F.array(F.struct("c", "p"), F.struct((F.col("c") - 1).alias("c"), (F.col("p") + chunk).alias("p")))).otherwise(F.array(F.struct("c", "p")))
    dealt = placed.select("k", "o", "s", F.explode(twice).alias("x")).groupBy("k", "x.c").agg(F.array_sort(F.collect_list(F.struct("x.p", "o", "s"))).alias("r"))
    dealt.select("k", "c", F.col("r.o").alias("o"), F.col("r.s").alias("s")).write.parquet(path := scratch("chunks"))
    chunks = spark.read.parquet(path)
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("k", "o")}

    def maps(frames):
        for f in frames:
            exits, counts = [], []
            for s in f["s"]:
                to, held = _breaks(np.asarray(s), budget, rows), min(len(s), chunk)
                e, n = np.zeros(max(held, rows) + 1, np.int32), np.zeros(max(held, rows) + 1, np.int64)
                for i in range(held - 1, -1, -1):
                    inside = to[i] < held
                    e[i], n[i] = (e[to[i]], n[to[i]] + 1) if inside else (max(to[i] - chunk, 0), 1)
                exits.append(e[:rows])
                counts.append(n[:rows])
            yield pd.DataFrame({"k": f["k"], "c": f["c"], "exits": exits, "counts": counts})

    def numbered(frames):
        for f in frames:
            out = []
            for s, e, n in zip(f["s"], f["entry"], f["batch"]):
                to, held = _breaks(np.asarray(s), budget, rows), min(len(s), chunk)
                begins, i = np.zeros(held, np.int64), e
                while i < held:
                    begins[i] = 1
                    i = to[i]
                out.append(n - 1 + np.cumsum(begins))
            yield pd.DataFrame({"k": f["k"], "o": [x[:chunk] for x in f["o"]], "batch": out})

    starts = _starts(chunks.select("k", "c", "s").mapInPandas(maps, f"k {kinds['k']}, c long, exits array<int>, counts array<long>"), fan, scratch)
    solved = join_same(chunks, starts, ["k", "c"]).select("k", "o", "s", "entry", "batch").mapInPandas(numbered, f"k {kinds['k']}, o {kinds['o']}, batch array<long>")
    return solved.select("k", F.explode(F.arrays_zip("o", "batch")).alias("x")).select(F.col("k").alias(by), F.col("x.o").alias(order), F.col("x.batch").alias("batch"))


def with_average_rank(df: DataFrame, value: str, by: list[str], name: str = "rank", descending: bool = False, total: str | None = None, parts: int = 64) -> DataFrame:
    """df with the average rank of a value (null for null) within few, large groups; total: a column for the
    number of values of the group.

    One window over a group would be one task. Here each group is cut at approximate quantiles into
    ordered parts; equal values share a part, so a rank is the number of values in earlier parts (a sum over at most
    `parts` + 1 counts a group) and the rank within the part. Exact, whatever the quantiles are. The quantiles and counts
    of a group are broadcast: groups are judges or pairs of them, or one whole table."""
    keys = by or ["__one"]
    base = df if by else df.withColumn("__one", F.lit(0))
    cuts = base.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("__q"))
    same = lambda a, b: [a[k].eqNullSafe(b[f"__k{i}"]) for i, k in enumerate(keys)]

    def keyed(d: DataFrame) -> DataFrame:
        for i, k in enumerate(keys):
            d = d.withColumnRenamed(k, f"__k{i}")
        return F.broadcast(d)

    def add(left: DataFrame, right: DataFrame, extra: list | None = None) -> DataFrame:
        on = same(left, right) + (extra or [])
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return left.join(right, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])

    part = F.when(F.col(value).isNotNull(), F.size(F.filter("__q", lambda q: q < F.col(value))))
    placed = add(base, keyed(cuts)).withColumn("__part", part).drop("__q")
    counts = placed.where(F.col(value).isNotNull()).groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    order = F.col("__part").desc() if descending else F.col("__part").asc()
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).withColumn("__all", F.sum("__n").over(w)).drop("__n").withColumnRenamed("__part", "__p")
    right = keyed(counts)
    joined = add(placed, right, [placed["__part"] == right["__p"]]).drop("__p")
    within = average_rank(value, [*keys, "__part"], descending)
    out = joined.withColumn(name, F.when(F.col(value).isNotNull(), F.col("__before") + within))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__part", "__before", "__all", *([] if by else ["__one"]))
