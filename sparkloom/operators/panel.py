"""Judge panels: long and wide forms, seats, missing-value rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_panel(events: DataFrame, n_gens: int = 15) -> DataFrame:
    """(gen, case_id, judge, score) from raw events: one cell a generator, case and judge."""
    return events.groupBy((F.col("user_id") % n_gens).alias("gen"), F.dayofmonth("ts").alias("case_id"), F.col("event_type").alias("judge")).agg(F.avg("value").alias("score"))


def wide_panel(panel: DataFrame, judges: list[str], value: str = "score") -> DataFrame:
    """One column a judge; the list makes the pivot one pass."""
    return panel.groupBy("gen", "case_id").pivot("judge", judges).agg(F.first(value))


def essay_median(panel: DataFrame) -> DataFrame:
    """(gen, case_id, med, n_seats): median over the judges that scored, and how many did."""
    return panel.groupBy("gen", "case_id").agg(F.percentile("score", 0.5).alias("med"), F.count("score").alias("n_seats"))


def row_median(cols: list[Column]) -> Column:
    """Median of a row's values without its nulls; null if there are none."""
    a = F.array_sort(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    n = F.size(a)
    return F.when(n > 0, (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2)


def coalesce_seats(df: DataFrame, seats: dict[str, list[str]], guard: bool = True) -> DataFrame:
    """Columns that stand for one judge become one column. With guard, a row in which two of them
    are filled is an error when it is read."""
    out = df
    for name, cols in seats.items():
        filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
        value = F.coalesce(*[F.col(c) for c in cols])
        out = out.withColumn(name, F.when(filled > 1, F.raise_error(F.lit(f"more than one seat of {name} is filled"))).otherwise(value) if guard else value)
    return out.drop(*{c for cols in seats.values() for c in cols} - set(seats))


def seat_column(df: DataFrame, aliases: list[str]) -> str | None:
    """The first of the alias columns that has a value at all."""
    there = [c for c in aliases if c in df.columns]
    if not there:
        return None
    counts = df.agg(*[F.count(c).alias(c) for c in there]).first()
    return next((c for c in there if counts[c]), None)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def ensemble_min(score: Column) -> Column:
    """Least score with missing ones as 1; null if all are missing."""
    return F.when(F.count(score) > 0, F.min(F.coalesce(score, F.lit(1.0))))


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def validated(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose value is among names; a name that no row has is an error."""
    there = {r[0] for r in df.select(column).where(F.col(column).isin(names)).distinct().limit(len(names)).collect()}
    if missing := sorted(set(names) - there):
        raise KeyError(f"unknown names: {missing}")
    return df.where(F.col(column).isin(names))


def ragged(panel: DataFrame) -> DataFrame:
    """Generators by judge whose number of cases isn't that of the fullest pair."""
    n = panel.groupBy("gen", "judge").agg(F.countDistinct("case_id").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).where("n < most")


def incomplete(panel: DataFrame, judges: list[str]) -> DataFrame:
    """Rows of the wide panel that lack a judge."""
    wide = wide_panel(panel, judges)
    return wide.where(reduce(lambda a, b: a | b, [F.col(j).isNull() for j in judges]))


def worklist(cells: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return cells.join(done.select(*keys).distinct(), keys, "left_anti")
