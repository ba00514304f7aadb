"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are summed; the targets follow by filling all sources in proportion to
their weights, none beyond `max_repeat` times its size; target / size is the rate at which a
source repeats. A document is taken floor(rate) times, and once more if a number drawn from a hash of its id
is among the source's lowest, so many as hold the rate's fraction of its words: a draw with that probability, but not an
independent one, so that a source's words come within one document of its target.

Null text counts as no words and is taken with its source's rate; a null source is a source of its
own, last in order; a document without id draws by its text. Repeated rows draw alike. An empty
table gives an empty result. Other columns pass through untouched, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, hex_long, lookup_join, numbered

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: int, key: str = "doc_id", text: str = "text") -> Column:
    return hex_long(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, rate) of (source, size).

    Weights go round over the sources in code-point order. Sources are filled in the order in which
    they reach their bound: a source is full if its bound is no more than its share of what
    the sources before it left. The windows run over one row a source, after the sum."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("bound", F.col("source_size") * max_repeat)
    every = Window.partitionBy(F.lit(0))
    by_bound = every.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    per = per.withColumn("full", F.col("bound") * weight_left <= F.col("weight") * left)
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0)).over(every)
    share = F.col("weight") * (rest / F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("full"), F.col("bound").cast("double")).otherwise(share)
    return per.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


#: A draw's bits, and those of them by which draws are summed first.
BITS, COARSE = 32, 16


def with_cutoffs(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with a cutoff a source: draws up to it give one more copy.

    The copies' words up to a draw are a sum in order of the draws, and the cutoff is where this sum is nearest to the fraction's
    share of the source. The draws are in no order of size, so about the fraction of the documents lies below, and no document's
    copy is more likely than another's; but the words come near the target whatever the documents' sizes are. Draws are summed by their first COARSE bits,
    and then one by one in the cell that the share falls into, so no source is ever in one task.

    sizes: (source, draw, size); targets: (source, source_size, target, rate), a row a source."""
    goal = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    wanted = cut(targets.select("source", goal.alias("goal")))

    def first_to_reach(sums: DataFrame, before: Column, place: str) -> DataFrame:
        """(source, place, upto, below): where the sum in order of the place first reaches the goal."""
        upto = before + F.sum("words").over(Window.partitionBy("source").orderBy(place))
        reached = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("goal"))
        return reached.groupBy("source").agg(F.min_by(F.struct(F.col(place), "upto", (F.col("upto") - F.col("words")).alias("below")), place).alias("x")).select("source", "x.*")

    cell = F.shiftright("draw", BITS - COARSE)
    coarse = lookup_join(sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words")), wanted, "source")
    at = cut(first_to_reach(coarse, F.lit(0), "cell").select("source", F.col("cell").alias("__cell"), F.col("below").alias("__below")))
    inside = lookup_join(sizes, at, "source").where(cell == F.col("__cell"))
    fine = lookup_join(inside.groupBy("source", "draw", "__below").agg(F.sum("size").alias("words")), wanted, "source")
    found = first_to_reach(fine, F.col("__below"), "draw")
    near = lookup_join(found, wanted, "source")
    nearer = (F.col("upto") - F.col("goal")) < (F.col("goal") - F.col("below"))
    cutoffs = cut(near.select("source", (F.col("draw") - F.when(nearer, 0).otherwise(1)).alias("cutoff")))
    return lookup_join(targets, cutoffs, "source", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-1)))


def copies(rate: Column, draw: Column, cutoff: Column) -> Column:
    """floor(rate), and one more up to the cutoff."""
    return (F.floor(rate) + F.when(draw <= cutoff, 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, rate, n_copies.
    The text is read once; the sizes are kept in the shared folder for the other uses."""
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _draw(seed).alias("draw")))
    targets = cut(source_targets(sizes, weights, max_repeat))
    plan = lookup_join(sizes, cut(with_cutoffs(sizes, targets)), "source")
    return plan.select("doc_id", "source", "size", "source_size", "target", "rate", copies(F.col("rate"), F.col("draw"), F.col("cutoff")).alias("n_copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of docs as often as it is taken, with the columns of docs. Texts aren't shuffled: what a
    document's source says decides, with the document's own draw."""
    sizes = cut(docs.select("source", n_words(F.col("text")).alias("size"), _draw(seed).alias("draw")))
    targets = cut(source_targets(sizes, weights, max_repeat))
    key, text, source = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "source"))
    rates = cut(with_cutoffs(sizes, targets).select(F.col("source").alias(source), "rate", "cutoff"))
    taken = lookup_join(numbered(docs), rates, source).withColumn("n", copies(F.col("rate"), _draw(seed, key, text), F.col("cutoff"))).where("n > 0")
    copied = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return copied.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS k FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * {MAX_REPEAT} AS bound FROM per),
ordered AS (SELECT *, sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY bound / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left FROM weighted),
flagged AS (SELECT *, bound * weight_left <= w * words_left AS is_full FROM ordered),
shared AS (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN is_full THEN bound ELSE 0 END) OVER ())::DOUBLE AS rest,
  (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE AS open_weight FROM flagged),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN bound::DOUBLE ELSE w * (rest / open_weight) END AS target FROM shared),
rated AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, ('0x' || substr(md5('{SEED}|' || k), 1, 8))::BIGINT AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
sums AS (SELECT source, draw, any_value((rate - floor(rate)) * source_size) AS goal, sum(size)::BIGINT AS words FROM rated GROUP BY source, draw),
upto AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto FROM sums),
reached AS (SELECT * FROM upto WHERE upto >= goal QUALIFY row_number() OVER (PARTITION BY source ORDER BY draw) = 1),
cutoffs AS (SELECT source, draw - CASE WHEN upto - goal < goal - (upto - words) THEN 0 ELSE 1 END AS cutoff FROM reached)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw <= coalesce(cutoff, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated r LEFT JOIN cutoffs c ON r.source IS NOT DISTINCT FROM c.source
"""
