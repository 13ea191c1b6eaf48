"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w, with u a hash of the document and w its quality weight. Within a source,
documents in ascending key order are a weighted sample without replacement at any length, so a prefix of that order whose
sizes sum to a budget is the sample of that budget. A target above the size of its source takes complete epochs first; what
remains is taken from the key order.

The order is never sorted as a whole: keys fall into 2**20 cells, prefix sums over cells (two levels, 1024 each) find the
one cell in which a source's budget ends, and only that cell's rows are sorted. A source that holds a third of all rows is
thus spread over all tasks.

Defined results: a null text has size 0; a null source is a source of its own and comes last; ties in the key are ordered by
the hash; identical rows (same id and text) move together; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import WORD, cut

FINE, COARSE = 20, 10


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(mx_source, mx_source_size) -> plus mx_target: share of all sizes dealt by weight, none above cap times its source.

    One row per source, so the unpartitioned windows hold as many rows as there are sources.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("mx_source").asc_nulls_last())) - 1)
    ranked = ranked.select("*", F.get(w, (F.col("_r") % len(weights)).cast("int")).alias("_w"), (F.col("mx_source_size") * cap).alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("mx_source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    levels = ranked.withColumn("_level", level)
    # sources in order of cap/weight: the capped ones come first, and the first that is not sets the level for all that follow
    free = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_r", "_level"))).over(every)
    return levels.select("mx_source", "mx_source_size", F.least(F.col("_cap"), F.coalesce(free["_level"] * F.col("_w"), F.col("_cap"))).alias("mx_target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """mx_row (a struct of docs' columns named in keep, all by default), mx_size, mx_source_size, mx_target, mx_epochs, mx_copies.

    mx_copies is how often the mix takes the row. quality: (mx_id, mx_quality), one row per id, a positive weight; ids that it
    lacks weigh 1.
    """
    rows = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("mx_row"),
        F.col(source_col).alias("mx_source"),
        word_count(text_col).alias("mx_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("mx_hash"),
        F.col(id_col).alias("mx_id"),
    )
    if quality is not None:
        rows = rows.join(quality, "mx_id", "left")
    else:
        rows = rows.withColumn("mx_quality", F.lit(1.0))
    u = (F.conv(F.substring("mx_hash", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("mx_key", -F.log(u) / F.coalesce("mx_quality", F.lit(1.0)))
    rows = rows.withColumn("mx_cell", F.floor((1.0 - F.exp(-F.col("mx_key"))) * float(1 << FINE)).cast("int"))
    plain = cut(rows.select("mx_source", "mx_size", "mx_key", "mx_hash", "mx_cell"))
    dealt = cut(targets(plain.groupBy("mx_source").agg(F.sum("mx_size").alias("mx_source_size")), weights, share, cap))
    dealt = dealt.withColumn("mx_epochs", F.when(F.col("mx_source_size") > 0, F.floor(F.col("mx_target") / F.col("mx_source_size"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("_rest", F.col("mx_target") - F.col("mx_epochs") * F.col("mx_source_size"))

    width = 1 << (FINE - COARSE)
    found = dealt.select("mx_source", "_rest", F.lit(0).alias("_lo"), F.lit(1 << FINE).alias("_hi"), F.lit(0).cast("long").alias("_before"))
    for step in (width, 1):
        found = _ends_in(_within(plain, found), step)
    by_key = Window.partitionBy("mx_source").orderBy("mx_key", "mx_hash")
    last = _within(plain, found).select("mx_source", "_rest", "mx_size", F.struct("mx_key", "mx_hash").alias("_at"), (F.col("_before") + F.sum("mx_size").over(by_key.rangeBetween(Window.unboundedPreceding, 0)) - F.col("mx_size")).alias("_sum"))
    last = last.where(F.col("_sum") + F.col("mx_size") / 2 < F.col("_rest")).groupBy("mx_source").agg(F.max("_at").alias("_last"))
    ends = dealt.join(found.select(F.col("mx_source").alias("_s"), F.col("_lo").alias("_cell")), F.col("mx_source").eqNullSafe(F.col("_s")), "left").drop("_s", "_rest")
    ends = cut(ends.join(last.withColumnRenamed("mx_source", "_s"), F.col("mx_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("mx_source", "_s"))
    out = rows.join(ends, F.col("mx_source").eqNullSafe(F.col("_s")), "left")
    chosen = (F.col("mx_cell") < F.col("_cell")) | ((F.col("mx_cell") == F.col("_cell")) & (F.struct("mx_key", "mx_hash") <= F.col("_last")))
    return out.select("mx_row", "mx_size", "mx_source_size", "mx_target", "mx_epochs", (F.col("mx_epochs") + F.coalesce(chosen & (F.col("mx_size") > 0), F.lit(False)).cast("int")).alias("mx_copies"))


def _within(plain: DataFrame, found: DataFrame) -> DataFrame:
    f = found.withColumnRenamed("mx_source", "_s")
    return plain.join(f, F.col("mx_source").eqNullSafe(F.col("_s")) & (F.col("mx_cell") >= F.col("_lo")) & (F.col("mx_cell") < F.col("_hi"))).drop("_s")


def _ends_in(rows: DataFrame, step: int) -> DataFrame:
    """For each source, the run of step cells in which the remaining budget ends, with what comes before it."""
    cells = rows.groupBy("mx_source", "_rest", "_before", F.floor(F.col("mx_cell") / step).alias("_c")).agg(F.sum("mx_size").alias("_n"))
    w = Window.partitionBy("mx_source").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_sum", F.col("_before") + F.sum("_n").over(w))
    ends = cells.where((F.col("_sum") > F.col("_rest")) & (F.col("_sum") - F.col("_n") <= F.col("_rest")))
    return cut(ends.select("mx_source", "_rest", (F.col("_c") * step).cast("int").alias("_lo"), ((F.col("_c") + 1) * step).cast("int").alias("_hi"), (F.col("_sum") - F.col("_n")).alias("_before")))


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(mx_id, mx_quality) from labelled documents; of several labels of one document the mean counts."""
    q = F.avg(F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad))
    return labels.groupBy(F.col("doc_id").alias("mx_id")).agg(q.alias("mx_quality")).where("mx_id is not null and mx_quality is not null")


def repeat(mixed: DataFrame) -> DataFrame:
    """The rows of mix()'s result, each as often as the mix takes it."""
    return mixed.where("mx_copies > 0").select("mx_row", F.explode(F.sequence(F.lit(1), F.col("mx_copies")))).select("mx_row.*")
