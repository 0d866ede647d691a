"""Counts, percentiles, quality measures and drift. Everything aggregates partially before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values of a group are cut into so many ranges, each ranked by itself.
RANGES = 64


def at_places(df: DataFrame, group: str, column: str, places: Column) -> DataFrame:
    """(group, n, place, value): the values at some places (an array of longs made from `n`, from 0) of each group's ascending values.

    Values are counted first, then cut into ranges at approximate quantiles; running counts over the ranges tell which
    of them hold a place, and only those are ranked. No group is held by one task, and the result is exact.
    """
    c = df.where(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    cuts = c.groupBy(group).agg(F.percentile_approx("v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 1000).alias("cuts"), F.sum("c").alias("n"))
    x = c.join(cuts, group).withColumn("range", F.size(F.filter("cuts", lambda y: y < F.col("v")))).drop("cuts")
    r = x.groupBy(group, "range", "n").agg(F.sum("c").alias("held"))
    r = r.withColumn("before", F.sum("held").over(Window.partitionBy(group).orderBy("range")) - F.col("held"))  # RANGES rows a group
    r = r.select(group, "range", "before", "held", F.explode(F.array_distinct(places)).alias("place")).where("place >= before and place < before + held")
    inside = Window.partitionBy(group, "range").orderBy("v")
    y = x.join(r.select(group, "range").distinct(), [group, "range"]).withColumn("upto", F.sum("c").over(inside))
    y = y.join(r, [group, "range"]).where(F.col("before") + F.col("upto") > F.col("place"))
    return y.groupBy(group, "n", "place").agg(F.min("v").alias("value"))


def percentiles(df: DataFrame, columns: list[str], qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row per column: count, mean and linearly interpolated percentiles of its numbers; nulls don't count."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").where("v is not null")
    spot = lambda q: F.lit(q) * (F.col("n") - 1)
    places = F.array(*[f for q in qs for f in (F.floor(spot(q)), F.ceil(spot(q)))])
    at = at_places(stacked, "metric", "v", places).groupBy("metric", "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    mean = stacked.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"))

    def value(q: float) -> Column:
        low, high = F.element_at("m", F.floor(spot(q))), F.element_at("m", F.ceil(spot(q)))
        return F.round(low + (high - low) * (spot(q) - F.floor(spot(q))), 6)

    return at.join(mean, "metric").select("metric", "n", "mean", *[value(q).alias(f"p{int(q * 100)}") for q in qs])


def nearest_rank(df: DataFrame, group: str, column: str, q: float) -> DataFrame:
    """The value at place int(n * q) of each group's ascending values."""
    at = at_places(df, group, column, F.array(F.least(F.floor(F.col("n") * q), F.col("n") - 1)))
    return at.select(group, "value", "n")


def histogram(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at or below each bound (and at no bound, the total)."""
    sums = [F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.agg(*sums, F.count(column).alias("total"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n"))]
    return one.select(F.explode(F.array(*rows)).alias("h")).select("h.*")


def classification(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 (0 where undefined); rows with a null don't count."""
    c = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    side = c.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("t"), F.lit(0).alias("g")), F.struct(F.col("g").alias("label"), F.lit(0).alias("t"), F.col("n").alias("g")))).alias("s"), F.expr("if(t = g, n, 0)").alias("hit"))
    per = side.groupBy("s.label").agg(F.sum("s.t").alias("t"), F.sum("s.g").alias("g"), (F.sum("hit") / 2).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "g"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "t"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return per.agg(F.count("*").alias("n_labels"), F.sum("t").cast("long").alias("n"), F.round(F.sum("hit") / F.sum("t"), 6).alias("accuracy"), F.round(F.avg(p), 6).alias("macro_precision"), F.round(F.avg(r), 6).alias("macro_recall"), F.round(F.avg(f), 6).alias("macro_f1"))


def stability(df: DataFrame, category: str, current: Column) -> DataFrame:
    """Population stability index of a category between reference and current rows; half a row stands for none."""
    g = df.where(current.isNotNull()).groupBy(F.coalesce(F.col(category), F.lit("")).alias("category")).agg(F.count_if(current).alias("cur"), F.count_if(~current).alias("ref"))
    t = g.agg(F.sum("cur").alias("ct"), F.sum("ref").alias("rt"))
    a, b = F.greatest("cur", F.lit(0.5)) / F.col("ct"), F.greatest("ref", F.lit(0.5)) / F.col("rt")
    return g.join(F.broadcast(t)).select("category", "cur", "ref", F.round((a - b) * F.log(a / b), 6).alias("psi"))  # t is one row
