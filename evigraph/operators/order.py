"""Ranks and running totals over a whole table, without a task that sees all of it.

Rows are range-partitioned, sorted and written; a row's total is what its own
file holds before it, plus the totals of the files before.  Only one row a file
is windowed in one task.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.sources.state import cut


def totals_before(rows: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all rows that come earlier in this (total) order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = cut(laid, "order").withColumn("_file", F.shiftright("_at", 33))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = laid.groupBy("_file").agg(F.sum(value).alias("_v")).select("_file", F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_v"))
    inside = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = laid.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(files, "_file").select(*rows.columns, (F.col("_v") + F.col("_own")).alias(name))


def with_rank(rows: DataFrame, by: Column, name: str = "rank") -> DataFrame:
    """Adds the rank by an ascending expression, ties sharing the smallest: different values are counted, ranked and joined back."""
    # written: a sum that is worked out twice may end otherwise in its last place, and its row would be lost
    keyed = cut(rows.withColumn("_by", by), "keyed")
    counts = keyed.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"))
    ranked = totals_before(counts, ["_by"], "_n", "_before").select("_by", (F.col("_before") + 1).cast("long").alias(name))
    return keyed.join(ranked, "_by").drop("_by")


ACCURACY = 100_000
FEW = 8


def quantiles_of_counts(counted: DataFrame, qs: list[float]) -> DataFrame:
    """One row (q, n): as ``quantiles``, of values x that occur m times; they are counted in range order, so no task sees all of them."""
    n = counted.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    place = F.transform(F.array(*[F.lit(q) for q in qs]), lambda q: q * (F.col("n") - 1))
    n = n.select("n", place.alias("place"), F.array_distinct(F.concat(F.transform(place, lambda p: F.floor(p)), F.transform(place, lambda p: F.ceil(p)))).alias("ranks"))
    ranked = totals_before(counted, ["x"], "m").join(F.broadcast(n))  # one row
    hit = ranked.select("x", F.explode(F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))).alias("rank"))
    found = hit.agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two ranks a quantile at most

    def between(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(F.col("n") > 0, low + (high - low) * (p - F.floor(p)))

    return n.join(F.broadcast(found)).select(F.transform("place", between).alias("q"), "n")


def quantiles(values: DataFrame, value: Column, qs: list[float]) -> DataFrame:
    """One row (q, n): exact, linearly interpolated quantiles, and the number of values that aren't null.

    A summary of bounded size brackets each quantile within 2 / ACCURACY of the
    rows; the values below a bracket are counted, and only the different values
    inside the brackets come together.  Many quantiles are picked from running
    counts of all different values instead.
    """
    # one column, written: what it is made of runs once, however often it is read below
    x = cut(values.select(value.cast("double").alias("x")).where("x IS NOT NULL"), "values")
    if len(qs) > FEW:
        return quantiles_of_counts(x.groupBy("x").agg(F.count(F.lit(1)).alias("m")), qs)
    ends = [min(1.0, max(0.0, q + side * 2 / ACCURACY)) for q in qs for side in (-1, 1)]
    # fetched, one row: a summary depends on the order in which its parts arrive, so one that is worked out twice gives two brackets
    rough = x.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("ends")).first()
    n = rough["n"]
    if n == 0:
        return x.sparkSession.createDataFrame([([None] * len(qs), 0)], "q array<double>, n long")
    low, high = rough["ends"][::2], rough["ends"][1::2]
    each = lambda f: F.array(*[f(i) for i in range(len(qs))])
    seen = x.agg(each(lambda i: F.count_if(F.col("x") < F.lit(low[i]))).alias("below"), each(lambda i: F.count_if(F.col("x") <= F.lit(high[i]))).alias("upto")).first()
    places = [q * (n - 1) for q in qs]
    if any(math.floor(at) < below or math.ceil(at) >= upto for at, below, upto in zip(places, seen["below"], seen["upto"], strict=True)):
        # the summary was off by more than it says
        return quantiles_of_counts(x.groupBy("x").agg(F.count(F.lit(1)).alias("m")), qs)
    inside = functools.reduce(lambda a, b: a | b, [F.col("x").between(F.lit(low[i]), F.lit(high[i])) for i in range(len(qs))])
    held = x.where(inside).groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    row = held.agg(F.array_sort(F.collect_list(F.struct("x", "m"))).alias("held"))

    def at(rank: int, i: int) -> Column:
        entries = F.filter("held", lambda e: e["x"].between(F.lit(low[i]), F.lit(high[i])))
        start = F.struct(F.lit(seen["below"][i]).cast("long").alias("seen"), F.lit(None).cast("double").alias("hit"))
        step = lambda acc, e: F.struct((acc["seen"] + e["m"]).alias("seen"), F.coalesce(acc["hit"], F.when(acc["seen"] + e["m"] > rank, e["x"])).alias("hit"))
        return F.aggregate(entries, start, step)["hit"]

    out = []
    for i, place in enumerate(places):
        one, two = at(math.floor(place), i), at(math.ceil(place), i)
        out.append(one + (two - one) * F.lit(place - math.floor(place)))
    return row.select(F.array(*out).alias("q"), F.lit(n).cast("long").alias("n"))


def grouped_quantiles(values: DataFrame, keys: list[str], value: Column, qs: list[float]) -> DataFrame:
    """(keys..., q, n): exact, linearly interpolated quantiles of every group, for all groups in one ordered pass.

    Different values of all groups are counted and lie in one range order, groups
    one after the other; running counts less those before the group are ranks in it.
    A group may be of any size: it is spread over as many ranges as it fills.
    """
    counted = values.select(*keys, value.cast("double").alias("x")).where("x IS NOT NULL").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("m"))
    ranked = cut(totals_before(counted, [*keys, "x"], "m"), "ranked")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    sizes = ranked.groupBy(*keys).agg(F.sum("m").alias("n"), F.min("before").alias("first"))
    places = sizes.withColumn("place", F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q: q * (F.col("n") - 1)))
    on = same("r", "p")
    met = ranked.alias("r").join(places.alias("p"), functools.reduce(lambda a, b: a & b, on))
    low = F.col("r.before") - F.col("p.first")
    ranks = F.array_distinct(F.concat(F.transform("p.place", lambda p: F.floor(p)), F.transform("p.place", lambda p: F.ceil(p))))
    inside = F.filter(ranks, lambda r: (r >= low) & (r < low + F.col("r.m")))
    hit = met.select(*[F.col(f"p.{k}").alias(k) for k in keys], "p.place", "p.n", "r.x", F.explode(inside).alias("rank"))
    # two ranks a quantile at most
    found = hit.groupBy(*keys).agg(F.first("place").alias("place"), F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def between(p: Column) -> Column:
        below, above = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return below + (above - below) * (p - F.floor(p))

    return found.select(*keys, F.transform("place", between).alias("q"), "n")
