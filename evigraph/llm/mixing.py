"""Mixing sources to target weights.

Rows get hash-random keys, are range-sorted by key within their source, and a
distributed prefix sum of token counts says where each source's budget ends.
All of it is DataFrame functions; no source is ever brought into one task: the
leading digits of the key, as many as the rows ask for, are range buckets,
windows run inside (source, bucket), and prefix sums over the buckets' totals are
distributed too.

Budgets.  Sources are ordered by code point with null last and have the weights
of ``WEIGHTS`` in turn.  They share ``share`` times the sum of all sizes by
weight; no target exceeds ``most`` times its source's size, the excess is
shared again by weight among the others.  That fixed point is
``min(most * size, level * weight)`` with one level for all, found from prefix
sums over the sources ordered by ``size / weight`` (no iteration).

A budget of e whole epochs and a rest takes every row e times and, once more,
the rows in key order up to the rest, the last one in part.

Defined cases: null or empty text has size 0, and rows of size 0 take nothing; very
long texts count whole and may be taken in part; a null source is a source of its
own; rows equal in key, size and text are interchangeable; an empty table gives an empty result; extra columns are carried
along, whatever their names (those of ``OWN`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import bucket_digits, carried, own_names, sums_before, word_count

WEIGHTS = (3, 1, 2)
OWN = ("size", "source_size", "target", "taken", "copies")


def mix_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> adds ``target``.  One row a source: a grouped table."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_w", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_at", F.col("_cap") / F.col("_w"))
    below = Window.orderBy("_at", F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_capped", F.sum("_cap").over(below))
        .withColumn("_left", F.sum("_w").over(everything) - F.sum("_w").over(below))
        # the level if exactly the sources up to here are capped
        .withColumn("_level", F.when(F.col("_left") > 0.5, (F.col("_all") - F.col("_capped")) / F.col("_left")))
    )
    # a source is capped while, with all before it capped, the level would still reach its own cap
    before = Window.orderBy("_at", F.col("source").isNull(), F.col("source"))
    rows = rows.withColumn("_reached", F.coalesce(F.lag("_level").over(before), F.col("_all") / F.sum("_w").over(everything)))
    rows = rows.withColumn("_is_capped", F.col("_reached") >= F.col("_at"))
    # of the sources that stay open the first has the highest level; capping more only lowers it
    rows = rows.withColumn("_water", F.max(F.when(~F.col("_is_capped"), F.col("_reached"))).over(everything))
    target = F.when(F.col("_is_capped"), F.col("_cap")).otherwise(F.col("_water") * F.col("_w"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
    size: Column | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Adds size (the words of the text if not given), source_size, target, taken (words) and copies (how often a row is begun)."""
    kept = carried(docs, *OWN)
    sized = docs.select(*kept, (word_count(F.col(text)) if size is None else size.cast("long")).alias("size"))
    # null sources get a key of their own, so that windows and join deal the rows out alike (one shuffle)
    s, none, bucket, digest, tie, upto = own_names(sized, "s", "none", "bucket", "digest", "tie", "upto")
    rows = (
        sized.withColumn(s, F.coalesce(F.col(source), F.lit("")))
        .withColumn(none, F.col(source).isNull())
        .withColumn(digest, mix_key(F.col(key), seed))
        .withColumn(bucket, F.substring(digest, 1, bucket_digits(docs.count())))
        # rows of one key and size may have different texts
        .withColumn(tie, F.xxhash64(text))
    )
    place = [s, none, bucket]
    totals = rows.groupBy(F.col(s).alias("s"), F.col(none).alias("none"), F.col(bucket).alias("bucket")).agg(F.sum("size").alias("total"))
    sizes = totals.groupBy("s", "none").agg(F.sum("total").alias("source_size"))
    goals = targets(sizes.select(F.when(~F.col("none"), F.col("s")).alias("source"), "source_size"), weights, share, most)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target")
    plan = sums_before(totals, ["s", "none"], "bucket", {"total": "ahead"}).join(goals, ["s", "none"])
    plan = plan.select(F.struct("ahead", "source_size", "target").alias("plan"), *[F.col(x).alias(y) for x, y in zip(("s", "none", "bucket"), place, strict=True)])
    own_plan = own_names(rows.withColumn(upto, F.lit(0)), "plan")[0]
    plan = plan.withColumnRenamed("plan", own_plan)
    within = Window.partitionBy(*place).orderBy(digest, F.col(key), "size", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn(upto, F.sum("size").over(within)).join(plan, place)
    source_size, target, ahead = (F.col(own_plan)[c] for c in ("source_size", "target", "ahead"))
    budget = F.floor(target).cast("long")
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("long")
    rest = budget - epochs * source_size
    start = ahead + F.col(upto) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return joined.select(
        *kept,
        "size",
        source_size.alias("source_size"),
        target.alias("target"),
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        (epochs + (part > 0).cast("long")).alias("copies"),
    )


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: these columns of each row as often as it is begun, whole each time."""
    copy = own_names(mixed, "copy")[0]
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy)).drop(copy)
