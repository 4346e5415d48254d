"""Identifier mapping: ordered fall-backs, ambiguity, one-to-one relations, windows on sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(rows: DataFrame, key: str, steps: list[tuple[Column, DataFrame]], found: str = "mapped") -> DataFrame:
    """Tries lookups (name, target) in order; the first that knows the row's name counts.

    One row a key comes back, with the step's number, or nulls.  A step that
    knows several targets for a name is ambiguous and maps nothing.
    """
    hits = None
    for number, (name, lookup) in enumerate(steps):
        table = lookup.toDF("_name", "_target")
        got = rows.select(F.col(key), name.alias("_name")).join(table, "_name").groupBy(key).agg(F.min("_target").alias(found), F.count_distinct("_target").alias("_n"))
        got = got.select(key, F.lit(number).alias("step"), found, "_n")
        hits = got if hits is None else hits.unionByName(got)
    best = hits.groupBy(key).agg(F.min_by(F.struct("step", found, "_n"), "step").alias("_h"))
    best = best.select(key, F.col("_h.step").alias("step"), F.when(F.col("_h._n") == 1, F.col(f"_h.{found}")).alias(found), (F.col("_h._n") > 1).alias("ambiguous"))
    return rows.join(best, key, "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def one_to_one(relation: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose ends have each other only."""
    r = relation.select(a, b).distinct()
    single = lambda x: r.groupBy(x).count().where("count = 1").select(x)
    return r.join(single(a), a, "left_semi").join(single(b), b, "left_semi")


def tiers(records: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """A if any record is A, else B, else ambiguous only; with different sources and methods counted."""
    rows = records.withColumn("_t", tier)
    best = F.when(F.bool_or(F.col("_t") == "A"), "A").when(F.bool_or(F.col("_t") == "B"), "B").otherwise("ambiguous_only")
    return rows.groupBy(*keys).agg(best.alias("tier"), F.count(F.lit(1)).alias("records"), F.count_distinct("method").alias("methods"))


def composition(rows: DataFrame, label_array: Column, group: str) -> DataFrame:
    """Multi-label counts in each group, and their share of the group's rows."""
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    counted = rows.select(group, F.explode(F.array_distinct(label_array)).alias("label")).groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(total, group).select(group, "label", "n", (100 * F.col("n") / F.col("rows")).alias("percent"))


def windows_of(text: Column, size: int) -> Column:
    """All windows of a sequence: array<struct<at, window>>."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(size)).alias("window")))


def target_sites(text: Column, flank: int, residues: str, letters: str) -> Column:
    """Sites of one sequence: array<struct<at, residue, window>> with a residue asked for in the middle and known letters only."""
    size = 2 * flank + 1
    good = lambda w: F.rlike(w["window"], F.lit(f"^[{letters}]{{{flank}}}[{residues}][{letters}]{{{flank}}}$"))
    site = lambda w: F.struct((w["at"] + flank).alias("at"), F.substring(w["window"], flank + 1, 1).alias("residue"), w["window"].alias("window"))
    return F.transform(F.filter(windows_of(text, size), good), site)


def weight_scores(windows: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """Position-weight sums: (key, window) against (model, letter, pos, weight); windows that occur often are scored once."""
    different = windows.select("window").distinct()
    letters = different.select("window", F.posexplode(F.split("window", "")).alias("pos", "letter")).where("letter != ''")
    scored = letters.join(F.broadcast(weights), ["letter", "pos"], "left").where(F.col("model").isNotNull())  # a model set has a fixed size
    sums = scored.groupBy("window", "model").agg(F.sum("weight").alias("score"))
    return windows.join(sums, "window").select(*key, "window", "model", "score")


def top_per_group(rows: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def melt(rows: DataFrame, ids: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, columns, name, value)


def batching(n_items: Column, sizes: list[int], workers: list[int]) -> Column:
    """array<struct<batch, workers, rounds>> of all scenarios."""
    return F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(w).alias("workers"), F.ceil(F.ceil(n_items / b) / w).cast("long").alias("rounds")) for b in sizes for w in workers])
