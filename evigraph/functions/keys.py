"""Identifiers, labels and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_TEXTS = ("true", "1", "yes")


def truthy(text: Column) -> Column:
    """Text booleans; a missing one is false, and so is '1.0'."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def pair_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends in order: without case first, then exact."""
    first = F.struct(F.lower(a), a) <= F.struct(F.lower(b), b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Trims the ends, drops pairs with an empty or equal end, and orders them."""
    rows = pairs.withColumn(a, F.trim(a)).withColumn(b, F.trim(b)).where((F.col(a) != "") & (F.col(b) != "") & (F.col(a) != F.col(b)))
    low, high = pair_ends(F.col(a), F.col(b))
    return rows.withColumns({a: low, b: high})


def ordered_ends(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def labels(text: Column, sep: str = ";") -> Column:
    """Multi-label text as an array of trimmed, non-empty labels."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def joined_set(values: Column, sep: str = ";") -> Column:
    """Aggregate: the different values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


def tidy(text: Column) -> Column:
    """White space collapsed, '.0' at the end dropped, '; ' as ';'."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\.0$", ""), r"\s*;\s*", ";")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: empty if the key is unique."""
    return df.groupBy(*keys).count().where("count > 1")


def left_join(left: DataFrame, right: DataFrame, *on: str, one_to_one: bool = False) -> DataFrame:
    """Left join whose right keys must be unique, and the left ones too if ``one_to_one``; a key that isn't stops it."""
    for side, df in (("right", right), ("left", left))[: 1 + one_to_one]:
        if not duplicates(df, *on).isEmpty():
            raise ValueError(f"the {side} table holds a key more than once")
    return left.join(right, list(on), "left")


def close_names(names: DataFrame, wanted: str, column: str, most: int = 5, least_ratio: float = 0.45) -> DataFrame:
    """Nearest names by edit distance, as a share of the longer name."""
    ratio = 1 - F.levenshtein(F.lower(F.col(column)), F.lit(wanted.lower())) / F.greatest(F.length(column), F.lit(len(wanted)))
    return names.select(column, ratio.alias("ratio")).where(F.col("ratio") >= least_ratio).orderBy(F.desc("ratio"), column).limit(most)
