"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Everything is DataFrame functions.  Row numbers are global and depend on the
rows alone, not on how they lie in partitions: rows are ordered by a digest of
their key, the first digits of the digest are range buckets, a window numbers
the rows inside a bucket, and prefix sums over the bucket counts give each
bucket's first number.  The number of digits follows the number of rows, so a
bucket stays small; the prefix sums are distributed.

The permutation is an unbalanced Feistel network on Z_a x Z_b with
a = ceil(sqrt(n)) and b = ceil(n / a), so that fewer than a values lie outside
[0, n); a value that falls outside is encrypted again until it is inside
(cycle walking).  ``shard = permuted mod shards`` and ``slot = permuted div
shards``: shard sizes differ by one row at most and slots have no gaps, and
both can be computed for any row number without looking at the data.

Defined cases: null text has no bytes (size 16) and a null checksum; a null key
is like an empty one; rows equal in key and text are interchangeable and each has
its own number; a text's length doesn't matter; an empty table gives an empty
result; further columns are carried along, whatever their names (``row_number``,
``shard`` and ``slot`` of the input, if present, are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import bucket_digits, carried, own_names, sums_before

ROUNDS = 6
MAX_WALK = 24


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def row_digest(key: Column, text: Column) -> Column:
    """Digest that orders the rows: of key and text, so that only whole copies tie."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def with_row_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Adds ``row_number`` (0..n-1) and returns n.

    One pass counts rows by bucket (map-side combined); one shuffle brings each
    bucket together.  Both passes derive the bucket from the row itself, so a
    task that is run again gives the same numbers.
    """
    n = docs.count()
    digest, bucket, number = own_names(docs, "digest", "bucket", "in_bucket")
    rows = docs.withColumn(digest, row_digest(F.col(key), F.col(text))).withColumn(bucket, F.substring(digest, 1, bucket_digits(n)))
    counts = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    first = sums_before(counts, [], "bucket", {"n": "first"}).select(F.col("bucket").alias(bucket), F.col("first").alias(number))
    order = Window.partitionBy(bucket).orderBy(digest, F.col(key))
    kept = carried(docs, "row_number")
    numbered = rows.select(*kept, bucket, (F.row_number().over(order) - 1).alias("row_number"))
    return numbered.join(first, bucket).select(*kept, (F.col(number) + F.col("row_number")).cast("long").alias("row_number")), n


def round_value(value: Column, round_key: Column, modulus: Column) -> Column:
    digest = F.md5(F.concat(value.cast("string"), F.lit("#"), round_key))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(number: Column, n: int, seed: int) -> Column:
    """Permutes [0, n); raises rather than return a value outside."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = F.array(*[
        F.struct(F.lit(f"{seed}/{i}").alias("key"), F.lit(a if i % 2 == 0 else b).cast("long").alias("m")) for i in range(ROUNDS)
    ])

    def once(value: Column) -> Column:
        halves = F.struct((value % F.lit(a)).alias("l"), F.floor(value / F.lit(a)).cast("long").alias("r"))
        # (l, r) -> (r, l + f(r)); the halves change places, so the modulus alternates between a and b
        done = F.aggregate(
            keys,
            halves,
            lambda acc, k: F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + round_value(acc["r"], k["key"], k["m"]), k["m"]).alias("r")),
        )
        return F.transform(F.array(done), lambda h: h["l"] + h["r"] * F.lit(a).cast("long"))[0]

    inside = F.lit(n).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(MAX_WALK)), once(number), lambda v, _: F.when(v < inside, v).otherwise(once(v))
    )
    return F.transform(
        F.array(walked), lambda v: F.when(v < inside, v).otherwise(F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long"))
    )[0]


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``row_number``, ``shard`` and ``slot`` to every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = carried(docs, "row_number", "shard", "slot")
    numbered, n = with_row_numbers(docs.select(*kept), key, text)
    place = own_names(numbered, "place")[0]
    return numbered.withColumn(place, feistel(F.col("row_number"), max(n, 1), seed)).select(
        *kept,
        "row_number",
        (F.col(place) % shards).cast("int").alias("shard"),
        F.floor(F.col(place) / shards).cast("long").alias("slot"),
    )
