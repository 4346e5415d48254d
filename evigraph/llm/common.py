"""Helpers shared by the training-data operators.

Tables that cut lineage go to the folder named by ``spark.checkpoint.dir``,
which the driver and all executors share.  Only where that setting is absent and
the master is local (tests) a folder of our own is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the word rule, as the body of a character class.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts, from the session; a local one only if none is set."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="evigraph-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evigraph-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing lazy refers to any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Tables that an operator writes on its way, to be removed once nothing lazy refers to them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialize_at(df, name)
        self.paths.setdefault(name, []).append(path)
        return out

    def remove(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, ()):
                remove(self.spark, path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def carried(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns that an operator carries along: all but those that it replaces, whatever their names hold."""
    gone = {name.lower() for name in replaced}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no input column has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


BUCKET_ROWS = 50_000
COARSE = 3


def bucket_digits(rows: int) -> int:
    """Hex digits of a digest that make range buckets of BUCKET_ROWS rows or less; they change no result."""
    digits = COARSE
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def sums_before(totals: DataFrame, groups: list[str], bucket: str, values: dict[str, str]) -> DataFrame:
    """Adds, for each value, its sum over the group's buckets before this one.

    In two levels: inside the buckets that share their first digits, and over
    those digits, of which a group has 16 ** COARSE at most.
    """
    coarse = F.substring(bucket, 1, COARSE).alias("coarse")
    level = totals.groupBy(*groups, coarse).agg(*[F.sum(v).alias(v) for v in values])
    ahead = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda v, window: F.coalesce(F.sum(v).over(window), F.lit(0))
    level = level.select(*groups, "coarse", *[before(v, ahead(*groups).orderBy("coarse")).alias(f"before_{v}") for v in values])
    inside = totals.withColumn("coarse", coarse)
    inside = inside.select("*", *[before(v, ahead(*groups, "coarse").orderBy(bucket)).alias(f"inside_{v}") for v in values])
    joined = inside.join(level, [*groups, "coarse"])
    return joined.select(*totals.columns, *[(F.col(f"inside_{v}") + F.col(f"before_{v}")).cast("long").alias(name) for v, name in values.items()])
